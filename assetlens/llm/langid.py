"""Language identification in two levels: the family first, then the language within it.

Features are hashed counts of byte 1- to 4-grams of the whole text (lower-cased, everything that
isn't a letter a single space), damped and scaled to length one.  One-versus-rest linear support
vector machines tell the family; within a family, a linear support vector machine for each pair of
its languages votes, margins breaking ties.

The models are fitted on at most ``SAMPLE_PER_LANGUAGE`` distinct labelled texts of each language,
those of least hash, and ``SAMPLE_TEXTS`` of all languages, shared alike; of these, counts alone
(not texts) reach the driver, in one job.  A text that fills a third of all rows counts once, and
every language that has a text is in the sample.  More than ``MAX_LANGUAGES`` values of ``lang``
are not languages (a column that holds something else): ``fit`` refuses them.

Cases: null text, or text without a letter, is ``und`` with score 0; a text of any length is read
whole; repeated documents get equal answers; with a single learnt language that one is predicted,
with none all is ``und``; languages outside FAMILIES are families of their own; an empty table
gives no rows; other document columns are carried along, except those named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import appended, mix64, only, slices, texts_of, widened

SAMPLE_PER_LANGUAGE = 600
#: Texts of the sample at most (16 KB each on the driver) and languages that are learnt at most.
SAMPLE_TEXTS, MAX_LANGUAGES = 20_000, 500
#: Texts whose counts are held at once.
ROWS = 512
#: Bytes whose n-grams are counted at once.
STRETCH = 1 << 21
BUCKETS = 1 << 12
UNKNOWN = "und"
#: Families of languages (fixed values).
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}

#: Lower-cases A-Z; digits, marks and blanks become a space; bytes of other letters stay.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def vectors(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Unit rows of damped n-gram counts, float32."""
    folded = [b" " + b" ".join(t.translate(_FOLD).split()) + b" " for t in texts]
    size = np.array([len(t) for t in folded], np.int64)
    data = np.frombuffer(b"".join(folded), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes up to the text's end
    counts = np.zeros(len(texts) * buckets)
    for at in range(0, len(data), STRETCH):  # bounds the memory of a very long text
        here = slice(at, at + STRETCH)
        gram = np.zeros(len(data[here]), np.uint64)
        for n in range(4):
            part = data[at + n : at + STRETCH + n]
            gram[: len(part)] |= part.astype(np.uint64) << np.uint64(8 * n)
            full = left[here] > n
            slot = (mix64(gram[full] + np.uint64((n + 1) << 40)) % np.uint64(buckets)).astype(np.int64)
            counts += np.bincount(owner[here][full] * buckets + slot, minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(texts), buckets)).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) of a squared-hinge support vector machine, classes weighed equally; all in float32."""
    x, y = np.hstack([x, np.ones((len(x), 1), np.float32)]), y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * len(y)
    step = 1 / (1 + 2 * c * float((weight[:, None] * x**2).sum()) / len(y))
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    for _ in range(rounds):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - 2 * c / len(y) * ((weight * slack * y) @ x))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (was - 1) / t * (new - w), new
    return w


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products row by row, summed alike wherever a row stands: equal texts get equal scores."""
    return (x * w).sum(1)


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # one row a family
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]  # positive: the first language

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        sure = np.ones(n)
        family = np.zeros(n, int)
        if len(self.families) > 1:
            margin = np.exp(4 * np.clip(np.stack([_dot(x, w) for w in self.family_weights], 1), -10, 10))
            family = margin.argmax(1)
            sure = margin.max(1) / margin.sum(1)
        out = np.empty(n, object)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            langs = self.members[name]
            votes = np.zeros((len(rows), len(langs)))
            margins = np.zeros_like(votes)
            for a, b in combinations(range(len(langs)), 2):
                m = _dot(x[rows], self.pairs[langs[a], langs[b]])
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                margins[:, a] += m
                margins[:, b] -= m
            best = (votes + 1e-3 * np.tanh(margins)).argmax(1)
            out[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                lead = margins[np.arange(len(rows)), best] / (len(langs) - 1)
                sure[rows] *= 1 / (1 + np.exp(-4 * np.clip(lead, -10, 10)))
        return out, np.clip(sure, 0, 1)


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """Learns from rows (text, lang) with letters; a bounded sample of each language is used."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = rows.select("lang", "text", draw.alias("draw"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02)).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return Model([], np.zeros((0, 0)), {}, {})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    per_language = min(per_language, max(1, SAMPLE_TEXTS // len(counts)))
    # A share of the hashes that leaves about twice the sample, then the least of these.
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * per_language / n))))
    picked = rows.filter(F.col("draw") <= share[F.col("lang")] * 2.0**63).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def features(batches):
        for batch in slices(batches, rows=ROWS):
            x = vectors(texts_of(batch.column("text")), buckets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "draw", "x"])

    # About twice the sample is left of each language, so the window is over few rows.
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "x"))
    drawn = picked.mapInArrow(features, "lang string, draw long, x binary").withColumn("place", place).filter(F.col("place") <= per_language)
    sample: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in drawn.select("lang", "place", "x").collect():
        sample[r["lang"]].append((r["place"], r["x"]))
    if empty := [lang for lang, got in sample.items() if not got]:
        raise ValueError(f"no text drawn for {empty}")
    data = {lang: np.stack([np.frombuffer(x, np.float16) for _, x in sorted(got)]).astype(np.float32) for lang, got in sample.items()}
    members: dict[str, list[str]] = {}
    for lang in data:
        members.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    families = sorted(members)
    every = np.concatenate([data[lang] for lang in data])
    owner = np.concatenate([np.full(len(x), families.index(FAMILIES.get(lang, lang))) for lang, x in data.items()])
    weights = [linear_svm(every, np.where(owner == k, 1.0, -1.0)) for k in range(len(families))] if len(families) > 1 else []
    pairs = {}
    for langs in members.values():
        for a, b in combinations(langs, 2):
            pairs[a, b] = linear_svm(np.concatenate([data[a], data[b]]), np.repeat([1.0, -1.0], [len(data[a]), len(data[b])]))
    return Model(families, np.array(weights, np.float32), members, pairs)


def identify(docs: DataFrame, model: Model, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with lang_pred and score; the text alone is looked at."""
    docs = only(docs, "lang_pred", "score")
    marked = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)

    def run(batches):
        for batch in slices(batches, rows=ROWS):
            lang, score = sent.value.predict(vectors(texts_of(batch.column("text")), buckets))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            lang[~letters], score[~letters] = UNKNOWN, 0.0
            score = np.where(lang == UNKNOWN, 0.0, score)
            yield appended(batch.drop_columns("_letters"), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    return marked.mapInArrow(run, widened(docs, "lang_pred string, score double"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame) -> Model:
    """Model of the documents that aren't held out."""
    return fit(documents.filter(~held_out()).select("text", "lang"))
