"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed (logarithms of sizes, log-odds of shares) to be
nearer to normal.  Class means and covariances come from sums over all labelled training rows,
added up by Spark; covariances are shrunk towards a multiple of the identity by the
oracle-approximating rule, their Cholesky factors are kept in the model, and a score is the
logistic of the difference of the two classes' log densities (Mahalanobis distance and
determinant) and log priors.

Cases: null text counts as empty and gets a score like any text; a text of any length is read
whole; repeated documents get equal scores; labels that are null or without a document don't
count, repeated labels count each time; without rows of both classes the score is the share of
label 1 (0.5 without any label); empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts_of

STATISTICS = ("words", "word_length", "line_length", "letters", "upper", "digits", "marks", "symbols", "other_bytes", "variety", "top_word", "repeats", "line_copies", "entropy")
THRESHOLD = 0.7
#: Least share of the identity in a covariance.
FLOOR = 0.02

_UPPER, _LOWER, _DIGIT, _BLANK, _MARK, _HIGH, _SYMBOL = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = _MARK


#: Pseudo-counts that draw the statistics of short texts to ordinary values: words, bytes, lines.
FEW_WORDS, FEW_BYTES, FEW_LINES = 30, 150, 3


def _odds(count: np.ndarray, of: np.ndarray, usual: float, few: float) -> np.ndarray:
    """Log-odds of ``count`` among ``of`` after ``few`` more with the ``usual`` share."""
    return np.log((count + usual * few) / (of - count + (1 - usual) * few))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)) * 256, size)
    bytes_ = np.bincount(owner + data, minlength=256 * len(texts)).reshape(len(texts), 256).astype(float)
    kinds = np.stack([bytes_[:, _CLASS == k].sum(1) for k in range(7)], 1)
    n = np.maximum(size, 1).astype(float)
    share = bytes_ / n[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    words, distinct, top, again, lines, copies = np.zeros((6, len(texts)))
    for k, t in enumerate(texts):
        w = t.split()
        seen = Counter(w)
        words[k], distinct[k], top[k] = len(w), len(seen), max(seen.values(), default=0)
        again[k] = sum(map(bytes.__eq__, w, w[1:]))
        ls = [x for x in t.split(b"\n") if x.strip()]
        lines[k], copies[k] = len(ls), len(ls) - len(set(ls))
    ink = size - kinds[:, _BLANK]
    return np.stack(
        [
            np.log(np.maximum(words, 2 * FEW_WORDS)),
            np.log((ink + 5 * FEW_WORDS) / (words + FEW_WORDS)),
            np.log((size + 200 * FEW_LINES) / (lines + FEW_LINES)),
            _odds(kinds[:, _UPPER] + kinds[:, _LOWER], ink, 0.95, FEW_BYTES),
            _odds(kinds[:, _UPPER], ink, 0.03, FEW_BYTES),
            _odds(kinds[:, _DIGIT], ink, 0.003, FEW_BYTES),
            _odds(kinds[:, _MARK], ink, 0.03, FEW_BYTES),
            _odds(kinds[:, _SYMBOL], ink, 0.003, FEW_BYTES),
            _odds(kinds[:, _HIGH], ink, 0.02, FEW_BYTES),
            np.log(distinct + FEW_WORDS) / np.log(words + FEW_WORDS),
            _odds(top, words, 0.06, FEW_WORDS),
            _odds(again, words, 0.01, FEW_WORDS),
            _odds(copies, lines, 0.02, FEW_LINES),
            (size * entropy + FEW_BYTES * 4.2) / (size + FEW_BYTES),
        ],
        1,
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, x0 ... ), one column for each of STATISTICS."""
    names = [f"x{i}" for i in range(len(STATISTICS))]

    def run(batches):
        for batch in slices(batches):
            x = statistics(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))


@dataclass(frozen=True)
class Quadratic:
    """Two classes: log priors, means, inverse Cholesky factors and log determinants."""

    share: float
    scale: tuple | None = None
    classes: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        mean, spread = self.scale
        z = (x - mean) / spread
        density = [prior - 0.5 * (((z - mu) @ inverse.T) ** 2).sum(1) - half_log_det for prior, mu, inverse, half_log_det in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def shrunk(covariance: np.ndarray, n: int) -> np.ndarray:
    """Covariance drawn towards a multiple of the identity by the oracle-approximating share."""
    p = len(covariance)
    level, square = np.trace(covariance) / p, float((covariance**2).sum())
    up = (1 - 2 / p) * square + (level * p) ** 2
    down = (n + 1 - 2 / p) * (square - p * level**2)
    share = min(1.0, max(FLOOR, up / down)) if down > 0 else 1.0
    return (1 - share) * covariance + share * max(level, 1e-6) * np.eye(p)


def fit(rows: DataFrame) -> Quadratic:
    """Model of rows (label 0 or 1, x0 ...): class sums and products are added up by Spark."""
    p = len(STATISTICS)
    xs = [F.col(f"x{i}") for i in range(p)]
    sums = [F.sum(x) for x in xs] + [F.sum(xs[i] * xs[j]) for i in range(p) for j in range(i, p)]
    found = {r[0]: (r[1], np.array(r[2:], float)) for r in rows.groupBy("label").agg(F.count(F.lit(1)), *sums).collect()}
    total = sum(n for n, _ in found.values())
    if not all(found.get(k, (0,))[0] > 1 for k in (0, 1)):
        return Quadratic(found[1][0] / total if total and 1 in found else 0.0 if total else 0.5)

    def moments(n, s):
        square = np.zeros((p, p))
        square[np.triu_indices(p)] = s[p:] / n
        square = square + np.triu(square, 1).T
        return s[:p] / n, square - np.outer(s[:p] / n, s[:p] / n)

    mean, covariance = moments(total, found[0][1] + found[1][1])
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    classes = []
    for k in (0, 1):
        n, s = found[k]
        mu, own = moments(n, s)
        factor = np.linalg.cholesky(shrunk(own / np.outer(spread, spread), n))
        classes.append((float(np.log(n / total)), (mu - mean) / spread, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Quadratic(found[1][0] / total, (mean, spread), tuple(classes))


def predict(rows: DataFrame, model: Quadratic, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, x0 ...) -> (doc_id, score, predicted)."""

    def run(batches):
        for batch in batches:
            score = model.score(np.stack([batch.column(f"x{i}").to_numpy() for i in range(len(STATISTICS))], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; held-out labels are never learnt."""
    rows = stored(document_statistics(documents), "quality-statistics")
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.join(known, "doc_id"))
    return predict(rows, model).withColumn("held_out", held_out())
