"""Each operator against a brute-force version, on cases: nulls, empty and long texts, ties,
repeated rows, empty tables and further columns whose names clash with results."""

import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import chat, decontam, jaccard, langid, linededup, media, mixing, quality, queries, secrets, tokenbin
from assetlens.llm.common import shared_dir

WORDS = "the of and to in is that was for it with as his on be at by an this had not are but from or have they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "Ünïcode ßtraße 日本語 ١٢٣  x y", "tab\tand  two  spaces \n new", prose(1, 3000), prose(1, 3000), "don't 'sreal it'll we've''s x's!'s", "%%% $$$ 12345 6.7e8"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 7, "clash") for i, t in enumerate(ODD)] + [(1, "", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_media_round_trip(spark, odd, empty):
    folder = shared_dir(spark, "m")
    manifest = media.write_archives(odd, folder, shard_bytes=4000)
    assert manifest.agg(F.sum("members")).first()[0] == len(ODD) + 1
    got = rows(media.media_digest(media.read_archives(spark, folder, rangeBytes="700")), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in [*enumerate(ODD), (1, "")]:
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    nothing = shared_dir(spark, "m")
    media.write_archives(empty, nothing)
    assert media.media_digest(media.read_archives(spark, nothing)).count() == 0


def test_media_members_are_retried_by_offset(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("0/1.png", b"abc" * 50)
        z.writestr("1/2.png", b"def" * 50)
    (tmp_path / "y.zip").write_bytes(path.read_bytes())
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})

    class Flaky:
        def __init__(self, fs):
            self.fs, self.failures = fs, 2

        def open_input_file(self, p):
            if self.failures:
                self.failures -= 1
                raise OSError("lost")
            return self.fs.open_input_file(p)

    import pyarrow.fs as pafs

    local = pafs.LocalFileSystem()
    info = zipfile.ZipFile(path).infolist()[1]
    assert reader.member(media._Archive(Flaky(local), str(path)), info) == (b"def" * 50, 3)
    assert reader.retried(media._Archive(Flaky(local), str(path)), "directory", lambda f: len(zipfile.ZipFile(f).infolist())) == (2, 3)
    assert len(reader.partitions()) == 1 and len(reader.partitions()[0].parts) == 2  # small archives share a partition
    cut = media.ArchiveReader({"path": f"file://{tmp_path}", "rangeBytes": "100"}).partitions()
    assert [hi - lo for p in cut for _, lo, hi in p.parts if hi - lo > 100] == [] and sum(b.num_rows for p in cut for b in reader.read(p)) == 4
    damaged = bytearray(path.read_bytes())
    damaged[info.header_offset + 40] ^= 1
    path.write_bytes(bytes(damaged))
    with pytest.raises(OSError, match="checksum"):
        reader.member(media._Archive(local, str(path)), info)


def masked_by_hand(line):
    return ["<*>" if re.search("[0-9@]|://", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line)]


def recurring_by_hand(docs):
    """The template tree, line by line: (n_lines, dropped) of each row."""
    places, first = defaultdict(list), {}
    for doc, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if doc is not None and (t := tuple(masked_by_hand(line))):
                places[t].append((doc, k))
    first = {t: min(p) for t, p in places.items()}
    root = {t: t for t in places}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    tree = defaultdict(list)
    for t in places:
        n = len(t)
        for b in range(n // 10 + 1):
            tree[n, t[:2], b, t[n * b // (n // 10 + 1) : n * (b + 1) // (n // 10 + 1)]].append(t)
    for members in tree.values():
        head = min(members, key=first.get)
        for t in members:
            if sum(x != y for x, y in zip(t, head)) <= len(t) // 10:
                a, b = sorted((find(t), find(head)), key=first.get)
                root[b] = a
    opened = defaultdict(list)
    for t in places:
        for i in range(2, len(t)) if len(t) >= 5 else ():
            opened[i, t[:i], t[i + 1 :]].append(t)
    for members in opened.values():
        for t in members:
            a, b = sorted((find(t), find(members[0])), key=first.get)
            root[b] = a
    joint = defaultdict(list)
    for t in places:
        joint[find(t)] += places[t]
    gone = {p for ps in joint.values() if len({d for d, _ in ps}) > 1 for p in ps if p != min(ps)}
    return sorted((str(doc), len((text or "").split("\n")), [k for k in range(len((text or "").split("\n"))) if (doc, k) in gone]) for doc, text in docs)


def test_line_templates(spark, odd, empty):
    long = "the quick brown fox jumps over the lazy dog and runs home to sleep until the cows come home again tonight".split()

    def varied(*at):
        return " ".join("other" if i in at else w for i, w in enumerate(long))

    docs = [
        (1, f"{varied()}\nonly here in this one document\nuser 17 logged in from host 10.0.0.1\n\n"),
        (2, f"{varied(7, 17)}\nuser 9 logged in from host http://x/y\nshort one"),  # two blocks vary
        (3, f"short  one\n{varied()}\n{varied()}\n{varied(1)}"),  # another leaf
        (4, None),
        (None, varied()),
        (5, varied(7, 8, 9)),  # too far
        (6, "yes"),
        (7, "yes\n"),
        (7, "yes\n"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("version", F.lit("clash")).withColumn("_dropped", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in linededup.recurring_lines(df).collect())
    assert got == recurring_by_hand(docs)
    assert ("2", 3, [0, 1]) in got and ("3", 4, [0, 1, 2]) in got and ("5", 1, []) in got and ("7", 2, [0]) in got
    texts = [(r["doc_id"], r["text"]) for r in linededup.drop_lines(df).collect()]
    assert (2, "short one") in texts and (3, varied(1)) in texts and (4, None) in texts and texts.count((7, "")) == 2
    assert linededup.drop_lines(df).columns == df.columns
    # C-A and A-B are alike, C-B are not: one template, whose first line alone stays.
    chain = [(1, varied(7, 8)), (2, varied(8)), (3, varied(8, 17))]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in linededup.recurring_lines(spark.createDataFrame(chain, "doc_id long, text string")).collect())
    assert got == recurring_by_hand(chain) == [("1", 1, []), ("2", 1, [0]), ("3", 1, [0])]
    # An unlike first line of the only common branch hides nothing, and short lines have an open token too.
    five = "alpha beta gamma delta eps "
    hidden = [(1, five + "one two three four five"), (2, five + "a b c d e"), (3, five + "a b c d f"), (4, "Posted by alice in news today"), (5, "Posted by bob in news today"), (6, "Posted by carol in news tonight"), (7, "by alice in it"), (8, "by alice in that")]
    got = {r["doc_id"]: r["dropped"] for r in linededup.recurring_lines(spark.createDataFrame(hidden, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [0], 4: [], 5: [0], 6: [], 7: [], 8: []}
    assert sorted((str(d), 1, x) for d, x in got.items()) == recurring_by_hand(hidden)
    r = random.Random(4)
    many = [(i, "\n".join(" ".join(w if r.random() > 0.05 else r.choice(WORDS) for w in prose(r.randint(0, 6), 3 + 9 * r.randint(0, 5)).split()) for _ in range(r.randint(0, 5)))) for i in range(120)]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["dropped"]) for r in linededup.recurring_lines(spark.createDataFrame(many, "doc_id long, text string").repartition(5)).collect())
    assert got == recurring_by_hand(many) and sum(len(x[2]) for x in got) > 20
    assert linededup.recurring_lines(empty).count() == 0
    assert linededup.recurring_lines(odd).count() == len(ODD) + 1


def test_mixing_reaches_margins(spark, empty):
    r = random.Random(5)
    data = [(i, prose(i, r.randint(5, 300)), r.choice(["en", "en", "fr", None]), r.choice("abc")) for i in range(600)] + [(900, None, None, None), (901, "", "en", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit("clash"))
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.4}, "topic": 1.0}
    out = mixing.mixed(docs, wanted, 0.4)
    got = out.collect()
    assert len(got) == len(data) and all(0 <= x["probability"] <= 1 for x in got)
    total = sum(x["n_tokens"] for x in got)
    assert total == sum(len((t[1] or "").split()) for t in data)
    assert sum(x["n_tokens"] * x["probability"] for x in got) == pytest.approx(0.4 * total, rel=1e-6)
    raked = defaultdict(float)
    for x in got:
        raked[x["source"]] += x["n_tokens"] * x["weight"] / total
        raked[x["lang"]] += x["n_tokens"] * x["weight"] / total
    assert raked["a"] == pytest.approx(0.5, abs=1e-4) and raked["b"] == pytest.approx(0.3, abs=1e-4) and raked["en"] == pytest.approx(0.4, abs=1e-4)
    taken = sum(x["n_tokens"] for x in got if x["sampled"])
    assert abs(taken / total - 0.4) < 0.08
    assert mixing.mixed(empty, wanted, 0.5).count() == 0


def test_mixing_by_hand(spark, monkeypatch):
    """Raking and draw against a plain version, in arrays and by Spark; targets that converge slowly."""
    import xxhash

    r = random.Random(6)
    data = [(i, prose(i, r.randint(1, 400)), "en" if r.random() < 0.97 - 0.9 * (i % 3 == 0) else "fr", "abc"[i % 3]) for i in range(300)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    wanted = {"source": {"a": 0.1, "b": 0.3, "c": 0.6}, "lang": {"en": 0.4, "fr": 0.6}, "topic": 0.5}
    out = mixing.mixed(docs, wanted, 0.3).collect()
    assert len(out) == len(data)
    tokens, total = Counter(), sum(x["n_tokens"] for x in out)
    for x in out:
        tokens[x["source"], x["lang"], x["topic"]] += x["n_tokens"]
    goals = []
    for m, name in enumerate(("source", "lang", "topic")):
        now = Counter()
        for c, t in tokens.items():
            now[c[m]] += t
        raw = {k: wanted[name][k] if isinstance(wanted[name], dict) else (v / total) ** wanted[name] for k, v in now.items()}
        goals.append({k: v / sum(raw.values()) * total for k, v in raw.items()})
    weight = {c: float(t) for c, t in tokens.items()}
    for _ in range(200):
        for m, goal in enumerate(goals):
            now = Counter()
            for c, w in weight.items():
                now[c[m]] += w
            weight = {c: w * goal[c[m]] / now[c[m]] for c, w in weight.items()}
    rate = {c: weight[c] / tokens[c] for c in tokens}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(t * min(1, mid * rate[c]) for c, t in tokens.items()) < 0.3 * total else (lo, mid)
    for x in out:
        c = x["source"], x["lang"], x["topic"]
        assert x["weight"] == pytest.approx(rate[c], rel=1e-5) and x["probability"] == pytest.approx(min(1, hi * rate[c]), rel=1e-5)
        h = xxhash.xxh64(x["text"].encode(), seed=xxhash.xxh64(struct.pack("<q", x["doc_id"]), seed=42).intdigest()).intdigest()
        assert x["sampled"] == (h % (1 << 52) / (1 << 52) < x["probability"])
    assert len({(x["doc_id"], x["sampled"]) for x in out}) == 300
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    some = {"source": 1.0, "lang": {"en": 0.4, "fr": 0.6}, "topic": 1.0}
    by_spark = {x["doc_id"]: x for x in mixing.mixed(docs, some, 0.3).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 100_000)
    for x in mixing.mixed(docs, some, 0.3).collect():
        assert by_spark[x["doc_id"]]["weight"] == pytest.approx(x["weight"], rel=1e-9)
        assert by_spark[x["doc_id"]]["probability"] == pytest.approx(x["probability"], rel=1e-9) and by_spark[x["doc_id"]]["sampled"] == x["sampled"]


def test_chat_round_trip(spark):
    control = "".join((chat.OPEN, chat.SEP, chat.PART, chat.CLOSE, "</s>[INST] ok [/INST] <<SYS>> <\\s> <\\\\|im_end|> [\\INST]"))
    data = [(1, 0, "user", control), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (1, 3, None, "x"), (2, 0, "assistant", "ü" * 1000), (None, None, "system", "<")]
    data += [(3, k, ("user", "assistant")[k // 2 % 2], f"t{k} [INST]") for k in range(700)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).repartition(5)
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    groups = defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned))
    assert got[3]["n_blocks"] == 350
    equal = spark.createDataFrame([(9, 5, ("user", "assistant")[k % 2], f"same turn {k:05d}") for k in range(1000)], df.drop("segments").schema)
    assert chat.chat_digest(equal).first()["n_turns"] == 1000 and chat.chat_digest(equal).first()["loss_sha256"] == sha("".join(f"same turn {k:05d}" for k in range(1, 1000, 2)))
    first = chat.format_chats(df).filter("conv_id = 1").first()
    text = first["text"]
    assert [text[r["start"] : r["end"]] for r in first["loss"]] == ["", "tie", "tie"]
    assert text.count(chat.OPEN) == 3 and text.startswith(chat.OPEN + "user" + chat.SEP)
    assert chat.chat_digest(df.filter("false")).count() == 0


def secrets_by_hand(text):
    out = []
    kinds = (
        ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    for k, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if good(m)]
    return ",".join(x[2] for x in sorted(out))


def test_secret_ledger(spark, odd, empty):
    tricky = ["é password: abc token=password : abcdefghijklmnop", "AKIAAKIA12 AKIA" + "Z" * 20, "x" + "deadbeef" * 4 + "g" + "0" * 15, 'API_KEY = "' + "q" * 12 + '" apikey:' + "z" * 11, "token=token=abcdefghijkl", "token = " + "0123456789abcdef" * 3]
    data = [(i, t) for i, t in enumerate(tricky + ODD)] + [(50, tricky[0]), (51, tricky[0]), (None, tricky[1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("path", F.lit("clash")).withColumn("blob_id", F.lit(1))
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    path = shared_dir(spark, "ledger")
    got = sorted((str(r["doc_id"]), r["spans"]) for r in secrets.secret_digest(docs, path, ()).collect())
    assert got == sorted((str(i), secrets_by_hand(t)) for i, t in data)
    entries = spark.read.parquet(path).count()
    secrets.update_ledger(versions, path)  # nothing unseen: nothing is added
    assert spark.read.parquet(path).count() == entries
    more = docs.unionByName(spark.createDataFrame([(99, "token: " + "n" * 20, "x", 1)], docs.schema))
    assert secrets.secret_digest(more, path, ()).filter("doc_id = 99").first()["n_assign"] == 1
    assert spark.read.parquet(path).count() == entries + 3
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{8,}"))
    secrets.update_ledger(versions, path, newer)  # a new rule version alone is scanned
    assert spark.read.parquet(path).groupBy("rule_version").count().count() == 4
    held = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    held.write.mode("append").parquet(path)  # every entry twice: nothing counts twice
    assert sorted((str(r["doc_id"]), r["spans"]) for r in secrets.secret_digest(docs, path, ()).collect()) == got
    assert secrets.secret_digest(empty, shared_dir(spark, "ledger")).count() == 0


def test_secret_versions_and_further_rules(spark):
    kept = "token: " + "k" * 20
    texts = ["plain", kept, f"{kept}\nAKIA{'B' * 16}", "a\nhttps://me:pass@host/x", "-----BEGIN RSA PRIVATE KEY-----\n" + "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = shared_dir(spark, "ledger")
    secrets.update_ledger(secrets.first_saved(docs), path)
    blobs = {t.split("\n")[0] for t in texts}
    assert spark.read.parquet(path).count() == 3 * len(blobs)
    got = {r["doc_id"]: r for r in secrets.secret_digest(docs, path).collect()}
    assert got[1]["spans"] == "assign:0:27" and got[2]["spans"] == "assign:0:27,access:28:48"
    assert got[3]["spans"] == "login:2:18" and got[3]["base_sha256"] == sha("") and got[4]["spans"] == "pem:0:31,jwt:32:64"
    n = len(secrets.RULES) + len(secrets.MORE_RULES)
    fresh = [t for t in texts if t not in blobs]
    assert spark.read.parquet(path).count() == 3 * len(blobs) + n * len(fresh) + (n - 3) * (len(texts) - len(fresh))


@pytest.mark.parametrize("unit, tail", [("a", ""), ("eyJ", ""), ("AKIA", ""), ("eyJ-", "."), ("a1+.-", "://user:word@"), ("0f", ""), ("-----BEGIN ", ""), ("x://u", ":"), ("password ", "= 'abcdefghijkl'")])
def test_secret_rules_read_long_runs_in_linear_time(spark, unit, tail):
    """A megabyte of one run; times are not told, a quadratic rule takes hours."""
    text = unit * (1_000_000 // len(unit)) + tail
    rules = (*secrets.RULES, *secrets.MORE_RULES)
    found = spark.createDataFrame([(text,)], "t string").select(*(secrets._spans(F.col("t"), r).alias(r.kind) for r in rules)).first()
    for r in rules:
        if r.kind in ("access", "hex", "code_host", "login"):
            want = [(m.start(), m.end()) for m in re.finditer(r.pattern, text)]
            assert [(f["start"], f["end"]) for f in found[r.kind]] == want


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    plain = Tokenizer.from_file(path)
    texts = [*ODD, *(prose(k, 50 * k) for k in range(8)), "\t\n x\n\n  y  \n", "'s 's\n's don't", "a'", "x'l", "'ll'd", "a　b\u0085c", "<|endoftext|> in it", "😀😀 ok 1²³"]
    docs = spark.createDataFrame([(len(texts) - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(4)
    folder = shared_dir(spark, "t")
    shards = tokenbin.write_token_files(docs, folder, path, sequence=16, batch=4, shard_ids=500)
    got = rows(tokenbin.token_digest(shards, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    want, at = [], 0
    for i, t in sorted((len(texts) - i, t) for i, t in enumerate(texts)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    first = shards.orderBy("part", "number").first()
    shard = tokenbin.TokenShard(folder, first["part"], first["number"])
    seen = np.concatenate([shard.row(k)[0][shard.row(k)[1]] for k in range(-(-first["n_ids"] // 16))])
    assert (seen == shard.ids(0, first["n_ids"])).all()
    nothing = shared_dir(spark, "t")
    assert tokenbin.token_digest(tokenbin.write_token_files(empty, nothing, path), nothing).count() == 0


def thue_morse(n=1024):
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_equal_polynomial_hashes_are_told_apart(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    docs = spark.createDataFrame(list(enumerate(thue_morse())) + [(None, "x")], "doc_id long, text string").coalesce(1)
    folder = shared_dir(spark, "t")
    got = {r["doc_id"]: r for r in tokenbin.token_digest(tokenbin.write_token_files(docs, folder, path), folder).collect()}
    for i, t in enumerate(thue_morse()):
        ids = Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert got[None]["start"] == 0  # null sorts first


def test_pieces_of_equal_hash_are_left_to_the_library(monkeypatch):
    encoder = tokenbin.PieceEncoder(queries.tokenizer_file())
    texts = ["one two three", "two  é three's", "", "four"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(tokenbin, "span_hashes", lambda data, lo, hi: ((hi - lo).astype(np.uint64),) * 2)
            encoder._clear()
        for _ in range(2):
            ids, counts = encoder.encode(texts)
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_equal_polynomial_hashes_make_no_links(spark):
    docs = spark.createDataFrame(list(enumerate(thue_morse())) + [(None, "x")], "doc_id long, text string").coalesce(1)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.similarity_components(docs).collect()) == [("0", 1, "0"), ("1", 1, "1"), ("None", 1, "None")]
    assert linededup.recurring_lines(docs).filter("n_dropped > 0").count() == 0


def test_word_hashes():
    from assetlens.llm.common import words_in

    r = random.Random(2)
    texts = [b"", b" ", b"x", *("".join(r.choice("ab c") for _ in range(r.randint(0, 300))).encode() for _ in range(50)), b"q" * 63, b"q" * 64, b"q" * 65, b"q" * 2000 + b" q\x0bq"]
    words = words_in(texts)
    want = [w for t in texts for w in t.split()]
    assert [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)] == want and words.counts.tolist() == [len(t.split()) for t in texts]
    lo, hi = (h.tolist() for h in words.hashes())
    assert len(set(lo)) == len(set(hi)) == len(set(want)) == len(set(zip(want, lo, hi)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def hits_by_hand(text, items):
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for i, t in items:
        x = WORD.findall(lower(t))
        for k in range(max(1, len(x) - 9)) if x else ():
            win = x[k : k + 10]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit.update(range(a, a + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, odd, empty, block_bytes):
    items = [(i, prose(100 + i, n)) for i, n in enumerate((3, 9, 10, 11, 40, 40))] + [(7, None), (8, "--"), (9, "Ünïcode"), (4, prose(104, 40)), (10, prose(104, 12))]
    data = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, f"before. {prose(100 + i, 60).upper()} after") for i in range(8)] + [(40, prose(104, 9)), (41, " ".join([prose(104, 40)] * 3)), (41, " ".join([prose(104, 40)] * 3))]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("lang", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((i, *hits_by_hand(t, items)) for i, t in data), key=lambda t: tuple((True, str(x)) for x in t))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1  # one pass over the documents, however many blocks
    assert decontam.decontaminate(docs.filter("false"), bench).count() == 0
    assert decontam.decontaminate(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_language_id(spark, odd, empty, sf_dir):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(documents.filter(~langid.held_out()), per_language=120)
    assert set(model.members) == {"germanic", "romance"}
    found = langid.identify(documents.drop("source"), model).filter(langid.held_out())
    good = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert good > 0.98
    edge = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert edge[0]["lang_pred"] == edge[2]["lang_pred"] == edge[10 - 7]["lang_pred"] == "und" and edge[0]["score"] == 0
    assert edge[7]["lang_pred"] == edge[8]["lang_pred"] and edge[7]["score"] == edge[8]["score"]
    assert all(0 <= r["score"] <= 1 for r in edge.values())
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(documents.filter("false"))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    single = langid.fit(documents.filter("lang = 'fr'"), per_language=20)
    assert langid.identify(odd, single).filter("doc_id = 7").first()["lang_pred"] == "fr"


def test_language_sample_keeps_every_language(spark):
    english = [(prose(k, 40), "en") for k in range(300)]
    df = spark.createDataFrame(english + [("le chat est sur la table et il dort", "fr")] * 2000 + [("je ne sais pas", "fr")], "text string, lang string")
    model = langid.fit(df, per_language=100)
    assert sorted(x for m in model.members.values() for x in m) == ["en", "fr"]
    french = spark.createDataFrame([(1, "le chat est la")], "doc_id long, text string")
    assert langid.identify(french, model).first()["lang_pred"] == "fr"


def svm_loss(w, x, y, c=10.0):
    """Squared hinge with classes weighed equally, as the models minimise it."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
    return 0.5 * w @ w + c / len(y) * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()


def test_language_sample_is_bounded(spark, monkeypatch):
    """Many languages share the sample; a column of other values is refused, not collected."""
    data = [(f"wort{k} und satz{k} {chr(97 + k % 26) * 5}", f"l{k % 12}") for k in range(240)]
    df = spark.createDataFrame(data, "text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 24)
    drawn = []
    monkeypatch.setattr(langid, "linear_svm", lambda x, y: drawn.append(len(x)) or np.zeros(x.shape[1] + 1, np.float32))
    assert sorted(langid.fit(df).families) == sorted({f"l{k}" for k in range(12)}) and set(drawn) == {24}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 11)
    with pytest.raises(ValueError, match="more than 11 languages"):
        langid.fit(df)


def test_linear_svm_by_hand():
    """No step along any axis or along the gradient lowers the loss noticeably."""
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=120) > 0.4, 1.0, -1.0)
    w = langid.linear_svm(x, y).astype(float)
    least = svm_loss(w, x, y)
    for axis in np.eye(6):
        for step in (-0.05, 0.05):
            assert svm_loss(w + step * axis, x, y) > least - 1e-6
    slope = np.array([(svm_loss(w + 1e-5 * e, x, y) - svm_loss(w - 1e-5 * e, x, y)) / 2e-5 for e in np.eye(6)])
    assert np.abs(slope).max() < 1e-2 and ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.85


def test_language_predictions_by_hand(spark):
    """Family by the largest margin, language by votes of the pairs, score from both, one text at a time in doubles."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(documents.filter(~langid.held_out()), per_language=60)
    assert set(model.pairs) == {tuple(sorted(p)) for m in model.members.values() for p in combinations(m, 2)}
    rows = documents.filter("doc_id < 150").select("doc_id", "text")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, model).collect()}
    unlike = 0
    for doc_id, text in rows.collect():
        if not text or not re.search(r"[^\W\d_]", text):
            assert got[doc_id] == ("und", 0.0)
            continue
        x = np.append(langid.vectors([text.encode()])[0].astype(float), 1.0)
        margins = {f: math.exp(4 * max(-10, min(10, float(x @ w)))) for f, w in zip(model.families, model.family_weights.astype(float))}
        family = max(margins, key=margins.get)
        score, members = margins[family] / sum(margins.values()), model.members[family]
        votes, total = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), w in model.pairs.items():
            if a in votes:
                m = float(x @ w.astype(float))
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        lang = max(members, key=lambda k: votes[k] + 1e-3 * math.tanh(total[k]))
        if len(members) > 1:
            score /= 1 + math.exp(-4 * max(-10, min(10, total[lang] / (len(members) - 1))))
        unlike += got[doc_id][0] != lang  # margins of almost nothing round either way
        assert got[doc_id][0] != lang or abs(got[doc_id][1] - score) < 1e-3
    assert unlike <= 1


def test_language_vectors_by_hand(monkeypatch):
    texts = [t.encode() for t in ("", "Ab1c", "xx  yy", "é" * 40, prose(1, 80))]
    plain = langid.vectors(texts, 64)
    monkeypatch.setattr(langid, "STRETCH", 7)  # a text longer than a stretch
    assert np.array_equal(langid.vectors(texts, 64), plain)
    for t, row in zip(texts, plain):
        folded = b" " + b" ".join(t.translate(langid._FOLD).split()) + b" "
        counts = Counter((n, folded[k : k + n + 1]) for n in range(4) for k in range(len(folded) - n))
        want = np.zeros(64)
        for (n, gram), c in counts.items():
            want[int(langid.mix64(np.array([int.from_bytes(gram, "little") + ((n + 1) << 40)], np.uint64))[0] % 64)] += c
        assert np.allclose(row, np.sqrt(want) / np.linalg.norm(np.sqrt(want)), atol=1e-6)


def components_by_hand(data, num=85, den=100, n=4):
    sets, root = {}, {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, index = sorted(sets), defaultdict(list)
    for i in ids:
        shared = Counter(j for g in sets[i] for j in index[g])
        for g in sets[i]:
            index[g].append(i)
        for j, k in shared.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(seed, base, n, edits):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [(85, 100), (60, 100)])
def test_jaccard_components(spark, odd, empty, threshold):
    texts = []
    for k, (size, n, edits) in enumerate(((300, 60, 18), (80, 30, 6), (25, 20, 2), (9, 12, 1), (5, 8, 1), (900, 25, 60), (150, 120, 9))):
        texts += near_copies(k, prose(200 + k, size), n, edits)
    passage = prose(999, 60)
    texts += [f"{prose(500 + k, 40)} {passage}" for k in range(40)] + [passage] * 5 + [prose(200, 300)[:-4], "one two", "one two", "one two three", "ONE two"]
    r = random.Random(1)
    data = list(enumerate(texts + [t for t in ODD]))
    r.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(6)
    got = sorted(tuple(x) for x in jaccard.similarity_components(docs, 4, *threshold).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components_by_hand(data, *threshold)
    assert jaccard.similarity_components(empty).count() == 0
    assert jaccard.similarity_components(odd).count() == len(ODD) + 1


def test_jaccard_lists_longer_than_memory(spark, monkeypatch):
    """Lists that stream by, leaders of many members and small rounds give the same components."""
    texts = near_copies(3, prose(77, 120), 60, 12) + near_copies(4, prose(78, 90), 40, 9) + [f"{prose(79, 50)} {prose(700 + k, 30)}" for k in range(30)]
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    entries = jaccard.index_entries(docs, 4, 85, 100)
    sizes = []
    for list_rows in (jaccard.LIST_ROWS, 3):
        blocks = jaccard.index_blocks(entries, 85, 100, list_rows).groupBy("block").agg(F.collect_set("doc_id").alias("m")).collect()
        sizes.append({tuple(sorted(b["m"])) for b in blocks if len(b["m"]) > 1})
    pairs = [{(a, b) for m in s for a in m for b in m if a < b} for s in sizes]
    assert pairs[0] and pairs[0] <= pairs[1]  # the class's largest size cuts less than the list's own
    for name, value in (("FAN", 2), ("LEADERS", (4, 8)), ("LIST_ROWS", 3), ("SEEN", 1)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard.index_blocks, "__defaults__", (3,))
    got = sorted(tuple(x) for x in jaccard.similarity_components(docs).collect())
    assert got == components_by_hand(data)


def test_quality(spark, odd, empty):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(documents, labels)
    assert found.count() == documents.count()
    held = found.filter("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(documents, flipped)  # held-out labels change nothing
    assert again.agg(F.sum("score")).first()[0] == pytest.approx(found.agg(F.sum("score")).first()[0], rel=1e-9)
    edge = quality.classify(odd.withColumn("predicted", F.lit("clash")), labels).collect()
    assert len(edge) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in quality.classify(odd, labels.filter("false")).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(documents, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.classify(empty, labels).count() == 0


def test_discriminant_by_hand():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5)) @ r.normal(size=(5, 5))
    c = np.cov(x.T, bias=True)
    s = quality.shrunk(c, 400)
    assert np.all(np.linalg.eigvalsh(s) > 0) and abs(np.trace(s) - np.trace(c)) < 1e-9
    factor = np.linalg.cholesky(s)
    mean = x.mean(0)
    model = quality.Quadratic(0.5, (np.zeros(5), np.ones(5)), tuple((np.log(0.5), m, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())) for m in (mean, mean + 1)))
    d = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m) for m in (mean, mean + 1)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(d[0] - d[1])))


def statistics_by_hand(text):
    """Raw counts of one text, without arrays."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    kinds = Counter("U" if 65 <= b < 91 else "L" if 97 <= b < 123 else "D" if 48 <= b < 58 else "H" if b > 127 else "B" if b in b" \t\n\r\x0b\x0c" else "M" if b in b".,;:!?'\"-()" else "S" for b in text)
    ink = len(text) - kinds["B"]

    def odds(count, of, usual, few):
        return np.log((count + usual * few) / (of - count + (1 - usual) * few))

    n, few = len(words), quality.FEW_BYTES
    entropy = -sum(c / len(text) * np.log2(c / len(text)) for c in Counter(text).values())
    return [
        np.log(max(n, 60)), np.log((ink + 150) / (n + 30)), np.log((len(text) + 600) / (len(lines) + 3)),
        odds(kinds["U"] + kinds["L"], ink, 0.95, few), odds(kinds["U"], ink, 0.03, few), odds(kinds["D"], ink, 0.003, few),
        odds(kinds["M"], ink, 0.03, few), odds(kinds["S"], ink, 0.003, few), odds(kinds["H"], ink, 0.02, few),
        np.log(len(set(words)) + 30) / np.log(n + 30), odds(max(Counter(words).values(), default=0), n, 0.06, 30),
        odds(sum(a == b for a, b in zip(words, words[1:])), n, 0.01, 30), odds(len(lines) - len(set(lines)), len(lines), 0.02, 3),
        (len(text) * entropy + few * 4.2) / (len(text) + few),
    ]


def test_quality_by_hand(spark):
    texts = [(t or "").encode() for t in ODD]
    assert np.allclose(quality.statistics(texts), [statistics_by_hand(t) for t in texts])
    data = [(i, prose(i, 20 + i % 60) + ("!" * (i % 7) if i % 2 else " 12 34" * (i % 5))) for i in range(200)] + [(None, "x")]
    labels = [(i, i % 2) for i in range(200)] + [(0, 0), (3, None), (999, 1), (None, 1)]  # repeated, null and without a document
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    x = {i: np.array(statistics_by_hand(t.encode())) for i, t in data}
    rows = [(x[i], q) for i, q in labels if i in x and i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    every = np.stack([a for a, _ in rows])
    mean, spread = every.mean(0), every.std(0).clip(np.sqrt(1e-9))
    density = []
    for k in (0, 1):
        z = (np.stack([a for a, q in rows if q == k]) - mean) / spread
        s = quality.shrunk(np.cov(z.T, bias=True), len(z))
        density.append((np.log(len(z) / len(rows)), z.mean(0), np.linalg.inv(s), np.linalg.slogdet(s)[1]))
    for i, a in x.items():
        z = (a - mean) / spread
        d = [prior - 0.5 * (z - m) @ inverse @ (z - m) - 0.5 * det for prior, m, inverse, det in density]
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(d[0] - d[1])), abs=1e-3)  # sums of squares lose digits where a statistic is constant
        assert got[i]["predicted"] == (got[i]["score"] >= 0.7) and got[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)


def test_media_of_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (5, None, "y"), (5, None, "z")], "doc_id long, text string, feature string")
    folder = shared_dir(spark, "m")
    media.write_archives(docs, folder)
    got = media.media_digest(media.read_archives(spark, folder)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "None"] and len({r["media_sha256"] for r in got if r["doc_id"] == 5}) == 1
    image = media.encode_png(media.padded(b"a"), b"1")
    one = next(r for r in got if r["doc_id"] is None)
    assert one["media_bytes"] == len(image) and one["media_sha256"] == hashlib.sha256(image).hexdigest()
    samples = np.frombuffer(media.padded(b"a"), np.uint8)
    assert one["feature"].startswith(f"rows=1;mean={samples.mean():.4f};std={samples.std():.4f};")
