"""Ranked search, exact top-k search and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import prefixtrie, ranked, topk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranking_by_hand(docs, items, top=10):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, w, c in bags:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def search_cases():
    r = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "日本", "x9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 40)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(25)] + [(3, docs[3][1]), (None, docs[5][1]), (300, None), (301, ""), (302, "-- !"), (303, "W1, w1;W2"), (304, "w1 " * 3000)]
    items = [(f"q{k}", " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(12)] + [("q1", "w5 w5"), ("none", "nowhere"), ("null", None), (None, "w7 ünï Ünï"), ("copy", docs[3][1].upper())]
    return docs, items


@pytest.mark.parametrize("size, block_bytes", [(1 << 20, 1 << 20), (40, 1 << 20), (300, 400)])
def test_ranked_search(spark, monkeypatch, size, block_bytes):
    monkeypatch.setattr(ranked, "SEGMENT", size)
    docs, items = search_cases()
    given = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit(0))
    by_number = {w: k for k, w in enumerate(sorted({t.encode() for _, x in items for t in terms(x)}))}
    held = [ranked.counted(i, (t or "").encode(), by_number) for i, t in docs]
    assert all([w for words in ranked.terms_in((t or "").encode(), 64) for w in words] == [w.encode() for w in terms(t)] for _, t in docs)
    assert [(c.n, {k: n for k, n in zip(c.terms, c.tf)}) for c in held] == [(len(terms(t)), {by_number[w.encode()]: n for w, n in Counter(terms(t)).items() if w.encode() in by_number}) for _, t in docs]
    found = ranked.ranked_search(given, bench, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in found.collect()), key=key) == sorted(ranking_by_hand(docs, items), key=key)
    assert ranked.ranked_search(given.filter("false"), bench).count() == ranked.ranked_search(given, bench.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_nra_reads_until_all_is_told(monkeypatch, seed):
    monkeypatch.setattr(ranked, "DEPTH", 1 + seed % 3)
    monkeypatch.setattr(ranked, "DEEPER", 1 + seed % 2)
    r = np.random.default_rng(seed)
    n, top = 40, 3
    scores, lists = np.zeros(n, np.int64), []
    for _ in range(r.integers(1, 6)):
        docs = r.permutation(n)[: r.integers(0, n)]
        gains = np.sort(r.integers(1, 6, len(docs)))[::-1]
        scores[docs] += gains
        lists.append(ranked.Impacts(docs, gains))
    found, told = ranked.nra(lists, n, top, 1)
    limit = max(1, np.sort(scores)[-top])
    assert found.tolist() == np.flatnonzero(scores >= limit).tolist() and told.tolist() == scores[found].tolist()


def test_segments_of_many_terms(spark, monkeypatch):
    docs, items = search_cases()
    number = {w.encode(): k for k, w in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    row = ranked.segment([ranked.counted(i, (t or "").encode(), number) for i, t in docs])
    bags = [terms(t) for _, t in docs]
    assert row[0] == sum(map(bool, bags)) and row[1] == sum(map(len, bags))
    df = Counter(t for w in bags for t in set(w))
    assert dict(zip(row[4].tolist(), row[5].tolist())) == {number[t.encode()]: n for t, n in df.items() if t.encode() in number}


def best_by_hand(rows, top=20, asked=20):
    kept = []
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(64 * v) for v in x]))
    out = []
    for a, (i, q) in enumerate(kept):
        if i % asked == 0:
            scores = sorted((-sum(p * r for p, r in zip(q, z)), j) for b, (j, z) in enumerate(kept) if a != b)[:top]
            out += [(i, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    return out


def vector_cases(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, 6))
    rows = [(int(i), (centres[i % 5] + 0.05 * r.normal(size=6)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(70)] + [(20, rows[3][1]), (20, rows[7][1]), (-40, rows[9][1])]
    odd = [(None, rows[0][1]), (2000, None), (2020, [1.0, None]), (2040, [math.nan] * 6), (2060, [math.inf] * 6), (2080, []), (2100, [0.5]), (2120, [1.0] * 9), (2140, [-0.0] * 6)]
    return rows + odd


@pytest.mark.parametrize("n, fans, cells, part, held", [(90, (2, 16), 1 << 16, 1 << 16, 1 << 20), (200, (1, 3), 30, 20, 10), (12, (2, 16), 6, 4, 1)])
def test_top_inner(spark, monkeypatch, n, fans, cells, part, held):
    for name, value in {"FANS": fans, "PAGE_CELLS": cells, "BLOCK_CELLS": 4 * cells, "PART_ROWS": part, "PIVOTS": 4, "RINGS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rows = vector_cases(n, n)
    given = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    found = topk.top_inner(given)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(best_by_hand(rows))
    assert topk.top_inner(given.filter("false")).count() == topk.top_inner(given.filter("vec_id % 20 <> 0")).count() == 0


def test_top_inner_of_few_and_of_large_numbers(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_inner(one).count() == 0
    rows = [(k * 20, [3e7 + k / 64, 1e7, -2e7]) for k in range(5)]
    found = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, found.collect())) == sorted(best_by_hand(rows))


def test_bounds_hold():
    r = np.random.default_rng(1)
    z = r.integers(-50, 50, (400, 8)).astype(float)
    keys = topk.fit_keys(z[:100])
    cell, ring, near = keys.of(z)
    q, apart = z[:60], topk.distances(z[:60], keys.pivots)
    scores = topk.inner(q, z)
    for c, k in set(zip(cell.tolist(), ring.tolist())):
        here = (cell == c) & (ring == k)
        most = topk.bounds((q * q).sum(1), apart[:, c], near[here].min(), near[here].max(), (z[here] ** 2).sum(1).max())
        assert (scores[:, here].max(1) <= most).all()


def test_block_picks_the_best(monkeypatch):
    monkeypatch.setattr(topk, "HELD", 5)
    r = np.random.default_rng(2)
    z, q = r.integers(-3, 4, (60, 4)).astype(float), r.integers(-3, 4, (7, 4)).astype(float)
    keys = topk.fit_keys(z)
    directory = topk.Directory(*(np.array([x]) for x in (0, 0, 0.0, 1e9, 1e9)))
    pack = lambda m: [x.astype("<i4").tobytes() for x in m]
    block = topk.Block({"query": list(range(7)), "z": pack(q), "tau": [None] * 7, "rings": [[0]] * 7}, keys, directory, 4, 6)
    for at in range(0, 60, 10):
        block.meet(0, 0, 0.0, 1e9, 1e9, np.arange(at, at + 10), np.arange(at, at + 10) // 2, z[at : at + 10])
    got = sorted(zip(*(c.to_pylist() for c in block.best().columns)))
    want = [(k, e, e // 2, int(q[k] @ z[e])) for k in range(7) for e in sorted(range(60), key=lambda e: (-(q[k] @ z[e]), e // 2, e))[:6]]
    assert got == sorted(want)


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        sums[node] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(m[0], len(x), members[x[:-1]][0] if x else None, len(m), len(children[x]), *sums[x], digest(ends[x])) for x, m in members.items()]


def trie_cases():
    r = random.Random(3)
    rows = []
    for c in range(-45, 90):
        if c % 20 or c % 40 == 0:
            rows += [(c, t, ("user", "assistant")[t % 2], r.choice(["a b", "c", "d\ne f"])) for t in range(r.randint(1, 6))]
    for c in range(100, 140):  # copies, and a long common beginning with many ends
        rows += [(c, t, "user", f"turn {t}") for t in range(9)] + ([(c, 20, "user", f"own {c}")] if c % 3 else [])
    rows += [(200, t, "user", f"long {t}") for t in range(50)] + [(201, t, "user", f"long {t}") for t in range(50)] + [(203, t, "user", f"long {t}") for t in range(40)]
    rows += [(300, None, "user", "first"), (300, 0, None, None), (300, 0, None, ""), (300, 1, "b", "x"), (300, 1, "a", "y"), (300, 1, "a", "x"), (None, 1, "user", "nobody"), (301, 0, "us", "er"), (302, 0, "use", "r")]
    return rows


@pytest.mark.parametrize("shard_nodes, characters", [(1 << 20, 1 << 16), (16, 10)])
def test_conversation_trie(spark, monkeypatch, shard_nodes, characters):
    monkeypatch.setattr(prefixtrie, "ID_CHARACTERS", characters)
    rows = trie_cases()
    given = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", shard_nodes > 1000)  # else conversations span several ranges
    try:
        found = prefixtrie.conversation_trie(given, shard_nodes)
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, trie_by_hand(rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefixtrie.conversation_trie(given.filter("false")).count() == 0


def test_node_table():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        lo, hi = r.integers(0, 2**63, (2, n)).astype(np.uint64)
        lo[: n // 2] = 7  # told apart by the other half
        table = prefixtrie.NodeTable(lo, hi)
        assert sorted(table.slots(lo, hi).tolist()) == list(range(n))
        assert (table.slots(lo + np.uint64(1), hi) == -1).all() and (table.slots(lo, ~hi) == -1).all()
    with pytest.raises(ValueError, match="twice"):
        prefixtrie.NodeTable(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


def test_colliding_prefixes_are_found_out(spark):
    rows = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 5, 8, 3, True), (2, 1, 5, 5, 0, 0, 5, 9, 3, True)], "conv_id long, d long, d1 long, d2 long, p1 long, p2 long, first long, k1 long, words long, ends boolean")
    with pytest.raises(Exception, match="digests of different prefixes are equal"):
        prefixtrie.trie_nodes(rows).collect()
