"""Operators on pairs against comparing everything with everything."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pawl.llm import minhash_dedup
from pawl.llm.components import connected_components
from pawl.llm.embedding_dedup import near_duplicates as near_vectors
from pawl.llm.minhash_dedup import CHUNK_SYMBOLS, CHUNKS, DISTANCE, SYMBOLS, chunk_keys
from pawl.llm.minhash_dedup import near_duplicates as near_documents


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def top(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100, 101), (101, 99)], [(1, 1), (None, 2), (3, 4), (4, 3)], []])
def test_components(spark, edges):
    union = Union({n for e in edges for n in e if n is not None})
    for a, b in edges:
        if a is not None and b is not None:
            union.join(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a is not None and b is not None and a != b for n in (a, b)}
    assert found == {n: union.top(n) for n in linked}


VECTORS = "vec_id long, embedding array<double>, label int, rep string"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            center = rng.normal(size=16)
            for k in range(int(rng.integers(1, 9))):
                v = center + rng.normal(size=16) * 0.12 * (k > 2)
                rows.append((n, (v * (1 + k)).tolist(), label, "x"))
                n += 1
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + k, v, 1, "x") for k, v in enumerate(bad)] + [(None, rows[0][1], 1, "x")]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, VECTORS), block=4, task_rows=50).collect()}
    good = [(i, np.array(v), label) for i, v, label, _ in rows if i is not None and i < n and label is not None]
    union, links = Union([i for i, *_ in rows if i is not None]), defaultdict(int)
    for x in range(len(good)):
        for y in range(x):
            (i, v, p), (j, w, q) = good[x], good[y]
            if p == q and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    assert sum(links.values()) > 50
    assert found.pop(None) == (0, None, False)
    assert found == {i: (links[i], union.top(i), union.top(i) == i) for i, *_ in rows if i is not None}


def test_vectors_empty_and_repeated(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 0.0], 1, "")] * 3 + [(2, [2.0, 0.0], 1, "")], VECTORS)
    assert sorted(tuple(r) for r in near_vectors(same).collect()) == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False)]


def test_pigeonhole():
    """Signatures within the distance share a key, whatever symbols differ."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (1, SYMBOLS)).astype("u1")
    for _ in range(300):
        other = base.copy()
        at = rng.choice(SYMBOLS, DISTANCE, replace=False)
        other[0, at] ^= rng.integers(1, 256, DISTANCE).astype("u1")
        assert set(chunk_keys(base)[0]) & set(chunk_keys(other)[0])
    spread = base.copy()
    spread.reshape(CHUNKS, CHUNK_SYMBOLS)[:, :2] ^= 1
    assert not set(chunk_keys(base)[0]) & set(chunk_keys(spread)[0])


def brute_documents(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    union = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(s), union.top(i), union.top(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "DOCUMENT_BLOCK", 7)
    monkeypatch.setattr(minhash_dedup, "SIGNATURE_BLOCK", 9)
    rng = random.Random(9)
    words = [f"w{k}é" for k in range(400)]
    rows = []
    for group in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 40, 120]))]
        for _ in range(rng.randint(1, 10)):
            text = [rng.choice(words) if rng.random() < group / 400 else w for w in base]
            rows.append((len(rows), rng.choice(["  ", " ", "\n", "\t"]).join(text).replace("w1", rng.choice(["W1", "w1"])), "x"))
    # a chain: each links with the next only
    chain = [f"c{k}" for k in range(90)]
    rows += [(len(rows) + k, " ".join(chain[k * 4 :]), "x") for k in range(4)]
    rows += [(len(rows) + k, t, "x") for k, t in enumerate([None, "", " \n ", "one", "one", "ONE", "nbsp\u00a0stays", "nbsp stays"])]
    found = near_documents(spark.createDataFrame(rows, "doc_id long, text string, component string"), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute_documents(rows, size, percent)


def test_documents_edges(spark):
    schema = "doc_id long, text string"
    assert near_documents(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A  b c")], schema)
    found = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_documents(rows).collect()), key=str)
    assert found == [(0, None, False), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_deduplicated(spark):
    """One row of each group; texts of one id are judged apart; what has no words or no id stays."""
    words = [f"w{k}" for k in range(60)]
    near, other = " ".join(words), " ".join(words[::-1])
    rows = [(4, near, "a"), (4, near, "a"), (4, other, "b"), (7, near + " more", "c"), (2, other, "d"), (9, "alone here", "e"), (None, near, "f"), (5, None, "g"), (5, " ", "h"), (5, " ", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    found = minhash_dedup.deduplicated(docs)
    assert found.columns == docs.columns
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([rows[0], rows[4], rows[5], *rows[6:]], key=str)
    assert minhash_dedup.deduplicated(docs.limit(0)).collect() == []


def test_an_id_on_ten_thousand_rows(spark):
    """Repeats of an id, with one text and with different ones, stay apart and are judged by their texts."""
    base = " ".join(f"w{k}" for k in range(40))
    same = spark.range(5000).selectExpr("3L AS doc_id", f"'{base}' AS text")
    apart = spark.range(5000).selectExpr("3L AS doc_id", "concat('t', id, ' u', id, ' v', id, ' x', id) AS text")
    rows = same.union(apart).union(spark.createDataFrame([(8, "t7 u7 v7 x7")], "doc_id long, text string"))
    found = near_documents(rows, 3, 85).collect()
    assert len(found) == 10_001 and {r.component_id for r in found} == {3}
    left = minhash_dedup.deduplicated(rows, 3, 85)
    assert left.count() == 5001 and left.where("doc_id = 8").isEmpty()


def test_vectors_of_an_id_that_repeats(spark):
    rows = spark.range(10_000).selectExpr("1L AS vec_id", "array(1.0D, 0.5D) AS embedding", "1 AS label", "'' AS rep")
    rows = rows.union(spark.createDataFrame([(1, [-1.0, 3.0], 1, ""), (5, [-1.0, 3.01], 1, "")], VECTORS))
    found = near_vectors(rows).groupBy("vec_id", "n_links", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, 1), (1, 9999, 1, 10_000), (5, 1, 1, 1)]


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op7_minhash_dedup"])
def test_registered_pairs(spark, sf, name):
    """The registered queries against comparing everything with everything."""
    from pawl.llm import queries

    found = queries.queries()[name](spark, sf).collect()
    if name == "op7_minhash_dedup":
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_documents(rows, 3, 85)
        return
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r.label for r in rows]), [r.vec_id for r in rows]
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    union = Union(ids)
    for i, j in zip(*np.nonzero(close), strict=True):
        union.join(ids[i], ids[j])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (int(close[k].sum()), union.top(i), union.top(i) == i) for k, i in enumerate(ids)}
