"""Sharding, URL rules, the registered queries and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from pawl.llm import queries
from pawl.llm.sharding import interleave, write_shards
from pawl.llm.url_filter import judge, rules_frame


def test_interleave(spark):
    rows = [(k, "é" * (k % 7) if k % 11 else None, f"s{0 if k % 3 else k % 5}" if k % 13 else None, "x") for k in range(500)] + [(7, "é" * 0, "s1", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    found = interleave(docs, n_shards=24, rows_per_bucket=32).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # The cut after g rows lies at a fractional rank within S / 2N of g / N, as each of S sources rounds
    # by half a row; so either end of a shard is off by half a row and S n / 2N rows of a source of n.
    sources = Counter(r[2] for r in rows)
    for shard in range(24):
        mine = Counter(r.source for r in found if r.shard == shard)
        for source, n in sources.items():
            assert abs(mine[source] - n * len(slots[shard]) / len(rows)) <= 1 + len(sources) * n / len(rows)
    ranks = defaultdict(list)
    for r in found:
        ranks[r.source].append(r.source_rank)
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    again = interleave(docs.repartition(7), n_shards=24, rows_per_bucket=32).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_interleave_edges(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    assert interleave(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(1, "a", "s"), (2, "b", None), (None, "c", "t")], schema)
    found = interleave(few, n_shards=24).collect()
    assert len({r.shard for r in found}) == 3 and {r.slot for r in found} == {0}
    write_shards(few, interleave(few, n_shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.Example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.b", "/x"), ("allow", None, "/"), ("block", "a.b", "/x"), ("allow", "a.b", "/x")]


def brute_verdict(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    n = min((tail.index(c) for c in "/?#" if c in tail), default=len(tail))
    host = "".join(c.lower() if c.isascii() else c for c in tail[:n])
    path = tail[n:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h) + len(p), len(h), h.lower() + p, v) for v, h, p in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_judge(spark):
    urls = [None, "", "nothing", "http://", "http://COM/", "http://x.com", "https://x.com/?q", "http://example.com/en/1", "http://www.EXAMPLE.com/en/", "http://sub.example.com/en/x#y", "http://notexample.com/en/", "http://a.net/es/q?r", "http://net/es/",
            "http://a.b/xyz", "http://q.a.b/x", "http://a.b/y", "ftp://u@x.com:80/a://b", "http://É.com/ß/", "http://x.com?/en/", "http://" + "a." * 300 + "com/" + "p" * 3000]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(3, urls[3], "x", "y")], "page_id long, url string, host string, rule string")
    found = judge(pages, rules_frame(spark, RULES)).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id])
    assert judge(pages.limit(0), rules_frame(spark, RULES)).collect() == []
    empty = judge(pages, rules_frame(spark, RULES).limit(0)).collect()
    assert {(r.rule, r.verdict) for r in empty} == {(None, "allow")}


def test_url_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    wanted = Counter(con.execute(queries.OP3_SQL).fetchall())
    assert Counter(tuple(r) for r in queries.op3_url_filter(spark, sf).collect()) == wanted


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n != "pipeline"))
def test_registered(spark, sf, name):
    found = queries.queries()[name](spark, sf)
    rows = found.collect()
    assert rows and {"doc_id", "vec_id", "page_id"} & set(found.columns)
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.selectExpr("*", "'x' AS score", "1 AS lang_pred", "2 AS n_hit").union(docs.limit(2).selectExpr("*", "'x'", "1", "2"))
    null = docs.limit(1).selectExpr("doc_id + 100000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", "'x' AS score", "1 AS lang_pred", "2 AS n_hit")
    rows, counts = extra.union(null), []
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = stage(spark, rows, sf).cache()
        counts.append(rows.count())
        if name != "tokens":
            assert rows.columns == before.columns
        if name == "near_duplicates":
            assert rows.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50
    assert {f.name for f in rows.schema} == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_pipeline_on_nothing(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert rows.collect() == []
