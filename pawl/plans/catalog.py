"""A query for each operator over the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawl.functions import source
from pawl.functions.columns import scaled, tenths
from pawl.operators import compare, coverage, hints, lints, observe, ratchet, tighten
from pawl.plans import adapters as A
from pawl.sources import lcov, lintlog, mutants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


PARTS = """
items AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'src/moved.rs::p' ELSE 'src/part.rs::p' END || l_partkey AS key, l_partkey AS ord, count(*) AS value FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_partkey),
earlier AS (SELECT 'src/part.rs::p' || l_partkey AS key, l_partkey AS ord, count(*) AS ceiling FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_partkey),
base AS (SELECT key, ceiling FROM earlier WHERE ceiling > 12)"""


@query(f"""WITH {PARTS}
SELECT 'cyclomatic' AS metric, b.key, i.value, b.ceiling,
  CASE WHEN i.value IS NULL THEN 'unmatched' WHEN i.value <= 17 THEN 'met' WHEN i.value < b.ceiling THEN 'loose' ELSE 'pinned' END AS status
FROM base b LEFT JOIN items i USING (key)""")
def ratchet_status(spark, d):
    found = ratchet.baseline_status(A.part_items(spark, d), A.part_targets(spark), A.part_baseline(spark, d))
    return found.select("metric", "key", "value", "ceiling", "status")


@query(f"""WITH {PARTS}
SELECT 'cyclomatic' AS metric, i.key, i.value, b.ceiling,
  CASE WHEN i.value <= 17 THEN 'within' WHEN b.ceiling IS NULL THEN 'new' WHEN i.value <= b.ceiling THEN 'grandfathered' ELSE 'exceeds' END AS status
FROM items i LEFT JOIN base b USING (key)""")
def ratchet_items(spark, d):
    found = ratchet.item_status(A.part_items(spark, d), A.part_targets(spark), A.part_baseline(spark, d))
    return found.select("metric", "key", "value", "ceiling", "status")


VIOLATIONS = f"""WITH {PARTS},
bad AS (SELECT i.key, CASE WHEN b.ceiling IS NULL THEN 'new' ELSE 'exceeds' END AS kind, i.value, b.ceiling
  FROM items i LEFT JOIN base b USING (key) WHERE i.value > 17 AND (b.ceiling IS NULL OR i.value > b.ceiling)),
stale AS (SELECT b.key, CASE WHEN i.value IS NULL THEN 'unmatched' WHEN i.value <= 17 THEN 'met' ELSE 'loose' END AS kind, i.value, b.ceiling
  FROM base b LEFT JOIN items i USING (key) WHERE i.value IS NULL OR i.value <= 17 OR i.value < b.ceiling),
violations AS (SELECT * FROM bad UNION ALL SELECT * FROM stale)"""


@query(VIOLATIONS + " SELECT 'cyclomatic' AS metric, key, kind, value, CAST(17 AS BIGINT) AS target, ceiling FROM violations")
def ratchet_violations(spark, d):
    return ratchet.violations(A.part_items(spark, d), A.part_targets(spark), A.part_baseline(spark, d))


@query(f"""WITH {PARTS}
SELECT 'cyclomatic' AS metric, arg_min(key, (-value, ord)) AS worst_key, max(value) AS worst_value,
  CAST(count(*) FILTER (value > 17) AS BIGINT) AS over_target, CAST(17 AS BIGINT) AS target FROM items""")
def ratchet_worst(spark, d):
    return ratchet.worst(A.part_items(spark, d), A.part_targets(spark))


REPORT = VIOLATIONS + """,
report AS (SELECT 'cyclomatic' AS metric, CAST(17 AS BIGINT) AS target, true AS measured,
  (SELECT arg_min(key, (-value, ord)) FROM items) AS worst_key, (SELECT max(value) FROM items) AS worst_value,
  (SELECT CAST(count(*) AS BIGINT) FROM items WHERE value > 17) AS over_target,
  (SELECT count(*) FROM items WHERE value > 17) = 0 AS meets_target, (SELECT count(*) FROM violations) = 0 AS passes_gate
UNION ALL SELECT 'crap', 25, false, NULL, NULL, 0, false, true)"""


def _report(spark, d):
    targets = A.part_targets(spark).union(spark.createDataFrame([("crap", 25, 10)], "metric string, target long, scale long"))
    items = A.part_items(spark, d)
    return ratchet.report_rows(items, targets, A.part_baseline(spark, d), measured=spark.createDataFrame([("cyclomatic",)], "metric string"))


@query(REPORT + " SELECT * FROM report")
def ratchet_report_rows(spark, d):
    return _report(spark, d)


@query(REPORT + " SELECT bool_and(passes_gate) AS passed FROM report")
def gate_verdict(spark, d):
    return ratchet.gate_passed(_report(spark, d))


@query("""WITH s AS (SELECT l_suppkey, (sum(CAST(l_quantity AS BIGINT)) * 100 // count(*)) / 100.0 AS v FROM lineitem GROUP BY 1),
m AS (SELECT 's' || l_suppkey AS key, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) + (l_suppkey % 4) / 10.0::DOUBLE AS c FROM s)
SELECT key, CAST(round(v * 10) AS BIGINT) AS tenths_value, CAST(round(c * 10) AS BIGINT) AS tenths_ceiling,
  CASE WHEN v <= 25.0 THEN 'met' WHEN round(v * 10) + 1 < round(c * 10) THEN 'loose' ELSE 'pinned' END AS status FROM m""")
def gate_float_slack(spark, d):
    found = ratchet.baseline_status(*A.supplier_floats(spark, d))
    return found.select("key", tenths(F.col("value")).alias("tenths_value"), tenths(F.col("ceiling")).alias("tenths_ceiling"), "status")


@query("""SELECT 'loc' AS metric, l_orderkey || '#' || l_linenumber AS key, CAST(max(l_quantity) AS BIGINT) AS value
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def duplicate_key_max(spark, d):
    rows = A.table(spark, d, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string"))
    return ratchet.duplicate_max(rows.select(F.lit("loc").alias("metric"), key.alias("key"), F.col("l_quantity").cast("long").alias("value")))


@query("""WITH s AS (SELECT l_suppkey, (sum(CAST(l_quantity AS BIGINT)) * 100 // count(*)) / 100.0 AS v FROM lineitem GROUP BY 1)
SELECT 'halstead' AS metric, 's' || l_suppkey AS key, CAST(round(CAST(v AS DOUBLE) * 10) + 1 AS BIGINT) AS ceiling_tenths FROM s WHERE v > 25.0""")
def fresh_baseline(spark, d):
    items, targets, _ = A.supplier_floats(spark, d)
    return tighten.fresh_baseline(items, targets).select("metric", "key", tenths(F.col("ceiling")).alias("ceiling_tenths"))


CLAMP = f"""WITH {PARTS},
old AS (SELECT key, ceiling FROM base), fresh AS (SELECT key, value AS ceiling FROM items WHERE value > 17),
clamped AS (SELECT key, o.ceiling AS old_ceiling, f.ceiling AS fresh_ceiling,
  CASE WHEN o.ceiling IS NULL THEN 'refused' WHEN f.ceiling IS NULL THEN 'removed' WHEN f.ceiling < o.ceiling THEN 'lowered'
       WHEN f.ceiling > o.ceiling THEN 'raise_refused' ELSE 'kept' END AS outcome
  FROM old o FULL JOIN fresh f USING (key))"""


def _clamped(spark, d):
    fresh = tighten.fresh_baseline(A.part_items(spark, d), A.part_targets(spark))
    return tighten.clamp(A.part_baseline(spark, d), fresh)


@query(CLAMP + """ SELECT 'cyclomatic' AS metric, key, old_ceiling, fresh_ceiling, outcome,
  CASE WHEN outcome = 'lowered' THEN fresh_ceiling WHEN outcome IN ('kept', 'raise_refused') THEN old_ceiling END AS ceiling FROM clamped""")
def tighten_clamp(spark, d):
    ceilings = {c: F.col(c).cast("long") for c in ("old_ceiling", "fresh_ceiling", "ceiling")}
    return _clamped(spark, d).withColumns(ceilings)


@query(CLAMP + """ SELECT count(*) FILTER (outcome = 'removed') AS removed, count(*) FILTER (outcome = 'lowered') AS lowered,
  count(*) FILTER (outcome IN ('refused', 'raise_refused')) AS refused FROM clamped""")
def tighten_summary(spark, d):
    return tighten.summary(_clamped(spark, d))


@query(CLAMP + " SELECT coalesce(bool_or(outcome IN ('removed', 'lowered')), false) AS needed FROM clamped")
def tighten_needed(spark, d):
    return tighten.needs_tightening(_clamped(spark, d))


@query("""WITH c AS (SELECT p_type AS grp, p_brand AS key, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS o,
  count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT 'lint_groups' AS metric, grp, key, CASE WHEN o > 2 THEN o END AS old_ceiling, CASE WHEN n > 3 THEN n END AS fresh_ceiling,
  CASE WHEN o <= 2 THEN 'refused' WHEN n <= 3 THEN 'removed' WHEN n < o THEN 'lowered' WHEN n > o THEN 'raise_refused' ELSE 'kept' END AS outcome,
  CASE WHEN o <= 2 OR n <= 3 THEN NULL WHEN n < o THEN n ELSE o END AS ceiling FROM c WHERE o > 2 OR n > 3""")
def tighten_groups(spark, d):
    late = F.col("l_shipdate") >= F.lit(A.SPLIT).cast("timestamp_ntz")
    rows = A.table(spark, d, "lineitem").join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counted = rows.groupBy(F.col("p_type").alias("grp"), F.col("p_brand").alias("key")).agg(F.count_if(~late).alias("o"), F.count_if(late).alias("n"))
    side = lambda c, least: counted.where(F.col(c) > least).select(F.lit("lint_groups").alias("metric"), "grp", "key", F.col(c).alias("ceiling"))
    return tighten.clamp(side("o", 2), side("n", 3), keys=("metric", "grp", "key"))


YEARS = """y AS (SELECT year(l_shipdate) AS yr, count(*) AS n, count(*) FILTER (l_quantity > 25) AS c FROM lineitem GROUP BY 1),
p AS (SELECT CAST(yr AS INTEGER) AS yr, c / n * 100.0 AS percent, CASE WHEN yr % 3 = 0 THEN NULL WHEN yr % 3 = 1 THEN 48.0 ELSE 52.0 END AS floor FROM y)"""


def _years(spark, d):
    rows = A.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("c"))
    floor = F.when(F.col("yr") % 3 == 1, 48.0).when(F.col("yr") % 3 == 2, 52.0)
    return rows.select("yr", (F.col("c") / F.col("n") * 100.0).alias("percent"), F.lit(60.0).alias("target"), floor.alias("floor"))


@query(f"""WITH {YEARS} SELECT yr, CAST(round(percent * 100) AS BIGINT) AS hundredths,
  CASE WHEN percent < coalesce(floor, 60.0) THEN 'below_floor' WHEN floor IS NOT NULL AND percent >= 60.0 THEN 'met'
       WHEN percent - floor > 1.0 + 1e-9 THEN 'loose' ELSE 'ok' END AS status FROM p""")
def coverage_floor_rule(spark, d):
    return ratchet.coverage_rule(_years(spark, d)).select("yr", scaled(F.col("percent"), 100).alias("hundredths"), "status")


@query(f"""WITH {YEARS}, f AS (SELECT yr, CAST(round(floor * 10) AS BIGINT) AS o, CAST(round(greatest(percent - 0.5, 0) * 10) AS BIGINT) AS n FROM p)
SELECT yr, o AS old_floor, n AS fresh_floor, CASE WHEN o IS NULL THEN 'refused' WHEN n > o THEN 'lowered' ELSE 'kept' END AS outcome,
  CASE WHEN o IS NULL THEN NULL WHEN n > o THEN n ELSE o END AS floor FROM f""")
def coverage_floor_clamp(spark, d):
    fresh = tighten.fresh_floor(_years(spark, d).withColumnRenamed("floor", "old"))
    return tighten.clamp_floor(fresh.select("yr", tenths(F.col("old")).alias("old_floor"), tenths(F.col("floor")).alias("fresh_floor")))


LINES = """lines AS (SELECT 'o' || l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS hits
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
SPANS = """funcs AS (SELECT 'o' || o_orderkey AS file, name, o_orderkey * 3 + nth AS ord, s, e, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cc
  FROM orders, (VALUES ('head', 0, 1, 3), ('tail', 1, 4, 7), ('inner', 2, 2, 2)) v(name, nth, s, e))"""


@query(f"WITH {LINES} SELECT file, line, hits FROM lines")
def line_hits(spark, d):
    return coverage.line_hits(A.coverage_records(spark, d))


@query(f"""WITH {LINES} SELECT count(*) AS instrumented, count(*) FILTER (hits > 0) AS covered,
  CAST(round(count(*) FILTER (hits > 0) / count(*) * 100 * 100) AS BIGINT) AS hundredths FROM lines""")
def total_coverage(spark, d):
    return coverage.totals(coverage.line_hits(A.coverage_records(spark, d))).select("instrumented", "covered", scaled(F.col("percent"), 100).alias("hundredths"))


CRAP = f"""WITH {LINES}, {SPANS},
crap AS (SELECT f.file, f.name, f.ord, f.cc, count(*) AS n, count(*) FILTER (hits > 0) AS c
  FROM funcs f JOIN lines l ON l.file = f.file AND l.line BETWEEN f.s AND f.e GROUP BY 1, 2, 3, 4),
scores AS (SELECT file, name, ord, cc AS cyclomatic, CAST(round(CAST(cc AS DOUBLE) * cc * pow(1.0 - c / n, 3.0) * 10 + cc * 10) AS BIGINT) AS crap_tenths,
  CAST(cc AS DOUBLE) * cc * pow(1.0 - c / n, 3.0) + cc AS crap FROM crap)"""


def _crap(spark, d):
    scores = coverage.crap_scores(A.order_functions(spark, d), coverage.line_hits(A.coverage_records(spark, d)))
    return scores.withColumn("crap_tenths", scaled(F.col("crap"), 10))


@query(CRAP + " SELECT file, name, cyclomatic, crap_tenths FROM scores")
def crap_scores(spark, d):
    return _crap(spark, d).select("file", "name", "cyclomatic", "crap_tenths")


@query(CRAP + " SELECT file, name, cyclomatic, crap_tenths FROM scores ORDER BY crap DESC, ord LIMIT 20")
def crap_topk(spark, d):
    scores = _crap(spark, d)
    return scores.orderBy(*coverage.crap_order(scores)).limit(20).select("file", "name", "cyclomatic", "crap_tenths")


@query(f"WITH {LINES}, {SPANS} SELECT file, line, hits FROM lines l WHERE EXISTS (SELECT 1 FROM funcs f WHERE f.file = l.file AND l.line BETWEEN f.s AND f.e)")
def production_lines(spark, d):
    return coverage.production_lines(coverage.line_hits(A.coverage_records(spark, d)), A.order_functions(spark, d))


FINDINGS = """found AS (SELECT DISTINCT CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.CODES.items()) + """ ELSE 'clippy::x_' || event_type END AS code,
  'u' || user_id AS file, CAST(day(ts) AS BIGINT) AS line, CAST(1 AS BIGINT) AS "column", 'm' AS message FROM events),
classed AS (SELECT *, CASE WHEN starts_with(code, 'clippy::too_') THEN 'group:size' WHEN code = 'clippy::unwrap_used' THEN 'group:unwraps'
  WHEN starts_with(code, 'clippy::t') THEN 'group:wide' WHEN code IN ('dead_code', 'unused_mut') THEN 'dead'
  WHEN starts_with(code, 'clippy::needless') THEN 'redundant' END AS kind FROM found)"""


def _classed(spark, d):
    return lints.classify(lints.deduplicated(A.findings(spark, d)), A.lint_groups(spark))


@query(f'WITH {FINDINGS} SELECT code, file, line, "column", message FROM found')
def lint_findings_dedup(spark, d):
    return lints.deduplicated(A.findings(spark, d))


@query(f"WITH {FINDINGS} SELECT code, kind, count(*) AS n FROM classed GROUP BY ALL")
def lint_classify(spark, d):
    return _classed(spark, d).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


ITEMS = FINDINGS + """, spans AS (SELECT * FROM (VALUES ('a', 0, 1, 10), ('b', 1, 6, 10), ('c', 2, 5, 9), ('d', 3, 15, 20)) v(name, ord, s, e)),
owned AS (SELECT c.*, (SELECT name FROM spans WHERE c.line BETWEEN s AND e ORDER BY e - s, ord LIMIT 1) AS fn FROM classed c WHERE kind IS NOT NULL),
keyed AS (SELECT kind, code, file, code || '@' || file || CASE WHEN fn IS NULL THEN '#L' || line ELSE '::' || fn END AS item,
  file || CASE WHEN fn IS NULL THEN '' ELSE '::' || fn END AS entity FROM owned)"""


def _items(spark, d):
    return lints.tally(lints.with_item(_classed(spark, d), A.user_functions(spark, d)))


@query(f"WITH {ITEMS} SELECT kind, item, count(*) AS n FROM keyed GROUP BY ALL")
def lint_item_counts(spark, d):
    return _items(spark, d)


@query(f"WITH {ITEMS} SELECT kind, code AS lint, entity, count(*) AS n FROM keyed GROUP BY ALL")
def lint_rollup_file(spark, d):
    return lints.rolled_up(_items(spark, d))


@query(f"WITH {FINDINGS} SELECT g.grp, CAST(count(c.code) AS BIGINT) AS n FROM (VALUES ('size'), ('unwraps'), ('wide')) g(grp) LEFT JOIN classed c ON c.kind = 'group:' || g.grp GROUP BY g.grp")
def lint_group_totals(spark, d):
    return lints.group_totals(A.lint_groups(spark), _items(spark, d))


@query(f'WITH {FINDINGS} SELECT code, file, line, "column", message FROM classed WHERE kind IS NOT NULL ORDER BY code, file, line, "column", message LIMIT 20')
def lint_examples(spark, d):
    return lints.examples(_classed(spark, d))


PATTERNS = """p AS (SELECT DISTINCT 'type' AS grp, split_part(p_type, ' ', 1) || '*' AS pattern FROM part UNION SELECT DISTINCT 'brand', substr(p_brand, 1, 7) || '*' FROM part
  UNION SELECT DISTINCT 'exact', p_type FROM part)"""


def _patterns(spark, d):
    part = A.table(spark, d, "part")
    one = part.select(F.lit("type").alias("grp"), F.concat(F.split("p_type", " ")[0], F.lit("*")).alias("pattern"))
    two = part.select(F.lit("brand"), F.concat(F.substring("p_brand", 1, 7), F.lit("*")))
    return one.union(two).union(part.select(F.lit("exact"), "p_type")).distinct()


@query(f"""WITH {PATTERNS}, s AS (SELECT *, ends_with(pattern, '*') AS star, CASE WHEN ends_with(pattern, '*') THEN left(pattern, length(pattern) - 1) ELSE pattern END AS stem FROM p)
SELECT a.grp AS grp_a, a.pattern AS pattern_a, b.grp AS grp_b, b.pattern AS pattern_b FROM s a JOIN s b ON (a.grp < b.grp OR (a.grp = b.grp AND a.pattern < b.pattern))
 AND CASE WHEN a.star AND b.star THEN starts_with(a.stem, b.stem) OR starts_with(b.stem, a.stem) WHEN a.star THEN starts_with(b.pattern, a.stem)
          WHEN b.star THEN starts_with(a.pattern, b.stem) ELSE a.pattern = b.pattern END""")
def pattern_overlap(spark, d):
    return lints.overlaps(_patterns(spark, d))


@query(f"""WITH {PATTERNS} SELECT p.grp, p.pattern, count(DISTINCT t.p_type) AS n_codes FROM p LEFT JOIN (SELECT DISTINCT p_type FROM part) t
 ON CASE WHEN ends_with(p.pattern, '*') THEN starts_with(t.p_type, left(p.pattern, length(p.pattern) - 1)) ELSE p.pattern = t.p_type END GROUP BY 1, 2""")
def pattern_resolution(spark, d):
    return lints.resolve(_patterns(spark, d), A.table(spark, d, "part").select(F.col("p_type").alias("code")))


LOG = """log AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS code, CAST(user_id AS VARCHAR) AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_id % 3 AS shape, event_id % 11 = 0 AS broken FROM events)"""


def _log(spark, d):
    """The events as the lines of a lint log: some without a code, without a primary span, or no JSON at all."""
    number = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    events = source.dealt(A.table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), "event_id").withColumn("k", number)
    k = F.col("k")
    span = lambda line, primary: F.struct(F.concat(F.lit("./src/u"), F.col("user_id").cast("string"), F.lit(".rs")).alias("file_name"), line.alias("line_start"), F.lit(3).cast("long").alias("column_start"), primary.alias("is_primary"))
    shape = F.col("event_id") % 3
    spans = F.when(shape == 0, F.array(span(k + 1, F.lit(False)), span(k, F.lit(True)))).when(shape == 1, F.array(span(-k - 1, F.lit(True)))).otherwise(F.array(span(k, F.lit(False))))
    code = F.when(F.col("event_id") % 7 != 0, F.struct(F.col("event_type").alias("code")))
    line = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.struct(F.lit("warning").alias("level"), F.lit("m").alias("message"), code.alias("code"), spans.alias("spans")).alias("message")))
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), line)).otherwise(line)
    return lintlog.parsed(events.select(F.col("event_id").alias("ord"), text.alias("line")))


@query(f"""WITH {LOG} SELECT code, CASE shape WHEN 2 THEN '<unknown>' ELSE 'src/u' || u || '.rs' END AS file, CASE shape WHEN 0 THEN k ELSE 0 END AS line,
  CAST(CASE shape WHEN 2 THEN 0 ELSE 3 END AS BIGINT) AS "column", 'm' AS message FROM log WHERE code IS NOT NULL AND NOT broken""")
def lint_log_findings(spark, d):
    return lintlog.findings(_log(spark, d), "/elsewhere")


@query(f"""WITH {LOG} SELECT CASE WHEN broken THEN 'malformed' ELSE 'not finished' END AS fault, count(*) AS n FROM
 (SELECT broken FROM log WHERE broken UNION ALL SELECT false) GROUP BY 1""")
def lint_log_faults(spark, d):
    return lintlog.faults(_log(spark, d), []).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (NOT (event_id % 11 = 0)) = 0 AS stale FROM events")
def lint_log_stale(spark, d):
    return lintlog.stale(_log(spark, d))


@query("""SELECT 'quantity@' || k AS id, 'quantity' AS metric, k AS entity, CAST(round(q * 10) AS BIGINT) AS value, CAST(10 AS BIGINT) AS scale FROM
 (SELECT l_orderkey || '#' || l_linenumber AS k, max(l_quantity) AS q, max(l_discount) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'discount@' || k, 'discount', k, CAST(round(c * 100) AS BIGINT), 100 FROM
 (SELECT l_orderkey || '#' || l_linenumber AS k, max(l_quantity) AS q, max(l_discount) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def observations_long(spark, d):
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string"))
    wide = A.table(spark, d, "lineitem").groupBy(key.alias("entity")).agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    return observe.to_long(wide, "entity", {"quantity": 10, "discount": 100}).select("id", "metric", "entity", "value", "scale")


def _side(year: int) -> str:
    value = "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE n END" if year == 1996 else "n"
    return f"""(SELECT 'cyclomatic@p' || l_partkey AS id, 'p' || l_partkey AS entity, false AS lint, {value} AS v, 4 AS t
  FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1)
  UNION ALL SELECT 'dead_code@p' || l_partkey, 'p' || l_partkey, true, n, 0
  FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1) WHERE n > 3)"""


COMPARED = f"""WITH b AS {_side(1996)}, a AS {_side(1997)},
j AS (SELECT coalesce(b.id, a.id) AS id, coalesce(b.t, a.t) AS target, coalesce(b.lint, a.lint) AS lint, b.id IS NOT NULL AS bh, a.id IS NOT NULL AS ah, b.v AS bv, a.v AS av FROM b FULL JOIN a ON a.id = b.id),
k AS (SELECT *, coalesce(bv, CASE WHEN lint THEN 0 ELSE target END) AS o, coalesce(av, 0) AS n FROM j),
c AS (SELECT id, CAST(target AS BIGINT) AS target, CAST(1 AS BIGINT) AS scale, CAST(o AS BIGINT) AS before, CAST(n AS BIGINT) AS after,
  CAST(greatest(0, o - target) AS BIGINT) AS excess_before, CAST(greatest(0, n - target) AS BIGINT) AS excess_after,
  CASE WHEN NOT ah AND NOT lint THEN 'disappeared' WHEN bh AND ah AND (bv IS NULL) <> (av IS NULL) THEN 'availability_changed'
       WHEN (bh AND bv IS NULL) OR (ah AND av IS NULL) THEN 'ignored' WHEN greatest(0, n - target) < greatest(0, o - target) THEN 'improved'
       WHEN greatest(0, n - target) > greatest(0, o - target) THEN 'regressed' ELSE 'unchanged' END AS outcome FROM k)"""


def _compared(spark, d):
    return compare.compared(A.snapshot_side(spark, d, 1996), A.snapshot_side(spark, d, 1997))


@query(COMPARED + " SELECT id, target, scale, before, after, excess_before, excess_after, outcome FROM c")
def snapshot_compare(spark, d):
    return _compared(spark, d)


@query(COMPARED + """, s AS (SELECT count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'regressed') AS regressed,
  count(*) FILTER (outcome IN ('disappeared', 'availability_changed')) AS items FROM c)
SELECT CASE WHEN items > 0 THEN 'incomparable' ELSE 'complete' END AS measurement,
  CASE WHEN items > 0 THEN 'incomparable' WHEN regressed > 0 THEN 'regressed' WHEN improved > 0 THEN 'improved' ELSE 'unchanged' END AS quality_change,
  items = 0 AND regressed = 0 AND improved > 0 AS eligible_to_tighten, 'none' AS baseline_action, items AS n_reasons, improved, regressed FROM s""")
def snapshot_decision(spark, d):
    none = spark.createDataFrame([], "reason string")
    found = compare.decision(_compared(spark, d), none)
    return found.withColumn("n_reasons", F.size("reasons").cast("long")).drop("reasons")


@query("""WITH b AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'old/' ELSE '' END || doc_id AS id, sha256(text) AS hash FROM documents),
a AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'new/' ELSE '' END || doc_id AS id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS hash FROM documents)
SELECT 'test' AS kind, b.id FROM b LEFT JOIN a USING (id) WHERE a.hash IS DISTINCT FROM b.hash
UNION ALL SELECT 'gate', b.id FROM b LEFT JOIN a USING (id) WHERE coalesce(a.hash, sha256('')) <> b.hash
UNION ALL SELECT 'removed', b.id FROM b WHERE id NOT IN (SELECT id FROM a)""")
def compat_reasons(spark, d):
    """All documents on both sides: some renamed since, some new under their name, some with another text."""
    docs, n = A.table(spark, d, "documents"), F.col("doc_id")
    side = lambda prefix, text: docs.select(F.concat(prefix, n.cast("string")).alias("id"), F.sha2(text, 256).alias("hash"))
    before = side(F.when(n % 5 == 0, "old/").otherwise(""), F.col("text"))
    after = side(F.when(n % 6 == 0, "new/").otherwise(""), F.when(n % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    tests = compare.changed_tests(before, after).select(F.lit("test").alias("kind"), "id")
    gates = compare.changed_gates(before, after).select(F.lit("gate").alias("kind"), "id")
    return tests.union(gates).union(compare.removed(before, after, "id").select(F.lit("removed").alias("kind"), "id"))


@query("""SELECT 'l' || l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS hits
  FROM lineitem""")
def trace_records(spark, d):
    """Orders as records of a trace, one block each: source, lines (some with a count that is no number), end."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    orders = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    data = F.transform("items", lambda x: F.concat(F.lit("DA:"), x["n"].cast("string"), F.lit(","), F.when(x["n"] % 5 == 0, "-").otherwise(x["q"].cast("string"))))
    record = F.concat(F.array(F.lit("TN:"), F.concat(F.lit("SF:.\\l"), F.col("l_orderkey").cast("string"))), data, F.array(F.lit("end_of_record"), F.lit("DA:1,1")))
    lines = orders.select(F.lit("trace").alias("trace"), F.col("l_orderkey").alias("block"), F.posexplode(record).alias("ord", "line"))
    return lcov.line_records(lines)


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY text)) AS digest FROM conversations GROUP BY conv_id")
def gate_digest(spark, d):
    return observe.sorted_digest(A.table(spark, d, "conversations"), ["conv_id"], "text")


@query("""WITH f AS (SELECT 's' || (p_partkey % 50) AS file, 'T' || (p_size % 20) AS name FROM part), dd AS (SELECT DISTINCT file, name FROM f),
i AS (SELECT DISTINCT 'T' || (s_nationkey % 20) AS name FROM supplier), r AS (SELECT DISTINCT CASE WHEN c_nationkey % 3 = 0 THEN 'U' ELSE 'T' END || (c_nationkey % 20) AS name FROM customer)
SELECT dd.file || '::' || dd.name AS item, CASE WHEN i.name IS NULL THEN 1 ELSE 0 END AS missing FROM dd JOIN r USING (name) LEFT JOIN i USING (name)""")
def error_type_scan(spark, d):
    """Parts define types, suppliers implement them, customers return them and some others that no part defines."""
    t = lambda c, prefix=F.lit("T"): F.concat(prefix, (c % 20).cast("string")).alias("name")
    defined = A.table(spark, d, "part").select(F.lit("root").alias("root"), F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")).alias("file"), t(F.col("p_size")))
    implemented = A.table(spark, d, "supplier").select(F.lit("root").alias("root"), t(F.col("s_nationkey")))
    returned = A.table(spark, d, "customer").select(F.lit("root").alias("root"), t(F.col("c_nationkey"), F.when(F.col("c_nationkey") % 3 == 0, "U").otherwise("T")))
    return observe.error_types(defined, implemented, returned)


@query("""WITH v AS (SELECT event_id AS ord, CASE event_type WHEN 'click' THEN 'cyclomatic: x' WHEN 'view' THEN 'lints.size: y (or run --tighten)' WHEN 'purchase' THEN 'lints.size: y' ELSE 'nothing: z' END AS text FROM events),
k AS (SELECT ord, CASE WHEN ends_with(text, '(or run --tighten)') THEN 'baseline' WHEN starts_with(text, 'lints.') THEN 'lints' ELSE split_part(text, ': ', 1) END AS metric FROM v)
SELECT metric, min(ord) AS first_ord FROM k WHERE metric IN ('baseline', 'lints', 'cyclomatic') GROUP BY metric""")
def hints_lookup(spark, d):
    text = (
        F.when(F.col("event_type") == "click", "cyclomatic: x")
        .when(F.col("event_type") == "view", "lints.size: y (or run --tighten)")
        .when(F.col("event_type") == "purchase", "lints.size: y")
        .otherwise("nothing: z")
    )
    found = A.table(spark, d, "events").select(F.col("event_id").alias("ord"), text.alias("text"))
    return hints.for_violations(found).select("metric", "first_ord")


@query("""WITH c AS (SELECT bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels),
have AS (SELECT 'source' AS name, CASE WHEN q THEN 'passed' ELSE 'failed' END AS status FROM c UNION ALL SELECT 'clippy', CASE WHEN t THEN 'failed' ELSE 'passed' END FROM c),
need AS (SELECT * FROM (VALUES ('source', 'passed'), ('clippy', 'passed'), ('tests', 'passed'), ('doctests', 'not_applicable'), ('coverage', 'passed')) v(name, needed))
SELECT name, needed, status FROM need LEFT JOIN have USING (name) WHERE status IS DISTINCT FROM needed""")
def required_checks(spark, d):
    flags = A.table(spark, d, "labels").agg(F.bool_or(F.col("quality") == 1).alias("q"), F.bool_or(F.col("toxic") == 1).alias("t"))
    source = flags.select(F.lit("source").alias("name"), F.when(F.col("q"), "passed").otherwise("failed").alias("status"))
    clippy = flags.select(F.lit("clippy").alias("name"), F.when(F.col("t"), "failed").otherwise("passed").alias("status"))
    return compare.failed_checks(source.union(clippy), coverage=True)


@query("""SELECT count(*) AS total, count(*) FILTER (toxic = 0 AND quality = 1) AS caught, count(*) FILTER (toxic = 1 AND quality = 1) AS missed,
  count(*) FILTER (toxic = 1 AND quality = 0) AS timeout, count(*) FILTER (toxic = 0 AND quality = 0) AS unviable, count(*) FILTER (toxic = 1 AND quality = 1) <= 0 AS passes_gate FROM labels""")
def mutant_summary(spark, d):
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    outcome = F.when(~toxic & good, "caught").when(toxic & good, "missed").when(toxic, "timeout").otherwise("unviable")
    return ratchet.mutants_rule(mutants.summarised(A.table(spark, d, "labels").select(outcome.alias("summary"))))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \\t\\r\\n]')) AS tok FROM documents),
k AS (SELECT doc_id, tok, regexp_matches(tok, '^[A-Za-z0-9_]') AS operand FROM t)
SELECT doc_id, count(DISTINCT tok) FILTER (NOT operand) AS n1, count(DISTINCT tok) FILTER (operand) AS n2, count(*) FILTER (operand) AS total_n2 FROM k GROUP BY doc_id""")
def halstead_documents(spark, d):
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \t\r\n]"), F.lit(0))
    rows = A.table(spark, d, "documents").select("doc_id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("doc_id", *observe.halstead_of(F.col("tokens"), lambda t: t.rlike("^[A-Za-z0-9_]")))


@query("""WITH w AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN conv_id || '/' || turn WHEN role = 'system' THEN '' END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM conversations)
SELECT conv_id, turn, CASE WHEN file = '' THEN NULL ELSE file END AS file FROM w""")
def carry_forward(spark, d):
    """Conversations as traces: a user's turn names a source, a system's ends a record, others stand inside."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    line = F.when(F.col("role") == "user", F.concat(F.lit("SF:"), conv, F.lit("/"), turn)).when(F.col("role") == "system", "end_of_record").otherwise("TN:")
    order = F.struct("turn", "role", "text")
    rows = A.table(spark, d, "conversations").select(conv.alias("trace"), F.expr("turn div 3").alias("block"), order.alias("ord"), line.alias("line"), "conv_id", "turn")
    return lcov.with_file(rows, "").select("conv_id", "turn", "file")


@query()
def code_lines_scan(spark, d):
    files = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return source.code_lines(files).select("file", F.size("code_lines").cast("long").alias("n_code_lines"), F.sha2(F.array_join(F.transform("code_lines", lambda x: x.cast("string")), ","), 256).alias("lines_sha256"))


def _generated(spark, d):
    """Rust files made from parts, whose counts follow from p_size."""
    body = F.concat(
        F.lit("#[allow(a)]\npub fn f(x: Rc<u8>) -> u8 {\n"),
        F.repeat(F.lit("    if a { b(); }\n"), F.col("p_size") % 5),
        F.repeat(F.lit("    x.unwrap(); // c\n\n"), F.col("p_size") % 3),
        F.lit("    0\n}\n#[cfg(test)]\nmod t {\n fn g() {}\n}\n"),
    )
    return _files(spark, d, body)


def _files(spark, d, body):
    name = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".rs"))
    parts = source.dealt(A.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select(F.lit("src").alias("root"), F.lit(0).alias("root_ord"), name.alias("file"), F.col("p_partkey").alias("ord"), body.alias("content"))


def _varied(spark, d):
    """Files with nested branches, matches, macros, unsafe blocks, getters, groups of warnings and error types.

    a, b, c and e are small numbers from p_size, and each shape is repeated so many times.
    """
    times = lambda text, n: F.repeat(F.lit(text), n)
    a, b, c, e = (F.col("p_size") % n for n in (2, 3, 4, 5))
    body = F.concat(
        F.lit("#![deny(warnings)]\n"),
        times("#![forbid(unused, missing_docs)]\n", a),
        F.lit("/* a\n comment */ use x::y; // kept\n\n"),
        F.lit("impl S {\n    pub fn get_size(&self) -> Result<u8, Fault> {\n"),
        times("        for i in v { if p && q || r { while s { t(); } } else { u(); } }\n", b),
        times("        match k { 1 => m(), 2 if g => n(), _ => {} }\n", c),
        times('        unsafe { w.expect("why") };\n', e),
        times("        unreachable!();\n        assert!(ok);\n        assert_eq!(l, r, \"said\");\n", a),
        times("        let z = |h| if h { 1 } else { 2 };\n", b),
        F.lit("        Ok(1 + 1)\n    }\n}\npub struct Fault;\n"),
        times("impl std::error::Error for Fault {}\n", a),
        F.lit("#[cfg(test)]\nmod t {\n    #[test]\n    fn g() { todo!() }\n}\n"),
    )
    return _files(spark, d, body)


SHAPES = "SELECT 'src/p' || p_partkey || '.rs' AS file, p_size % 2 AS a, p_size % 3 AS b, p_size % 4 AS c, p_size % 5 AS e FROM part"


@query(f"""WITH s AS ({SHAPES}) SELECT file, 'S::get_size' AS name, 1 + 6 * b + 2 * c AS cyclomatic, 12 * b + c AS cognitive, e AS unsafe_count,
  e + 3 * a AS panic_count, 2 * a AS bare_panic_count, 0 AS allow_count, 0 AS pub_wrapper_count, 1 AS get_prefix_count FROM s""")
def function_shapes(spark, d):
    rows = source.function_rows(source.measured(source.production(_varied(spark, d))))
    return rows.select("file", "name", "cyclomatic", "cognitive", "unsafe_count", "panic_count", "bare_panic_count", "allow_count", "pub_wrapper_count", "get_prefix_count")


@query(f"WITH s AS ({SHAPES}) SELECT file, CAST(8 + 5 * a + 2 * b + c + e AS BIGINT) AS loc, 1 + a AS deny_warnings_count FROM s")
def file_shapes(spark, d):
    return source.file_rows(source.measured(_varied(spark, d))).select("file", "loc", "deny_warnings_count")


@query(f"WITH s AS ({SHAPES}) SELECT file || '::Fault' AS item, CASE WHEN (SELECT max(a) FROM s) = 1 THEN 0 ELSE 1 END AS missing FROM s")
def error_types_of_files(spark, d):
    return source.error_rows(source.measured(_varied(spark, d)))


@query("""SELECT 'src/p' || p_partkey || '.rs' AS file, 1.0 * 4 / 2 * (6.0 + p_size % 5) / (CASE WHEN p_size % 5 = 0 THEN 3 ELSE 4 END) AS halstead_difficulty FROM part""")
def halstead_of_files(spark, d):
    """Operators {} = + ;, operands x, 1, 2 and w; w is used once for each fifth of p_size."""
    body = F.concat(F.lit("fn f() { x = 1 + 2; x = 1 + 2; "), F.repeat(F.lit("w;"), F.col("p_size") % 5), F.lit("}"))
    rows = source.function_rows(source.measured(_files(spark, d, body)))
    return rows.select("file", "halstead_difficulty")


@query(f"WITH s AS ({SHAPES}) SELECT file, CAST(8 + 5 * a + 2 * b + c + e + 5 AS BIGINT) AS n FROM s")
def code_lines(spark, d):
    return source.code_lines(_varied(spark, d)).select("file", F.size("code_lines").cast("long").alias("n"))


@query("""SELECT 'src/p' || p_partkey || '.rs' AS file, 'f' AS name, CAST(1 AS BIGINT) AS start_line,
  CAST(4 + p_size % 5 + 2 * (p_size % 3) AS BIGINT) AS end_line, 1 + p_size % 5 AS cyclomatic, p_size % 5 AS cognitive, p_size % 3 AS panic_count,
  p_size % 3 AS bare_panic_count, 1 AS allow_count, 1 AS pub_wrapper_count FROM part""")
def function_metrics(spark, d):
    rows = source.function_rows(source.measured(source.production(_generated(spark, d))))
    return rows.select("file", "name", "start_line", "end_line", "cyclomatic", "cognitive", "panic_count", "bare_panic_count", "allow_count", "pub_wrapper_count")


@query("""SELECT 'src/p' || p_partkey || '.rs' AS file, CAST(4 + p_size % 5 + p_size % 3 AS BIGINT) AS loc, 0 AS allow_count, 0 AS deny_warnings_count FROM part""")
def file_metrics(spark, d):
    return source.file_rows(source.measured(_generated(spark, d))).select("file", "loc", "allow_count", "deny_warnings_count")


@query()
def contract_hashes(spark, d):
    return source.contracts(_generated(spark, d))
