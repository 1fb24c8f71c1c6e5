"""Queries for the case suite and for graph upkeep, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import suite, upkeep
from ..sources import fixtures as fx
from .io_plans import folder
from .shapes import FACTS, OBSERVATIONS

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NOT_YEAR = "NOT (value = floor(value) AND value BETWEEN 2015 AND 2030)"
HASH = "CAST('0x' || substr(sha256({0}), 1, 14) AS BIGINT)"
FOUR = "sign({0}) * floor(abs({0}) * 10000 + 0.5) / 10000.0::DOUBLE"
ID = "substr(sha256({0}), 1, 16)"
SUITE_SQL = f"""WITH RECURSIVE {FACTS}, raw AS (SELECT ticker, metric, year, ordinal, value FROM facts_raw UNION ALL SELECT ticker, metric, year, 'T', value FROM facts WHERE metric IN ('gross_profit', 'operating_income', 'net_income')),
  ok AS (SELECT * FROM raw WHERE ticker <> '' AND metric <> ''), firsts AS (SELECT ticker, metric, year, arg_min(value, ordinal) AS value FROM ok GROUP BY ALL), lasts AS (SELECT ticker, metric, year, arg_max(value, ordinal) AS value FROM ok GROUP BY ALL),
  f AS (SELECT * FROM firsts WHERE {NOT_YEAR}), l AS (SELECT *, {HASH.format("metric || '|' || year || '|' || ticker")} AS h FROM lasts WHERE {NOT_YEAR} AND metric IN ('total_revenue', 'gross_profit', 'operating_income', 'net_income', 'operating_expense', 'cost_of_sales', 'income_tax_expense')),
  m AS (SELECT n.ticker, CASE n.metric WHEN 'gross_profit' THEN 'gross_margin' WHEN 'operating_income' THEN 'operating_margin' ELSE 'net_margin' END AS metric, n.year, n.value AS num, d.value AS den, n.value / d.value * 100 AS r FROM f n JOIN f d USING (ticker, year) WHERE d.metric = 'total_revenue' AND d.value <> 0 AND n.metric IN ('gross_profit', 'operating_income', 'net_income')),
  mh AS (SELECT *, {HASH.format("metric || '|' || year || '|' || ticker")} AS h FROM m), g AS (SELECT ticker, year, value, {HASH.format("'total_revenue|' || ticker")} AS h FROM f WHERE metric = 'total_revenue'),
  gp AS (SELECT a.ticker AS a, b.ticker AS b, (a.h + b.h) % 72057594037927936 AS rank, min(year) AS y0, max(year) AS y1, arg_min(a.value, year) AS a0, arg_max(a.value, year) AS a1, arg_min(b.value, year) AS b0, arg_max(b.value, year) AS b1 FROM g a JOIN g b USING (year) WHERE a.ticker < b.ticker GROUP BY a.ticker, b.ticker, a.h, b.h HAVING min(year) < max(year)),
  gr AS (SELECT *, (a1 - a0) / abs(a0) * 100 AS ga, (b1 - b0) / abs(b0) * 100 AS gb FROM gp WHERE a0 <> 0 AND b0 <> 0),
  pairs AS (
    SELECT 'L1_direct' AS level, 'r14_l1_' || {ID.format("a.metric || a.year || a.ticker || b.ticker")} AS case_id, a.metric, a.year, NULL::INTEGER AS start_year, a.ticker AS a, b.ticker AS b, [a.value, b.value, abs(a.value - b.value)] AS s, [a.value, b.value] AS src, a.value > b.value AS win, (a.h + b.h) % 72057594037927936 AS rank FROM l a JOIN l b USING (metric, year) WHERE a.ticker < b.ticker AND a.value <> b.value
    UNION ALL SELECT 'L2_derived', 'r14_l2_' || {ID.format("a.metric || a.year || a.ticker || b.ticker")}, a.metric, a.year, NULL, a.ticker, b.ticker, [a.r, b.r, abs(a.r - b.r)], [a.num, a.den, b.num, b.den], a.r > b.r, (a.h + b.h) % 72057594037927936 FROM mh a JOIN mh b USING (metric, year) WHERE a.ticker < b.ticker AND a.r <> b.r
    UNION ALL SELECT 'L3_trend', 'r14_l3_' || {ID.format("y0 || '' || y1 || a || b")}, 'total_revenue_growth', y1, y0, a, b, [ga, gb, abs(ga - gb)], [a0, a1, b0, b1], ga > gb, rank FROM gr),
  pick AS (SELECT level, target, 0 AS n, -1::BIGINT AS rank, []::VARCHAR[] AS used, NULL::VARCHAR AS case_id FROM (VALUES ('L1_direct', 40), ('L2_derived', 30), ('L3_trend', 10)) t(level, target)
    UNION ALL SELECT level, target, n + 1, p.rank, used || [p.a, p.b], p.case_id FROM (SELECT pick.level, pick.target, pick.n, pick.used, (SELECT arg_min({{'rank': q.rank, 'a': q.a, 'b': q.b, 'case_id': q.case_id}}, q.rank) FROM pairs q WHERE q.level = pick.level AND q.rank > pick.rank AND len(list_filter(pick.used, lambda x: x = q.a)) < 8 AND len(list_filter(pick.used, lambda x: x = q.b)) < 8) AS p FROM pick WHERE pick.n < pick.target) WHERE p IS NOT NULL)
  SELECT p.case_id, p.level, p.metric, p.year, p.start_year, p.a AS company_a, p.b AS company_b, list_transform(p.s, lambda x: {FOUR.format('x')}) AS expected, p.src AS source_fact_numbers, CASE WHEN p.win THEN p.a ELSE p.b END AS winner
  FROM pairs p JOIN pick ON pick.case_id = p.case_id AND pick.level = p.level"""


@query("w5_case_suite", SUITE_SQL)
def _(spark, d):
    from ..operators import pairs

    raw = pairs.stored(fx.suite_facts(spark, d))
    s = suite.build(pairs.first_value(raw), pairs.last_value(raw))
    return s.select("case_id", "level", "metric", "year", "start_year", "company_a", "company_b", F.col("target_slots.expected").alias("expected"), "source_fact_numbers", "winner")


KEPT = f"""{OBSERVATIONS}, kept AS (SELECT case_id, ticker, raw_metric AS metric, year, value, unit, quote, ordinal, row_number() OVER (PARTITION BY case_id ORDER BY raw_metric, year, ordinal) AS place FROM observations WHERE unit <> '' AND quote <> '')"""


@query(
    "kg2_resume_and_rollback",
    f"""WITH {KEPT}, one AS (SELECT * FROM kept WHERE place <= 5), two AS (SELECT * FROM kept WHERE place > 5), steps AS (
      SELECT 'first' AS step, 'b1' AS kg_batch, count(*) AS observations, count(DISTINCT ticker) AS companies FROM one UNION ALL
      SELECT 'broken_off', 'b1', count(*), count(DISTINCT ticker) FROM one UNION ALL SELECT 'broken_off', 'b2', count(*), count(DISTINCT ticker) FROM two WHERE place % 3 = 0 UNION ALL
      SELECT 'resumed', 'b1', count(*), count(DISTINCT ticker) FROM one UNION ALL SELECT 'resumed', 'b2', count(*), count(DISTINCT ticker) FROM two UNION ALL
      SELECT 'rolled_back', 'b1', count(*), count(DISTINCT ticker) FROM one)
    SELECT step, kg_batch, observations, observations AS logged, companies, step = 'rolled_back' AS as_at_first FROM steps WHERE observations > 0""",
)
def _(spark, d):
    """Write a batch, break another off after a third, resume it, roll it back: the first state is there again, row by row."""
    store, facts = upkeep.Store(spark, folder(spark)), fx.upkeep_facts(spark, d)
    out = []

    def note(step: str, same=None) -> None:
        c = store.census().select(F.lit(step).alias("step"), "kg_batch", "observations", "logged", "companies", F.lit(bool(same)).alias("as_at_first"))
        c.write.parquet(f"{store.path}/notes/{step}")
        out.append(spark.read.schema(c.schema).parquet(f"{store.path}/notes/{step}"))

    def state():
        rows = store.observations().select(F.xxhash64("obs_id", "value", "unit", "quote", "kg_batch").cast("decimal(38,0)").alias("h"))
        return rows.agg(F.count("*"), F.sum("h")).first()

    store.write(facts.where("place <= 5"), "b1")
    first = state()
    note("first")
    store.write(facts.where("place > 5 and place % 3 = 0"), "b2")
    note("broken_off")
    store.write(facts.where("place > 5"), "b2", resume=True)
    note("resumed")
    store.roll_back("b2")
    note("rolled_back", state() == first)
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def graph_facts(spark, d):
    f = fx.upkeep_facts(spark, d)
    return f.withColumn("obs_id", F.concat_ws("__", "case_id", "metric", F.col("year").cast("string"))).withColumn("display", F.concat("metric", F.lit(" by "), "ordinal")).withColumn("at", F.concat("ordinal", F.lpad(F.col("place").cast("string"), 9, "0")))


def merged(spark, d):
    """The graph after two batches, the facts of ordinal A and then the others."""
    f = graph_facts(spark, d)
    n1, e1 = upkeep.graph_rows(f.where("ordinal = 'A'"))
    n2, e2 = upkeep.graph_rows(f.where("ordinal <> 'A'"))
    none_n, none_e = n1.limit(0), e1.limit(0)
    before_n, before_e = upkeep.merge_nodes(none_n, n1), upkeep.merge_edges(none_e, e1)
    return upkeep.merge_nodes(before_n, n2), upkeep.merge_edges(before_e, e2)


GRAPH = f"""{KEPT}, gf AS (SELECT *, case_id || '__' || metric || '__' || year AS obs_id, metric || ' by ' || ordinal AS display, ordinal || lpad(CAST(place AS VARCHAR), 9, '0') AS seen FROM kept),
  gn AS (SELECT 'Company' AS label, ticker AS id, ordinal, seen, 'Company ' || ticker AS made, NULL AS put FROM gf UNION ALL SELECT 'Metric', metric, ordinal, seen, display, NULL FROM gf UNION ALL SELECT 'FiscalYear', CAST(year AS VARCHAR), ordinal, seen, NULL, NULL FROM gf UNION ALL SELECT 'Observation', obs_id, ordinal, seen, seen, unit FROM gf),
  ge AS (SELECT obs_id AS src, 'MENTIONS_COMPANY' AS type, ticker AS dst, ordinal FROM gf UNION ALL SELECT obs_id, 'OBSERVES_METRIC', metric, ordinal FROM gf UNION ALL SELECT obs_id, 'OBSERVED_IN_YEAR', CAST(year AS VARCHAR), ordinal FROM gf)"""


@query("kg1_merged_nodes", f"WITH {GRAPH} SELECT label, id, arg_min(made, seen) AS made, arg_max(put, seen) AS put, min(ordinal) <> 'A' AS created FROM gn GROUP BY label, id")
def _(spark, d):
    n, _ = merged(spark, d)
    made = F.coalesce(F.try_element_at("on_create", F.lit("name")), F.try_element_at("on_create", F.lit("display_name")), F.try_element_at("on_create", F.lit("created_at")))
    return n.select("label", "id", made.alias("made"), F.try_element_at("on_set", F.lit("unit")).alias("put"), "created")


@query(
    "kg1_created_counts",
    f"WITH {GRAPH}, x AS (SELECT 'node' AS kind, label AS name, min(ordinal) <> 'A' AS c FROM gn GROUP BY label, id UNION ALL SELECT 'edge', type, min(ordinal) <> 'A' FROM ge GROUP BY src, type, dst) SELECT kind, name, count_if(c) AS created, count(*) AS total FROM x GROUP BY ALL",
)
def _(spark, d):
    return upkeep.created_counts(*merged(spark, d))


@query(
    "ag10_property_census",
    f"""WITH {GRAPH}, nodes AS (SELECT label, id, arg_min(made, seen) AS made, arg_max(put, seen) AS put FROM gn GROUP BY label, id), edges AS (SELECT DISTINCT src, type, dst FROM ge WHERE length(dst) % 7 <> 0 OR type <> 'MENTIONS_COMPANY' UNION ALL SELECT 'x', 'LOST', 'nowhere')
    SELECT 'node' AS kind, label AS name, NULL::VARCHAR AS detail, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, NULL, count(*) FROM edges GROUP BY type
    UNION ALL SELECT 'target', type, label, count(*) FROM edges LEFT JOIN (SELECT DISTINCT id, label FROM nodes) ON dst = id GROUP BY ALL
    UNION ALL SELECT 'key', label, CASE WHEN (label = 'Company' AND made IS NOT NULL AND length(id) < 3) OR (label = 'Observation') THEN 'set' ELSE 'null' END, count(*) FROM nodes WHERE label IN ('Company', 'Observation', 'FiscalYear') GROUP BY ALL
    UNION ALL SELECT 'property', label, p, count(*) FROM (SELECT label, unnest(CASE label WHEN 'Company' THEN CASE WHEN length(id) < 3 THEN ['name'] ELSE []::VARCHAR[] END WHEN 'Metric' THEN ['display_name'] WHEN 'Observation' THEN ['created_at', 'value', 'unit', 'ticker'] ELSE []::VARCHAR[] END) AS p FROM nodes) GROUP BY ALL""",
)
def _(spark, d):
    n, e = merged(spark, d)
    nameless = F.map_filter("on_create", lambda k, v: (k != "name") | (F.length("id") < 3))
    n = n.select("label", "id", F.map_concat(nameless, "on_set").alias("properties"))
    e = e.where("length(dst) % 7 <> 0 or type <> 'MENTIONS_COMPANY'").select("src", "type", "dst")
    lost = e.sparkSession.range(1).select(F.lit("x").alias("src"), F.lit("LOST").alias("type"), F.lit("nowhere").alias("dst"))
    return upkeep.property_census(n, e.unionByName(lost), {"Company": "name", "Observation": "value", "FiscalYear": "year"})


@query(
    "kg5_suite_integrity",
    f"""WITH {KEPT}, t AS (SELECT o_orderkey % 1000 AS case_id, 'm' || (o_orderkey // 1000 % 3) AS method FROM orders), c AS (SELECT DISTINCT o_orderkey % 1000 AS case_id, 'S' || (o_orderkey % 1000 % 9 + 1) AS a, 'S' || (o_orderkey % 1000 % 7 + 1) AS b FROM orders),
    s AS (SELECT DISTINCT o_orderkey % 1000 AS case_id, 'S' || (o_orderkey % 1000 % (6 + u) + 1) AS ticker FROM orders, (SELECT unnest([1, 3]) AS u) WHERE o_orderkey % 1000 % 10 <> 3 OR u = 1),
    x AS (SELECT 'duplicate_case_method' AS "check", (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY case_id, method HAVING count(*) > 1)) AS found, 0 AS expected UNION ALL SELECT 'trace_rows', (SELECT count(*) FROM t), (SELECT 3 * count(*) FROM c)
      UNION ALL SELECT 'cases_without_a_side', (SELECT count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.case_id = c.case_id AND ticker = a) OR NOT EXISTS (SELECT 1 FROM s WHERE s.case_id = c.case_id AND ticker = b)), 0
      UNION ALL SELECT 'observations', (SELECT count(*) FROM kept), 1000 UNION ALL SELECT 'placeholder_metrics', (SELECT count(*) FROM kept WHERE starts_with(metric, 'source_value')), 0 UNION ALL SELECT 'bad_metric_names', (SELECT count(*) FROM kept WHERE NOT regexp_matches(metric, '^[a-z][a-z0-9_]{{3,}}$')), 0)
    SELECT "check", CAST(found AS BIGINT) AS found, CAST(expected AS BIGINT) AS expected, found = expected AS ok FROM x""",
)
def _(spark, d):
    o = fx.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("case_id"))
    t = o.select("case_id", F.concat(F.lit("m"), (F.floor(F.col("o_orderkey") / 1000) % 3).cast("string")).alias("method"))
    side = lambda n: F.concat(F.lit("S"), (F.col("case_id") % n + 1).cast("string"))
    c = o.select("case_id").distinct().select("case_id", side(9).alias("company_a"), side(7).alias("company_b"))
    s = c.select("case_id", F.explode(F.when(F.col("case_id") % 10 == 3, F.array(side(7))).otherwise(F.array(side(7), side(9)))).alias("ticker"))
    return upkeep.integrity(t, c, s, fx.upkeep_facts(spark, d).select("metric"), 3, 1000)
