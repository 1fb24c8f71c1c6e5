"""Queries for evidence of facts in answers, pools of cases and the bounded stream, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, select
from ..sources import fixtures as fx
from ..streaming import ingest
from .io_plans import folder
from .shapes import TRACES

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NUMBER = rf"(?i)\(?-?\$?\d[\d,]*(?:\.\d+)?\)?\s*(?:%|percent|percentage|million|millions|billion|billions|thousand|thousands)?"
BARE = "TRY_CAST(trim(regexp_replace(trim(lower(trim(r)), '()'), '[$,%]|percent|millions?|billions?|thousands?', '', 'g')) AS DOUBLE) * CASE WHEN contains(lower(r), 'million') THEN 1e6 ELSE 1.0 END"
NUMBERS = f"list_filter(list_transform(list_filter(regexp_extract_all({{0}}, '{NUMBER}'), lambda r: NOT regexp_full_match(trim(r), '(19|20)\\d\\d')), lambda r: struct_pack(v := CASE WHEN starts_with(trim(r), '(') AND ends_with(trim(r), ')') THEN -({BARE}) ELSE {BARE} END, p := contains(r, '%'))), lambda n: n.v IS NOT NULL)"
WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1))"


def near(x: str) -> str:
    return f"abs({x} - n.v) <= greatest(0.005 * greatest(abs({x}), abs(n.v)), 0.02)"


ANSWERED = f"""al AS (SELECT l_orderkey, l_linenumber, CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
  ak AS (SELECT *, (l_orderkey * 3 + l_linenumber) % 7 AS k, ['total_revenue', 'cost_of_sales', 'net_income', 'operating_expense', 'gross_profit', 'long_term_debt_of_the_group', ''][l_linenumber] AS metric, 2014 + l_linenumber AS y, CASE WHEN s % 4 = 0 THEN '' ELSE 'Supplier ' || s END AS entity FROM al),
  asaid AS (SELECT *, CASE k WHEN 0 THEN metric || ' was $' || p WHEN 1 THEN 'Total Revenue and Net: ' || p || ' million' WHEN 2 THEN p || '% of sales' WHEN 3 THEN '(' || p || ') lost' WHEN 4 THEN entity || ' had ' || (p * 1.004::DECIMAL(4,3)) WHEN 5 THEN metric || ' near ' || (p * 1.2::DECIMAL(2,1)) ELSE 'nothing' END || CASE WHEN k <> 6 AND l_linenumber <> 3 THEN ' in ' || y ELSE '' END AS said FROM ak),
  atext AS (SELECT l_orderkey, CASE WHEN l_orderkey % 23 > 0 THEN string_agg(said, '; ' ORDER BY l_linenumber) ELSE '' END AS t FROM asaid GROUP BY l_orderkey),
  aread AS (SELECT *, {NUMBERS.format('t')} AS ns, {WORDS.format('t')} AS ws FROM atext),
  afact AS (SELECT l_orderkey AS trace_id, l_linenumber AS fact_id, metric, entity, CASE WHEN l_orderkey % 6 > 0 THEN y END AS y, CAST(p AS DOUBLE) AS value, CASE k WHEN 1 THEN 'm' WHEN 2 THEN 'p' ELSE 'a' END AS u, t, ns, ws, {WORDS.format('metric')} AS mw, {WORDS.format('entity')} AS ew FROM asaid JOIN aread USING (l_orderkey)),
  afound AS (SELECT trace_id, fact_id, len(list_filter(ns, lambda n: CASE WHEN u = 'p' OR n.p THEN abs(CASE WHEN u = 'p' THEN value ELSE CASE WHEN u = 'm' THEN value * 1e6 ELSE value END * 100 END - CASE WHEN n.p THEN n.v ELSE n.v * 100 END) <= greatest(0.25, 1e-9 * greatest(abs(CASE WHEN u = 'p' THEN value ELSE CASE WHEN u = 'm' THEN value * 1e6 ELSE value END * 100 END), abs(CASE WHEN n.p THEN n.v ELSE n.v * 100 END)))
      WHEN u = 'm' THEN {near('value * 1e6')} OR {near('value')} OR {near('value * 1e12')} ELSE {near('value')} END)) > 0 AS value_found,
    y IS NULL OR contains(t, CAST(y AS VARCHAR)) AS year_found, len(mw) = 0 OR len(list_intersect(mw, ws)) >= 0.45 * len(mw) AS metric_found, entity = '' OR contains(lower(t), lower(entity)) OR len(list_intersect(ew, ws)) >= 0.45 * len(ew) AS entity_found FROM afact),
  amatch AS (SELECT *, value_found AND year_found AND (metric_found OR entity_found) AS matched FROM afound)"""


@query("sc7_fact_evidence", f"WITH {ANSWERED} SELECT trace_id, fact_id, value_found, year_found, metric_found, entity_found, matched FROM amatch")
def _(spark, d):
    return evidence.matches(*fx.answered_facts(spark, d)).drop("case_id")


@query("sc7_fact_recall", f"WITH {ANSWERED} SELECT trace_id, count(*) AS facts, count_if(matched) AS matched, floor(count_if(matched) / count(*) * 10000 + 0.5) / 10000.0::DOUBLE AS recall FROM amatch GROUP BY trace_id")
def _(spark, d):
    return evidence.recall(evidence.matches(*fx.answered_facts(spark, d)))


PRIORITY = ("T3", "T9", "T27")
POOLS_SQL = """WITH RECURSIVE c AS (
    SELECT o_orderkey AS source_id, CASE WHEN o_custkey % 17 = 0 THEN 'Unknown' ELSE 'c' || (o_custkey % 40) END AS company, 'T' || (o_custkey % 40) AS ticker, ['Financials', 'Company Overview', 'Risk', 'Legal', 'Accounting'][o_orderkey % 5 + 1] AS category,
      ['S1_FIN_COMP', 'S3_CO_COMP', 'S6_BASELINE_SINGLE', 'S9_OTHER'][o_orderkey // 5 % 4 + 1] AS slice, o_orderkey % 4 AS facts, CAST(floor(o_totalprice / 50000) AS INTEGER) AS quality, o_orderkey * 7 % 101 AS fairness FROM orders),
  p AS (SELECT * FROM c WHERE facts >= 2 AND quality >= 8 AND slice IN ('S1_FIN_COMP', 'S3_CO_COMP') AND category IN ('Financials', 'Company Overview')),
  o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, fairness DESC, source_id) AS r FROM p),
  line AS (SELECT row_number() OVER (ORDER BY phase, r) AS i, phase, source_id, company FROM (SELECT 1 AS phase, * FROM o WHERE category = 'Company Overview' UNION ALL SELECT 2, * FROM o WHERE category = 'Financials' UNION ALL SELECT 3, * FROM o WHERE category = 'Company Overview')),
  deal AS (
    SELECT 0::BIGINT AS i, []::BIGINT[] AS dev, []::BIGINT[] AS test, []::VARCHAR[] AS firms, 0 AS od, 0 AS ot
    UNION ALL
    SELECT i, CASE WHEN go = 'dev' THEN list_append(dev, source_id) ELSE dev END, CASE WHEN go = 'test' THEN list_append(test, source_id) ELSE test END, CASE WHEN go = 'test' THEN list_append(firms, company) ELSE firms END, od + CAST(phase = 1 AND go = 'dev' AS INTEGER), ot + CAST(phase = 1 AND go = 'test' AS INTEGER)
    FROM (SELECT l.*, dev, test, firms, od, ot, CASE WHEN phase = 1 AND od < 6 THEN 'dev' WHEN phase = 1 AND ot < 6 THEN CASE WHEN fresh THEN 'test' END WHEN phase = 1 OR list_contains(dev, l.source_id) OR list_contains(test, l.source_id) THEN NULL
        WHEN len(dev) <= len(test) THEN CASE WHEN len(dev) < 20 THEN 'dev' WHEN fresh AND len(test) < 20 THEN 'test' END ELSE CASE WHEN fresh AND len(test) < 20 THEN 'test' WHEN len(dev) < 20 THEN 'dev' END END AS go
      FROM (SELECT l.*, d.dev, d.test, d.firms, d.od, d.ot, l.company = 'Unknown' OR NOT list_contains(d.firms, l.company) AS fresh FROM deal d JOIN line l ON l.i = d.i + 1) l)),
  dealt AS (SELECT unnest(dev) AS source_id, 'dev' AS split FROM (SELECT * FROM deal ORDER BY i DESC LIMIT 1) UNION ALL SELECT unnest(test), 'test' FROM (SELECT * FROM deal ORDER BY i DESC LIMIT 1)),
  ctl AS (SELECT source_id, 'control' AS split FROM c WHERE source_id NOT IN (SELECT source_id FROM dealt) AND slice = 'S6_BASELINE_SINGLE' AND facts >= 1 AND quality >= 8 AND category <> 'Accounting' ORDER BY fairness DESC, facts DESC, quality DESC, source_id LIMIT 5),
  dm AS (SELECT source_id, 'demo' AS split FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY facts DESC, quality DESC, source_id) AS r FROM c WHERE source_id NOT IN (SELECT source_id FROM dealt UNION ALL SELECT source_id FROM ctl) AND ticker IN ('T3', 'T9', 'T27') AND facts >= 2 AND quality >= 8) WHERE r <= 2 ORDER BY facts DESC, quality DESC, source_id LIMIT 5),
  s AS (SELECT * FROM dealt UNION ALL SELECT * FROM ctl UNION ALL SELECT * FROM dm)
  SELECT c.source_id, c.company, c.slice, coalesce(s.split, 'rejected') AS split, CASE WHEN s.split IS NULL THEN CASE WHEN facts = 0 THEN 'no_parser_verified_required_facts' WHEN quality < 8 THEN 'quality_score_below_selection_threshold' ELSE 'lower_score_or_duplicate' END END AS reason FROM c LEFT JOIN s USING (source_id)"""


@query("w8_case_pools", POOLS_SQL)
def _(spark, d):
    return select.pools(fx.pool_candidates(spark, d), PRIORITY).select("source_id", "company", "slice", "split", "reason")


@query(
    "st1_bounded_ingest",
    f"WITH {TRACES}, t AS (SELECT 'gpt_' || level AS model, tokens, CASE level WHEN 0 THEN 0.6 WHEN 1 THEN 10.0 ELSE 0.0 END::DOUBLE AS price FROM traces WHERE tokens > 0), g AS (SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens * price / 1e6) AS cost FROM t GROUP BY model) SELECT model, calls, tokens, round(tokens * CASE model WHEN 'gpt_0' THEN 0.6 WHEN 'gpt_1' THEN 10.0 ELSE 0.0 END::DOUBLE / 1e6, 6) AS cost, cost > 0.5 AS over_limit FROM g",
)
def _(spark, d):
    """Two runs of several batches with a watermark; a tenth of the traces comes twice."""
    path = folder(spark)
    t = fx.traces(spark, d).select("trace_id", F.concat(F.lit("gpt_"), "level").alias("model"), "tokens", F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("trace_id") % 86400), "yyyy-MM-dd HH:mm:ss").alias("ts"))
    prices, args = {"gpt_0": 0.6, "gpt_1": 10.0}, (spark, f"{path}/logs", f"{path}/state", f"{path}/totals")
    t.where("trace_id % 2 = 0").write.json(f"{path}/logs")
    ingest.run_once(*args, prices, 0.5, files=4)
    t.where("trace_id % 2 = 1 or trace_id % 10 = 0").write.mode("append").json(f"{path}/logs")
    return ingest.run_once(*args, prices, 0.5, files=4)
