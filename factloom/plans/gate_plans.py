"""Queries for repair, leakage, provenance, triage, gates, lookups and readers, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import contracts, coverage, gates, select, slots
from ..sources import fixtures as fx
from ..sources import io
from .io_plans import folder
from .shapes import FACTS, SLOTTED
from .slot_plans import SCORED_SQL

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pick(n, *values):
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


MEAN = "coalesce(CAST((2 * sum(CAST(round({0} * 1000000) AS HUGEINT)) + 100 * count({0})) // (200 * count({0})) AS DOUBLE) / 10000, 0.0::DOUBLE)"
ARM = "['graph_structured_v14', 'vector_single_v14', 'vector_multi_by_company_v14', 'graph_guided_text_v14'][trace_id % 4 + 1]"
RUN_SQL = f"""{SCORED_SQL}, run AS (SELECT trace_id, {ARM} AS method, CAST(success AS INTEGER) AS ac, CASE WHEN kept THEN coalesce(earlier_nc, nc0) ELSE nc0 END AS nc, CASE WHEN trace_id % 9 > 0 THEN trace_id % 5 > 1 END AS both_found, CASE WHEN trace_id % 6 > 0 THEN (trace_id % 8) / 8.0::DOUBLE END AS fact_recall,
  length(final_answer) AS tokens, CASE WHEN kept THEN 'none' ELSE reason END AS failure_reason, final_answer, trace_id % 3 > 0 AS contains_match, trace_id % 7 > 2 AS contains_number FROM scored)"""


def run(spark, d):
    """Scored traces of four arms with what retrieval found for them."""
    i = F.col("trace_id")
    s = slots.score(fx.slotted_traces(spark, d)).withColumn("method", pick(i % 4, "graph_structured_v14", "vector_single_v14", "vector_multi_by_company_v14", "graph_guided_text_v14"))
    return s.select("trace_id", "method", "ac", "nc", F.when(i % 9 > 0, i % 5 > 1).alias("both_found"), F.when(i % 6 > 0, (i % 8) / 8.0).alias("fact_recall"), F.length("final_answer").alias("tokens"), "failure_reason", "final_answer", (i % 3 > 0).alias("contains_match"), (i % 7 > 2).alias("contains_number"))


@query("ag1_run_summary", f"WITH {RUN_SQL} SELECT method, count(*) AS n, {MEAN.format('ac')} AS ac, {MEAN.format('nc')} AS nc, {MEAN.format('CAST(both_found AS INTEGER)')} AS both_found, {MEAN.format('fact_recall')} AS fact_recall, {MEAN.format('tokens')} AS tokens FROM run GROUP BY method")
def _(spark, d):
    return gates.method_summary(run(spark, d))


@query(
    "ag4_hypotheses",
    f"""WITH {RUN_SQL}, m AS (SELECT method, {MEAN.format('ac')} AS ac, {MEAN.format('CAST(both_found AS INTEGER)')} AS both FROM run GROUP BY method), g AS (SELECT * FROM m WHERE method = 'graph_structured_v14'), s AS (SELECT * FROM m WHERE method = 'vector_single_v14'), u AS (SELECT * FROM m WHERE method = 'vector_multi_by_company_v14'), t AS (SELECT * FROM m WHERE method = 'graph_guided_text_v14')
    SELECT g.ac > s.ac AS h1_graph_gt_single, g.ac >= u.ac - 0.0001 AS h2_graph_ge_multi, t.ac >= g.ac - 0.0001 AS h3_guided_ge_graph, g.both > s.both AS h4_graph_coverage_gt_single, (SELECT {MEAN.format('CAST(NOT coalesce(both_found, false) AS INTEGER)')} FROM run WHERE method = 'vector_single_v14' AND ac = 0) AS h5_single_failures_missing_a_company FROM g, s, u, t""",
)
def _(spark, d):
    return gates.hypotheses(run(spark, d), "graph_structured_v14", "graph_guided_text_v14", "vector_single_v14", "vector_multi_by_company_v14")


@query(
    "sc11_failure_types",
    f"""WITH {RUN_SQL} SELECT trace_id, CASE WHEN ac = 1 THEN 'none' WHEN NOT contains_match OR NOT coalesce(both_found, false) THEN 'retrieval_miss' WHEN failure_reason = 'answer_format_error' THEN 'answer_format_error' WHEN final_answer <> '' THEN 'retrieved_but_reasoning_error' ELSE 'scorer_uncertain' END AS failure_type FROM run""",
)
def _(spark, d):
    kind = gates.failure_type(*[F.col(c) for c in ("ac", "contains_match", "both_found", "contains_number", "failure_reason", "final_answer")])
    return run(spark, d).select("trace_id", kind.alias("failure_type"))


WARNED = "[CASE WHEN trace_id % 5 = 0 THEN 'ambiguous_formula' END, CASE WHEN trace_id % 7 = 0 THEN 'rounding' END, CASE WHEN trace_id % 11 = 0 THEN 'missing_prior_period' END]"


def warned(spark, d):
    i = F.col("trace_id")
    w = F.array_compact(F.array(F.when(i % 5 == 0, "ambiguous_formula"), F.when(i % 7 == 0, "rounding"), F.when(i % 11 == 0, "missing_prior_period")))
    return run(spark, d).select(F.floor(i / 6).alias("case_id"), "method", "ac", "nc", F.when(i % 13 > 0, w).alias("warnings"))


WARNED_SQL = f"{RUN_SQL}, warned AS (SELECT trace_id // 6 AS case_id, method, ac, nc, CASE WHEN trace_id % 13 > 0 THEN list_filter({WARNED}, lambda x: x IS NOT NULL) ELSE [] END AS w FROM run)"


@query(
    "ag21_flagged_cases",
    f"WITH {WARNED_SQL} SELECT case_id, coalesce(list_sort(list(DISTINCT method) FILTER (len(w) > 0)), []) AS methods_flagged, list_sort(list_distinct(flatten(list(w)))) AS warnings, bool_or(list_contains(w, 'ambiguous_formula') OR list_contains(w, 'missing_prior_period')) AS excluded FROM warned GROUP BY case_id",
)
def _(spark, d):
    return gates.case_flags(warned(spark, d))


@query(
    "ag21_clean_means",
    f"WITH {WARNED_SQL}, k AS (SELECT * FROM warned WHERE NOT list_contains(w, 'ambiguous_formula') AND NOT list_contains(w, 'missing_prior_period')) SELECT m.method, coalesce(g.clean, 0) AS clean, coalesce(g.ac, 0.0) AS ac, coalesce(g.nc, 0.0) AS nc FROM (SELECT unnest(['graph_structured_v14', 'vector_single_v14', 'absent']) AS method) m LEFT JOIN (SELECT method, count(*) AS clean, {MEAN.format('ac')} AS ac, {MEAN.format('nc')} AS nc FROM k GROUP BY method) g ON g.method = m.method",
)
def _(spark, d):
    return gates.clean_means(warned(spark, d), ("graph_structured_v14", "vector_single_v14", "absent"), ("ac", "nc"))


@query(
    "fp9_contract_leaks",
    f"""WITH {SLOTTED} SELECT trace_id AS case_id, list_transform(list_filter(lines, lambda l: l.expected <> '' AND contains(final_answer, l.expected)), lambda l: 'slot_' || l.n) AS leaked_slots, len(lines) > 0 AND trace_id % 12 = 0 AS derived_as_source,
    len(list_filter(lines, lambda l: l.expected <> '' AND contains(final_answer, l.expected))) = 0 AND NOT (len(lines) > 0 AND trace_id % 12 = 0) AS ok FROM slotted""",
)
def _(spark, d):
    t = fx.slotted_traces(spark, d)
    facts = t.select(F.col("trace_id").alias("case_id"), F.explode("facts").alias("f"), (F.col("trace_id") % 4 == 0).alias("derived"), (F.col("trace_id") % 3 == 0).alias("source"))
    return gates.leaks(t.select(F.col("trace_id").alias("case_id"), F.col("final_answer").alias("visible"), "slots"), facts)


METHODS = ("vector_only_scaled", "vector_single_v14", "vector_multi_by_company_v14", "vector_only_v8", "vector_only_v10", "vector_only_v7", "vector_only_v4", "hybrid_vector_graph_v3", "graph_neo4j_v9", "something")


@query(
    "fp11_provenance",
    f"""WITH m AS (SELECT {list(METHODS)}[o_orderkey % 10 + 1] AS method FROM orders), t(method, classification, verdict, naming_honest, label) AS (VALUES
      ('vector_only_scaled', 'gold_context_no_retrieval', 'needs_reclassification', false, 'gold_text_only'), ('vector_single_v14', 'real_retrieval_full_corpus', 'ok_but_weak_retriever', true, 'vector_single_v14 (keep; document-level in-memory baseline)'),
      ('vector_multi_by_company_v14', 'real_retrieval_full_corpus', 'ok_but_weak_retriever', true, 'vector_multi_by_company_v14 (keep; document-level in-memory baseline)'), ('vector_only_v8', 'per_case_evidence_only', 'mislabeled', false, 'case_text_only_v8'),
      ('vector_only_v10', 'per_case_evidence_only', 'mislabeled', false, 'case_text_only_v10'), ('vector_only_v7', 'per_case_evidence_only', 'mislabeled', false, 'case_text_only_v7'), ('vector_only_v4', 'per_case_evidence_only', 'mislabeled_or_legacy_prompt_arm', false, 'case_text_only_v4'),
      ('hybrid_vector_graph_v3', 'per_case_evidence_only', 'mislabeled_or_legacy_prompt_arm', false, 'hybrid_vector_graph_v3'), ('graph_neo4j_v9', 'unknown', 'blocker_unknown', false, 'unknown'), ('something', 'unknown', 'blocker_unknown', false, 'unknown'))
    SELECT method, classification, verdict, naming_honest, label, count(*) AS n FROM m JOIN t USING (method) GROUP BY ALL""",
)
def _(spark, d):
    m = fx.read(spark, d, "orders").select(pick(F.col("o_orderkey") % 10, *METHODS).alias("method"))
    p = m.groupBy("method").agg(F.count("*").alias("n")).select("method", "n", gates.provenance(F.col("method")).alias("p"))
    return p.select("method", "p.classification", "p.verdict", "p.naming_honest", "p.label", "n")


def repair_frames(spark, d):
    """A fact and its case for each line of an order, of twelve kinds of being right or wrong."""
    p = F.col("l_extendedprice").cast("decimal(12,2)")
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    lines = fx.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("l_extendedprice"))
    plain = F.regexp_replace(p.cast("string"), r"\.?0+$", "")
    metric = F.when(k == 7, "Year ended net income").when(k == 8, "net sales").when(k == 9, "Total  revenue").when(k == 10, "Basic EPS").otherwise("net income")
    body = (
        F.when(k == 1, F.concat(F.lit("Net Income was ($"), plain, F.lit(")"))).when(k == 2, "Net income was not disclosed").when(k == 3, F.concat(F.lit("Somewhere it was "), plain))
        .when(k == 9, F.concat(F.lit("TOTAL REVENUE of $ "), plain)).when(k == 10, F.concat(F.lit("basic eps "), plain)).when(k == 11, F.concat(F.lit("net income for each employee "), plain)).otherwise(F.concat(metric, F.lit(": "), plain, F.lit(" only")))
    )
    question = F.when(k == 4, "Which age group?").when(k == 5, "When does the contract end?").when(k == 6, "How large is the debt?").when(k == 0, "What is the margin?").otherwise("How much?")
    cases = lines.select(i.alias("case_id"), question.alias("question"), F.lit(None).cast("string").alias("expected_answer"), F.when(k == 2, body).otherwise(F.concat(F.lit("Report in thousands\n"), body)).alias("evidence"))
    value = F.when(k == 1, -p.cast("double")).otherwise(p.cast("double"))
    facts = lines.select(i.alias("case_id"), i.alias("fact_id"), metric.alias("metric_raw"), F.lit("").alias("metric_canonical"), F.when(i % 17 == 0, 1998).otherwise(2020).alias("year"), value.alias("value"), F.when(k == 8, "USD_per_share").otherwise("USD_millions").alias("unit"), F.lit("component").alias("fact_role"))
    return facts, cases


@query(
    "fp8_repaired_facts",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS p FROM lineitem GROUP BY ALL), x AS (SELECT l_orderkey * 10 + l_linenumber AS i, (l_orderkey + l_linenumber) % 12 AS k, regexp_replace(CAST(p AS VARCHAR), '\\.?0+$', '') AS v FROM l)
    SELECT i AS fact_id, CASE k WHEN 1 THEN 'Net Income was ($' || v WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 8 THEN 'net sales: ' || v WHEN 9 THEN 'TOTAL REVENUE of $ ' || v WHEN 10 THEN 'basic eps ' || v WHEN 11 THEN 'net income for each employee ' || v WHEN 7 THEN 'Year ended net income: ' || v ELSE 'net income: ' || v END AS quote,
      CASE WHEN k = 4 THEN 'birth_year_range' WHEN k = 5 THEN 'expiration_year' WHEN k = 6 THEN 'maturity_year' WHEN i % 17 = 0 THEN 'other' ELSE 'reporting_period' END AS period_role,
      CASE WHEN k = 10 THEN 'USD_per_share' WHEN k = 11 THEN 'employees' WHEN k = 2 THEN 'USD_millions' ELSE 'USD_thousands' END AS repaired_unit, CASE WHEN k = 0 THEN 'numerator' WHEN k = 9 THEN 'total' ELSE 'component' END AS role,
      CASE WHEN k = 7 THEN 'metric_header_phrase' WHEN k = 4 THEN 'non_reporting_birth_year_range' WHEN k = 5 THEN 'non_reporting_expiration_year' WHEN k = 6 THEN 'debt_maturity_year_excluded_from_reporting_period' WHEN i % 17 = 0 THEN 'pre_2000_year_not_reporting_period'
        WHEN k = 8 THEN 'unit_metric_mismatch' WHEN k IN (2, 3) THEN 'exact_quote_recovery_failed' END AS reject_reason FROM x""",
)
def _(spark, d):
    return gates.repair_facts(*repair_frames(spark, d)).select("fact_id", "quote", "period_role", "repaired_unit", "role", "reject_reason")


@query(
    "ag19_fact_triage",
    """WITH x AS (SELECT o_orderkey AS i, o_orderkey % 5 = 0 AS co, o_orderkey % 3 AS obs, o_orderkey % 4 = 0 AS ms, o_orderkey % 6 = 0 AS vs, o_orderkey % 7 <> 0 AS has_unit, o_orderkey % 8 <> 0 AS has_year, o_orderkey % 9 <> 0 AS has_period, o_orderkey % 10 <> 3 AS q, o_orderkey % 13 <> 0 AS firm FROM orders),
    c AS (SELECT *, list_filter([CASE WHEN co THEN 'KGEntity_mapping_issue' END, CASE WHEN co THEN 'case_id_source_id_mismatch' END, CASE WHEN obs = 0 THEN 'missing_observation' END, CASE WHEN ms THEN 'metric_alias_mismatch' END, CASE WHEN vs THEN 'value_mismatch' END, CASE WHEN NOT has_unit THEN 'unit_mismatch' END, CASE WHEN NOT has_year AND NOT has_period THEN 'year_or_period_mismatch' END, CASE WHEN NOT q THEN 'evidence_quote_mismatch' END], lambda z: z IS NOT NULL) AS f FROM x),
    d AS (SELECT *, CASE WHEN len(f) = 0 THEN ['unresolved_manual_review'] ELSE f END AS classes FROM c)
    SELECT i, classes, classes[1] AS "primary", CASE WHEN co THEN 'manual_approve_link_company_case_and_observation_kgentity' WHEN obs = 0 THEN 'manual_approve_create_financial_observation_kgentity' ELSE 'manual_approve_normalize_existing_observation_properties' END AS patch_type,
      CASE WHEN NOT q OR NOT firm THEN 'high' WHEN len(list_filter(classes, lambda z: z NOT IN ('KGEntity_mapping_issue', 'case_id_source_id_mismatch', 'metric_alias_mismatch', 'value_mismatch'))) = 0 THEN 'medium' ELSE 'medium_high' END AS risk FROM d""",
)
def _(spark, d):
    i = F.col("o_orderkey")
    f = fx.read(spark, d, "orders").select(
        i.alias("i"), F.when(i % 10 == 0, "needs_company_ticker_review").otherwise("partial").alias("coverage_status"), (i % 3).alias("observations"), (i % 5 == 0).alias("company_sensitive"), F.when(i % 4 == 0, True).alias("metric_sensitive"),
        (i % 6 == 0).alias("value_sensitive"), F.when(i % 7 != 0, "u").alias("unit"), F.when(i % 8 != 0, 2020).alias("year"), F.when(i % 9 != 0, "FY").otherwise("").alias("period_label"), (i % 10 != 3).alias("exact_quote"), F.lit("c").alias("company"), F.when(i % 13 != 0, "T").alias("ticker"),
    )
    return gates.triage(f).select("i", "classes", "primary", "patch_type", "risk")


@query(
    "ag8_smoke_gate",
    f"""WITH {FACTS}, o AS (SELECT ticker, CASE WHEN hash_k % 40 = 0 THEN 'source_value_1' ELSE metric END AS metric, year, value * CASE WHEN ordinal = 'R' AND hash_k % 3 = 0 THEN 1.005 ELSE 1.0 END::DOUBLE AS value, hash_k % 12 > 0 AS verified, ascii(ordinal) AS place FROM (SELECT *, CAST(substr(ticker, 2) AS INTEGER) * 7 + year + length(metric) AS hash_k FROM facts_raw)),
    same AS (SELECT ticker, metric, year, value * CASE WHEN place = 1 THEN 1.0 ELSE 1.004 END::DOUBLE AS value, verified, place FROM (SELECT ticker, metric, year, arg_min(value, place) AS value, bool_or(verified) AS verified FROM o GROUP BY ALL), (SELECT unnest([1, 2]) AS place)),
    u AS (SELECT * FROM same WHERE year % 2 = 0 UNION ALL SELECT * FROM o WHERE year % 2 = 1), cell AS (SELECT arg_min(value, place) AS b, min(value) AS lo, max(value) AS hi FROM u GROUP BY ticker, metric, year HAVING count(*) > 1),
    a AS (SELECT (SELECT count(*) FROM supplier) AS cases, (SELECT count(*) FROM u) AS observations, (SELECT 60 * count(*) FROM supplier) AS raw_count, (SELECT count(*) FROM u WHERE starts_with(metric, 'source_value')) AS placeholders, (SELECT count(*) FROM u WHERE value = floor(value) AND value BETWEEN 2015 AND 2030) AS value_as_year,
      (SELECT count(*) FROM u WHERE verified) AS v, (SELECT count(*) FROM cell) AS checked, (SELECT count(*) FROM cell WHERE abs(lo - b) <= greatest(abs(b) * 0.01, 0.1) AND abs(hi - b) <= greatest(abs(b) * 0.01, 0.1)) AS agree,
      (SELECT {MEAN.format('y')} FROM (SELECT s_suppkey, (SELECT count(DISTINCT year) FROM u WHERE u.ticker = 'S' || s_suppkey) AS y FROM supplier)) AS years_per_case),
    b AS (SELECT cases, observations, raw_count, placeholders, floor(observations / raw_count * 10000 + 0.5) / 10000.0::DOUBLE AS mapped_ratio, years_per_case, value_as_year, floor(v / observations * 10000 + 0.5) / 10000.0::DOUBLE AS verified_ratio, floor(agree / checked * 10000 + 0.5) / 10000.0::DOUBLE AS duplicate_consistency FROM a)
    SELECT *, placeholders = 0 AND mapped_ratio >= 0.7 AND years_per_case >= 2 AND value_as_year <= 1 AND verified_ratio >= 0.9 AND duplicate_consistency >= 0.95 AS passes FROM b""",
)
def _(spark, d):
    f = fx.facts_raw(spark, d).withColumn("k", F.substring("ticker", 2, 20).cast("int") * 7 + F.col("year") + F.length("metric"))
    o = f.select("ticker", F.when(F.col("k") % 40 == 0, "source_value_1").otherwise(F.col("metric")).alias("metric"), "year", (F.col("value") * F.when((F.col("ordinal") == "R") & (F.col("k") % 3 == 0), 1.005).otherwise(1.0)).alias("value"), (F.col("k") % 12 > 0).alias("verified"), F.ascii("ordinal").alias("place"))
    one = o.groupBy("ticker", "metric", "year").agg(F.min_by("value", "place").alias("value"), F.bool_or("verified").alias("verified"))
    same = one.select("ticker", "metric", "year", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"), "value", "verified").withColumn("value", F.col("value") * F.when(F.col("place") == 1, 1.0).otherwise(1.004))
    u = same.where("year % 2 = 0").unionByName(o.where("year % 2 = 1")).withColumn("case_id", F.col("ticker"))
    rows = fx.read(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("case_id"), F.lit(60).alias("raw_count"))
    return gates.smoke_gate(rows, u)


@query(
    "ag9_slice_audit",
    """WITH r AS (SELECT o_orderkey // 2 AS id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'x' END AS e, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'y' END AS a FROM orders), m AS (SELECT c_mktsegment AS slice, c_custkey AS id FROM customer), u AS (SELECT DISTINCT o_orderkey // 2 AS id FROM orders WHERE o_orderkey % 10 = 0), f AS (SELECT slice, count(*) AS total, count_if(m.id NOT IN (SELECT id FROM u)) AS fresh FROM m GROUP BY slice),
    x AS (SELECT 'input' AS kind, 'rows' AS name, (SELECT count(*) FROM r) AS n UNION ALL SELECT 'input', 'unique_ids', (SELECT count(DISTINCT id) FROM r) UNION ALL SELECT 'input', 'duplicate_ids', (SELECT count(*) - count(DISTINCT id) FROM r) UNION ALL SELECT 'input', 'missing_evidence', (SELECT count(*) FROM r WHERE trim(e) = '') UNION ALL SELECT 'input', 'missing_answer', (SELECT count(*) FROM r WHERE a IS NULL)
      UNION ALL SELECT 'input', 'manifest_ids_missing', (SELECT count(DISTINCT id) FROM m WHERE id NOT IN (SELECT id FROM r)) UNION ALL SELECT 'total', slice, total FROM f UNION ALL SELECT 'fresh', slice, fresh FROM f)
    SELECT kind, name, CAST(n AS BIGINT) AS n FROM x UNION ALL SELECT 'gate', 'passes', CAST((SELECT n FROM x WHERE name = 'duplicate_ids') = 0 AND (SELECT n FROM x WHERE name = 'manifest_ids_missing') = 0 AND coalesce((SELECT n FROM x WHERE kind = 'fresh' AND name = 'BUILDING'), 0) >= 20 AS BIGINT)""",
)
def _(spark, d):
    i = F.col("o_orderkey")
    o = fx.read(spark, d, "orders")
    rows = o.select(F.floor(i / 2).alias("id"), F.when(i % 7 == 0, " ").otherwise("x").alias("evidence"), F.when(i % 9 != 0, "y").alias("answer"))
    manifest = fx.read(spark, d, "customer").select(F.col("c_mktsegment").alias("slice"), F.col("c_custkey").alias("id"))
    return gates.input_audit(rows, manifest, o.where("o_orderkey % 10 = 0").select(F.floor(i / 2).alias("id")), "BUILDING", 20)


@query(
    "j5_batch_lookup",
    f"""WITH {FACTS}, c AS (SELECT c_custkey AS case_id, 'S' || (c_custkey % 10 + 1) AS ticker, range(2014, 2016 + c_custkey % 7) AS ys, CASE c_custkey % 4 WHEN 0 THEN ['income_tax', 'the'] WHEN 1 THEN ['zzzz'] WHEN 2 THEN NULL ELSE ['Gross Profit'] END AS tags FROM customer),
    k AS (SELECT *, list_filter(flatten(list_transform(coalesce(tags, []), lambda t: string_split(replace(lower(t), '_', ' '), ' '))), lambda w: length(w) >= 4) AS ws FROM c), f AS (SELECT ticker || '/' || metric || '/' || year AS fact_id, * FROM facts WHERE (year + length(metric)) % 5 <> 0 AND NOT (metric = 'net_income' AND year % 3 = 0)),
    j AS (SELECT case_id, fact_id, metric, year, value, len(list_filter(ws, lambda w: contains(metric, w))) > 0 AS hit FROM k JOIN f USING (ticker) WHERE list_contains(ys, f.year)), n AS (SELECT *, count(*) OVER w AS n, count_if(hit) OVER w AS h FROM j WINDOW w AS (PARTITION BY case_id)) SELECT case_id, fact_id, metric, year, value FROM n WHERE n <= 20 OR h < 3 OR hit""",
)
def _(spark, d):
    k = F.col("c_custkey")
    tags = F.when(k % 4 == 0, F.array(F.lit("income_tax"), F.lit("the"))).when(k % 4 == 1, F.array(F.lit("zzzz"))).when(k % 4 == 3, F.array(F.lit("Gross Profit")))
    cases = fx.read(spark, d, "customer").select(k.alias("case_id"), F.concat(F.lit("S"), k % 10 + 1).alias("ticker"), F.sequence(F.lit(2014), (2015 + k % 7).cast("int")).alias("years"), tags.alias("tags"))
    f = fx.facts(spark, d)
    f = f.select(F.concat_ws("/", "ticker", "metric", "year").alias("fact_id"), "ticker", "metric", "year", "value", F.when((F.col("year") + F.length("metric")) % 5 == 0, "old").otherwise("b1").alias("kg_batch"), F.when((F.col("metric") == "net_income") & (F.col("year") % 3 == 0), "deprecated").alias("status"))
    return coverage.lookup(cases, f, "b1")


NEED = "need AS (SELECT DISTINCT 'S' || (c_custkey % 12 + 1) AS ticker, ['revenue_total', 'income_net_of_tax', 'operating_income', 'profit', 'x_y', 'cost_of_sales'][c_custkey % 6 + 1] AS metric, CASE WHEN c_custkey % 8 > 0 THEN CAST(2014 + c_custkey % 9 AS INTEGER) END AS year FROM customer)"
COVERED = f"""WITH {FACTS}, {NEED}, g AS (SELECT * FROM facts WHERE ticker <> 'S3'), w AS (SELECT *, list_filter(string_split(metric, '_'), lambda x: length(x) >= 4)[1:2] AS ws FROM need),
  c AS (SELECT ticker, metric, year, EXISTS (SELECT 1 FROM g WHERE g.ticker = w.ticker) AS company_found, len(ws) > 0 AND EXISTS (SELECT 1 FROM (SELECT DISTINCT metric AS m FROM g) v WHERE contains(m, ws[1]) AND contains(m, coalesce(ws[2], ws[1]))) AS metric_found,
    len(ws) > 0 AND EXISTS (SELECT 1 FROM g WHERE g.ticker = w.ticker AND g.year = w.year AND contains(g.metric, ws[1]) AND contains(g.metric, coalesce(ws[2], ws[1]))) AS chain_found FROM w), k AS (SELECT *, CASE WHEN company_found AND metric_found AND chain_found THEN 'full' WHEN NOT company_found THEN 'none' ELSE 'partial' END AS coverage FROM c)"""


def covered(spark, d):
    k = F.col("c_custkey")
    need = fx.read(spark, d, "customer").select(F.concat(F.lit("S"), k % 12 + 1).alias("ticker"), pick(k % 6, "revenue_total", "income_net_of_tax", "operating_income", "profit", "x_y", "cost_of_sales").alias("metric"), F.when(k % 8 > 0, 2014 + k % 9).cast("int").alias("year"))
    return coverage.fuzzy_coverage(need.distinct(), fx.facts(spark, d).where("ticker <> 'S3'"))


@query("j6_word_coverage", f"{COVERED} SELECT * FROM k WHERE year IS NOT NULL")
def _(spark, d):
    return covered(spark, d).where("year is not null")


@query("j6_coverage_by_ticker", f"{COVERED} SELECT ticker, bool_or(company_found) AS company_found, count(*) AS combinations, count_if(coverage = 'full') AS \"full\", count_if(coverage = 'partial') AS partial, count_if(coverage = 'none') AS none FROM k WHERE year IS NOT NULL GROUP BY ticker")
def _(spark, d):
    return coverage.coverage_by_ticker(covered(spark, d).where("year is not null"))


@query(
    "sc9_sides_found",
    """WITH c AS (SELECT c_custkey AS case_id, 'S' || (c_custkey % 5) AS a, 'S' || (5 + c_custkey % 4) AS b FROM customer), s AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || (o_custkey % 5) WHEN o_orderkey % 3 = 1 THEN 'S' || (5 + o_custkey % 4) ELSE 'other' END AS ticker, o_orderkey AS source_id FROM orders),
    h AS (SELECT o_custkey AS case_id, o_orderkey AS source_id, CASE WHEN o_orderkey % 20 = 0 THEN 'S' || (o_custkey % 5) ELSE 'none' END AS ticker FROM orders WHERE o_orderkey % 4 = 0),
    x AS (SELECT case_id, a, b, (SELECT count(*) FROM s WHERE s.case_id = c.case_id AND s.ticker = a) AS na, (SELECT count(*) FROM s WHERE s.case_id = c.case_id AND s.ticker = a AND source_id % 4 = 0) AS ka, (SELECT count(*) FROM s WHERE s.case_id = c.case_id AND s.ticker = b) AS nb, (SELECT count(*) FROM s WHERE s.case_id = c.case_id AND s.ticker = b AND source_id % 4 = 0) AS kb,
      EXISTS (SELECT 1 FROM h WHERE h.case_id = c.case_id AND h.ticker = a) AS ha, EXISTS (SELECT 1 FROM h WHERE h.case_id = c.case_id AND h.ticker = b) AS hb FROM c)
    SELECT case_id, ka > 0 OR ha AS a_found, kb > 0 OR hb AS b_found, (ka > 0 OR ha) AND (kb > 0 OR hb) AS both_found, (CAST(ka > 0 OR ha AS INTEGER) + CAST(kb > 0 OR hb AS INTEGER)) / 2.0::DOUBLE AS fact_recall, CASE WHEN na > 0 THEN floor(ka / na * 10000 + 0.5) / 10000 ELSE 0 END AS share_a, CASE WHEN nb > 0 THEN floor(kb / nb * 10000 + 0.5) / 10000 ELSE 0 END AS share_b FROM x""",
)
def _(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    s = lambda n: F.concat(F.lit("S"), n.cast("string"))
    cases = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), s(F.col("c_custkey") % 5).alias("company_a"), s(5 + F.col("c_custkey") % 4).alias("company_b"))
    orders = fx.read(spark, d, "orders").select(k.alias("case_id"), o.alias("source_id"), F.when(o % 3 == 0, s(k % 5)).when(o % 3 == 1, s(5 + k % 4)).otherwise("other").alias("ticker"))
    hits = fx.read(spark, d, "orders").where("o_orderkey % 4 = 0").select(k.alias("case_id"), o.alias("source_id"), F.when(o % 20 == 0, s(k % 5)).otherwise("none").alias("ticker"))
    return coverage.sides_found(cases, orders, hits)


@query(
    "j19_merged_contracts",
    """WITH u AS (SELECT o_custkey AS case_id, 'o' || o_orderkey AS origin, o_orderkey AS priority, o_orderkey % 29 = 0 AS over, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey] ELSE []::BIGINT[] END AS slots FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 3 <> 0),
    one AS (SELECT case_id, origin, slots FROM u QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY over DESC, CASE WHEN over THEN -priority ELSE CASE WHEN len(slots) = 0 THEN 1 ELSE 0 END * 1000000000 + priority END) = 1),
    f AS (SELECT DISTINCT c_custkey AS case_id, ['m1', 'm2', 'm1'][i] AS metric, 2020 + c_custkey % 2 AS y, CAST(c_custkey % 7 AS DOUBLE) + 0.5 AS v FROM customer, (SELECT unnest([1, 2, 3]) AS i) WHERE c_custkey % 5 > 0),
    m AS (SELECT case_id, list('source_' || metric || '_' || y || '_' || lpad(CAST(i AS VARCHAR), 2, '0') || '=' || v ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY metric) AS i FROM f) GROUP BY case_id)
    SELECT case_id, origin, CASE WHEN len(slots) > 0 THEN list_transform(slots, lambda x: 'slot=' || x) ELSE coalesce(names, []) END AS slots, len(slots) = 0 AND names IS NOT NULL AS filled FROM one LEFT JOIN m USING (case_id)""",
)
def _(spark, d):
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    slot = F.struct(F.lit("slot").alias("name"), o.cast("string").alias("expected"), F.lit("").alias("unit"))
    s = fx.read(spark, d, "orders").where("o_custkey % 2 = 0 or o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("o"), o).alias("origin"), o.alias("priority"), (o % 29 == 0).alias("overrides"), F.when(o % 3 == 0, F.array(slot)).alias("slots"))
    f = fx.read(spark, d, "customer").where("c_custkey % 5 > 0").select(k.alias("case_id"), F.posexplode(F.array(*map(F.lit, ("m1", "m2", "m1")))).alias("place", "metric"), (2020 + k % 2).alias("year"), ((k % 7).cast("double") + 0.5).alias("value"), F.lit("u").alias("unit"))
    c = contracts.merge(s, f)
    return c.select("case_id", "origin", F.transform("slots", lambda x: F.concat(x["name"], F.lit("="), x["expected"])).alias("slots"), "filled")


@query(
    "w9_samples_in_turn",
    """WITH t AS (SELECT o_orderkey AS i, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 < 3 AS c FROM orders), x AS (SELECT i, row_number() OVER (ORDER BY i) AS p FROM t WHERE a QUALIFY p <= 3), y AS (SELECT i, row_number() OVER (ORDER BY i) AS p FROM t WHERE b AND i NOT IN (SELECT i FROM x) QUALIFY p <= 4), z AS (SELECT i, row_number() OVER (ORDER BY i) AS p FROM t WHERE c AND i NOT IN (SELECT i FROM x UNION ALL SELECT i FROM y) QUALIFY p <= 2)
    SELECT i, 'even' AS bucket, CAST(p AS INTEGER) AS place FROM x UNION ALL SELECT i, 'third', CAST(p AS INTEGER) FROM y UNION ALL SELECT i, 'fifths', CAST(p AS INTEGER) FROM z""",
)
def _(spark, d):
    i = F.col("i")
    t = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    return select.samples_in_turn(t, [("even", i % 2 == 0, 3), ("third", i % 3 == 0, 4), ("fifths", i % 5 < 3, 2)], ["i"])


ASKED = ("What was revenue (ABC) and (EPS)?", "Growth of sales, XYZ.", "Costs for QRS in total", "TUV FY23 income", "In LMN 2020", "KLM revenue is what", "does GHI grow", "both ABC and DEF", "Amazon grew", "what (EPS) is US GAAP?", "")
TICKERS = ("ABC", "XYZ", "QRS", "TUV", "LMN", "KLM", "GHI", None, "AMAZO", None, None)


@query(
    "sf7_tickers_and_companies",
    """WITH q AS (SELECT c_custkey, ['What was revenue (ABC) and (EPS)?', 'Growth of sales, XYZ.', 'Costs for QRS in total', 'TUV FY23 income', 'In LMN 2020', 'KLM revenue is what', 'does GHI grow', 'both ABC and DEF', 'Amazon grew', 'what (EPS) is US GAAP?', ''][c_custkey % 11 + 1] AS q, ['ABC', 'XYZ', 'QRS', 'TUV', 'LMN', 'KLM', 'GHI', NULL, 'AMAZO', NULL, NULL][c_custkey % 11 + 1] AS t FROM customer)
    SELECT c_custkey, coalesce(t, 'C' || upper(substr(sha256(q), 1, 5))) AS ticker, CASE c_custkey % 4 WHEN 0 THEN 'Big Co' WHEN 1 THEN 'Firm ' || c_custkey ELSE coalesce(t, 'C' || upper(substr(sha256(q), 1, 5))) END AS company FROM q""",
)
def _(spark, d):
    k = F.col("c_custkey")
    c = fx.read(spark, d, "customer").select("c_custkey", text.ticker_of(pick(k % 11, *ASKED)).alias("ticker"))
    lines = F.when(k % 4 == 0, "\n  Big Co, and Subsidiaries Inc\nmore").when(k % 4 == 1, F.concat(F.lit("Firm "), k.cast("string"), F.lit(" Consolidated Statements"))).when(k % 4 == 2, "\r\n 12 34 \nText")
    return c.select("c_custkey", "ticker", text.company_of(lines, F.col("ticker")).alias("company"))


@query(
    "sf16_case_scores",
    r"""WITH x AS (SELECT doc_id, text AS t, ['Financials', 'Risk', 'Company Overview'][doc_id % 3 + 1] AS c, ['Compositional', 'Division', 'None', 'Addition'][doc_id % 4 + 1] AS r, CASE WHEN doc_id % 2 = 0 THEN 'what is it?' ELSE 'How did the operating margin of it develop?' END AS q, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Calculated as a sum' ELSE 'x' END AS a, CAST(doc_id % 9 AS INTEGER) AS f FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, round(CASE WHEN c <> 'Risk' THEN 3.0 ELSE 1.0 END::DOUBLE + CASE r WHEN 'Compositional' THEN 3.0 WHEN 'Division' THEN 2.2 WHEN 'Addition' THEN 2.0 ELSE 0.4 END::DOUBLE + least(3.0::DOUBLE, len(list_distinct(regexp_extract_all(t, '\b(19[89]\d|20[0-3]\d)\b'))) * 0.8::DOUBLE) + least(3.0::DOUBLE, f * 0.55::DOUBLE)
      + least(3, len(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?')) // 12) + CASE WHEN doc_id % 5 = 1 THEN 1.2 ELSE 0.0 END::DOUBLE + CASE WHEN length(q) BETWEEN 20 AND 180 THEN 0.6 ELSE 0.0 END::DOUBLE + CASE WHEN f >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE, 3) AS quality,
      round(CASE WHEN c <> 'Risk' THEN 1.5 ELSE 0.8 END::DOUBLE + CASE WHEN t <> '' AND a <> '' THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN f >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN r = 'None' THEN 0.8 ELSE 0.4 END::DOUBLE + CASE WHEN doc_id % 5 = 1 THEN 0.7 ELSE 0.0 END::DOUBLE, 3) AS fairness,
      round(least(6.0::DOUBLE, len(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?')) / 5.0::DOUBLE) + least(3.0::DOUBLE, length(a) / 20.0::DOUBLE) + least(3.0::DOUBLE, length(q) / 40.0::DOUBLE), 4) AS derivation_quality FROM x""",
)
def _(spark, d):
    k = F.col("doc_id")
    x = fx.read(spark, d, "documents").where("text is not null").select("doc_id", "text", pick(k % 3, "Financials", "Risk", "Company Overview").alias("c"), pick(k % 4, "Compositional", "Division", "None", "Addition").alias("r"), F.when(k % 2 == 0, "what is it?").otherwise("How did the operating margin of it develop?").alias("q"), F.when(k % 5 == 0, "").when(k % 5 == 1, "Calculated as a sum").otherwise("x").alias("a"), (k % 9).cast("int").alias("f"))
    scores = text.case_scores(*[F.col(c) for c in ("c", "r", "text", "q", "a", "f")])
    return x.select("doc_id", scores.alias("s"), text.derivation_quality(F.col("text"), F.col("q"), F.col("a")).alias("derivation_quality")).select("doc_id", "s.quality", "s.fairness", "derivation_quality")


@query(
    "io2_json_cases",
    "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'i' || c_custkey ELSE 'u' || c_custkey END AS id, c_mktsegment AS category, CASE WHEN c_custkey % 3 = 0 THEN 'Division' ELSE '' END AS reasoning_type, CASE WHEN c_custkey % 2 = 0 THEN 'text ' || c_custkey ELSE 'refs' END AS text, CASE WHEN c_custkey % 2 = 0 THEN 'text ' || c_custkey ELSE 'why?' END AS question, CAST(c_custkey AS VARCHAR) AS expected_answer FROM customer",
)
def _(spark, d):
    """Arrays of cases, a file for each market segment, with other names for every second case."""
    path, k = folder(spark), F.col("c_custkey")
    s, even = k.cast("string"), k % 2 == 0
    item = F.to_json(F.struct(F.when(even, F.concat(F.lit("i"), s)).alias("id"), F.when(~even, F.concat(F.lit("u"), s)).alias("_id"), F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "Division").alias("type"), F.when(even, F.concat(F.lit("text "), s)).alias("text"), F.when(~even, "refs").alias("references"), F.when(~even, "why?").alias("question"), s.alias("answer")))
    groups = fx.read(spark, d, "customer").groupBy((k % 50).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(item), ",\n"), F.lit("\n]")).alias("value"))
    groups.repartition(50, "file").write.partitionBy("file").text(path)
    return io.read_json_cases(spark, f"{path}/*")


@query(
    "io3_evidence",
    "WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS t, string_agg(l_linenumber || chr(9) || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS tab FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, t || CASE WHEN l_orderkey % 2 = 0 THEN chr(10) || 'before it' ELSE '' END || CASE WHEN l_orderkey % 3 = 0 THEN chr(10) || 'after' ELSE '' END AS evidence, 'TABLE' || chr(10) || tab || chr(10) || chr(10) || 'CONTEXT' || chr(10) || CASE WHEN l_orderkey % 2 = 0 THEN 'before' || chr(10) || 'it' ELSE '' END AS context FROM l",
)
def _(spark, d):
    k = F.col("l_orderkey")
    row = F.struct("l_linenumber", F.array(F.col("l_linenumber").cast("string"), "l_returnflag").alias("r"))
    t = fx.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("x")).select("l_orderkey", F.col("x.r").alias("table"), F.when(k % 2 == 0, F.array(F.lit("before"), F.lit("it"))).alias("pre"), F.when(k % 3 == 0, F.array(F.lit("after"))).otherwise(F.array(F.lit(" "))).alias("post"))
    return t.select("l_orderkey", io.table_evidence("table", "pre", "post").alias("evidence"), io.context_evidence("table", "pre").alias("context"))


@query(
    "io5_exposed_cases",
    "SELECT 'round3_dev_' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 3, '0') || '_0000abcd' AS case_id, CASE WHEN o_orderkey % 100 % 4 = 0 THEN 'informed' ELSE 'seen' END AS category, count(DISTINCT o_orderkey % 100) AS files FROM orders GROUP BY ALL",
)
def _(spark, d):
    """A hundred files that mention cases; those of every fourth are of the second kind."""
    path, k = folder(spark), F.col("o_orderkey")
    line = F.concat(F.lit("see round3_dev_"), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("_0000abcd, not xround3_dev_001_0000abcd"))
    o = fx.read(spark, d, "orders").select((k % 100).alias("file"), line.alias("line")).distinct()
    files = o.groupBy("file").agg(F.concat(F.when(F.col("file") % 4 == 0, "An APD case\n").otherwise(""), F.array_join(F.collect_list("line"), "\n")).alias("value"))
    files.repartition(100, "file").write.partitionBy("file").option("lineSep", "\n\n").text(path)
    e = io.exposures(spark, path, r"\bround3_(?:dev|test)_\d{3}_[0-9a-f]{8}\b", "apd", ("seen", "informed"))
    return e.select("case_id", "category", F.size("sources").cast("long").alias("files"))
