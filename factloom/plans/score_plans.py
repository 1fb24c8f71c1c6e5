"""Queries for scoring, contracts and reports, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import coverage, graph, pairs, report, score, validate
from ..sources import fixtures as fx
from .graph_plans import COVER_SQL, EDGES, hits, hits_sql, modes, reachable, required, triples, REQ_SQL, ROUTE_SQL
from .shapes import FACTS, JUDGMENTS, OBSERVATIONS, TRACES
from .text_plans import EVIDENCE_SQL, NUMBERS_SQL, PARSE, VALID_SQL, evidence

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scored_sql(normalise: bool = False) -> str:
    unit = "list_transform(nums, lambda v: CASE WHEN expected = 0 THEN v WHEN v / expected BETWEEN 80 AND 120 THEN v / 100 WHEN v / expected BETWEEN 0.008 AND 0.012 THEN v * 100 ELSE v END)" if normalise else "nums"
    return f"""{TRACES}, num AS (SELECT *, {NUMBERS_SQL.format('answer')} AS nums FROM traces), unit AS (SELECT *, {unit} AS u FROM num),
  gap AS (SELECT *, list_min(list_transform(u, lambda v, i: struct_pack(gap := abs(v - expected), i := i, v := v))).v AS best FROM unit),
  flags AS (SELECT *, coalesce(abs(best - expected) <= CASE WHEN level = 0 THEN greatest(0.5, 0.02 * abs(expected)) ELSE greatest(0.1, 0.005 * abs(expected)) END, false) AS numeric_ok, answer <> '' AND calculation <> '' AS format_ok,
    regexp_matches(lower(calculation), '{score.CALCULATION}') AS calculation_ok, round(coalesce(1 - least(abs(best - expected) / greatest(abs(expected), 1.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE), 4) AS nc FROM gap),
  scored AS (SELECT *, CAST(numeric_ok AND format_ok AND calculation_ok AS INTEGER) AS ac, CASE WHEN numeric_ok AND format_ok AND calculation_ok THEN 'none' WHEN NOT format_ok THEN 'answer_format_error' WHEN NOT numeric_ok THEN 'formula_target_mismatch' ELSE 'scoring_uncertain' END AS failure_reason FROM flags)"""


def scored(spark, d):
    return score.score(fx.traces(spark, d))


MEAN = "coalesce(CAST((2 * sum(CAST(round({0} * 1000000) AS HUGEINT)) + 100 * count({0})) // (200 * count({0})) AS DOUBLE) / 10000, 0.0::DOUBLE)"


@query("sc1_slot_scorer", f"WITH {scored_sql()} SELECT trace_id, best, ac FROM scored")
def _(spark, d):
    return scored(spark, d).select("trace_id", "best", "ac")


@query("sc1_slot_scorer_in_unit", f"WITH {scored_sql(True)} SELECT trace_id, best, ac FROM scored")
def _(spark, d):
    return score.score(fx.traces(spark, d), normalise=True).select("trace_id", "best", "ac")


@query("sc2_numerical_closeness", f"WITH {scored_sql()} SELECT case_id, {MEAN.format('nc')} AS nc, max(nc) AS best_nc FROM scored GROUP BY case_id")
def _(spark, d):
    return scored(spark, d).groupBy("case_id").agg(report.mean("nc").alias("nc"), F.max("nc").alias("best_nc"))


@query("sc3_failure_reasons", f"WITH {scored_sql()} SELECT trace_id, failure_reason, ac = 0 AND trace_id % 13 = 0 AS original_success_preserved FROM scored")
def _(spark, d):
    return scored(spark, d).select("trace_id", "failure_reason", ((F.col("ac") == 0) & (F.col("trace_id") % 13 == 0)).alias("original_success_preserved"))


@query(
    "sc4_slot_recall_scorer",
    f"WITH {scored_sql()} SELECT case_id, round(avg(CASE WHEN numeric_ok THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS recall, avg(CASE WHEN numeric_ok THEN 1.0 ELSE 0.0 END::DOUBLE) >= 0.8 AS success, avg(CASE WHEN numeric_ok THEN 1.0 ELSE 0.0 END::DOUBLE) >= 0.8 AND bool_and(calculation_ok) AS faithful FROM scored GROUP BY case_id",
)
def _(spark, d):
    r = F.avg(F.col("numeric_ok").cast("double"))
    return scored(spark, d).groupBy("case_id").agg(F.round(r, 4).alias("recall"), (r >= 0.8).alias("success"), ((r >= 0.8) & F.bool_and("calculation_ok")).alias("faithful"))


VARIANTS = f"""WITH {scored_sql()}, v AS (SELECT method, unnest(['base', 'tolerance_2pct', 'partial', 'no_suspects']) AS variant, unnest([CAST(ac AS DOUBLE), CAST(coalesce(abs(best - expected) <= greatest(0.5, 0.02 * abs(expected)), false) AND format_ok AS DOUBLE), CASE WHEN ac = 1 THEN 1.0 WHEN nc >= 0.9 THEN 0.5 ELSE 0.0 END::DOUBLE, CASE WHEN case_id % 7 <> 0 THEN CAST(ac AS DOUBLE) END]) AS s FROM scored)"""


@query("sc5_sensitivity_variants", f"{VARIANTS} SELECT variant, method, count(s) AS n, {MEAN.format('s')} AS mean FROM v GROUP BY ALL")
def _(spark, d):
    return score.variants(scored(spark, d)).groupBy("variant", "method").agg(F.count("score").alias("n"), report.mean("score").alias("mean"))


@query("sc6_rescore_check", f"WITH {scored_sql()}, m AS (SELECT method, {MEAN.format('ac')} AS mean FROM scored GROUP BY method) SELECT method, mean, 0.3::DOUBLE AS expected_mean, abs(mean - 0.3::DOUBLE) <= 0.01 AS reproduced FROM m")
def _(spark, d):
    m = scored(spark, d).groupBy("method").agg(report.mean("ac").alias("mean"))
    return m.withColumn("expected_mean", F.lit(0.3)).withColumn("reproduced", F.abs(F.col("mean") - 0.3) <= 0.01)


@query("sc7_answer_fact_match", f"WITH {EVIDENCE_SQL}, m AS (SELECT ticker, metric, year, contains(evidence, CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR)) AS value_found, contains(evidence, CAST(year AS VARCHAR)) AS year_found, contains(evidence, metric) AS metric_found FROM facts JOIN evidence USING (ticker)) SELECT ticker, round(avg(CASE WHEN value_found AND metric_found THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS value_recall, count_if(year_found) AS years_found FROM m GROUP BY ticker")
def _(spark, d):
    m = fx.facts(spark, d).join(evidence(spark, d), "ticker")
    hit = F.contains("evidence", F.floor(F.abs("value")).cast("string")) & F.contains("evidence", "metric")
    return m.groupBy("ticker").agg(F.round(F.avg(hit.cast("double")), 4).alias("value_recall"), F.count_if(F.contains("evidence", F.col("year").cast("string"))).alias("years_found"))


@query("sc8_target_numbers", f"WITH {TRACES} SELECT trace_id, list_filter({NUMBERS_SQL.format('answer')}, lambda v: NOT (abs(expected - v) <= 0.01 * greatest(abs(expected), 1.0))) AS targets FROM traces")
def _(spark, d):
    t = fx.traces(spark, d)
    return t.select("trace_id", score.targets_of(F.col("answer"), F.array("expected")).alias("targets"))


@query("sc9_retrieval_coverage", f"WITH {hits_sql(12)} SELECT query_id AS case_id, bool_or(source = entity) AS side_a, bool_or(source = (entity + 1) % 10) AS side_b, bool_or(source = entity) AND bool_or(source = (entity + 1) % 10) AS both, round(count_if(source = entity) / 12.0::DOUBLE, 4) AS share FROM hits GROUP BY query_id")
def _(spark, d):
    h = hits(spark, d, 12)
    a, b = F.bool_or(F.col("source") == F.col("entity")), F.bool_or(F.col("source") == (F.col("entity") + 1) % 10)
    return h.groupBy(F.col("query_id").alias("case_id")).agg(a.alias("side_a"), b.alias("side_b"), (a & b).alias("both"), F.round(F.count_if(F.col("source") == F.col("entity")) / 12.0, 4).alias("share"))


CONTAINS = f"{hits_sql(6)}, ctx AS (SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) AS t FROM hits JOIN documents ON doc_id = chunk_id GROUP BY query_id)"


SC10_CASE = """CASE query_id % 3 WHEN 0 THEN 'open_source_license' WHEN 1 THEN 'the_user' ELSE 'no_such_metric' END AS metric, [(query_id % 50) || '.0', '2020.50'] AS nums, CASE WHEN query_id % 40 = 0 THEN ['The', 'zzq'] ELSE ['', 'Data'] END AS companies"""


@query(
    "sc10_context_contains",
    f"""WITH {CONTAINS}, k AS (SELECT query_id, t, {SC10_CASE} FROM ctx),
    h AS (SELECT query_id, len(list_filter(list_transform(nums, lambda x: rtrim(rtrim(x, '0'), '.')), lambda x: x <> '' AND contains(t, x))) AS n, contains(t, replace(metric, '_', ' ')) OR contains(t, metric) AS m, len(list_filter(companies, lambda c: c <> '' AND contains(t, lower(c)))) AS c FROM k)
    SELECT query_id, n > 0 AS expected_number, m AS expected_metric, c > 0 AS expected_company, n > 0 AND (m OR c > 0) AS matches, round((n + CAST(m AS INTEGER) + c) / 5.0::DOUBLE, 4) AS overlap FROM h""",
)
def _(spark, d):
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("k"), "text")
    h = hits(spark, d, 6).select("query_id", "rank", F.col("chunk_id").alias("k")).join(docs, "k")
    c = h.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"], " ").alias("context"))
    q = F.col("query_id")
    metric = F.when(q % 3 == 0, "open_source_license").when(q % 3 == 1, "the_user").otherwise("no_such_metric")
    numbers = F.array(F.concat((q % 50).cast("string"), F.lit(".0")), F.lit("2020.50"))
    companies = F.when(q % 40 == 0, F.array(F.lit("The"), F.lit("zzq"))).otherwise(F.array(F.lit(""), F.lit("Data")))
    return c.select("query_id", score.context_checks(F.col("context"), numbers, metric, companies).alias("x")).select("query_id", "x.*")


TAXONOMY = "CASE WHEN ac = 1 THEN 'none' WHEN tokens < 20 THEN 'retrieval_miss' WHEN NOT format_ok THEN 'answer_format_error' WHEN nc >= 0.9 THEN 'scorer_uncertain' WHEN nc > 0 THEN 'retrieved_but_reasoning_error' ELSE 'possible_hallucination' END"


@query("sc11_failure_taxonomy", f"WITH {scored_sql()} SELECT {TAXONOMY} AS failure_type, method, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, d):
    kind = (
        F.when(F.col("ac") == 1, "none").when(F.col("tokens") < 20, "retrieval_miss").when(~F.col("format_ok"), "answer_format_error")
        .when(F.col("nc") >= 0.9, "scorer_uncertain").when(F.col("nc") > 0, "retrieved_but_reasoning_error").otherwise("possible_hallucination")
    )
    return scored(spark, d).groupBy(kind.alias("failure_type"), "method").agg(F.count("*").alias("n"))


@query("sc12_oracle_self_test", f"WITH {TRACES} SELECT trace_id, case_id, k AS check, k = 'right' AS passes FROM traces, (SELECT unnest(['right', 'blank', 'wrong']) AS k)")
def _(spark, d):
    t = fx.traces(spark, d).withColumn("calculation", F.lit("a / b"))
    made = F.explode(F.array(F.struct(F.lit("right").alias("check"), F.format_string("%.2f", "expected").alias("answer")), F.struct(F.lit("blank").alias("check"), F.lit("").alias("answer")), F.struct(F.lit("wrong").alias("check"), F.format_string("%.2f", F.col("expected") * 3 + 50).alias("answer"))))
    t = t.withColumn("x", made).withColumn("answer", F.col("x.answer")).withColumn("check", F.col("x.check"))
    return score.score(t).select("trace_id", "case_id", "check", (F.col("ac") == 1).alias("passes"))


def sc13_percents(t: str) -> str:
    window = f"substr({t}, greatest(1, strpos({t}, y) - 90), strpos({t}, y) + 180 - greatest(1, strpos({t}, y) - 90))"
    return rf"list_transform(regexp_extract_all({window}, '(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(?:%|percent)', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE))"


SC13_YEARS = r"list_distinct(regexp_extract_all({0}, '\b((?:19|20)\d\d)\b', 1))"


@query(
    "sc13_consistency_warnings",
    f"""WITH {TRACES}, x AS (SELECT trace_id, 'In 2020: ' || answer AS f, CASE WHEN calculation = '' THEN '' ELSE '2020 gave ' || printf('%.2f', expected) || ' %' END AS c, CASE WHEN trace_id % 5 = 0 THEN 'Inventory turnover?' ELSE 'Margin?' END AS q FROM traces),
    w AS (SELECT trace_id, len(list_filter(list_intersect({SC13_YEARS.format('f')}, {SC13_YEARS.format('c')}), lambda y: len({sc13_percents('c')}) > 0 AND len(list_filter({sc13_percents('f')}, lambda v: len(list_filter({sc13_percents('c')}, lambda e: abs(v - e) <= 0.35)) = 0)) > 0)) > 0 AS mismatch, trace_id % 5 = 0 AS inventory FROM x)
    SELECT trace_id, list_filter([CASE WHEN inventory THEN 'ambiguous_formula' END, CASE WHEN mismatch THEN 'final_answer_calculation_mismatch' END, CASE WHEN inventory THEN 'missing_prior_period' END], lambda z: z IS NOT NULL) AS warnings FROM w WHERE inventory OR mismatch""",
)
def _(spark, d):
    calculation = F.when(F.col("calculation") == "", "").otherwise(F.concat(F.lit("2020 gave "), F.format_string("%.2f", "expected"), F.lit(" %")))
    question = F.when(F.col("trace_id") % 5 == 0, "Inventory turnover?").otherwise("Margin?")
    w = score.consistency_warnings(F.concat(F.lit("In 2020: "), "answer"), calculation, question, F.array(F.lit(2019), F.lit(2020)))
    return fx.traces(spark, d).select("trace_id", w.alias("warnings")).where(F.size("warnings") > 0)


@query("fc1_formula_roles", f"WITH {FACTS} SELECT ticker, CASE WHEN list_contains(m, 'gross_profit') AND list_contains(m, 'total_revenue') THEN 'gross_profit / total_revenue' END AS formula, len(list_filter(m, lambda x: contains(x, 'income'))) > 1 AS ambiguous FROM (SELECT ticker, list_distinct(list(metric)) AS m FROM facts GROUP BY ticker)")
def _(spark, d):
    m = fx.facts(spark, d).groupBy("ticker").agg(F.collect_set("metric").alias("m"))
    both = F.array_contains("m", "gross_profit") & F.array_contains("m", "total_revenue")
    return m.select("ticker", F.when(both, "gross_profit / total_revenue").alias("formula"), (F.size(F.filter("m", lambda x: F.contains(x, F.lit("income")))) > 1).alias("ambiguous"))


PIVOT = f"{FACTS}, p AS (SELECT ticker, year, rev, cost, rev - cost AS gross FROM cells)"


@query("fc2_target_slots", f"WITH {PIVOT} SELECT ticker, year, CASE WHEN rev <> 0 THEN round(gross / rev * 100, 4) END AS margin, round(cost / ((cost + lag(cost) OVER w) / 2), 4) AS turnover, round(rev - lag(rev) OVER w, 4) AS change FROM p WINDOW w AS (PARTITION BY ticker ORDER BY year)")
def _(spark, d):
    p = fx.facts(spark, d).groupBy("ticker", "year").pivot("metric", ["total_revenue", "cost_of_sales", "gross_profit"]).agg(F.first("value"))
    w = Window.partitionBy("ticker").orderBy("year")
    mean = (F.col("cost_of_sales") + F.lag("cost_of_sales").over(w)) / 2
    return p.select("ticker", "year", F.round(F.try_divide("gross_profit", "total_revenue") * 100, 4).alias("margin"), F.round(F.try_divide(F.col("cost_of_sales"), mean), 4).alias("turnover"), F.round(F.col("total_revenue") - F.lag("total_revenue").over(w), 4).alias("change"))


PROGRAM = "'subtract(' || CAST(o_totalprice AS VARCHAR) || ', const_100)'"
OPS = rf"list_transform(regexp_extract_all({PROGRAM}, 'const_m?\d+|-?\d+(?:\.\d+)?'), lambda x: TRY_CAST(regexp_replace(x, 'const_', '') AS DOUBLE))"


def contracts(spark, d):
    program = F.concat(F.lit("subtract("), F.col("o_totalprice").cast("string"), F.lit(", const_100)"))
    o = fx.read(spark, d, "orders").withColumn("operands", F.slice(text.operands(program), 1, 8))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("dataset"), "operands", (F.round("o_totalprice", 0) - 100).alias("answer"))


@query("fc3_program_contracts", f"SELECT o_orderkey, {OPS}[1:8] AS operands, round({OPS}[1] - {OPS}[2], 4) AS expected_value FROM orders")
def _(spark, d):
    return contracts(spark, d).select("o_orderkey", "operands", F.round(F.col("operands")[0] - F.col("operands")[1], 4).alias("expected_value"))


@query("fc4_contract_validation", f"WITH c AS (SELECT o_orderstatus AS dataset, abs({OPS}[1] - {OPS}[2] - (round(o_totalprice, 0) - 100)) <= greatest(0.5, 0.02 * abs(round(o_totalprice, 0) - 100)) AS ok FROM orders) SELECT dataset, ok, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 4) AS share FROM c GROUP BY dataset, ok")
def _(spark, d):
    c = contracts(spark, d)
    ok = F.abs(F.col("operands")[0] - F.col("operands")[1] - F.col("answer")) <= F.greatest(F.lit(0.5), 0.02 * F.abs("answer"))
    g = c.groupBy("dataset", ok.alias("ok")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dataset")), 4))


# extraction


@query(
    "tx3_canonical_observations",
    f"""WITH {VALID_SQL}, {metrics.DICT_SQL}, k AS (SELECT c.*, coalesce(d.canonical, {metrics.RULE_SQL}) AS metric FROM (SELECT * FROM checked WHERE reason IS NULL OR reason = 'metric_artifact') c LEFT JOIN dict d USING (m)),
    u AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric, year, round(value, 6) ORDER BY case_id, i) AS place FROM k WHERE reason IS NULL OR metric IS NOT NULL) SELECT ticker, metric, year, ordinal, metric IS NOT NULL AS mapped FROM u WHERE place = 1""",
)
def _(spark, d):
    o = validate.first_reason(fx.observations(spark, d)).where("reason is null or reason = 'metric_artifact'")
    o = metrics.canonical(o.withColumnRenamed("slug", "s")).where("reason is null or metric is not null")
    r = F.row_number().over(Window.partitionBy("ticker", "metric", "year", F.round("value", 6)).orderBy("case_id", "i"))
    return o.withColumn("r", r).where("r = 1").select("ticker", "metric", "year", "ordinal", F.col("metric").isNotNull().alias("mapped"))


@query("tx4_quote_for_value", f"WITH {EVIDENCE_SQL}, l AS (SELECT ticker, metric, year, evidence, strpos(evidence, CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR)) AS p FROM facts JOIN evidence USING (ticker)) SELECT ticker, metric, year, CASE WHEN p > 0 THEN substr(evidence, CAST(greatest(1, p - 60) AS BIGINT), 120) END AS quote FROM l")
def _(spark, d):
    j = fx.facts(spark, d).join(evidence(spark, d), "ticker").withColumn("p", F.expr("locate(cast(floor(abs(value)) as string), evidence)"))
    return j.select("ticker", "metric", "year", F.when(F.col("p") > 0, F.substring("evidence", F.greatest(F.lit(1), F.col("p") - 60), F.lit(120))).alias("quote"))


# reports


@query("ag1_method_summary", f"WITH {scored_sql()} SELECT method, count(*) AS n, {MEAN.format('ac')} AS ac, {MEAN.format('nc')} AS nc, {MEAN.format('tokens')} AS tokens FROM scored GROUP BY method")
def _(spark, d):
    return report.by_method(scored(spark, d))


@query("ag2_grouping_sets", f"WITH {scored_sql()} SELECT method, dataset, level, grouping(method, dataset, level) AS grain, count(*) AS n, {MEAN.format('ac')} AS ac FROM scored GROUP BY GROUPING SETS ((method), (method, dataset), (method, level), ())")
def _(spark, d):
    return report.at_grains(scored(spark, d), [("method",), ("method", "dataset"), ("method", "level"), ()], ["method", "dataset", "level"])


MODES = ("structural_graph", "graph_guided_chunk", "vector_topic_fallback", "text_only", "no_go")


@query("ag3_mode_pivot", f"WITH {ROUTE_SQL}, {scored_sql()}, j AS (SELECT method, mode, ac FROM scored s JOIN modes m ON m.case_id = s.case_id) SELECT method, " + ", ".join(f"CASE WHEN count(*) FILTER (mode = '{m}') > 0 THEN {MEAN.format(f"CASE WHEN mode = '{m}' THEN ac END")} END AS {m}_mean, count(*) FILTER (mode = '{m}') AS {m}_n" for m in ("structural_graph", "graph_guided_chunk", "vector_topic_fallback", "text_only", "no_go")) + f", {MEAN.format('ac')} AS overall_mean, count(*) AS overall_n FROM j GROUP BY method")
def _(spark, d):
    return report.pivot_means(scored(spark, d).join(modes(spark, d), "case_id"), "method", "mode", MODES, "ac")


@query("ag4_hypothesis_rates", f"WITH {scored_sql()} SELECT round(avg(ac) FILTER (method = 'm0'), 4) > round(avg(ac) FILTER (method = 'm1'), 4) AS h1, round(avg(CASE WHEN tokens < 20 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (ac = 0), 4) AS failed_short FROM scored")
def _(spark, d):
    a = lambda m: F.round(F.avg(F.when(F.col("method") == m, F.col("ac"))), 4)
    return scored(spark, d).agg((a("m0") > a("m1")).alias("h1"), F.round(F.avg(F.when(F.col("ac") == 0, (F.col("tokens") < 20).cast("double"))), 4).alias("failed_short"))


@query("ag5_judge_margins", f"WITH {JUDGMENTS}, m AS (SELECT judge, method, avg(code / 2.0::DOUBLE) AS s FROM judgments GROUP BY ALL), g AS (SELECT judge, round(max(s) FILTER (method = 'm0') - max(s) FILTER (method <> 'm0'), 6) AS margin FROM m GROUP BY judge) SELECT judge, margin, bool_and(margin > 0) OVER () AS all_judges FROM g")
def _(spark, d):
    m = fx.judgments(spark, d).groupBy("judge", "method").agg(F.avg(F.col("code") / 2).alias("s"))
    g = m.groupBy("judge").agg(F.round(F.max(F.when(F.col("method") == "m0", F.col("s"))) - F.max(F.when(F.col("method") != "m0", F.col("s"))), 6).alias("margin"))
    return g.join(g.agg(F.bool_and(F.col("margin") > 0).alias("all_judges")))  # one row


@query("ag6_coverage_cells", f"WITH {FACTS} SELECT metric, year, count(DISTINCT ticker) AS companies, count(*) AS observations, (SELECT count(DISTINCT ticker) FROM facts_raw) AS all_companies, (SELECT count(DISTINCT metric) FROM facts_raw) AS all_metrics, (SELECT count(*) FROM facts_raw) AS all_observations, (SELECT count(*) FROM (SELECT 1 FROM facts_raw GROUP BY metric, year HAVING count(DISTINCT ticker) >= 2)) AS comparable_cells FROM facts_raw GROUP BY metric, year HAVING count(DISTINCT ticker) >= 2 ORDER BY companies DESC, observations DESC, metric, year LIMIT 20")
def _(spark, d):
    return report.coverage_cells(fx.facts_raw(spark, d), 20)


CONS = "c AS (SELECT metric, ticker, year, bool_and(abs(value - f) <= greatest(0.01 * abs(f), 0.1)) AS same FROM (SELECT *, first_value(value) OVER (PARTITION BY ticker, metric, year ORDER BY ordinal) AS f, count(*) OVER (PARTITION BY ticker, metric, year) AS n FROM facts_raw) WHERE n > 1 GROUP BY ALL)"


@query("ag7_duplicate_consistency", f"WITH {FACTS}, {CONS} SELECT metric, count(*) AS cells, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS consistent FROM c GROUP BY metric")
def _(spark, d):
    w = Window.partitionBy("ticker", "metric", "year")
    f = fx.facts_raw(spark, d).withColumn("f", F.first("value").over(w.orderBy("ordinal"))).withColumn("n", F.count("*").over(w)).where("n > 1")
    c = f.groupBy("metric", "ticker", "year").agg(F.bool_and(F.abs(F.col("value") - F.col("f")) <= F.greatest(0.01 * F.abs("f"), F.lit(0.1))).alias("same"))
    return c.groupBy("metric").agg(F.count("*").alias("cells"), F.round(F.avg(F.col("same").cast("double")), 4).alias("consistent"))


@query("ag8_quality_gate", f"WITH {OBSERVATIONS} SELECT round(avg(CASE WHEN quote <> '' THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS verified, count_if(value = floor(value) AND value BETWEEN 2015 AND 2030) AS year_valued, avg(CASE WHEN quote <> '' THEN 1.0 ELSE 0.0 END::DOUBLE) >= 0.9 AS verified_ok, count_if(value = floor(value) AND value BETWEEN 2015 AND 2030) <= 1 AS years_ok FROM observations")
def _(spark, d):
    v, y = F.avg((F.col("quote") != "").cast("double")), F.count_if(text.value_is_year(F.col("value")))
    return fx.observations(spark, d).agg(F.round(v, 4).alias("verified"), y.alias("year_valued"), (v >= 0.9).alias("verified_ok"), (y <= 1).alias("years_ok"))


@query("ag9_input_audit", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_ids, count(*) - count(DISTINCT o_custkey) AS repeats, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing, count_if(o_orderstatus = '') AS blank FROM orders")
def _(spark, d):
    o, c = fx.read(spark, d, "orders"), fx.read(spark, d, "customer")
    a = o.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("distinct_ids"), F.count_if(F.col("o_orderstatus") == "").alias("blank"))
    m = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("missing"))
    return a.join(m).withColumn("repeats", F.col("rows") - F.col("distinct_ids"))  # one row each


@query("ag10_graph_census", f"WITH {EDGES} SELECT kind, target, count(*) AS n FROM (SELECT DISTINCT 'Company' AS kind, '' AS target, ticker AS k FROM obs UNION ALL SELECT DISTINCT 'Metric', '', metric FROM obs UNION ALL SELECT DISTINCT 'FiscalYear', '', CAST(year AS VARCHAR) FROM obs UNION ALL SELECT 'Observation', '', o FROM obs UNION ALL SELECT 'HAS_OBSERVATION', 'Observation', o FROM obs UNION ALL SELECT 'OBSERVES_METRIC', 'Metric', o FROM obs UNION ALL SELECT 'OBSERVED_IN_YEAR', 'FiscalYear', o FROM obs) GROUP BY ALL")
def _(spark, d):
    return report.census(*graph.to_graph(fx.facts(spark, d)))


@query("ag11_judge_distribution", f"WITH {JUDGMENTS} SELECT method, judge, count(*) AS n, round(avg(code / 2.0::DOUBLE), 4) AS mean, count_if(code = 0) AS incorrect, count_if(code = 1) AS partial, count_if(code = 2) AS correct, count_if(code IS NULL) AS parse_fail FROM judgments GROUP BY ALL")
def _(spark, d):
    n = lambda c: F.count_if(c)
    return fx.judgments(spark, d).groupBy("method", "judge").agg(F.count("*").alias("n"), F.round(F.avg(F.col("code") / 2), 4).alias("mean"), n(F.col("code") == 0).alias("incorrect"), n(F.col("code") == 1).alias("partial"), n(F.col("code") == 2).alias("correct"), n(F.col("code").isNull()).alias("parse_fail"))


FULL = f"{JUDGMENTS}, ok AS (SELECT item FROM judgments WHERE code IS NOT NULL GROUP BY item HAVING count(*) = 4), lab AS (SELECT * FROM judgments WHERE item IN (SELECT item FROM ok))"


@query(
    "ag12_cohen_kappa",
    f"""WITH {FULL}, p AS (SELECT a.judge AS j1, b.judge AS j2, a.code AS c1, b.code AS c2 FROM lab a JOIN lab b ON a.item = b.item AND a.judge < b.judge), n AS (SELECT j1, j2, count(*) AS n, avg(CASE WHEN c1 = c2 THEN 1.0 ELSE 0.0 END::DOUBLE) AS po, """
    + " + ".join(f"avg(CASE WHEN c1 = {k} THEN 1.0 ELSE 0.0 END::DOUBLE) * avg(CASE WHEN c2 = {k} THEN 1.0 ELSE 0.0 END::DOUBLE)" for k in range(3))
    + " AS pe FROM p GROUP BY ALL) SELECT j1, j2, n, round(po, 4) AS agreement, CASE WHEN abs(1 - pe) >= 1e-12 THEN round((po - pe) / (1 - pe), 4) END AS kappa FROM n",
)
def _(spark, d):
    return report.cohen(fx.judgments(spark, d).select("item", "judge", "code"))


@query(
    "ag13_fleiss_kappa",
    f"""WITH {FULL}, c AS (SELECT item, code, count(*) AS n FROM lab GROUP BY ALL), i AS (SELECT item, (sum(n * n) - 4) / 12.0::DOUBLE AS p, max(n) = 4 AS same FROM c GROUP BY item), t AS (SELECT count(*) AS items, avg(p) AS po, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END::DOUBLE) AS fu FROM i),
    e AS (SELECT CAST(sum(s * s) AS DOUBLE) / (sum(s) * sum(s)) AS pe FROM (SELECT code, sum(n) AS s FROM c GROUP BY code)) SELECT items, CASE WHEN abs(1 - pe) >= 1e-12 THEN round((po - pe) / (1 - pe), 4) END AS kappa, round(fu, 4) AS full_agreement FROM t, e""",
)
def _(spark, d):
    return report.fleiss(fx.judgments(spark, d).select("item", "judge", "code"))


LEDGER = f"{TRACES}, logs AS (SELECT trace_id, 'r' || (trace_id % 3) AS round, 'gpt_' || level AS model, tokens, 'a' AS file FROM traces UNION ALL SELECT trace_id, 'r9', 'gpt_' || level, tokens, 'b' FROM traces WHERE trace_id % 10 = 0), u AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY file) = 1)"


def logs(spark, d):
    t = fx.traces(spark, d).select("trace_id", F.concat(F.lit("r"), F.col("trace_id") % 3).alias("round"), F.concat(F.lit("gpt_"), "level").alias("model"), "tokens", F.lit("a").alias("file"))
    return t.unionByName(t.where("trace_id % 10 = 0").withColumn("round", F.lit("r9")).withColumn("file", F.lit("b")))


@query("ag14_cost_ledger", f"WITH {LEDGER} SELECT round, count(*) AS calls, sum(tokens) AS tokens, round(coalesce(sum(tokens * CASE model WHEN 'gpt_0' THEN 0.6 WHEN 'gpt_1' THEN 10.0 END::DOUBLE / 1e6), 0.0::DOUBLE), 6) AS cost, count_if(model NOT IN ('gpt_0', 'gpt_1')) AS unpriced, array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM u WHERE tokens > 0 GROUP BY ROLLUP (round)")
def _(spark, d):
    return report.ledger(logs(spark, d), spark.createDataFrame([("gpt_0", 0.6), ("gpt_1", 10.0)], "model string, per_million double"))


@query("ag15_extraction_rollup", f"WITH {FACTS}, {REQ_SQL}, x AS (SELECT r.metric, f.value IS NOT NULL AS got, coalesce(abs(f.value - r.expected) <= 0.01 * abs(r.expected), false) AS ok FROM req r LEFT JOIN facts f ON f.ticker = r.ticker AND f.metric = r.metric AND f.year = r.year AND f.year % 4 <> 0) SELECT metric, count(*) AS targets, count_if(got) AS extracted, count_if(ok) AS ok, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS rate FROM x GROUP BY ROLLUP (metric)")
def _(spark, d):
    x = required(spark, d).join(fx.facts(spark, d).where("year % 4 <> 0"), ["ticker", "metric", "year"], "left")
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= 0.01 * F.abs("expected"), F.lit(False))
    return x.rollup("metric").agg(F.count("*").alias("targets"), F.count("value").alias("extracted"), F.count_if(ok).alias("ok"), F.round(F.avg(ok.cast("double")), 4).alias("rate"))


@query("ag16_error_matrix", f"WITH {scored_sql()} SELECT failure_reason, method, dataset, count(*) AS n FROM scored GROUP BY CUBE (method, dataset), failure_reason")
def _(spark, d):
    s = scored(spark, d)
    g = s.groupingSets([[F.col("failure_reason"), F.col("method"), F.col("dataset")], [F.col("failure_reason"), F.col("method")], [F.col("failure_reason"), F.col("dataset")], [F.col("failure_reason")]], F.col("failure_reason"), F.col("method"), F.col("dataset"))
    return g.agg(F.count("*").alias("n"))


@query("ag17_attempts", f"WITH {scored_sql()} SELECT method, count(*) AS attempts, round(avg(CASE WHEN answer = '' THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS provider_error_rate, round(avg(ac) FILTER (answer <> ''), 4) AS scored_mean, round(avg(ac), 4) AS all_mean FROM scored GROUP BY method")
def _(spark, d):
    empty = F.col("answer") == ""
    return scored(spark, d).groupBy("method").agg(F.count("*").alias("attempts"), F.round(F.avg(empty.cast("double")), 4).alias("provider_error_rate"), F.round(F.avg(F.when(~empty, F.col("ac"))), 4).alias("scored_mean"), F.round(F.avg("ac"), 4).alias("all_mean"))


@query("ag18_name_hygiene", "SELECT p_name AS name, count(*) AS entries, count(DISTINCT p_brand) AS owners, regexp_matches(p_name, '[^a-z0-9 _#]') AS malformed FROM part GROUP BY p_name HAVING count(*) > 1 OR regexp_matches(p_name, '[^a-z0-9 _#]')")
def _(spark, d):
    n = fx.read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("entries"), F.countDistinct("p_brand").alias("owners"))
    return n.withColumn("malformed", F.col("name").rlike("[^a-z0-9 _#]")).where("entries > 1 or malformed")


@query(
    "ag19_missing_fact_triage",
    f"""WITH {COVER_SQL}, t AS (SELECT case_id, side, list_filter([CASE WHEN NOT company THEN 'company_ticker_mismatch' END, CASE WHEN NOT metric_found THEN 'metric_mismatch' END, CASE WHEN NOT chain THEN 'period_mismatch' END, CASE WHEN case_id % 3 = 0 THEN 'value_mismatch' END], lambda x: x IS NOT NULL) AS c FROM fl)
    SELECT case_id, side, array_to_string(c, ',') AS classes, coalesce(c[1], 'matched') AS primary_class, CASE WHEN len(c) = 0 THEN 'none' WHEN c[1] = 'value_mismatch' THEN 'replace_value' ELSE 'insert_fact' END AS patch, CASE WHEN len(c) >= 3 THEN 'high' WHEN len(c) = 2 THEN 'medium' ELSE 'low' END AS risk FROM t""",
)
def _(spark, d):
    from .graph_plans import Q as G

    f = G["j6_fuzzy_coverage"](spark, d).withColumn("year_found", F.col("chain")).withColumn("value_near", F.col("case_id") % 3 != 0)
    return coverage.triage(f).select("case_id", "side", F.array_join("classes", ",").alias("classes"), "primary_class", "patch", "risk")


@query("ag20_term_presence", "SELECT term, count(*) AS records FROM (SELECT unnest(['license', 'the', 'und', 'idiot']) AS term) t JOIN documents d ON contains(lower(d.text), term) GROUP BY term")
def _(spark, d):
    terms = spark.createDataFrame([(x,) for x in ("license", "the", "und", "idiot")], "term string")
    docs = fx.read(spark, d, "documents").select(F.lower("text").alias("t"))
    return docs.join(F.broadcast(terms), F.contains("t", F.col("term"))).groupBy("term").agg(F.count("*").alias("records"))  # four terms


@query(
    "ag21_case_flags",
    f"""WITH {scored_sql()}, w AS (SELECT case_id, method, ac, list_filter([CASE WHEN answer = '' THEN 'blank' END, CASE WHEN calculation = '' THEN 'no_calculation' END, CASE WHEN nc BETWEEN 0.85 AND 0.95 THEN 'near' END], lambda x: x IS NOT NULL) AS c FROM scored)
    SELECT case_id, array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS categories, bool_or(list_contains(c, 'blank')) AS excluded, round(avg(ac) FILTER (NOT list_contains(c, 'blank')), 4) AS clean_mean FROM w GROUP BY case_id""",
)
def _(spark, d):
    c = F.array_compact(F.array(F.when(F.col("answer") == "", "blank"), F.when(F.col("calculation") == "", "no_calculation"), F.when(F.col("nc").between(0.85, 0.95), "near")))
    s = scored(spark, d).withColumn("c", c)
    out = F.array_contains("c", "blank")
    return s.groupBy("case_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), ",").alias("categories"), F.bool_or(out).alias("excluded"), F.round(F.avg(F.when(~out, F.col("ac"))), 4).alias("clean_mean"))


@query("w12_disagreements", f"WITH {FULL} SELECT item, string_agg(judge || ':' || code, ' ' ORDER BY judge) AS verdicts FROM lab GROUP BY item HAVING count(DISTINCT code) > 1 ORDER BY item LIMIT 20")
def _(spark, d):
    full = report.complete(fx.judgments(spark, d), 4)
    v = full.groupBy("item").agg(F.countDistinct("code").alias("k"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "judge", "code"))), " ").alias("verdicts"))
    return v.where("k > 1").orderBy("item").limit(20).select("item", "verdicts")
