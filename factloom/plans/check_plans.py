"""Queries for re-scoring, self-tests, targets, validation, the ledger, term presence and required facts, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, contracts, graph, slots
from ..sources import fixtures as fx
from .gate_plans import MEAN, pick
from .graph_plans import EDGES
from .shapes import FACTS, SLOTTED, SLOTTED_WHOLE
from .slot_plans import BOTH, SCORED_SQL, numbers_sql, rounded_sql

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scored(spark, d):
    return slots.score(fx.slotted_traces(spark, d))


STEPPED = "CASE WHEN e = 0 THEN v WHEN v / e BETWEEN 80 AND 120 THEN v / 100 WHEN v / e BETWEEN 0.008 AND 0.012 THEN v * 100 ELSE v END"
TWO = "coalesce(list_min(list_transform(vs, lambda v: abs({0} - e))) <= greatest(0.5, 0.02 * abs(e)), false)"


@query(
    "sc5_slot_variants",
    f"""WITH {SCORED_SQL}, w AS (SELECT trace_id, bool_and({TWO.format('v')}) AS two, bool_and({TWO.format(STEPPED)}) AS stepped FROM s2 GROUP BY trace_id),
    x AS (SELECT s.*, coalesce(w.two, false) AND format_ok AS two, coalesce(w.stepped, false) AND format_ok AS stepped, CASE WHEN kept THEN coalesce(earlier_nc, nc0) ELSE nc0 END AS nc, formula_type = 'finqa_program' AND NOT success AS again FROM scored s LEFT JOIN w USING (trace_id)),
    v AS (SELECT method, unnest(['base', 'tolerance_2pct', 'tolerance_2pct_unit', 'partial', 'no_suspects']) AS variant, unnest([CAST(success AS DOUBLE), CAST(CASE WHEN again THEN two ELSE success END AS DOUBLE), CAST(CASE WHEN again THEN stepped ELSE success END AS DOUBLE), CASE WHEN success THEN 1.0 WHEN nc >= 0.9 THEN 0.5 ELSE 0.0 END::DOUBLE, CASE WHEN trace_id % 6 <> 1 THEN CAST(success AS DOUBLE) END]) AS s FROM x)
    SELECT method, variant, count(s) AS n, {MEAN.format('s')} AS mean FROM v GROUP BY ALL""",
)
def _(spark, d):
    s = scored(spark, d)
    v = checks.variants(s, fx.read(spark, d, "orders").where("o_orderkey % 6 = 1").select(F.col("o_orderkey").alias("trace_id")))
    return v.groupBy("method", "variant").agg(F.count("score").alias("n"), checks.average(F.col("score")).alias("mean"))


@query(
    "sc6_reproduced_means",
    f"WITH {SCORED_SQL}, e(method, expected_mean) AS (VALUES ('vector_only', 0.45::DOUBLE), ('hybrid', 0.11::DOUBLE), ('graph_neo4j_v9', 0.09::DOUBLE), ('absent', 0.0::DOUBLE)), m AS (SELECT method, count(*) AS n, {MEAN.format('CAST(success AS INTEGER)')} AS mean FROM scored GROUP BY method), j AS (SELECT e.method, coalesce(n, 0) AS n, coalesce(mean, 0.0) AS mean, expected_mean FROM e LEFT JOIN m ON m.method = e.method) SELECT *, {rounded_sql('(mean - expected_mean)')} AS delta, abs({rounded_sql('(mean - expected_mean)')}) <= 0.01 AS reproduced FROM j",
)
def _(spark, d):
    e = spark.createDataFrame([("vector_only", 0.45), ("hybrid", 0.11), ("graph_neo4j_v9", 0.09), ("absent", 0.0)], "method string, expected_mean double")
    return checks.reproduced(scored(spark, d), e)


#: Whether a slot that expects e agrees with a number v of an answer, where p tells if v was said in percent.
LIKE_SQL = """CASE WHEN unit = 'percentage' THEN abs(e - CASE WHEN p OR abs(v) > 1 THEN v ELSE v * 100 END) <= greatest(0.1, 1e-9 * greatest(abs(e), abs(CASE WHEN p OR abs(v) > 1 THEN v ELSE v * 100 END)))
      OR abs(e - CASE WHEN p THEN v / 100 ELSE v END) <= greatest(0.0015, 0.01 * greatest(abs(e), abs(CASE WHEN p THEN v / 100 ELSE v END)))
    WHEN abs(e) < 100 AND abs(v) < 100 THEN abs(e - v) <= greatest(0.01, 0.01 * greatest(abs(e), abs(v))) ELSE abs(e - v) <= greatest(0.01, 0.005 * greatest(abs(e), abs(v))) END"""


@query(
    "sc12_slot_self_test",
    f"""WITH {SLOTTED_WHOLE}, c AS (SELECT trace_id AS case_id, len(lines) AS k, list_transform(lines, lambda l: TRY_CAST(l.expected AS DOUBLE)) AS es, unit, unit = 'percentage' AS own FROM slotted),
    r AS (SELECT *, list_filter(es, lambda e: e IS NOT NULL) AS "real", list_filter(es[1:1], lambda e: e IS NOT NULL) AS "first", coalesce(es[1], 0.0) AS e1 FROM c),
    made AS (SELECT case_id, 'correct' AS "check", k, es, unit, own AS p, "real" AS vs FROM r UNION ALL SELECT case_id, 'blank', k, es, unit, false, [] FROM r
      UNION ALL SELECT case_id, 'wrong_formula', k, es, unit, own, list_transform(es, lambda e: {rounded_sql('(coalesce(e, 0.0) * 1.25 + 1)')}) FROM r UNION ALL SELECT case_id, 'wrong_year', k, es, unit, own, "first" FROM r
      UNION ALL SELECT case_id, 'wrong_denominator', k, es, unit, own, [{rounded_sql('(e1 * 0.5)')}] FROM r UNION ALL SELECT case_id, 'unit_mismatch', k, es, unit, false, "first" FROM r UNION ALL SELECT case_id, 'source_only', k, es, unit, false, "real" FROM r),
    hit AS (SELECT case_id, "check", k, len(list_filter(es, lambda e: e IS NOT NULL AND len(list_filter(vs, lambda v: {LIKE_SQL})) > 0)) AS hits FROM made)
    SELECT case_id, "check", CASE WHEN k = 0 THEN 0.0 ELSE {rounded_sql('hits / k')} END AS score, CASE WHEN "check" = 'correct' THEN k > 0 AND hits = k ELSE k = 0 OR hits < k END AS passes FROM hit""",
)
def _(spark, d):
    t = fx.slotted_traces(spark, d, every_line=True)
    facts = F.transform("slots", lambda s: F.struct(F.lit("m").alias("metric"), F.lit(2020).alias("year"), s["expected"].alias("value"), F.lit("u").alias("unit")))
    return checks.self_test(t.select(F.col("trace_id").alias("case_id"), "slots", facts.alias("facts")))


@query(
    "sc8_preferred_targets",
    f"""WITH {SLOTTED}, a AS (SELECT trace_id, {numbers_sql(BOTH)} AS ns, list_transform(lines, lambda l: TRY_CAST(l.expected AS DOUBLE)) AS es FROM slotted),
    f AS (SELECT trace_id, list_filter(ns, lambda n: len(list_filter(es, lambda e: e IS NOT NULL AND CASE WHEN n.p THEN abs(n.v - CASE WHEN abs(e) > 1 THEN e ELSE e * 100 END) <= greatest(0.1, 1e-9 * greatest(abs(n.v), abs(e))) OR abs(n.v / 100 - e) <= greatest(0.0015, 0.01 * greatest(abs(n.v / 100), abs(e))) ELSE abs(n.s - e) <= greatest(0.01, 0.005 * greatest(abs(n.s), abs(e))) OR abs(n.v - e) <= greatest(0.01, 0.005 * greatest(abs(n.v), abs(e))) END)) = 0) AS fresh FROM a)
    SELECT trace_id, len(list_filter(fresh, lambda n: n.p OR abs(n.v) < 100)) > 0 AS preferred, len(fresh) > 0 AS any_fresh FROM f""",
)
def _(spark, d):
    t = fx.slotted_traces(spark, d)
    got = checks.target_numbers(slots.both_texts(), F.transform("slots", lambda s: s["expected"]))
    all_ = F.size(got) > 0
    t = t.select("trace_id", got.alias("got"), text_numbers().alias("ns"))
    small = F.exists("got", lambda v: (F.abs(v) < 100) | F.exists("ns", lambda n: n["percent"] & (n["value"] == v)))
    return t.select("trace_id", small.alias("preferred"), (F.size("got") > 0).alias("any_fresh"))


def text_numbers():
    from ..functions import text

    return text.scaled_numbers(slots.both_texts())


@query(
    "fc4_validated_contracts",
    r"""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS dataset, CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS DOUBLE) AS p FROM orders),
    c AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'finqa_program' ELSE 'tatqa_arithmetic' END AS formula_type, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN k % 100 ELSE p END AS e, (k % 9 <> 0 AND k % 3 = 0) OR k % 3 = 1 AS enough FROM o),
    v AS (SELECT *, e IS NOT NULL AND enough AS has, CASE WHEN k % 4 = 0 THEN e * 1.05 WHEN k % 4 = 1 THEN e * 1.01 ELSE e END AS t FROM c), r AS (SELECT *, CASE WHEN has THEN abs(t - e) <= greatest(0.5, 0.02 * abs(e)) ELSE false END AS ok FROM v)
    SELECT dataset, formula_type, count(*) AS n, count_if(ok) AS ok, floor(count(*) / sum(count(*)) OVER (PARTITION BY dataset) * 10000 + 0.5) / 10000 AS share FROM r GROUP BY dataset, formula_type""",
)
def _(spark, d):
    c = contracts.from_derivations(fx.derivation_cases(spark, d))
    c = c.join(fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("dataset")), "case_id")
    k = F.col("case_id") % 4
    t = F.when(k == 0, F.col("expected") * 1.05).when(k == 1, F.col("expected") * 1.01).otherwise(F.col("expected"))
    v = checks.validated(c.select("dataset", F.col("kind").alias("formula_type"), "facts", F.array_compact(F.array(t)).alias("targets"), F.col("expected").alias("answer")))
    return checks.validation_shares(v)


PATHS = ("outputs/naive_baseline/v2/x.jsonl", "outputs/naive_baseline/a.jsonl", "outputs/round3_eval_runs/round8_traces.jsonl", "outputs/round10_rescore_v2/t.jsonl", "outputs/round12b/x.jsonl", "outputs/runs/locked_test_traces.jsonl", "outputs/any/thing.jsonl", "a\\round14b\\x.jsonl")
LEDGER = f"""l AS (SELECT event_id AS i, {list(PATHS)}[event_id % 8 + 1] AS path, event_id // 2 AS tid, ['gpt-4o-mini-2024', 'GPT-4o', 'other-model', NULL][event_id // 8 % 4 + 1] AS model, CASE WHEN event_id % 5 > 0 THEN user_id % 50 END AS p, CASE WHEN event_id % 5 > 1 THEN user_id % 7 END AS c, CASE WHEN event_id % 5 = 0 THEN user_id % 90 END AS t FROM events),
  once AS (SELECT * FROM l QUALIFY tid % 10 = 0 OR row_number() OVER (PARTITION BY tid ORDER BY path, model, p) = 1), r AS (SELECT *, coalesce(p, 0) AS pp, CASE WHEN p IS NULL AND c IS NULL THEN coalesce(t, 0) ELSE coalesce(c, 0) END AS cc,
    CASE path WHEN 'outputs/naive_baseline/v2/x.jsonl' THEN 'naive_v2' WHEN 'outputs/naive_baseline/a.jsonl' THEN 'naive_v1' WHEN 'outputs/round3_eval_runs/round8_traces.jsonl' THEN 'R8' WHEN 'outputs/round10_rescore_v2/t.jsonl' THEN 'R10_v2_rescore' WHEN 'outputs/round12b/x.jsonl' THEN 'R12B' WHEN 'outputs/runs/locked_test_traces.jsonl' THEN 'R3_locked_test' WHEN 'outputs/any/thing.jsonl' THEN 'other' ELSE 'R14B' END AS round,
    CASE WHEN model LIKE 'gpt-4o-mini%' THEN 'gpt-4o-mini' WHEN model = 'GPT-4o' THEN 'gpt-4o' ELSE coalesce(model, 'unknown') END AS name, CASE WHEN model LIKE 'gpt-4o-mini%' THEN 0.15 WHEN model = 'GPT-4o' THEN 2.5 END::DOUBLE AS rp, CASE WHEN model LIKE 'gpt-4o-mini%' THEN 0.6 WHEN model = 'GPT-4o' THEN 10.0 END::DOUBLE AS rc FROM once)"""


@query("ag14_full_ledger", f"WITH {LEDGER} SELECT round, count(*) AS calls, CAST(sum(pp) AS BIGINT) AS prompt, CAST(sum(cc) AS BIGINT) AS completion, list_sort(list(DISTINCT name)) AS models, round(coalesce(sum(pp / 1e6 * rp + cc / 1e6 * rc), 0.0), 4) AS cost, count_if(rp IS NULL) AS unpriced FROM r WHERE pp <> 0 OR cc <> 0 GROUP BY ROLLUP(round)")
def _(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    p, c, t = F.when(i % 5 > 0, u % 50), F.when(i % 5 > 1, u % 7), F.when(i % 5 == 0, u % 90)
    none = F.lit(None).cast("long")
    nested = i % 3 == 0
    usage = F.when(nested, F.struct(p.cast("long").alias("prompt_tokens"), c.cast("long").alias("completion_tokens"), t.cast("long").alias("total_tokens")))
    flat = lambda x: F.when(~nested, x.cast("long")).otherwise(none)
    rows = fx.read(spark, d, "events").select(
        pick(i % 8, *PATHS).alias("path"), F.when(F.floor(i / 2) % 10 != 0, F.floor(i / 2).cast("string")).alias("trace_id"), pick(F.floor(i / 8) % 4, "gpt-4o-mini-2024", "GPT-4o", "other-model", None).alias("model"),
        flat(p).alias("prompt_tokens"), flat(c).alias("completion_tokens"), flat(t).alias("total_tokens"), usage.alias("usage"),
    )
    return checks.ledger(rows, {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6)})


@query(
    "ag20_terms_with_none",
    r"WITH t(component, term) AS (VALUES ('license', 'open source'), ('license', 'license'), ('company', 'zzqx'), ('year', '2020'), ('metric', 'the')), d AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM documents) SELECT component, term, (SELECT count(*) FROM d WHERE contains(x, term)) AS records FROM t",
)
def _(spark, d):
    t = spark.createDataFrame([("license", "Open  Source"), ("license", "license"), ("company", "zzqx"), ("year", "2020"), ("metric", " THE "), ("metric", "the"), ("unit", " "), ("unit", None)], "component string, term string")
    return checks.term_presence(t, fx.read(spark, d, "documents").select("text"))


@query(
    "w6_scored_required_facts",
    f"""WITH {FACTS}, c AS (SELECT c_custkey AS case_id, 'S' || (c_custkey % 10 + 1) AS ticker, ['What was net income in 2018 and the gross profit?', 'Total revenue of 2020', 'Who?'][c_custkey % 3 + 1] AS q FROM customer),
    best AS (SELECT ticker, arg_max(value, year * 100 + length(metric)) AS v FROM facts GROUP BY ticker), ans AS (SELECT c.*, CASE WHEN case_id % 4 = 0 THEN v END AS a FROM c LEFT JOIN best USING (ticker)),
    j AS (SELECT case_id, f.metric || f.year AS fact_id, 2.0::DOUBLE * CASE case_id % 3 WHEN 0 THEN CASE f.metric WHEN 'net_income' THEN 2 WHEN 'gross_profit' THEN 2 WHEN 'operating_income' THEN 1 WHEN 'income_tax_expense' THEN 1 ELSE 0 END WHEN 1 THEN CASE f.metric WHEN 'total_revenue' THEN 1 ELSE 0 END ELSE 0 END
      + CASE WHEN a IS NOT NULL AND floor(abs(f.value) * 10000 + 0.5) * sign(f.value) = floor(abs(a) * 10000 + 0.5) * sign(a) THEN 3.0 ELSE 0.0 END + CASE WHEN contains(q, CAST(f.year AS VARCHAR)) OR (a IS NOT NULL AND contains(CAST(CAST(a AS DECIMAL(18,4)) AS VARCHAR), CAST(f.year AS VARCHAR))) THEN 1.5 ELSE 0.0 END + CASE WHEN f.metric IN ('total_revenue', 'net_income', 'operating_income') THEN 0.8 ELSE 0.0 END + CASE WHEN f.year % 2 = 0 THEN 0.0 ELSE 0.5 END AS score FROM ans JOIN facts f USING (ticker)),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, fact_id) AS rank, least(count_if(score > 0) OVER (PARTITION BY case_id), 8) AS hits, count(*) OVER (PARTITION BY case_id) AS n FROM j) SELECT case_id, fact_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE CASE WHEN hits < 2 AND n >= 2 THEN rank <= 4 ELSE score > 0 AND rank <= 8 END""",
)
def _(spark, d):
    k = F.col("c_custkey")
    c = fx.read(spark, d, "customer").select(k.alias("case_id"), F.concat(F.lit("S"), k % 10 + 1).alias("ticker"), pick(k % 3, "What was net income in 2018 and the gross profit?", "Total revenue of 2020", "Who?").alias("question"))
    f = fx.facts(spark, d)
    j = fx.facts_of_cases(c, f)
    answer = F.max_by("value", F.col("year") * 100 + F.length("metric")).cast("decimal(18,4)").cast("string")
    cases = j.groupBy("case_id", "question").agg(F.when(F.col("case_id") % 4 == 0, answer).alias("answer"))
    facts = j.select("case_id", F.concat("metric", "year").alias("fact_id"), F.replace("metric", F.lit("_"), F.lit(" ")).alias("metric_raw"), "metric", "year", "value", F.when(F.col("year") % 2 == 0, "numeric").otherwise("u").alias("unit"))
    return checks.required_facts(cases, facts)


@query("sf18_fact_texts", f"WITH {FACTS} SELECT ticker, metric, year, ticker || ' ' || metric || ' ' || year || ': ' || CAST(floor(value) AS BIGINT) || ' ' || CASE WHEN year % 3 = 0 THEN '' ELSE 'USD' END || CASE WHEN year % 2 = 0 THEN ' | ' || substr(repeat(metric || ' ', 9), 1, 80) ELSE '' END AS line FROM facts")
def _(spark, d):
    y = F.col("year")
    line = checks.fact_text(F.col("ticker"), F.col("metric"), y, F.floor("value"), F.when(y % 3 != 0, "USD"), F.when(y % 2 == 0, F.repeat(F.concat("metric", F.lit(" ")), F.lit(9))))
    return fx.facts(spark, d).select("ticker", "metric", "year", line.alias("line"))


@query(
    "tx4_spelt_quotes",
    """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), x AS (SELECT *, CASE k % 4 WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN format('{:,}', v) WHEN 2 THEN format('{:,}', v) || '.0' ELSE 'none' END AS s FROM o)
    SELECT k, CASE WHEN k % 4 = 3 THEN repeat('ab ', 10) || 'none at all' WHEN k % 4 = 2 THEN repeat('ab ', 10) || s || ' and ' || repeat('cd ', 17) || 'cd' ELSE repeat('ab ', 10) || s || ' and ' || repeat('cd ', 18) || 'c' END AS quote FROM x""",
)
def _(spark, d):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice")
    s = F.when(k % 4 == 0, v.cast("string")).when(k % 4 == 1, F.format_string("%,d", v)).when(k % 4 == 2, F.concat(F.format_string("%,d", v), F.lit(".0")))
    e = F.when(k % 4 == 3, F.concat(F.repeat(F.lit("ab "), F.lit(10)), F.lit("none at all"))).otherwise(F.concat(F.repeat(F.lit("ab "), F.lit(10)), s, F.lit(" and "), F.repeat(F.lit("cd "), F.lit(40))))
    q = checks.quote_of(e, v.cast("double"))
    return fx.read(spark, d, "orders").select(k.alias("k"), q.alias("quote"))


@query("j4_chain_share", f"WITH {EDGES} SELECT count(*) AS observations, count_if(length(o) % 5 <> 0) AS chained, {rounded_sql('count_if(length(o) % 5 <> 0) / count(*) * 100')} AS percent FROM obs")
def _(spark, d):
    f = fx.facts(spark, d)
    _, edges = graph.to_graph(f)
    return checks.chain_share(f, graph.full_chains(edges.where("type <> 'OBSERVES_METRIC' or length(src) % 5 <> 0")))
