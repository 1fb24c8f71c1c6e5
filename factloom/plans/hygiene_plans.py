"""Queries for tickers, issues, formula types, tolerances, coverage, dictionaries and graphs of clean cases, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import hygiene, slots, validate
from ..sources import fixtures as fx
from .gate_plans import pick
from .shapes import FACTS, OBSERVATIONS
from .text_plans import EVIDENCE_SQL, QUESTION_SQL, REASON_SQL, YEARS_SQL, evidence, questions

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(c: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter([{quoted(words)}], lambda w: contains({c}, w))) > 0"


def codes_sql(rules: list[tuple[str, str]]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules) + "], lambda x: x IS NOT NULL))"


CASES = """cases AS (
  SELECT s_suppkey AS s, 'case_' || s_suppkey AS case_id,
    ['', 'Unknown', 'Values and Principles', 'Impact of growth', 'What is the net result', 'Long-Term Debt', s_name, ' A company whose name runs on well past all of its letters '][s_suppkey % 8 + 1] AS company,
    CASE WHEN s_suppkey % 5 < 3 THEN ['N/A', 'us', ''][s_suppkey % 5 + 1] ELSE 'S' || s_suppkey END AS ticker,
    ['What is the net result of 2020?', 'How did total_revenue grow?', 'impact of growth at ' || s_name][s_suppkey % 3 + 1] AS question,
    ['', 'It was 12.5% in 2021', 'operating_expense fell', '(1,250) and 2019'][s_suppkey % 4 + 1] AS expected_answer,
    ['total_revenue was reported', 'cost_of_sales was reported' || chr(10) || 'operating_expense was reported', 'total_revenue was reported; their maturity is in 2016',
      'total_revenue was reported, cost_of_sales was reported, 10% - 12% of it; expires by 2018'][s_suppkey % 4 + 1] AS evidence
  FROM supplier)"""

CASE_FACTS = f"""{OBSERVATIONS}, {CASES}, case_facts AS (
  SELECT case_id, raw_metric || '/' || year || '/' || ordinal AS fact_id, CASE WHEN year % 7 = 0 THEN raw_metric || ' at the end of' ELSE raw_metric END AS metric_raw,
    {metrics.SLUG_SQL.format('raw_metric')} AS metric, ticker, year, CASE WHEN ordinal = 'R' THEN -value ELSE value END AS value,
    CASE year % 3 WHEN 0 THEN unit WHEN 1 THEN 'USD_per_share' ELSE 'numeric' END AS unit, quote, CASE ordinal WHEN 'A' THEN 'numerator' WHEN 'R' THEN 'total' END AS role, year % 4 = 0 AS derived,
    ordinal = 'A' AS source, ordinal FROM observations)"""


def cases(spark, d):
    """A case for each supplier; companies, tickers and evidence are of all kinds that can be wrong."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    of = lambda n, *v: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]), (k % n).cast("int"))
    s = F.concat(F.lit("S"), k.cast("string"))
    return fx.read(spark, d, "supplier").select(
        k.alias("s"), F.concat(F.lit("case_"), k.cast("string")).alias("case_id"),
        of(8, "", "Unknown", "Values and Principles", "Impact of growth", "What is the net result", "Long-Term Debt", name, " A company whose name runs on well past all of its letters ").alias("company"),
        of(5, "N/A", "us", "", s, s).alias("ticker"),
        of(3, "What is the net result of 2020?", "How did total_revenue grow?", F.concat(F.lit("impact of growth at "), name)).alias("question"),
        of(4, "", "It was 12.5% in 2021", "operating_expense fell", "(1,250) and 2019").alias("expected_answer"),
        of(4, "total_revenue was reported", "cost_of_sales was reported\noperating_expense was reported", "total_revenue was reported; their maturity is in 2016",
           "total_revenue was reported, cost_of_sales was reported, 10% - 12% of it; expires by 2018").alias("evidence"),
    )


def case_facts(spark, d):
    o, raw, year = fx.observations(spark, d), F.col("raw_metric"), F.col("year")
    return o.select(
        "case_id", F.concat(raw, F.lit("/"), year.cast("string"), F.lit("/"), "ordinal").alias("fact_id"), F.when(year % 7 == 0, F.concat(raw, F.lit(" at the end of"))).otherwise(raw).alias("metric_raw"),
        metrics.slug(raw).alias("metric"), "ticker", "year", F.when(F.col("ordinal") == "R", -F.col("value")).otherwise(F.col("value")).alias("value"),
        F.when(year % 3 == 0, F.col("unit")).when(year % 3 == 1, "USD_per_share").otherwise("numeric").alias("unit"), "quote",
        F.when(F.col("ordinal") == "A", "numerator").when(F.col("ordinal") == "R", "total").alias("role"), (year % 4 == 0).alias("derived"), (F.col("ordinal") == "A").alias("source"), "ordinal",
    )


DENY = ("FY", "US", "EPS", "GAAP")


@query(
    "fp3_allowed_tickers",
    f"""WITH t AS (SELECT c_custkey, replace(upper(trim(left(c_mktsegment, CAST(c_custkey % 7 AS INTEGER)) || CASE WHEN c_custkey % 3 = 0 THEN '.a' ELSE ' ' END)), '.', '') AS ticker FROM customer)
    SELECT c_custkey, ticker FROM t WHERE regexp_full_match(ticker, '[A-Z]{{1,5}}') AND ticker NOT IN ({quoted(DENY)}) AND ticker IN (SELECT upper(left(c_mktsegment, CAST(c_custkey % 4 + 1 AS INTEGER))) FROM customer WHERE c_custkey % 2 = 0)""",
)
def _(spark, d):
    c = fx.read(spark, d, "customer")
    raw = F.concat(F.left("c_mktsegment", (F.col("c_custkey") % 7).cast("int")), F.when(F.col("c_custkey") % 3 == 0, ".a").otherwise(" "))
    listed = c.where("c_custkey % 2 = 0").select(F.lower(F.left("c_mktsegment", (F.col("c_custkey") % 4 + 1).cast("int"))))
    return hygiene.allowed_tickers(c.select("c_custkey", raw.alias("ticker")), "ticker", DENY, listed).select("c_custkey", "ticker")


COMPANY_RULES = [
    ("bad_company_exact_or_unknown", f"c IN ({quoted(hygiene.NO_COMPANY)})"),
    ("bad_or_missing_ticker", f"upper(t) IN ({quoted(hygiene.NO_TICKER)})"),
    ("company_looks_like_question_phrase", f"length(c) > 45 OR {any_of('c', hygiene.QUESTION_WORDS)}"),
    ("company_looks_like_section_heading", any_of("c", hygiene.SECTIONS)),
    ("company_prefix_matches_question_phrase", "c <> '' AND starts_with(lower(question), left(c, 25))"),
]


@query("fp7_company_issues", f"WITH {CASES}, n AS (SELECT *, lower(trim(company)) AS c, trim(ticker) AS t FROM cases), i AS (SELECT case_id, company, ticker, {codes_sql(COMPANY_RULES)} AS issues FROM n) SELECT * FROM i WHERE len(issues) > 0")
def _(spark, d):
    return hygiene.company_issues(cases(spark, d)).select("case_id", "company", "ticker", "issues")


NUMBERS_SQL = r"""list_transform(regexp_extract_all(expected_answer, '\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?'), lambda t: round((CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN -1 ELSE 1 END) * TRY_CAST(regexp_replace(trim(t, '()'), '[$,%]', '', 'g') AS DOUBLE), 4))"""
WORDS_SQL = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9&''-]{{2,}}'), lambda w: lower(w)), lambda w: w NOT IN ({1}))"
FACT_RULES = [
    ("derived_answer_value_marked_as_source_fact", "derived AND source"),
    ("evidence_quote_is_synthetic_not_exact_excerpt", "quote <> '' AND NOT contains(evidence, quote)"),
    ("fact_not_clearly_needed_for_expected_answer", "NOT (common > 0 OR contains(asked, CAST(year AS VARCHAR)) OR list_contains(numbers, round(value, 4)))"),
    ("metric_looks_like_header_or_section_phrase", any_of("names", hygiene.HEADERS)),
    ("missing_evidence_quote", "quote = ''"),
    ("negative_value_may_be_percentage_range_artifact", rf"value < 0 AND regexp_matches(evidence, '(?i){hygiene.PERCENT_RANGE}')"),
    ("unclear_fact_role", f"coalesce(role, '') NOT IN ({quoted(hygiene.ROLES)})"),
    ("unit_conflicts_with_metric", "unit = 'USD_per_share' AND (contains(names, 'revenue') OR contains(names, 'premium') OR contains(names, 'sales'))"),
    ("unit_too_generic_for_eval_ready_fact", "unit = 'numeric'"),
    ("year_is_before_2000_reporting_period", "year < 2000"),
    ("year_looks_like_birth_maturity_or_expiration_date", rf"regexp_matches(evidence, '(?i){hygiene.OTHER_DATE}' || year || '\b')"),
]
ARTIFACT_NAMES = {
    "metric_looks_like_header_or_section_phrase": "metric_header_phrase", "unit_conflicts_with_metric": "usd_per_share_revenue_conflict", "year_is_before_2000_reporting_period": "pre_2000_reporting_period",
    "year_looks_like_birth_maturity_or_expiration_date": "non_reporting_year_used_as_period", "negative_value_may_be_percentage_range_artifact": "negative_percentage_range_artifact",
}


@query(
    "fp7_fact_issues",
    f"""WITH {CASE_FACTS}, n AS (SELECT f.*, question || ' ' || expected_answer AS asked, evidence, lower(metric_raw || ' ' || metric) AS names, {NUMBERS_SQL} AS numbers,
      len(list_intersect({WORDS_SQL.format("question || ' ' || expected_answer", quoted(hygiene.STOP_WORDS))}, {WORDS_SQL.format('metric_raw', quoted(hygiene.STOP_WORDS))})) AS common FROM case_facts f JOIN cases USING (case_id)),
    i AS (SELECT case_id, fact_id, {codes_sql(FACT_RULES)} AS issues, {codes_sql([(ARTIFACT_NAMES[k], c) for k, c in FACT_RULES if k in ARTIFACT_NAMES])} AS artifacts FROM n) SELECT * FROM i WHERE len(issues) > 0""",
)
def _(spark, d):
    return hygiene.fact_issues(case_facts(spark, d), cases(spark, d)).select("case_id", "fact_id", "issues", "artifacts")


@query(
    "sf9_formula_type_with_evidence",
    f"""WITH {EVIDENCE_SQL}, s AS (SELECT c_custkey, lower({QUESTION_SQL} || ' ' || left(coalesce(CASE WHEN c_custkey % 3 > 0 THEN evidence END, ''), 600)) AS q FROM customer LEFT JOIN evidence ON ticker = 'S' || (c_custkey % 10 + 1)),
    y AS (SELECT *, len({YEARS_SQL.format('q')}) AS n_years FROM s) SELECT c_custkey, {text.FORMULA_SQL} AS formula_type FROM y""",
)
def _(spark, d):
    q = questions(spark, d).withColumn("ticker", F.concat(F.lit("S"), (F.col("c_custkey") % 10 + 1).cast("string"))).join(evidence(spark, d), "ticker", "left")
    q = q.withColumn("evidence", F.when(F.col("c_custkey") % 3 > 0, F.col("evidence")))
    return hygiene.formula_types(q, "question", "evidence").select("c_custkey", "formula_type")


FACTORS = (1.0, 1.004, 1.015, 100.0, 0.01, 1.03)


@query(
    "sf12_typed_tolerance",
    f"""WITH n AS (SELECT l_orderkey, l_linenumber, ['finqa_program', 'revenue_growth', 'tatqa_arithmetic'][l_orderkey % 3 + 1] AS formula_type, CAST(l_extendedprice AS DOUBLE) AS e,
      CAST(l_extendedprice AS DOUBLE) * [{', '.join(f'{x}::DOUBLE' for x in FACTORS)}][(l_orderkey + l_linenumber) % 6 + 1] AS a FROM lineitem),
    u AS (SELECT *, CASE WHEN formula_type IN ('finqa_program', 'tatqa_arithmetic') THEN greatest(0.5, abs(e) * 0.02::DOUBLE) ELSE greatest(0.1, abs(e) * 0.005::DOUBLE) END AS tol,
      CASE WHEN e = 0 OR a = 0 THEN a WHEN a / e BETWEEN 80 AND 120 THEN a / 100.0::DOUBLE WHEN a / e BETWEEN 0.008::DOUBLE AND 0.012::DOUBLE THEN a * 100.0::DOUBLE ELSE a END AS v FROM n)
    SELECT formula_type, (l_orderkey + l_linenumber) % 6 AS kind, count(*) AS n, count_if(abs(a - e) <= tol) AS within, count_if(abs(v - e) <= tol) AS within_after_step, count_if(v <> a) AS stepped FROM u GROUP BY ALL""",
)
def _(spark, d):
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    l = fx.read(spark, d, "lineitem").select(pick(F.col("l_orderkey") % 3, "finqa_program", "revenue_growth", "tatqa_arithmetic").alias("formula_type"), kind.alias("kind"), F.col("l_extendedprice").cast("double").alias("e"))  # noqa: E741
    l = l.withColumn("a", F.col("e") * pick(F.col("kind"), *FACTORS)).withColumn("tol", slots.tolerance(F.col("e"), F.col("formula_type"))).withColumn("v", slots.in_unit(F.col("a"), F.col("e")))  # noqa: E741
    near = lambda c: F.count_if(F.abs(F.col(c) - F.col("e")) <= F.col("tol"))
    return l.groupBy("formula_type", "kind").agg(F.count("*").alias("n"), near("a").alias("within"), near("v").alias("within_after_step"), F.count_if(F.col("v") != F.col("a")).alias("stepped"))


REQUIRED = f"""{FACTS}, required AS (
  SELECT 'case_' || CAST(substr(ticker, 2) AS INTEGER) || '_' || ticker AS case_id, metric || year AS fact_id, CASE WHEN metric = 'cost_of_sales' AND year % 2 = 0 THEN 'src/' || ticker END AS source_id,
    CASE WHEN ascii(substr(ticker, length(ticker))) % 2 = 0 THEN ticker END AS ticker, CASE WHEN metric <> 'net_income' THEN metric END AS metric, replace(metric, '_', ' ') AS metric_raw,
    CASE WHEN year % 5 > 0 THEN year END AS year, CASE WHEN year % 3 = 0 THEN 'Currency Millions' END AS unit, CASE WHEN year % 4 > 0 THEN value * CASE length(metric) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.00005::DOUBLE ELSE 1.02::DOUBLE END END AS value FROM facts
), seen AS (
  SELECT CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 3 = 0 THEN ticker ELSE 'src/' || ticker END AS case_key, metric || '_reported' AS metric, year, CASE WHEN year % 2 = 0 THEN 'currency_millions' ELSE 'count' END AS unit, value FROM facts
), k AS (
  SELECT case_id, coalesce(min(source_id) FILTER (fact_id = first_id), NULLIF(string_split(case_id, '_')[-1], ''), case_id) AS case_key
  FROM (SELECT *, min(CASE WHEN source_id IS NOT NULL THEN fact_id END) OVER (PARTITION BY case_id) AS first_id FROM required) GROUP BY case_id
), m AS (
  SELECT r.case_id, r.fact_id, r.ticker, r.metric, r.metric_raw, r.value, k.case_key, count_if(coalesce((contains(o.metric, coalesce(r.metric, replace(r.metric_raw, ' ', '_'))) OR contains(o.metric, replace(r.metric_raw, ' ', '_')))
    AND (r.unit IS NULL OR contains(o.unit, 'currency_millions')) AND (r.value IS NULL OR abs(abs(o.value) - abs(r.value)) <= greatest(0.01, abs(r.value) * 0.0001::DOUBLE)), false)) AS matches
  FROM required r JOIN k USING (case_id) LEFT JOIN seen o ON o.case_key = k.case_key AND (r.year IS NULL OR o.year = r.year) GROUP BY ALL)"""


@query(
    "j7_case_coverage",
    f"""WITH {REQUIRED} SELECT case_id, count(*) AS required, count_if(matches > 0) AS matched, CASE WHEN count_if(matches > 0) = count(*) THEN 'ready_for_eval' WHEN count_if(matches = 0 AND ticker IS NOT NULL) > 0 THEN 'needs_company_ticker_review' ELSE 'needs_metric_normalization' END AS status,
      any_value(case_key) AS case_key, CAST(sum(matches) AS BIGINT) AS matches FROM m GROUP BY case_id""",
)
def _(spark, d):
    f, year, metric, ticker = fx.facts(spark, d), F.col("year"), F.col("metric"), F.col("ticker")
    kind = F.length("metric") % 3
    required = f.select(
        F.concat(F.lit("case_"), F.substring("ticker", 2, 20), F.lit("_"), "ticker").alias("case_id"), F.concat("metric", year.cast("string")).alias("fact_id"),
        F.when((metric == "cost_of_sales") & (year % 2 == 0), F.concat(F.lit("src/"), ticker)).alias("source_id"), F.when(F.ascii(F.right("ticker", F.lit(1))) % 2 == 0, ticker).alias("ticker"),
        F.when(metric != "net_income", metric).alias("metric"), F.replace("metric", F.lit("_"), F.lit(" ")).alias("metric_raw"), F.when(year % 5 > 0, year).alias("year"),
        F.when(year % 3 == 0, "Currency Millions").alias("unit"), F.when(year % 4 > 0, F.col("value") * F.when(kind == 0, 1.0).when(kind == 1, -1.00005).otherwise(1.02)).alias("value"),
    )
    key = F.when(F.substring("ticker", 2, 20).cast("int") % 3 == 0, ticker).otherwise(F.concat(F.lit("src/"), ticker))
    seen = f.select(key.alias("case_key"), F.concat("metric", F.lit("_reported")).alias("metric"), "year", F.when(year % 2 == 0, "currency_millions").otherwise("count").alias("unit"), "value")
    ids = required.select("case_id")
    keys = hygiene.case_keys(ids, required)
    matched = hygiene.fact_matches(required, keys, seen)
    total = matched.groupBy("case_id").agg(F.sum("matches").alias("matches"))
    return hygiene.case_status(ids, matched).join(keys, "case_id").join(total, "case_id")


CHECKED = f"""{OBSERVATIONS}, parts AS (
  SELECT * REPLACE (CASE WHEN raw_metric = 'cost_of_sales' AND year % 4 = 0 THEN 'Cost of revenue' WHEN raw_metric = 'cost_of_sales' AND year % 4 = 1 THEN 'cost revenue' WHEN raw_metric = 'G&A' THEN 'Marketing Generation_X' ELSE raw_metric END AS raw_metric,
    CASE WHEN quote = '' THEN '' WHEN year % 3 = 0 THEN 'Cost of Products sold' WHEN year % 3 = 1 THEN 'Total cost of products' ELSE quote END AS quote) FROM observations
), numbered AS (SELECT *, {metrics.SLUG_SQL.format('raw_metric')} AS m, row_number() OVER (PARTITION BY case_id ORDER BY raw_metric, year, ordinal, value) AS i FROM parts),
  reasons AS (SELECT *, {REASON_SQL} AS r FROM numbered WHERE i <= 20), checked AS (
    SELECT *, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY case_id, m, year, r ORDER BY i) > 1 THEN 'duplicate_observation_id' END) AS reason FROM reasons),
  {metrics.DICT_SQL}, named AS (SELECT c.*, CASE WHEN m IN ('', {quoted(metrics.BLOCKED)}) OR starts_with(m, '{metrics.BLOCKED[0]}') THEN NULL ELSE coalesce(d.canonical, {metrics.RULE_SQL}) END AS canonical FROM checked c LEFT JOIN dict d USING (m)),
  usable AS (SELECT *, reason IS NOT NULL AS recovered, CASE WHEN reason IS NULL THEN m ELSE canonical END AS shown FROM named
    WHERE reason IS NULL OR (reason = 'metric_artifact' AND canonical IS NOT NULL AND year BETWEEN 2000 AND 2030 AND isfinite(value) AND unit IN {text.UNITS} AND trim(quote) <> '')),
  decided AS (SELECT * EXCLUDE (canonical), CASE WHEN regexp_matches(canonical, '{hygiene.NAME}') AND NOT (canonical = 'cost_of_sales' AND NOT contains(lower(quote), 'total') AND (contains(lower(quote), 'cost of products') OR contains(lower(quote), 'cost of services')
    OR contains(replace(shown, '_', ' '), 'cost of product') OR contains(replace(shown, '_', ' '), 'cost of service'))) THEN canonical END AS metric FROM usable),
  placed AS (SELECT *, CASE WHEN metric IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY case_id, ticker, metric, year, round(value, 6) ORDER BY recovered, i) END AS place FROM decided)"""


@query("tx3_mapped_and_unmapped", f"WITH {CHECKED} SELECT case_id, i, raw_metric, metric, metric IS NOT NULL AS mapped, recovered FROM placed WHERE place = 1")
def _(spark, d):
    year, raw = F.col("year"), F.col("raw_metric")
    o = fx.observations(spark, d)
    cost = raw == "cost_of_sales"
    name = F.when(cost & (year % 4 == 0), "Cost of revenue").when(cost & (year % 4 == 1), "cost revenue").when(raw == "G&A", "Marketing Generation_X").otherwise(raw)
    quote = F.when(F.col("quote") == "", "").when(year % 3 == 0, "Cost of Products sold").when(year % 3 == 1, "Total cost of products").otherwise(F.col("quote"))
    checked = validate.first_reason(o.withColumn("raw_metric", name).withColumn("quote", quote))
    return hygiene.split_by_dictionary(checked).select("case_id", F.col("i").cast("long").alias("i"), "raw_metric", "metric", "mapped", "recovered")


PROBLEMS = [
    ("derived answer value", "year % 9 = 0 AND s % 2 = 0"), ("manual review", "value < 0 AND s % 3 = 0"), ("missing company/ticker", "company = '' OR ticker = ''"),
    ("quote flag false", "NOT coalesce(exact, false)"), ("quote not substring", "quote = '' OR NOT contains(evidence, quote)"),
]
GRAPH_FACTS = f"""{CASE_FACTS}, gf AS (
  SELECT f.* REPLACE (c.ticker AS ticker), c.s, c.company, c.evidence, f.quote <> '' AS exact FROM (SELECT * REPLACE (split_part(quote, ' ', 2) AS quote) FROM case_facts) f JOIN cases c USING (case_id)
), problems AS (SELECT case_id, fact_id, unnest({codes_sql(PROBLEMS)}) AS reason FROM gf), fine AS (SELECT * FROM gf WHERE case_id NOT IN (SELECT case_id FROM problems)), named AS (
  SELECT fact_id, unnest([{{'id': 'company::' || ticker, 'label': 'Company', 'name': company}}, {{'id': 'metric::' || metric, 'label': 'Metric', 'name': metric_raw}}, {{'id': 'year::' || year, 'label': 'Year', 'name': CAST(year AS VARCHAR)}},
    {{'id': 'obs::' || fact_id, 'label': 'Observation', 'name': quote}}], recursive := true) FROM fine), nodes AS (SELECT id, label, max({{'f': fact_id, 'n': name}}).n AS name FROM named GROUP BY id, label)"""


def graph_facts(spark, d):
    c = cases(spark, d)
    f = case_facts(spark, d).drop("ticker", "derived").join(c.select("case_id", "s", "company", "ticker"), "case_id")
    f = f.withColumn("quote", F.split_part("quote", F.lit(" "), F.lit(2)))
    return f.select("*", (F.col("quote") != "").alias("exact"), ((F.col("year") % 9 == 0) & (F.col("s") % 2 == 0)).alias("derived"), ((F.col("value") < 0) & (F.col("s") % 3 == 0)).alias("review")), c


@query("kg4_excluded_cases", f"WITH {GRAPH_FACTS} SELECT * FROM problems")
def _(spark, d):
    return hygiene.fact_problems(*graph_facts(spark, d))


@query(
    "kg4_clean_case_graph",
    f"""WITH {GRAPH_FACTS} SELECT 'node' AS kind, label AS type, id AS src, name AS dst FROM nodes UNION ALL
    SELECT DISTINCT 'edge', e.t, e.a, e.b FROM (SELECT unnest([{{'t': 'HAS_OBSERVATION', 'a': 'company::' || ticker, 'b': 'obs::' || fact_id}}, {{'t': 'OBSERVES_METRIC', 'a': 'obs::' || fact_id, 'b': 'metric::' || metric}},
      {{'t': 'OBSERVED_IN_YEAR', 'a': 'obs::' || fact_id, 'b': 'year::' || year}}]) AS e FROM fine)""",
)
def _(spark, d):
    facts, c = graph_facts(spark, d)
    nodes, edges = hygiene.case_graph(facts, hygiene.fact_problems(facts, c))
    n = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("type"), F.col("id").alias("src"), F.col("name").alias("dst"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), "type", "src", "dst"))


ENTRIES = f"""entries AS (SELECT CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN 'amount' WHEN 2 THEN '' ELSE {metrics.SLUG_SQL.format('p_name')} || '_' || (p_partkey % 11) END AS canonical_name,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS label, CASE WHEN p_partkey % 5 > 0 THEN p_brand || ' ' || p_size END AS definition, [p_brand || ' ' || (p_partkey % 13), upper(p_name)] AS aliases FROM part)"""


@query(
    "ag18_dictionary_report",
    f"""WITH {ENTRIES}, a AS (SELECT DISTINCT canonical_name, {metrics.SLUG_SQL.format('x')} AS item FROM (SELECT canonical_name, unnest([canonical_name, label] || aliases) AS x FROM entries))
    SELECT 'malformed_name' AS "check", canonical_name AS item, count(*) AS n FROM entries WHERE NOT regexp_matches(canonical_name, '{hygiene.NAME}') OR canonical_name IN ({quoted(hygiene.NO_NAMES)}) GROUP BY 2
    UNION ALL SELECT 'duplicate_name', canonical_name, count(*) FROM entries GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_label', label, count(*) FROM entries GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'missing_label_or_definition', canonical_name, count(*) FROM entries WHERE label = '' OR coalesce(definition, '') = '' GROUP BY 2
    UNION ALL SELECT 'alias_of_several', item, count(*) FROM a WHERE item <> '' GROUP BY 2 HAVING count(*) > 1""",
)
def _(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    canonical = F.when(k % 9 == 0, name).when(k % 9 == 1, "amount").when(k % 9 == 2, "").otherwise(F.concat(metrics.slug(name), F.lit("_"), (k % 11).cast("string")))
    entries = fx.read(spark, d, "part").select(
        canonical.alias("canonical_name"), F.when(k % 7 == 0, "").otherwise(F.col("p_type")).alias("label"), F.when(k % 5 > 0, F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"))).alias("definition"),
        F.array(F.concat("p_brand", F.lit(" "), (k % 13).cast("string")), F.upper(name)).alias("aliases"),
    )
    return hygiene.dictionary_report(entries)
