"""Queries for scalar functions, predicates and filters, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import score, validate
from ..sources import fixtures as fx
from .shapes import FACTS, OBSERVATIONS, TRACES

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NUM_SQL = r"'\(?\$?\s*-?\d[\d,]*(?:\.\d+)?\)?\s*%?'"
#: The number of the first match in {0}.
PARSE = (
    "(SELECT CASE WHEN t = '' THEN NULL WHEN t LIKE '(%' AND t LIKE '%)' THEN -abs(TRY_CAST(trim(regexp_replace(substr(t, 2, length(t) - 2), '[$,%]', '', 'g')) AS DOUBLE)) "
    "ELSE TRY_CAST(trim(regexp_replace(t, '[$,%]', '', 'g')) AS DOUBLE) END FROM (SELECT trim(regexp_extract({0}, " + NUM_SQL + ")) AS t))"
)
NUMBERS = (
    r"list_distinct_ordered(list_transform(flatten(list_transform(list_filter(regexp_extract_all({0}, '\d[\d,]*(?:\.\d+)?%?'), lambda t: NOT regexp_matches(t, '^20\d\d$')), "
    r"lambda t: CASE WHEN t LIKE '%\%' ESCAPE '\' THEN [TRY_CAST(regexp_replace(t, '[,%]', '', 'g') AS DOUBLE), TRY_CAST(regexp_replace(t, '[,%]', '', 'g') AS DOUBLE) / 100] "
    r"ELSE [TRY_CAST(regexp_replace(t, '[,%]', '', 'g') AS DOUBLE)] END)), lambda v: round(v, 8)))"
)


def ordered_distinct(expr: str) -> str:
    """DuckDB's list_distinct has no order; keep each value's first place."""
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {expr} AS l))"


NUMBERS_SQL = ordered_distinct(NUMBERS.removeprefix("list_distinct_ordered(").removesuffix(")"))


VALUE = "(CASE WHEN starts_with(trim(t), '(') AND ends_with(trim(t), ')') THEN -1 ELSE 1 END * TRY_CAST(replace(trim(t, '()%$ '), ',', '') AS DOUBLE))"
SIGNED_SQL = ordered_distinct(
    f"list_transform(list_filter(flatten(list_transform(regexp_extract_all({{0}}, {NUM_SQL}), lambda t: CASE WHEN ends_with(trim(t), '%') THEN [{VALUE}, {VALUE} / 100] ELSE [{VALUE}] END)), lambda v: v IS NOT NULL), lambda v: round(v, 8))"
)


def match_sql(a: str, b: str) -> str:
    bare = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
    x, y = (f"list_distinct(list_filter(string_split({bare(c)}, '_'), lambda w: length(w) >= 4))" for c in (a, b))
    return f"({bare(a)} <> '' AND {bare(b)} <> '' AND (contains({bare(a)}, {bare(b)}) OR contains({bare(b)}, {bare(a)}) OR (len({x}) > 0 AND len(list_intersect({x}, {y})) >= least(2, len({x})))))"


@query("sf1_metric_slug", f"WITH {OBSERVATIONS} SELECT DISTINCT raw_metric, {metrics.SLUG_SQL.format('raw_metric')} AS slug FROM observations")
def _(spark, d):
    return fx.observations(spark, d).select("raw_metric").distinct().withColumn("slug", metrics.slug(F.col("raw_metric")))


@query(
    "sf2_canonical_metric",
    f"WITH {OBSERVATIONS}, {metrics.DICT_SQL} SELECT o.raw_metric, "
    f"CASE WHEN m NOT IN ('', 'source_value', 'program_operand', 'operand', 'value', 'amount', 'number') AND NOT starts_with(m, 'source_value') THEN coalesce(d.canonical, {metrics.RULE_SQL}) END AS metric, count(*) AS n "
    f"FROM (SELECT raw_metric, {metrics.SLUG_SQL.format('raw_metric')} AS m FROM observations UNION ALL "
    f"SELECT p_type, {metrics.SLUG_SQL.format('p_type')} FROM part UNION ALL SELECT 'source_value revenue ' || p_type, {metrics.SLUG_SQL.format("'source_value revenue ' || p_type")} FROM part) o LEFT JOIN dict d USING (m) GROUP BY ALL",
)
def _(spark, d):
    kinds = fx.read(spark, d, "part").select(F.explode(F.array("p_type", F.concat(F.lit("source_value revenue "), "p_type"))).alias("raw_metric"))
    names = fx.observations(spark, d).select("raw_metric").unionByName(kinds)
    return metrics.canonical(names).groupBy("raw_metric", "metric").agg(F.count("*").alias("n"))


@query("sf3_parse_number", f"WITH {TRACES} SELECT trace_id, {PARSE.format('answer')} AS number FROM traces")
def _(spark, d):
    return fx.traces(spark, d).select("trace_id", text.parse_number(F.col("answer")).alias("number"))


@query(
    "sf4_scaled_number",
    f"""WITH {TRACES}, s AS (SELECT trace_id, answer || CASE trace_id % 4 WHEN 0 THEN ' million' WHEN 1 THEN ' Billion' WHEN 2 THEN ' percent' ELSE '' END AS a FROM traces),
    n AS (SELECT trace_id, a, {PARSE.format('a')} AS v FROM s)
    SELECT trace_id, v AS number, v * CASE WHEN contains(lower(a), 'billion') THEN 1e9 WHEN contains(lower(a), 'million') THEN 1e6 WHEN contains(lower(a), 'thousand') THEN 1e3 ELSE 1.0::DOUBLE END AS scaled,
      contains(a, '%') OR contains(lower(a), 'percent') AS is_percent, CASE WHEN contains(a, '%') OR contains(lower(a), 'percent') THEN v / 100 ELSE v END AS ratio FROM n""",
)
def _(spark, d):
    tail = F.element_at(F.array(F.lit(" million"), F.lit(" Billion"), F.lit(" percent"), F.lit("")), (F.col("trace_id") % 4 + 1).cast("int"))
    s = fx.traces(spark, d).withColumn("p", text.parse_scaled(F.concat("answer", tail)))
    return s.select("trace_id", F.col("p.value").alias("number"), "p.scaled", "p.is_percent", "p.ratio")


@query("sf5_numbers_in_text", f"WITH {TRACES} SELECT trace_id, {NUMBERS_SQL.format('answer')} AS numbers, {SIGNED_SQL.format('answer')} AS signed FROM traces")
def _(spark, d):
    return fx.traces(spark, d).select("trace_id", text.numbers_in(F.col("answer")).alias("numbers"), text.signed_numbers(F.col("answer")).alias("signed"))


YEARS_SQL = ordered_distinct(r"list_transform(regexp_extract_all({0}, '\b(19[89]\d|20[0-3]\d)\b', 1), lambda y: CAST(y AS INTEGER))")


@query("sf6_years_in_text", f"WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') || ' to ' || (year(o_orderdate) + o_orderkey % 3) AS t FROM orders) SELECT o_orderkey, {YEARS_SQL.format('t')} AS years FROM s")
def _(spark, d):
    t = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" to "), F.year("o_orderdate") + F.col("o_orderkey") % 3)
    return fx.read(spark, d, "orders").select("o_orderkey", text.years_in(t).alias("years"))


QUESTION_SQL = """CASE c_custkey % 6 WHEN 0 THEN 'Revenue growth (' || left(c_mktsegment, 4) || ')' WHEN 1 THEN 'What is the operating margin for ' || left(c_mktsegment, 3)
  WHEN 2 THEN left(c_mktsegment, 5) || ' FY2023 debt ratio' WHEN 3 THEN 'Effective tax rate, ' || left(c_mktsegment, 2) WHEN 4 THEN left(c_mktsegment, 3) || ' 2022 margin of 2021' ELSE 'operating income of the year' END"""


def questions(spark, d):
    seg = lambda n: F.left("c_mktsegment", F.lit(n))
    k = F.col("c_custkey") % 6
    q = (
        F.when(k == 0, F.concat(F.lit("Revenue growth ("), seg(4), F.lit(")")))
        .when(k == 1, F.concat(F.lit("What is the operating margin for "), seg(3)))
        .when(k == 2, F.concat(seg(5), F.lit(" FY2023 debt ratio")))
        .when(k == 3, F.concat(F.lit("Effective tax rate, "), seg(2)))
        .when(k == 4, F.concat(seg(3), F.lit(" 2022 margin of 2021")))
        .otherwise("operating income of the year")
    )
    return fx.read(spark, d, "customer").select("c_custkey", "c_mktsegment", q.alias("question"))


@query(
    "sf7_ticker_inference",
    rf"""WITH s AS (SELECT c_custkey, {QUESTION_SQL} AS q FROM customer) SELECT c_custkey, coalesce(nullif(regexp_extract(q, '\(([A-Z]{{1,5}})\)', 1), ''), nullif(regexp_extract(q, ',\s*([A-Z]{{1,5}})\.?\s*$', 1), ''),
      nullif(regexp_extract(q, '\bfor\s+([A-Z]{{1,5}})\b', 1), ''), nullif(regexp_extract(q, '\b([A-Z]{{1,5}})\s+FY\d{{2,4}}\b', 1), ''), nullif(regexp_extract(q, '\b([A-Z]{{1,5}})\s+\d{{4}}\b', 1), ''), 'C' || upper(substr(sha256(q), 1, 5))) AS ticker FROM s""",
)
def _(spark, d):
    return questions(spark, d).select("c_custkey", text.ticker_in(F.col("question")).alias("ticker"))


@query(
    "sf8_unit_inference",
    f"""WITH {FACTS}, m AS (SELECT DISTINCT metric FROM facts UNION ALL SELECT unnest(['net_margin', 'diluted_eps', 'basic_shares', 'tax_rate', 'income_per_share']))
    SELECT metric, t AS note, CASE WHEN contains(metric, 'per_share') OR metric LIKE '%\\_eps' ESCAPE '\\' THEN 'currency_per_share' WHEN contains(metric, 'margin') OR contains(metric, 'rate') OR contains(metric, 'percentage') THEN 'percentage'
      WHEN contains(metric, 'share') THEN 'count' WHEN contains(lower(t), 'in billions') THEN 'currency_billions' ELSE 'currency_millions' END AS unit FROM m, (SELECT unnest(['(In billions)', 'other']) AS t)""",
)
def _(spark, d):
    m = fx.facts(spark, d).select("metric").distinct().unionByName(spark.createDataFrame([(x,) for x in ("net_margin", "diluted_eps", "basic_shares", "tax_rate", "income_per_share")], "metric string"))
    m = m.withColumn("note", F.explode(F.array(F.lit("(In billions)"), F.lit("other"))))
    return m.withColumn("unit", text.unit_of(F.col("metric"), F.col("note")))


@query("sf9_formula_type", f"WITH s AS (SELECT c_custkey, lower({QUESTION_SQL}) AS q FROM customer), y AS (SELECT *, len({YEARS_SQL.format('q')}) AS n_years FROM s) SELECT c_custkey, {text.FORMULA_SQL} AS formula_type FROM y")
def _(spark, d):
    q = questions(spark, d).withColumn("q", F.lower("question"))
    return q.withColumn("n_years", F.size(text.years_in(F.col("q")))).select("c_custkey", F.expr(text.FORMULA_SQL).alias("formula_type"))


@query(
    "sf10_stable_ids",
    f"""WITH {FACTS}, i AS (SELECT 'b1__' || 'case_' || ordinal || '__' || ticker || '__' || metric || '__' || year || '__' || lpad(CAST(row_number() OVER (PARTITION BY ticker, metric ORDER BY year, ordinal) AS VARCHAR), 2, '0') AS obs_id FROM facts_raw)
    SELECT obs_id, substr(sha256(obs_id), 1, 16) AS hash, string_split(obs_id, '__')[-4] AS ticker, string_split(obs_id, '__')[-3] AS metric, TRY_CAST(string_split(obs_id, '__')[-2] AS INTEGER) AS year FROM i""",
)
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("ticker", "metric").orderBy("year", "ordinal"))
    ids = fx.facts_raw(spark, d).select(validate.obs_id("b1", F.concat(F.lit("case_"), "ordinal"), "ticker", "metric", "year", n).alias("obs_id"))
    return ids.select("obs_id", text.stable_hash(F.col("obs_id")).alias("hash"), *validate.parsed_id("obs_id"))


EVIDENCE_SQL = f"""{FACTS}, line AS (
  SELECT ticker, metric, metric || ' ' || string_agg(CASE WHEN value < 0 THEN '($' || CAST(floor(-value) AS BIGINT) || ')' ELSE '$' || CAST(floor(value) AS BIGINT) END, ' ' ORDER BY year DESC) AS line FROM facts GROUP BY ticker, metric
), evidence AS (SELECT ticker, string_agg(line, chr(10) ORDER BY metric) AS evidence FROM line GROUP BY ticker)"""


def evidence(spark, d):
    """(ticker, evidence): a line per metric, its values newest first."""
    money = F.when(F.col("value") < 0, F.concat(F.lit("($"), F.floor(-F.col("value")), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.floor("value")))
    f = fx.facts(spark, d).select("ticker", "metric", (-F.col("year")).alias("y"), money.alias("t"))
    line = f.groupBy("ticker", "metric").agg(F.array_sort(F.collect_list(F.struct("y", "t"))).alias("v"))
    line = line.select("ticker", "metric", F.concat("metric", F.lit(" "), F.array_join("v.t", " ")).alias("line"))
    return line.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list(F.struct("metric", "line")))["line"], "\n").alias("evidence"))


@query(
    "sf11_quote_verification",
    f"""WITH {EVIDENCE_SQL}, q AS (SELECT ticker, metric, year, metric || CASE WHEN year % 2 = 0 THEN ' $' ELSE '  ' END || CAST(floor(value) AS BIGINT) AS quote, CAST(floor(value) AS BIGINT) AS v FROM facts WHERE value >= 0)
    SELECT ticker, metric, year, contains(evidence, quote) AS exact, contains(regexp_replace(evidence, '[$\\s]', '', 'g'), regexp_replace(quote, '[$\\s]', '', 'g')) AS verified,
      list_filter(string_split(evidence, chr(10)), lambda l: contains(l, CAST(v AS VARCHAR)) AND contains(l, metric))[1] AS repaired FROM q JOIN evidence USING (ticker)""",
)
def _(spark, d):
    v = F.floor("value").cast("string")
    q = fx.facts(spark, d).where("value >= 0").select("ticker", "metric", "year", F.concat("metric", F.when(F.col("year") % 2 == 0, " $").otherwise("  "), v).alias("quote"), v.alias("v"))
    return validate.verify_quotes(q.join(evidence(spark, d), "ticker")).select("ticker", "metric", "year", "exact", "verified", "repaired")


@query(
    "sf12_closeness",
    f"""WITH {TRACES}, n AS (SELECT trace_id, expected AS e, {PARSE.format('answer')} AS a, contains(answer, '%') AS p FROM traces)
    SELECT trace_id, CASE WHEN p THEN abs(pe - pa) <= greatest(1e-9 * greatest(abs(pe), abs(pa)), 0.1) OR abs(pe / 100 - pa / 100) <= greatest(0.01 * greatest(abs(pe / 100), abs(pa / 100)), 0.0015)
      WHEN abs(e) < 100 AND abs(a) < 100 THEN abs(e - a) <= greatest(0.01 * greatest(abs(e), abs(a)), 0.01) ELSE abs(e - a) <= greatest(0.005 * greatest(abs(e), abs(a)), 0.01) END AS close
    FROM (SELECT *, CASE WHEN abs(e) > 1 THEN e ELSE e * 100 END AS pe, CASE WHEN abs(a) > 1 THEN a ELSE a * 100 END AS pa FROM n)""",
)
def _(spark, d):
    t = fx.traces(spark, d).withColumn("actual", text.parse_number(F.col("answer")))
    return t.select("trace_id", text.close_in_unit(F.col("expected"), F.col("actual"), F.contains("answer", F.lit("%"))).alias("close"))


@query(
    "sf13_metric_match",
    f"WITH {OBSERVATIONS}, m AS (SELECT metric AS name FROM facts UNION SELECT raw_metric FROM observations) SELECT a.name AS a, b.name AS b, {match_sql('a.name', 'b.name')} AS matches FROM m a JOIN m b ON a.name <> b.name",
)
def _(spark, d):
    m = fx.facts(spark, d).select(F.col("metric").alias("name")).union(fx.observations(spark, d).select("raw_metric")).distinct()
    pairs = m.select(F.col("name").alias("a")).join(m.select(F.col("name").alias("b")), F.col("a") != F.col("b"))  # a handful of names
    return pairs.withColumn("matches", text.metric_matches(F.col("a"), F.col("b")))


@query(
    "sf14_token_f1",
    """WITH x AS (SELECT doc_id, doc_id % 40 AS item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), y AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
    nx AS (SELECT doc_id, item_id, w, count(*) AS n FROM x GROUP BY ALL), ny AS (SELECT item_id, w, count(*) AS n FROM y GROUP BY ALL), c AS (SELECT doc_id, sum(least(nx.n, ny.n)) AS c FROM nx JOIN ny USING (item_id, w) GROUP BY doc_id),
    tx AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), ty AS (SELECT item_id, count(*) AS n FROM y GROUP BY item_id)
    SELECT d.doc_id, CAST(coalesce(round(2.0::DOUBLE * coalesce(c, 0) / nullif(coalesce(tx.n, 0) + coalesce(ty.n, 0), 0), 4), 0) AS DOUBLE) AS f1
    FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN tx ON tx.doc_id = d.doc_id LEFT JOIN ty ON ty.item_id = b.item_id""",
)
def _(spark, d):
    gold = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    return score.token_f1(fx.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("key"), "text"), gold, "doc_id", "key")


@query(
    "sf15_number_overlap",
    f"""WITH {TRACES}, s AS (SELECT case_id, any_value(expected) FILTER (trace_id % 5 = 0) AS e0, list(expected ORDER BY trace_id) AS gold, string_agg(answer, ' ; ' ORDER BY trace_id) AS t FROM traces GROUP BY case_id),
    n AS (SELECT case_id, gold, {SIGNED_SQL.format('t')} AS v FROM s)
    SELECT case_id, CAST(round(len(list_filter(gold, lambda g: len(list_filter(v, lambda x: abs(x - g) <= greatest(0.5, 0.02 * abs(g)))) > 0)) / len(gold), 4) AS DOUBLE) AS overlap FROM n""",
)
def _(spark, d):
    s = fx.traces(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("trace_id", "expected", "answer"))).alias("t"))
    return s.select("case_id", text.number_overlap(text.signed_numbers(F.array_join("t.answer", " ; ")), F.col("t.expected")).alias("overlap"))


QUALITY_SQL = rf"""round(CASE reasoning WHEN 'Calculation' THEN 3.0 WHEN 'Compositional' THEN 2.8 WHEN 'Subtraction' THEN 2.4 ELSE 1.0 END::DOUBLE
  + least(4.0::DOUBLE, len(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?')) / 8.0::DOUBLE) + least(3.0::DOUBLE, 0.8::DOUBLE * len({YEARS_SQL.format("(t || ' ' || q)")})) + least(2.0::DOUBLE, length(t) / 1200.0::DOUBLE)
  + CASE WHEN regexp_matches(lower(q || ' ' || a), '\b(margin|ratio|percent|percentage|growth|change|increase|decrease|divided|per share)\b') THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN {PARSE.format('a')} IS NOT NULL THEN 2.0 ELSE 0.0 END::DOUBLE, 4)"""
CASES_SQL = f"""{EVIDENCE_SQL}, cases AS (
  SELECT c_custkey AS case_id, 'S' || (c_custkey % 100 + 1) AS ticker, c_mktsegment AS slice, {QUESTION_SQL} AS q, CASE c_custkey % 3 WHEN 0 THEN 'Calculation' WHEN 1 THEN 'Compositional' ELSE 'Other' END AS reasoning,
    CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE '$' || CAST(floor(abs(c_acctbal)) AS BIGINT) END AS a FROM customer
), full_cases AS (SELECT c.*, coalesce(evidence, '') AS t FROM cases c LEFT JOIN evidence e USING (ticker))"""


def cases(spark, d):
    """(case_id, ticker, slice, question, reasoning, answer, evidence_text)."""
    q = questions(spark, d).join(fx.read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    k = F.col("c_custkey")
    q = q.select(
        k.alias("case_id"),
        F.concat(F.lit("S"), k % 100 + 1).alias("ticker"),
        F.col("c_mktsegment").alias("slice"),
        "question",
        F.when(k % 3 == 0, "Calculation").when(k % 3 == 1, "Compositional").otherwise("Other").alias("reasoning"),
        F.when(k % 4 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.floor(F.abs("c_acctbal")))).alias("answer"),
    )
    return q.join(evidence(spark, d), "ticker", "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumnRenamed("evidence", "evidence_text")


@query("sf16_quality_score", f"WITH {CASES_SQL} SELECT case_id, {QUALITY_SQL} AS quality FROM full_cases")
def _(spark, d):
    return cases(spark, d).select("case_id", text.quality(F.col("reasoning"), F.col("evidence_text"), F.col("question"), F.col("answer")).alias("quality"))


@query(
    "sf17_verdict_json",
    r"""WITH s AS (SELECT doc_id, 'So: ' || CASE doc_id % 5 WHEN 0 THEN '{"verdict": "correct", "score": 1.0} ok' WHEN 1 THEN '{"verdict": "partial", "score": 0.5}' WHEN 2 THEN '{"verdict": "incorrect", "score": 0.0}.' WHEN 3 THEN '{"verdict": "maybe", "score": 0.5}' ELSE 'none {' END AS t FROM documents),
    j AS (SELECT doc_id, regexp_extract(t, '(?s)\{.*\}') AS j FROM s), p AS (SELECT doc_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.verdict') END AS v, CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.score') AS DOUBLE) END AS s FROM j)
    SELECT doc_id, CASE WHEN v IN ('correct', 'partial', 'incorrect') AND s IN (0, 0.5, 1) THEN v ELSE 'parse_fail' END AS verdict, CASE WHEN v IN ('correct', 'partial', 'incorrect') AND s IN (0, 0.5, 1) THEN s END AS score FROM p""",
)
def _(spark, d):
    texts = ['{"verdict": "correct", "score": 1.0} ok', '{"verdict": "partial", "score": 0.5}', '{"verdict": "incorrect", "score": 0.0}.', '{"verdict": "maybe", "score": 0.5}', "none {"]
    t = F.concat(F.lit("So: "), F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 5 + 1).cast("int")))
    return fx.read(spark, d, "documents").select("doc_id", text.verdict_of(t).alias("p")).select("doc_id", "p.verdict", "p.score")


@query(
    "sf18_fact_table_text",
    f"WITH {FACTS} SELECT ticker, string_agg(metric || ' | ' || year || ' | ' || CAST(floor(value) AS BIGINT), chr(10) ORDER BY metric, year) AS context FROM facts GROUP BY ticker",
)
def _(spark, d):
    return validate.fact_context(fx.facts(spark, d))


BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


@query(
    "sf19_chunks",
    f"""WITH n AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1200 THEN 1 ELSE CAST(ceil((length(t) - 1200) / 1050.0) AS INTEGER) + 1 END)) AS i FROM n),
    x AS (SELECT doc_id, i, length(t) AS n, {strip_sql('substr(t, i * 1050 + 1, 1200)')} AS x FROM c)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 1050 AS INTEGER) AS char_start, CAST(least(n, i * 1050 + 1200) AS INTEGER) AS char_end, substr(sha256(doc_id || ':' || i || ':' || x), 1, 20) AS chunk_id, CAST(length(x) AS INTEGER) AS n FROM x WHERE x <> ''""",
)
def _(spark, d):
    c = fx.read(spark, d, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    c = c.select("doc_id", F.col("c.i").alias("chunk_index"), F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"), F.col("c.chunk").alias("chunk"))
    id_ = F.substring(F.sha2(F.concat_ws(":", "doc_id", "chunk_index", "chunk").cast("binary"), 256), 1, 20)
    return c.select("doc_id", "chunk_index", "char_start", "char_end", id_.alias("chunk_id"), F.length("chunk").alias("n"))


@query(
    "sf20_cosine",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _(spark, d):
    e = fx.read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(text.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    "sf21_program_operands",
    r"""WITH p AS (SELECT o_orderkey, 'subtract(' || o_totalprice || ', const_100), divide(#0, const_m1), add(#0, const_1.5)' AS t FROM orders)
    SELECT o_orderkey, list_transform(regexp_extract_all(t, 'const_m?\d+(?:\.\d+)?|-?\d+(?:\.\d+)?'), lambda x: TRY_CAST(regexp_replace(regexp_replace(x, 'const_', ''), '^m', '-') AS DOUBLE)) AS operands FROM (SELECT o_orderkey, replace(t, '#0', 'x') AS t FROM p)""",
)
def _(spark, d):
    p = F.concat(F.lit("subtract("), F.format_string("%s", F.col("o_totalprice").cast("string")), F.lit(", const_100), divide(x, const_m1), add(x, const_1.5)"))
    return fx.read(spark, d, "orders").select("o_orderkey", text.operands(p).alias("operands"))


# filters and predicates


@query(
    "fp1_eligibility_funnel",
    f"""WITH {CASES_SQL}, f AS (SELECT length(t) >= 200 AS a, len(regexp_extract_all(t, '\\d[\\d,]*(?:\\.\\d+)?')) > 2 AS b, {PARSE.format('a')} IS NOT NULL AS c, reasoning <> 'Other' AS e FROM full_cases)
    SELECT count(*) AS read, count_if(a) AS long_text, count_if(a AND b) AS with_numbers, count_if(a AND b AND c) AS numeric_answer, count_if(a AND b AND c AND e) AS reasoning FROM f""",
)
def _(spark, d):
    c = cases(spark, d)
    stages = [
        ("long_text", F.length("evidence_text") >= 200),
        ("with_numbers", F.regexp_count("evidence_text", F.lit(text.PLAIN_NUMBER)) > 2),
        ("numeric_answer", text.parse_number(F.col("answer")).isNotNull()),
        ("reasoning", F.col("reasoning") != "Other"),
    ]
    return validate.funnel(c, stages)


@query("fp2_normalised_labels", "SELECT c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Goods' WHEN 'MACHINERY' THEN 'Goods' WHEN 'FURNITURE' THEN 'Goods' WHEN 'BUILDING' THEN 'Sites' ELSE 'Other' END AS category, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, d):
    c = validate.relabel(fx.read(spark, d, "customer"), "c_mktsegment", {"AUTOMOBILE": "Goods", "MACHINERY": "Goods", "FURNITURE": "Goods", "BUILDING": "Sites"}, "Other", "category")
    return c.groupBy("c_mktsegment", "category").agg(F.count("*").alias("n"))


@query(
    "fp3_valid_tickers",
    "WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'FY' WHEN 2 THEN 'TOOLONG' ELSE ' xyz ' END AS raw FROM supplier), n AS (SELECT s_suppkey, replace(upper(trim(raw)), '.', '') AS t FROM t) SELECT s_suppkey, t AS ticker FROM n WHERE regexp_full_match(t, '[A-Z]{1,5}') AND t NOT IN ('FY', 'US')",
)
def _(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("a.b", "FY", "TOOLONG", " xyz "))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return fx.read(spark, d, "supplier").select("s_suppkey", text.valid_ticker(raw, ("FY", "US")).alias("ticker")).where("ticker is not null")


REASON_SQL = f"""CASE WHEN {' OR '.join(f"contains(m, '{a}')" for a in text.ARTIFACTS)} THEN 'metric_artifact' WHEN length(m) < 4 THEN 'metric_too_short' WHEN year IS NULL OR year < 2000 OR year > 2030 THEN 'year_out_of_range'
  WHEN value IS NULL OR isnan(value) OR value IN ('inf'::DOUBLE, '-inf'::DOUBLE) THEN 'invalid_value' WHEN unit NOT IN {text.UNITS} THEN 'invalid_unit' WHEN quote = '' THEN 'empty_evidence_quote' END"""
VALID_SQL = f"""{OBSERVATIONS}, numbered AS (SELECT *, {metrics.SLUG_SQL.format('raw_metric')} AS m, row_number() OVER (PARTITION BY case_id ORDER BY raw_metric, year, ordinal, value) AS i FROM observations),
  reasons AS (SELECT *, {REASON_SQL} AS r FROM numbered WHERE i <= 20), checked AS (
    SELECT *, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY case_id, m, year, r ORDER BY i) > 1 THEN 'duplicate_observation_id' END) AS reason FROM reasons)"""


@query("fp4_observation_validation", f"WITH {VALID_SQL} SELECT case_id, m AS metric, year, ordinal, reason FROM checked")
def _(spark, d):
    return validate.first_reason(fx.observations(spark, d)).select("case_id", F.col("slug").alias("metric"), "year", "ordinal", "reason")


@query("fp5_value_is_year", f"WITH {OBSERVATIONS} SELECT value = floor(value) AND value BETWEEN 2015 AND 2030 AS is_year, count(*) AS n FROM observations GROUP BY 1")
def _(spark, d):
    return fx.observations(spark, d).groupBy(text.value_is_year(F.col("value")).alias("is_year")).agg(F.count("*").alias("n"))


@query("fp6_junk_metrics", f"""WITH n AS (SELECT p_type, CASE p_partkey % 3 WHEN 0 THEN 'the_' WHEN 1 THEN 'at_the_' ELSE '' END || {metrics.SLUG_SQL.format('p_type')} AS m FROM part) SELECT m AS metric, regexp_matches(m, '{text.JUNK}') AS junk, count(*) AS n FROM n GROUP BY ALL""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    m = F.concat(F.when(k == 0, "the_").when(k == 1, "at_the_").otherwise(""), metrics.slug(F.col("p_type")))
    return fx.read(spark, d, "part").groupBy(m.alias("metric")).agg(F.count("*").alias("n")).withColumn("junk", F.col("metric").rlike(text.JUNK))


@query(
    "fp7_issue_flags",
    f"""WITH {OBSERVATIONS}, i AS (SELECT case_id, raw_metric, year, ordinal, list_filter([CASE WHEN year IS NULL OR year < 2000 THEN 'year' END, CASE WHEN coalesce(unit, '') = '' THEN 'unit' END, CASE WHEN trim(coalesce(quote, '')) = '' THEN 'quote' END, CASE WHEN value = floor(value) AND value BETWEEN 2015 AND 2030 THEN 'value_is_year' END], lambda x: x IS NOT NULL) AS issues FROM observations)
    SELECT * FROM i WHERE len(issues) > 0""",
)
def _(spark, d):
    none = lambda c: text.strip(F.coalesce(c, F.lit(""))) == ""
    rules = {"year": F.col("year").isNull() | (F.col("year") < 2000), "unit": none("unit"), "quote": none("quote"), "value_is_year": text.value_is_year(F.col("value"))}
    return validate.issues(fx.observations(spark, d), rules).select("case_id", "raw_metric", "year", "ordinal", "issues")


@query(
    "fp8_repair_gate",
    f"""WITH {EVIDENCE_SQL}, o AS (SELECT ticker, metric, ordinal, CASE WHEN s % 11 = 0 THEN '' ELSE 'currency_millions' END AS unit, CASE WHEN s % 13 = 0 THEN 1999 ELSE year END AS year, value FROM (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS s FROM facts_raw)),
    g AS (SELECT o.*, list_filter(string_split(evidence, chr(10)), lambda l: contains(l, metric))[1] AS q FROM o JOIN evidence USING (ticker))
    SELECT ticker, metric, year, ordinal, CASE WHEN unit = '' THEN 'currency_millions' ELSE unit END AS unit, CASE WHEN year = 2021 THEN 'current' WHEN year >= 2015 THEN 'prior' ELSE 'unknown' END AS period_role,
      CASE WHEN q IS NULL THEN 'no_exact_quote' WHEN year < 2000 THEN 'bad_year' WHEN value = 0 THEN 'zero_value' END AS reject_reason FROM g""",
)
def _(spark, d):
    o = fx.facts_raw(spark, d).withColumn("s", F.substring("ticker", 2, 20).cast("int"))
    o = o.withColumn("unit", F.when(F.col("s") % 11 == 0, "").otherwise("currency_millions")).withColumn("year", F.when(F.col("s") % 13 == 0, 1999).otherwise(F.col("year")))
    return validate.repair(o, evidence(spark, d), latest=2021).select("ticker", "metric", "year", "ordinal", "unit", "period_role", "reject_reason")


@query(
    "fp9_leakage_guard",
    f"WITH {TRACES} SELECT case_id, bool_or(contains(answer, CAST(CAST(floor(expected) AS BIGINT) AS VARCHAR))) AS leaks FROM traces GROUP BY case_id",
)
def _(spark, d):
    t = fx.traces(spark, d)
    return t.groupBy("case_id").agg(F.bool_or(F.contains("answer", F.floor("expected").cast("string"))).alias("leaks"))


PROMPT_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Q' || chr(10) || 'TEXT_CONTEXT:' || chr(10) || 'x' WHEN 1 THEN 'GRAPH_FACTS_TABLE' || chr(10) || 'y' WHEN 2 THEN 'see TEXT_CONTEXT here' ELSE 'GOLD_CONTEXT: ' || chr(10) || 'TEXT_CONTEXT' END"


@query(
    "fp10_context_isolation",
    f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'vector' ELSE 'graph' END AS method, {PROMPT_SQL} AS t FROM documents),
    m AS (SELECT doc_id, method, regexp_matches(t, '(?m)^TEXT_CONTEXT:?\\s*$') AS has_text, regexp_matches(t, '(?m)^GRAPH_FACTS_TABLE:?\\s*$') AS has_graph, regexp_matches(t, '(?m)^GOLD_CONTEXT:?\\s*$') AS has_gold FROM p)
    SELECT * FROM m WHERE has_gold OR (method = 'vector' AND has_graph) OR (method = 'graph' AND has_text)""",
)
def _(spark, d):
    k = F.col("doc_id") % 4
    prompt = F.when(k == 0, "Q\nTEXT_CONTEXT:\nx").when(k == 1, "GRAPH_FACTS_TABLE\ny").when(k == 2, "see TEXT_CONTEXT here").otherwise("GOLD_CONTEXT: \nTEXT_CONTEXT")
    p = fx.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "vector").otherwise("graph").alias("method"), prompt.alias("prompt"))
    return validate.isolation_violations(p)


@query(
    "fp11_arm_classification",
    f"""WITH {TRACES} SELECT method, CASE method WHEN 'm0' THEN 'real_retrieval' WHEN 'm1' THEN 'real_retrieval' WHEN 'm2' THEN 'per_case_text' WHEN 'm3' THEN 'gold_context' ELSE 'unknown' END AS arm, count(*) AS n, count(*) FILTER (method = 'm4') AS unknown FROM traces GROUP BY ALL""",
)
def _(spark, d):
    rules = spark.createDataFrame([("m0", "real_retrieval"), ("m1", "real_retrieval"), ("m2", "per_case_text"), ("m3", "gold_context")], "method string, arm string")
    t = fx.traces(spark, d).join(F.broadcast(rules), "method", "left").withColumn("arm", F.coalesce("arm", F.lit("unknown")))  # a rule for each method
    return t.groupBy("method", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("arm") == "unknown").alias("unknown"))
