"""Queries for pairs, selections, joins and fact graphs, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, pairs, select, vectors
from ..sources import fixtures as fx
from .shapes import FACTS, TRACES
from .text_plans import CASES_SQL, QUALITY_SQL, cases, evidence, match_sql

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NOT_YEAR = "NOT (value = floor(value) AND value BETWEEN 2015 AND 2030)"
LAST = f"{FACTS}, last_cells AS (SELECT ticker, metric, year, max_by(value, ordinal) AS value FROM facts_raw GROUP BY ALL), first_cells AS (SELECT ticker, metric, year, min_by(value, ordinal) AS value FROM facts_raw GROUP BY ALL)"
DIRECT_SQL = f"SELECT a.metric, a.year, a.ticker AS company_a, b.ticker AS company_b, round(a.value - b.value, 4) AS difference, CASE WHEN a.value > b.value THEN a.ticker ELSE b.ticker END AS winner FROM {{0}} a JOIN {{0}} b USING (metric, year) WHERE a.ticker < b.ticker AND a.value <> b.value AND a.metric IN {pairs.DIRECT}"


@query("w4_first_and_last_values", f"WITH {LAST} SELECT ticker, metric, year, f.value AS first_value, l.value AS last_value FROM first_cells f JOIN last_cells l USING (ticker, metric, year)")
def _(spark, d):
    raw = fx.facts_raw(spark, d)
    return pairs.first_value(raw).withColumnRenamed("value", "first_value").join(pairs.last_value(raw).withColumnRenamed("value", "last_value"), ["ticker", "metric", "year"])


@query("j10_direct_pairs", f"WITH {LAST}, c AS (SELECT * FROM last_cells WHERE {NOT_YEAR}) {DIRECT_SQL.format('c')}")
def _(spark, d):
    return pairs.direct_pairs(pairs.last_value(fx.facts_raw(spark, d)))


MARGIN_SQL = f"m AS (SELECT n.ticker, CASE n.metric WHEN 'gross_profit' THEN 'gross_margin' WHEN 'operating_income' THEN 'operating_margin' ELSE 'net_margin' END AS metric, n.year, n.value / r.value * 100 AS value FROM facts n JOIN facts r USING (ticker, year) WHERE r.metric = 'total_revenue' AND r.value <> 0 AND n.metric IN ('gross_profit', 'operating_income', 'net_income'))"


@query("j11_margin_pairs", f"WITH {FACTS}, {MARGIN_SQL} SELECT a.metric, a.year, a.ticker AS company_a, b.ticker AS company_b, CAST(round(CAST(a.value - b.value AS DECIMAL(38,9)), 4) AS DOUBLE) AS difference, CASE WHEN a.value > b.value THEN a.ticker ELSE b.ticker END AS winner FROM m a JOIN m b USING (metric, year) WHERE a.ticker < b.ticker AND a.value <> b.value")
def _(spark, d):
    return pairs.margin_pairs(fx.facts(spark, d))


@query(
    "j12_growth_pairs",
    f"""WITH {FACTS}, r AS (SELECT ticker, year, value FROM facts WHERE metric = 'total_revenue' AND {NOT_YEAR}), p AS (SELECT a.ticker AS company_a, b.ticker AS company_b, year, a.value AS va, b.value AS vb FROM r a JOIN r b USING (year) WHERE a.ticker < b.ticker),
    g AS (SELECT company_a, company_b, min(year) AS start_year, max(year) AS end_year, min_by(va, year) AS sa, max_by(va, year) AS ea, min_by(vb, year) AS sb, max_by(vb, year) AS eb FROM p GROUP BY ALL HAVING min(year) < max(year)),
    h AS (SELECT *, (ea - sa) / abs(sa) * 100 AS ga, (eb - sb) / abs(sb) * 100 AS gb FROM g WHERE sa <> 0 AND sb <> 0)
    SELECT company_a, company_b, start_year, end_year, CAST(round(CAST(ga AS DECIMAL(38,9)), 4) AS DOUBLE) AS growth_a, CAST(round(CAST(gb AS DECIMAL(38,9)), 4) AS DOUBLE) AS growth_b, CASE WHEN ga > gb THEN company_a ELSE company_b END AS winner FROM h""",
)
def _(spark, d):
    return pairs.growth_pairs(fx.facts(spark, d))


@query(
    "w3_year_over_year",
    f"WITH {FACTS}, l AS (SELECT *, lag(value) OVER w AS p, lag(year) OVER w AS previous_year FROM facts WINDOW w AS (PARTITION BY ticker, metric ORDER BY year)) SELECT ticker, metric, year, previous_year, CASE WHEN p <> 0 THEN round((value - p) / abs(p) * 100, 4) END AS change FROM l",
)
def _(spark, d):
    return pairs.year_over_year(fx.facts(spark, d))


@query("w5_capped_pairs")
def _(spark, d):
    """The first 40 direct pairs in the hash order of the case suite, none of a company beyond 8; no cell is paired as a whole."""
    from ..operators import suite

    p = suite.direct_choice(pairs.last_value(fx.facts_raw(spark, d)), 40, 8)
    return p.select("metric", "year", "company_a", "company_b", F.round(F.col("value_a") - F.col("value_b"), 4).alias("difference"), pairs.winner(), "rank")


TOP_SQL = f"scored AS (SELECT case_id, ticker, slice, {QUALITY_SQL} AS quality FROM full_cases)"


def scored(spark, d):
    from ..functions import text

    q = text.quality(F.col("reasoning"), F.col("evidence_text"), F.col("question"), F.col("answer"))
    return cases(spark, d).select("case_id", "ticker", "slice", q.alias("quality"))





def _order():
    return [F.desc("quality"), "ticker", F.sha2(F.col("case_id").cast("string").cast("binary"), 256)]


def top_sql(k: int, n: int) -> str:
    return f"""WITH {CASES_SQL}, {TOP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quality DESC, ticker, sha256(CAST(case_id AS VARCHAR))) AS r FROM scored)
    SELECT case_id, ticker, quality, CAST(row_number() OVER (ORDER BY quality DESC, ticker, sha256(CAST(case_id AS VARCHAR))) AS INTEGER) AS number FROM r WHERE r <= {k} QUALIFY number <= {n}"""


@query("w1_top_cases", top_sql(1, 30))
def _(spark, d):
    return select.top_per_key(scored(spark, d), "ticker", _order(), 1, 30).select("case_id", "ticker", "quality", "number")


@query("w2_top_cases_three_per_company", top_sql(3, 50))
def _(spark, d):
    return select.top_per_key(scored(spark, d), "ticker", _order(), 3, 50).select("case_id", "ticker", "quality", "number")


@query(
    "w6_required_facts",
    f"""WITH {CASES_SQL}, j AS (SELECT case_id, f.metric, f.year, 2 * len(list_intersect(string_split(f.metric, '_'), string_split(regexp_replace(lower(q), '[^a-z]+', '_', 'g'), '_'))) + CASE WHEN contains(q, CAST(f.year AS VARCHAR)) THEN 1 ELSE 0 END AS score FROM cases JOIN facts f USING (ticker)),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, metric, year) AS rank, count(*) FILTER (score > 0) OVER (PARTITION BY case_id) AS hits FROM j)
    SELECT case_id, metric, year, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE (hits >= 2 AND score > 0 AND rank <= 8) OR (hits < 2 AND rank <= 4)""",
)
def _(spark, d):
    c = cases(spark, d).select("case_id", "ticker", "question")
    j = c.join(fx.facts(spark, d).select("ticker", "metric", "year"), "ticker")
    shared = F.size(F.array_intersect(F.split("metric", "_"), F.split(F.regexp_replace(F.lower("question"), "[^a-z]+", "_"), "_")))
    j = j.withColumn("score", 2 * shared + F.contains("question", F.col("year").cast("string")).cast("int"))
    by = Window.partitionBy("case_id")
    j = j.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "metric", "year"))).withColumn("hits", F.count_if(F.col("score") > 0).over(by))
    return j.where("(hits >= 2 and score > 0 and rank <= 8) or (hits < 2 and rank <= 4)").select("case_id", "metric", "year", "score", "rank")


@query(
    "w8_stratified_split",
    f"""WITH {CASES_SQL}, {TOP_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quality DESC, case_id) AS c FROM scored), p AS (SELECT *, row_number() OVER (PARTITION BY slice, c = 1 ORDER BY quality DESC, case_id) AS p FROM c),
    s AS (SELECT *, c = 1 AND ceil(p / 2.0) <= CASE WHEN p % 2 = 1 THEN 5 ELSE 8 END AS kept FROM p)
    SELECT case_id, ticker, slice, CASE WHEN NOT kept THEN 'rejected' WHEN p % 2 = 1 THEN 'dev' ELSE 'test' END AS split, CASE WHEN c > 1 THEN 'company_used' WHEN NOT kept THEN 'quota_full' END AS reason FROM s""",
)
def _(spark, d):
    s = select.stratified_split(scored(spark, d), "slice", "ticker", [F.desc("quality"), "case_id"], {"dev": 5, "test": 8})
    return s.select("case_id", "ticker", "slice", "split", "reason")


@query(
    "w9_failure_samples",
    f"""WITH {TRACES}, b AS (SELECT trace_id, CASE WHEN answer <> '' AND calculation <> '' THEN NULL WHEN level = 0 AND method = 'm4' THEN 'hybrid' WHEN level = 0 AND method = 'm3' THEN 'graph' WHEN level = 0 AND method = 'm2' THEN 'gold'
      WHEN level = 1 AND method IN ('m3', 'm4') THEN 'live' WHEN answer <> '' THEN 'no_calculation' END AS bucket FROM traces)
    SELECT trace_id, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY trace_id) AS INTEGER) AS place FROM b WHERE bucket IS NOT NULL QUALIFY place <= CASE bucket WHEN 'hybrid' THEN 3 WHEN 'no_calculation' THEN 1 ELSE 2 END""",
)
def _(spark, d):
    failed = (F.col("answer") == "") | (F.col("calculation") == "")
    of = lambda level, *methods: failed & (F.col("level") == level) & F.col("method").isin(*methods)
    buckets = [("hybrid", of(0, "m4"), 3), ("graph", of(0, "m3"), 2), ("gold", of(0, "m2"), 2), ("live", of(1, "m3", "m4"), 2), ("no_calculation", failed & (F.col("answer") != ""), 1)]
    return select.first_per_bucket(fx.traces(spark, d), buckets, "trace_id").select("trace_id", "bucket", "place")


@query(
    "w10_priority_ranking",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_totalprice DESC, o_orderdate, o_custkey, length(o_orderpriority), o_orderkey) AS INTEGER) AS rank, rank <= 12 AS wave_one FROM orders QUALIFY rank <= 100",
)
def _(spark, d):
    keys = ["o_orderpriority", "o_orderstatus", F.desc("o_totalprice"), "o_orderdate", "o_custkey", F.length("o_orderpriority"), "o_orderkey"]
    first = fx.read(spark, d, "orders").orderBy(*keys).limit(100)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("o_orderkey", "rank", (F.col("rank") <= 12).alias("wave_one"))


@query(
    "w11_stratified_sample",
    "SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1' || c_custkey), c_custkey) AS INTEGER) AS place FROM customer QUALIFY place <= CASE c_mktsegment WHEN 'BUILDING' THEN 26 WHEN 'MACHINERY' THEN 11 WHEN 'FURNITURE' THEN 13 ELSE 0 END",
)
def _(spark, d):
    c = fx.read(spark, d, "customer")
    return select.sample_per_stratum(c, "c_mktsegment", "c_custkey", "s1", {"BUILDING": 26, "MACHINERY": 11, "FURNITURE": 13}).select("c_custkey", "c_mktsegment", "place")


# joins


@query("j1_held_out_exclusion", "SELECT c_custkey FROM customer WHERE substr(sha256(CAST(c_custkey AS VARCHAR)), 57, 8) NOT IN (SELECT substr(sha256(CAST(o_custkey AS VARCHAR)), 57, 8) FROM orders WHERE o_orderkey % 3 = 0) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 50 = 0)")
def _(spark, d):
    tail = lambda c: F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 57, 8)
    used = fx.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(tail("o_custkey").alias("h"))
    nations = fx.read(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    c = fx.read(spark, d, "customer").withColumn("h", tail("c_custkey"))
    return c.join(used, "h", "left_anti").join(nations, "c_nationkey", "left_anti").select("c_custkey")


@query("j2_resume_work_list", f"WITH {TRACES}, done AS (SELECT DISTINCT case_id, method FROM traces WHERE answer <> '') SELECT c.case_id, m.method FROM (SELECT DISTINCT case_id FROM traces) c, (SELECT unnest(['m0', 'm1', 'm2', 'm3', 'm4']) AS method) m WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.case_id = c.case_id AND x.method = m.method)")
def _(spark, d):
    t = fx.traces(spark, d)
    todo = t.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(f"m{k}") for k in range(5)])).alias("method"))
    return todo.join(t.where("answer <> ''").select("case_id", "method"), ["case_id", "method"], "left_anti")


@query("j3_known_cases_and_missing", f"WITH {TRACES}, known AS (SELECT c_custkey AS case_id FROM customer WHERE c_custkey % 2 = 0) SELECT case_id, 'kept' AS status, count(*) AS n FROM traces WHERE case_id IN (SELECT case_id FROM known) AND method IN ('m0', 'm1') GROUP BY case_id UNION ALL SELECT case_id, 'missing', 0 FROM known WHERE case_id NOT IN (SELECT case_id FROM traces)")
def _(spark, d):
    t = fx.traces(spark, d)
    known = fx.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("case_id"))
    kept = t.where("method in ('m0', 'm1')").join(known, "case_id", "left_semi").groupBy("case_id").agg(F.lit("kept").alias("status"), F.count("*").alias("n"))
    return kept.unionByName(known.join(t, "case_id", "left_anti").select("case_id", F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n")))


EDGES = f"{FACTS}, obs AS (SELECT *, ticker || '/' || metric || '/' || year AS o FROM facts)"


@query("j4_full_chains", f"WITH {EDGES} SELECT ticker, metric, year FROM obs WHERE length(o) % 5 <> 0")
def _(spark, d):
    _, edges = graph.to_graph(fx.facts(spark, d))
    return graph.full_chains(edges.where("type <> 'OBSERVES_METRIC' or length(src) % 5 <> 0"))


@query(
    "j5_fact_lookup",
    f"""WITH {CASES_SQL}, k AS (SELECT case_id, ticker, [2015 + CAST(case_id % 7 AS INTEGER), 2016 + CAST(case_id % 7 AS INTEGER)] AS years, split_part(lower(q), ' ', 1) AS word FROM cases), j AS (SELECT case_id, metric, year, value, contains(metric, word) AS hit FROM k JOIN facts f USING (ticker) WHERE list_contains(years, f.year)),
    n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, count(*) FILTER (hit) OVER (PARTITION BY case_id) AS h FROM j) SELECT case_id, metric, year, value FROM n WHERE n <= 8 OR h < 1 OR hit""",
)
def _(spark, d):
    y = (F.col("case_id") % 7).cast("int")
    k = cases(spark, d).select("case_id", "ticker", F.array(2015 + y, 2016 + y).alias("years"), F.substring_index(F.lower("question"), " ", 1).alias("word"))
    j = k.join(fx.facts(spark, d), "ticker").where(F.array_contains("years", F.col("year"))).withColumn("hit", F.contains("metric", "word"))
    by = Window.partitionBy("case_id")
    j = j.withColumn("n", F.count("*").over(by)).withColumn("h", F.count_if("hit").over(by))
    return j.where("n <= 8 or h < 1 or hit").select("case_id", "metric", "year", "value")


TRIPLES_SQL = f"{EDGES}, reach AS (SELECT ticker, metric, year FROM obs WHERE length(o) % 5 <> 0), required AS (SELECT c_custkey AS case_id, unnest(['a', 'b']) AS side, 'S' || (c_custkey % 100 + unnest([1, 2])) AS ticker, unnest(['total_revenue', 'net_income']) AS metric, CAST(2015 + c_custkey % 7 AS INTEGER) AS year FROM customer)"


def triples(spark, d):
    c = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.lit(1).alias("k"), F.lit("total_revenue").alias("metric")), F.struct(F.lit("b").alias("side"), F.lit(2).alias("k"), F.lit("net_income").alias("metric")))).alias("x"))
    return c.select("case_id", "x.side", F.concat(F.lit("S"), F.col("case_id") % 100 + F.col("x.k")).alias("ticker"), "x.metric", (2015 + F.col("case_id") % 7).cast("int").alias("year"))


def reachable(spark, d):
    _, edges = graph.to_graph(fx.facts(spark, d))
    return graph.full_chains(edges.where("type <> 'OBSERVES_METRIC' or length(src) % 5 <> 0"))


COVER_SQL = f"{TRIPLES_SQL}, fl AS (SELECT r.*, EXISTS (SELECT 1 FROM facts f WHERE f.ticker = r.ticker) AS company, EXISTS (SELECT 1 FROM facts f WHERE f.ticker = r.ticker AND f.year = r.year AND contains(f.metric, split_part(r.metric, '_', 2))) AS metric_found, EXISTS (SELECT 1 FROM reach x WHERE x.ticker = r.ticker AND x.metric = r.metric AND x.year = r.year) AS chain FROM required r)"


@query("j6_fuzzy_coverage", f"WITH {COVER_SQL} SELECT case_id, side, ticker, company, metric_found, chain, CASE WHEN chain THEN 'full' WHEN company AND metric_found THEN 'partial' ELSE 'none' END AS coverage FROM fl")
def _(spark, d):
    f, yes = fx.facts(spark, d), F.lit(True)
    r = triples(spark, d).withColumn("word", F.get(F.split("metric", "_"), 1))
    r = r.join(f.select("ticker").distinct().withColumn("company", yes), "ticker", "left")
    found = r.join(f.select("ticker", "year", F.col("metric").alias("m")), ["ticker", "year"]).where(F.contains("m", F.col("word"))).select("case_id", "side").distinct().withColumn("metric_found", yes)
    r = r.join(found, ["case_id", "side"], "left").join(reachable(spark, d).withColumn("chain", yes), ["ticker", "metric", "year"], "left").fillna(False, ["company", "metric_found", "chain"])
    status = F.when(F.col("chain"), "full").when(F.col("company") & F.col("metric_found"), "partial").otherwise("none")
    return r.select("case_id", "side", "ticker", "company", "metric_found", "chain", status.alias("coverage"))


REQ_SQL = "req AS (SELECT ticker, metric, year, value * CASE CAST(substr(ticker, 2) AS INTEGER) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.00005 WHEN 2 THEN 1.02 ELSE 2.0 END::DOUBLE AS expected FROM facts)"


def required(spark, d):
    k = F.substring("ticker", 2, 20).cast("int") % 4
    factor = F.when(k == 0, 1.0).when(k == 1, 1.00005).when(k == 2, 1.02).otherwise(2.0)
    return fx.facts(spark, d).select("ticker", "metric", "year", (F.col("value") * factor).alias("expected"))


@query(
    "j7_tolerance_join",
    f"""WITH {FACTS}, {REQ_SQL}, m AS (SELECT r.ticker, r.metric, r.year, count(f.value) AS matches FROM req r LEFT JOIN facts f ON f.ticker = r.ticker AND f.year = r.year AND (contains(f.metric, r.metric) OR contains(r.metric, f.metric)) AND abs(f.value - r.expected) <= greatest(0.01, 1e-4 * abs(r.expected)) GROUP BY ALL)
    SELECT ticker, CAST(count(*) AS BIGINT) AS required, count_if(matches > 0) AS matched, CASE WHEN count_if(matches > 0) = count(*) THEN 'ready_for_eval' WHEN count_if(matches > 0) = 0 THEN 'value' ELSE 'partial' END AS status FROM m GROUP BY ticker""",
)
def _(spark, d):
    from ..operators import coverage

    m = coverage.tolerance_matches(required(spark, d), fx.facts(spark, d))
    n, hit = F.count("*"), F.count_if(F.col("matches") > 0)
    return m.groupBy("ticker").agg(n.alias("required"), hit.alias("matched"), F.when(hit == n, "ready_for_eval").when(hit == 0, "value").otherwise("partial").alias("status"))


@query(
    "j8_extraction_validation",
    f"""WITH {FACTS}, {REQ_SQL}, x AS (SELECT * FROM facts WHERE (year + length(metric)) % 3 <> 0) SELECT r.ticker, r.metric, r.year, CASE WHEN x.value IS NULL THEN 'extraction_failed' WHEN r.expected = 0 THEN 'no_contract_fact' WHEN abs(x.value - r.expected) <= CASE WHEN abs(r.expected) > 1 THEN 0.01 * abs(r.expected) ELSE 0.05 END THEN 'matched' ELSE 'mismatch' END AS status
    FROM req r LEFT JOIN x ON x.ticker = r.ticker AND x.metric = r.metric AND x.year = r.year""",
)
def _(spark, d):
    from ..operators import coverage

    x = fx.facts(spark, d).where((F.col("year") + F.length("metric")) % 3 != 0)
    return coverage.extraction_status(required(spark, d), x)


@query(
    "j9_required_fact_recall",
    f"""WITH {FACTS}, {REQ_SQL}, h AS (SELECT r.ticker, r.metric, r.year, coalesce(bool_or({match_sql('r.metric', 'f.metric')} AND abs(f.value - r.expected) <= greatest(0.01 * greatest(abs(f.value), abs(r.expected)), 0.01)), false) AS hit FROM req r LEFT JOIN facts f ON f.ticker = r.ticker AND f.year = r.year GROUP BY ALL) SELECT ticker, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS recall FROM h GROUP BY ticker""",
)
def _(spark, d):
    from ..operators import coverage

    return coverage.recall(required(spark, d), fx.facts(spark, d), ["ticker"])


COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


def hits_sql(k: int) -> str:
    return f"hits AS (SELECT q.vec_id AS query_id, q.label AS entity, c.vec_id AS chunk_id, c.label AS source, {COS} AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, c.vec_id) AS INTEGER) AS rank FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 20 = 0 QUALIFY rank <= {k})"


def hits(spark, d, k):
    e = fx.read(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("entity"), "embedding")
    return vectors.top_k(queries, e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source"), "embedding"), k)


@query("j13_top_k_retrieval", f"WITH {hits_sql(12)} SELECT query_id, rank, chunk_id, round(s, 6) AS score FROM hits")
def _(spark, d):
    return hits(spark, d, 12).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("w7_hit_ranks", f"WITH {hits_sql(6)} SELECT query_id, chunk_id, rank, rank = 1 AS best FROM hits")
def _(spark, d):
    return hits(spark, d, 6).select("query_id", "chunk_id", "rank", (F.col("rank") == 1).alias("best"))


@query(
    "j14_per_entity_retrieval",
    f"WITH {hits_sql(8)}, u AS (SELECT query_id // 40 AS case_id, query_id // 20 % 2 AS side, chunk_id, rank FROM hits) SELECT case_id, chunk_id, side, rank FROM u QUALIFY row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY side, rank) = 1",
)
def _(spark, d):
    h = hits(spark, d, 8).select(F.floor(F.col("query_id") / 40).alias("case_id"), F.floor(F.col("query_id") % 40 / 20).alias("side"), "chunk_id", "rank")
    first = F.row_number().over(Window.partitionBy("case_id", "chunk_id").orderBy("side", "rank"))
    return h.withColumn("_r", first).where("_r = 1").drop("_r")


@query(
    "j15_filtered_retrieval",
    f"""WITH {FACTS}, v AS (SELECT max(vec_id) + 1 AS n FROM embeddings), f AS (SELECT ticker, year, metric, ordinal AS source, embedding FROM facts_raw, v JOIN embeddings ON vec_id = (year * 7 + length(metric) * 13 + ascii(ordinal)) % n),
    k AS (SELECT c_custkey AS case_id, 'S' || (c_custkey % 100 + 1) AS ticker, CAST(2015 + c_custkey % 7 AS INTEGER) AS year, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS case_source, embedding AS question FROM customer, v JOIN embeddings ON vec_id = c_custkey % n),
    j AS (SELECT k.*, f.metric, f.source, list_cosine_similarity(CAST(question AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS s, f.source = k.case_source AS own FROM k JOIN f USING (ticker, year)), n AS (SELECT *, count(*) FILTER (own) OVER (PARTITION BY case_id) AS n_own FROM j)
    SELECT case_id, metric, source, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s DESC, metric, source) AS INTEGER) AS rank FROM n WHERE own OR n_own = 0 QUALIFY rank <= 8""",
)
def _(spark, d):
    e = fx.read(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.max("vec_id") + 1).first()[0] or 1
    k = F.col("c_custkey")
    c = fx.read(spark, d, "customer").select(k.alias("case_id"), F.concat(F.lit("S"), k % 100 + 1).alias("ticker"), (2015 + k % 7).cast("int").alias("year"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("X").alias("case_source"), (k % n).alias("vec_id"))
    of = (F.col("year") * 7 + F.length("metric") * 13 + F.ascii("ordinal")) % n
    f = fx.facts_raw(spark, d).select("ticker", "year", "metric", F.col("ordinal").alias("source"), of.alias("vec_id"))
    return graph.fallback_lookup(c.join(e, "vec_id").drop("vec_id"), f.join(e, "vec_id").drop("vec_id")).select("case_id", "metric", "source", "rank")


@query(
    "j16_guided_lookup",
    "WITH s AS (SELECT DISTINCT o_custkey AS case_id, o_orderkey % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM orders) SELECT case_id, count(*) AS sources, CAST(sum(length(left(text, 7000))) AS BIGINT) AS chars, substr(sha256(string_agg(left(text, 7000), chr(10) ORDER BY doc_id)), 1, 16) AS context FROM s JOIN documents USING (doc_id) GROUP BY case_id",
)
def _(spark, d):
    n = fx.read(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0] or 1
    s = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % n).alias("doc_id"))
    return select.contexts(s, fx.read(spark, d, "documents").select("doc_id", F.left("text", F.lit(7000)).alias("t")))


ROUTE_SQL = f"""{TRIPLES_SQL}, sides AS (SELECT case_id, side, bool_and(x.ticker IS NOT NULL) AS v, bool_or(a.ticker IS NOT NULL) AS a, bool_or(t.ticker IS NOT NULL) AS t FROM required r LEFT JOIN reach x ON x.ticker = r.ticker AND x.metric = r.metric AND x.year = r.year
    LEFT JOIN (SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 9 <> 0) a ON a.ticker = r.ticker LEFT JOIN (SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 5 <> 0) t ON t.ticker = r.ticker GROUP BY ALL),
  modes AS (SELECT case_id, CASE WHEN bool_and(v AND a) THEN 'structural_graph' WHEN bool_and(a) AND bool_and(t) THEN 'graph_guided_chunk' WHEN bool_and(t) THEN 'vector_topic_fallback' WHEN bool_or(t) THEN 'text_only' ELSE 'no_go' END AS mode FROM sides GROUP BY case_id)"""


def modes(spark, d):
    s = fx.read(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), "s_suppkey")
    return graph.route(triples(spark, d), reachable(spark, d), s.where("s_suppkey % 9 <> 0"), s.where("s_suppkey % 5 <> 0"))


@query("j17_mode_routing", f"WITH {ROUTE_SQL} SELECT * FROM modes")
def _(spark, d):
    return modes(spark, d)


@query("j18_routed_traces", f"WITH {ROUTE_SQL}, {TRACES} SELECT trace_id, t.case_id, method, mode FROM traces t LEFT JOIN modes m ON m.case_id = t.case_id")
def _(spark, d):
    return fx.traces(spark, d).join(modes(spark, d), "case_id", "left").select("trace_id", "case_id", "method", "mode")


@query(
    "j19_contract_precedence",
    "WITH u AS (SELECT o_orderkey % 500 AS case_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority, o_totalprice > 200000 AS has_slots FROM orders) SELECT case_id, o_orderkey, has_slots FROM u QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY has_slots DESC, priority, o_orderkey) = 1",
)
def _(spark, d):
    o = fx.read(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("case_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("priority"), (F.col("o_totalprice") > 200000).alias("has_slots"))
    return o.groupBy("case_id").agg(F.min_by(F.struct("o_orderkey", "has_slots"), F.struct(~F.col("has_slots"), "priority", "o_orderkey")).alias("x")).select("case_id", "x.o_orderkey", "x.has_slots")


@query(
    "j20_embedding_cache",
    "WITH c AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 2 = 0), n AS (SELECT sha256(text) AS k FROM documents UNION ALL SELECT sha256(text) FROM benchmark) SELECT k AS key, count(*) AS wanted, bool_or(k IN (SELECT k FROM c)) AS hit FROM n GROUP BY k",
)
def _(spark, d):
    key = F.sha2(F.col("text").cast("binary"), 256).alias("key")
    docs = fx.read(spark, d, "documents")
    wanted = docs.select(key).unionByName(fx.read(spark, d, "benchmark").select(key)).groupBy("key").agg(F.count("*").alias("wanted"))
    cache = docs.where("doc_id % 2 = 0").select(key).distinct().withColumn("hit", F.lit(True))
    return wanted.join(cache, "key", "left").fillna(False, ["hit"])


GEO = "geo AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'HAS' AS type FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'LIVES' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'ORDERED' FROM orders)"


@query(
    "j21_bounded_paths",
    f"""WITH {GEO}, one AS (SELECT dst AS node, [src, dst] AS path, [type] AS relations FROM geo WHERE src IN ('r0', 'r1')), two AS (SELECT g.dst AS node, list_append(path, g.dst) AS path, list_append(relations, g.type) AS relations FROM one JOIN geo g ON g.src = one.node), three AS (SELECT g.dst AS node, list_append(path, g.dst) AS path, list_append(relations, g.type) AS relations FROM two JOIN geo g ON g.src = two.node)
    SELECT node, array_to_string(path, '>') AS path, array_to_string(relations, '>') AS relations FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)""",
)
def _(spark, d):
    e = lambda t, a, b, k: t.select(F.concat(F.lit(a[0]), a[1:]).alias("src"), F.concat(F.lit(b[0]), b[1:]).alias("dst"), F.lit(k).alias("type"))
    nation = e(fx.read(spark, d, "nation"), "rn_regionkey", "nn_nationkey", "HAS")
    customer = e(fx.read(spark, d, "customer"), "nc_nationkey", "cc_custkey", "LIVES")
    orders = e(fx.read(spark, d, "orders"), "co_custkey", "oo_orderkey", "ORDERED")
    p = graph.paths(nation.unionByName(customer).unionByName(orders), spark.createDataFrame([("r0",), ("r1",)], "id string"))
    return p.select("node", F.array_join("path", ">").alias("path"), F.array_join("relations", ">").alias("relations"))


@query(
    "j22_run_comparison",
    f"WITH {TRACES} SELECT a.case_id, a.expected AS before, b.expected AS after, round(b.expected - a.expected, 4) AS delta FROM traces a LEFT JOIN traces b ON b.case_id = a.case_id AND b.method = 'm1' WHERE a.method = 'm0'",
)
def _(spark, d):
    t = fx.traces(spark, d)
    after = t.where("method = 'm1'").select("case_id", F.col("expected").alias("after"))
    return t.where("method = 'm0'").select("case_id", F.col("expected").alias("before")).join(after, "case_id", "left").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


# fact graphs


@query(
    "kg1_upsert",
    f"WITH {FACTS}, k AS (SELECT ticker || '/' || metric || '/' || year AS id, ordinal, value FROM facts_raw), w AS (SELECT id, min_by(ordinal, ordinal) FILTER (ordinal = 'A') AS of, min(ordinal) AS first_seen, max_by(value, ordinal) AS value, count_if(ordinal = 'A') = 0 AS created FROM k GROUP BY id) SELECT id, first_seen, value, created FROM w",
)
def _(spark, d):
    k = fx.facts_raw(spark, d).select(F.concat_ws("/", "ticker", "metric", "year").alias("id"), F.col("ordinal").alias("first_seen"), "value", "ordinal")
    return graph.upsert(k.where("ordinal = 'A'").drop("ordinal"), k.where("ordinal <> 'A'"), ["id"], "ordinal", ["first_seen"], ["value"])


@query("kg2_batch_rollback", f"WITH {FACTS}, b AS (SELECT ticker, metric, year, 'batch_' || ordinal AS kg_batch FROM facts_raw) SELECT kg_batch, count(*) AS rows, count(DISTINCT ticker) AS companies, kg_batch IN (SELECT 'batch_' || l_linestatus FROM lineitem) AS collides FROM b GROUP BY kg_batch")
def _(spark, d):
    b = fx.facts_raw(spark, d).withColumn("kg_batch", F.concat(F.lit("batch_"), "ordinal"))
    there = fx.read(spark, d, "lineitem").select(F.concat(F.lit("batch_"), "l_linestatus").alias("kg_batch")).distinct().withColumn("collides", F.lit(True))
    return b.groupBy("kg_batch").agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("companies")).join(there, "kg_batch", "left").fillna(False, ["collides"])


PATCH = f"{FACTS}, p AS (SELECT ticker, metric, year, value + 1 AS nv FROM facts WHERE year = 2017 AND metric = 'net_income')"


@query("kg3_patch_overlay", f"WITH {PATCH}, a AS (SELECT f.*, CASE WHEN nv IS NULL THEN 'active' ELSE 'deprecated' END AS status FROM facts f LEFT JOIN p USING (ticker, metric, year) UNION ALL BY NAME SELECT ticker, metric, year, nv AS value, 'replacement' AS status FROM p) SELECT ticker, metric, year, value, status FROM a")
def _(spark, d):
    f = fx.facts(spark, d)
    p = f.where("year = 2017 and metric = 'net_income'").withColumn("value", F.col("value") + 1)
    return graph.patch(f, p, ["ticker", "metric", "year"]).select("ticker", "metric", "year", "value", "status")


@query("kg3_snapshot_diff", f"WITH {FACTS} SELECT coalesce(b.ticker, a.ticker) AS ticker, coalesce(b.metric, a.metric) AS metric, coalesce(b.year, a.year) AS year, b.value AS before, a.value AS after, CASE WHEN b.value IS NULL THEN 'added' WHEN a.value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM facts WHERE year < 2019) b FULL JOIN (SELECT ticker, metric, year, CASE WHEN metric = 'net_income' THEN value + 1 ELSE value END AS value FROM facts WHERE year > 2015) a ON a.ticker = b.ticker AND a.metric = b.metric AND a.year = b.year WHERE a.value IS DISTINCT FROM b.value")
def _(spark, d):
    f = fx.facts(spark, d)
    after = f.where("year > 2015").withColumn("value", F.when(F.col("metric") == "net_income", F.col("value") + 1).otherwise(F.col("value")))
    return graph.snapshot_diff(f.where("year < 2019"), after, ["ticker", "metric", "year"])


@query(
    "kg4_nodes_and_edges",
    f"""WITH {EDGES}, bad AS (SELECT DISTINCT ticker FROM facts WHERE metric = 'net_income' AND value < 0 AND year = 2016), ok AS (SELECT * FROM obs WHERE ticker NOT IN (SELECT ticker FROM bad)),
    x AS (SELECT 'node' AS kind, 'Company' AS type, ticker AS src, '' AS dst FROM ok UNION SELECT 'node', 'Metric', metric, '' FROM ok UNION SELECT 'node', 'FiscalYear', CAST(year AS VARCHAR), '' FROM ok UNION SELECT 'node', 'Observation', o, '' FROM ok UNION SELECT 'edge', 'HAS_OBSERVATION', ticker, o FROM ok UNION SELECT 'edge', 'OBSERVES_METRIC', o, metric FROM ok UNION SELECT 'edge', 'OBSERVED_IN_YEAR', o, CAST(year AS VARCHAR) FROM ok) SELECT * FROM x""",
)
def _(spark, d):
    f = fx.facts(spark, d)
    bad = f.where("metric = 'net_income' and value < 0 and year = 2016").select("ticker").distinct()
    nodes, edges = graph.to_graph(f.join(bad, "ticker", "left_anti"))
    n = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("type"), F.col("id").alias("src"), F.lit("").alias("dst"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), "type", "src", "dst"))


@query("kg5_integrity", f"WITH {TRACES}, k AS (SELECT case_id, method, count(*) AS n FROM traces GROUP BY ALL) SELECT (SELECT count(*) FROM k WHERE n > 1) AS duplicate_keys, (SELECT count(*) FROM traces) AS rows, (SELECT count(*) FROM (SELECT case_id FROM k GROUP BY 1 HAVING count(*) <> 5)) AS incomplete_cases, (SELECT count(*) FROM traces WHERE answer = '') AS blank_answers")
def _(spark, d):
    t = fx.traces(spark, d)
    k = t.groupBy("case_id", "method").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "").alias("blank"))
    c = k.groupBy("case_id").agg(F.count_if(F.col("n") > 1).alias("dup"), F.sum("n").alias("n"), F.count("*").alias("m"), F.sum("blank").alias("blank"))
    return c.agg(F.sum("dup").alias("duplicate_keys"), F.sum("n").alias("rows"), F.count_if(F.col("m") != 5).alias("incomplete_cases"), F.sum("blank").alias("blank_answers"))


@query("so1_written_vs_reachable", f"WITH {EDGES} SELECT ticker, metric, year, CASE WHEN length(o) % 5 <> 0 THEN 'both' ELSE 'written_only' END AS status FROM obs")
def _(spark, d):
    written, reach = fx.facts(spark, d).select("ticker", "metric", "year"), reachable(spark, d)
    return written.intersect(reach).withColumn("status", F.lit("both")).unionByName(written.subtract(reach).withColumn("status", F.lit("written_only")))


@query("so2_orphan_vocabulary", f"WITH {FACTS} SELECT DISTINCT metric FROM facts EXCEPT SELECT DISTINCT metric FROM facts_raw")
def _(spark, d):
    return fx.facts(spark, d).select("metric").distinct().join(fx.facts_raw(spark, d), "metric", "left_anti")


@query("so3_union_of_case_sets", "SELECT 'L1' AS level, c_custkey AS case_id, c_mktsegment AS slice, NULL::BIGINT AS orders FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'L2', o_custkey, NULL, count(*) FROM orders GROUP BY o_custkey")
def _(spark, d):
    a = fx.read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.lit("L1").alias("level"), F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("slice"))
    b = fx.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("orders")).withColumn("level", F.lit("L2"))
    return a.unionByName(b, allowMissingColumns=True)


@query("so4_first_source_wins", "WITH u AS (SELECT 0 AS priority, c_custkey AS id, c_mktsegment AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1, s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 2, p_partkey, p_brand FROM part) SELECT id, origin, priority FROM u QUALIFY rank() OVER (PARTITION BY id ORDER BY priority) = 1")
def _(spark, d):
    c = fx.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("origin"))
    s = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"))
    p = fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("origin"))
    return select.first_source([c, s, p], "id")
