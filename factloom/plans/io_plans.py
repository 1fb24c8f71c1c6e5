"""Queries for sources, sinks, extraction and the stream, over files written from the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract
from ..sources import fixtures as fx
from ..sources import io
from ..streaming import ingest
from .shapes import FACTS, TRACES
from .text_plans import evidence

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def folder(spark) -> str:
    """A new folder that driver and executors share: in the one the session names, else, in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/io-{uuid.uuid4().hex}"


@query("io1_lenient_jsonl", "SELECT count(*) FILTER (o_orderkey % 50 <> 0) AS read, count(*) FILTER (o_orderkey % 50 = 0) AS broken FROM orders")
def _(spark, d):
    path = folder(spark)
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    fx.read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.concat(line, F.lit(" {broken"))).otherwise(line).alias("value")).select(F.concat(F.when(F.col("value").endswith("broken"), "{").otherwise(""), "value").alias("value")).write.text(path)
    return io.line_report(io.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string"))


@query("io2_unified_cases", "SELECT 'c' || c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'x' || chr(10) || c_name END AS evidence, c_acctbal AS answer FROM customer")
def _(spark, d):
    path = folder(spark)
    c = fx.read(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.to_json(F.array(F.lit("x"), "c_name"))).alias("references"), F.col("c_acctbal").alias("expected_answer")
    )
    c.write.option("header", True).option("escape", '"').csv(path)
    r = spark.read.schema("_id string, references string, expected_answer double").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    u = io.unify_cases(r, {"case_id": ("case_id", "_id"), "evidence": ("text", "references"), "answer": ("answer", "expected_answer")})
    return u.withColumn("evidence", io.unwrap_references("evidence"))


@query("io3_flattened_questions", "SELECT l_orderkey AS uid, l_linenumber AS q, string_agg(l_orderkey || ' | ' || n || ' | ' || f, chr(10) ORDER BY n, f) OVER (PARTITION BY l_orderkey) AS lines FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_returnflag AS f FROM lineitem)")
def _(spark, d):
    path = folder(spark)
    row = F.struct(F.col("l_linenumber").alias("n"), F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("r"))
    docs = fx.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    docs.select("uid", F.col("t.r").alias("table"), F.transform("t.n", lambda n: F.struct(n.alias("q"))).alias("questions")).write.json(path)
    r = spark.read.schema("uid long, table array<array<string>>, questions array<struct<q:int>>").json(path)
    return r.select("uid", F.explode("questions.q").alias("q"), io.linearise("table").alias("lines"))


@query("io4_trace_scan", f"WITH {TRACES} SELECT method, dataset, count(*) AS n, 1 AS folders FROM traces GROUP BY ALL")
def _(spark, d):
    path = folder(spark)
    fx.traces(spark, d).write.partitionBy("dataset").json(path)
    r = io.read_traces(spark, path, "trace_id long, method string").withColumn("dataset", F.regexp_extract("path", "dataset=([^/]+)/", 1))
    return r.groupBy("method", "dataset").agg(F.count("*").alias("n"), F.countDistinct("dataset").cast("int").alias("folders"))


@query("io5_case_ids_in_texts", "SELECT 'case_' || (doc_id % 50) AS case_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def _(spark, d):
    t = fx.read(spark, d, "documents").select("source", F.concat("text", F.lit(" case_"), F.col("doc_id") % 50, F.lit(" end")).alias("text"))
    return io.case_ids(t, "case_[0-9]+").select("case_id", F.array_join("sources", ",").alias("sources"))


@query("io6_written_fields", "SELECT n_nationkey AS n_nationkey, n_name AS n_name, NULL::VARCHAR AS missing FROM nation")
def _(spark, d):
    path = folder(spark)
    io.write_fields(fx.read(spark, d, "nation"), path, ["n_nationkey", "n_name", "missing"], "csv")
    return spark.read.schema("n_nationkey int, n_name string, missing string").option("header", True).csv(path)


@query("io7_vector_index", "SELECT vec_id AS chunk_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def _(spark, d):
    path = folder(spark)
    io.save_index(fx.read(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), path, "given", 1200, 150)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return io.load_index(spark, path).select("chunk_id", F.size("embedding").cast("long").alias("width"), F.round(total, 6).alias("total"))


def report_text(spark, d):
    """(ticker, evidence): a header of years, then a line for each metric."""
    years = fx.facts(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_set("year"), False).alias("y"))
    return evidence(spark, d).join(years, "ticker").select("ticker", F.concat(F.lit("Years "), F.array_join("y", " "), F.lit("\n"), "evidence").alias("evidence"))


@query("tx1_text_facts", f"WITH {FACTS} SELECT ticker, metric AS label, year, CAST(CASE WHEN value < 0 THEN -floor(-value) ELSE floor(value) END AS DOUBLE) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric ORDER BY year DESC) <= 4")
def _(spark, d):
    return extract.extract(report_text(spark, d))


@query("tx2_fallback_facts", f"WITH {FACTS}, x AS (SELECT ticker, metric AS label, year, CAST(CASE WHEN value < 0 THEN -floor(-value) ELSE floor(value) END AS DOUBLE) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric ORDER BY year DESC) <= 4) SELECT * FROM x WHERE (label, year) NOT IN (SELECT metric, year FROM facts WHERE metric = 'net_income')")
def _(spark, d):
    return extract.fallback(extract.extract(report_text(spark, d)), fx.facts(spark, d).where("metric = 'net_income'"))


@query(
    "st1_incremental_ingest",
    f"WITH {TRACES}, t AS (SELECT 'gpt_' || level AS model, tokens, CASE level WHEN 0 THEN 0.6 WHEN 1 THEN 10.0 ELSE 0.0 END::DOUBLE AS price FROM traces WHERE tokens > 0), g AS (SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens * price / 1e6), 6) AS cost FROM t GROUP BY model) SELECT *, cost > 0.5 AS over_limit FROM g",
)
def _(spark, d):
    path = folder(spark)
    t = fx.traces(spark, d).select("trace_id", F.concat(F.lit("gpt_"), "level").alias("model"), "tokens", F.lit("2024-01-01 00:00:00").alias("ts"))
    t.write.json(f"{path}/logs")
    t.where("trace_id % 10 = 0").write.mode("append").json(f"{path}/logs")
    return ingest.run_once(spark, f"{path}/logs", f"{path}/state", f"{path}/totals", {"gpt_0": 0.6, "gpt_1": 10.0}, 0.5)
