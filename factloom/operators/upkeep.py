"""A fact graph kept in tables: batches that can be resumed and rolled back, nodes and edges merged once, censuses and integrity checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an observation in the store, which is partitioned by kg_batch; the log has the first three.
STORED = "obs_id string, case_id string, ticker string, metric string, year int, value double, unit string, quote string"
LOGGED = "obs_id string, case_id string, ticker string"
# What a metric's name looks like, and how placeholders begin.
GOOD_NAME, PLACEHOLDER = "^[a-z][a-z0-9_]{3,}$", "source_value"


# batches


class Store:
    """Observations below a shared folder, a partition for each batch, and a log of what each batch has written.

    A batch that is there is refused, unless it is resumed: then only what is missing is written, to the table and to
    the log. Rolling back a batch overwrites its partition, and no other, with nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, what: str, batch: str) -> str:
        if not re.fullmatch("[A-Za-z0-9_]+", batch):
            raise ValueError(f"{batch!r} is no name of a batch")
        return f"{self.path}/{what}/kg_batch={batch}"

    def _empty(self, what: str) -> None:
        """Make sure that a table's folder is there."""
        schema = STORED if what == "observations" else LOGGED
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{what}/kg_batch=__none__")

    def _read(self, what: str) -> DataFrame:
        self._empty(what)
        schema = STORED if what == "observations" else LOGGED
        return self.spark.read.schema(f"{schema}, kg_batch string").option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def observations(self) -> DataFrame:
        return self._read("observations")

    def log(self) -> DataFrame:
        return self._read("log")

    def written(self, batch: str) -> DataFrame:
        """(obs_id): what a batch has in the table, so that a run that broke off goes on behind it."""
        return self.observations().where(F.col("kg_batch") == batch).select("obs_id").distinct()

    def write(self, facts: DataFrame, batch: str, resume: bool = False) -> None:
        """Write facts (case_id, ticker, metric, year, value, unit, quote, place) as a batch; place numbers the facts of a case from 1."""
        there = self.written(batch)
        if not resume and there.limit(1).count():
            raise ValueError(f"batch {batch} is there already")
        rows = facts.withColumn("ticker", F.upper("ticker")).withColumn("obs_id", obs_id(F.lit(batch)))
        new = rows.dropDuplicates(["obs_id"]).join(there, "obs_id", "left_anti").select(*[c.split()[0] for c in STORED.split(", ")])
        new.write.mode("append").parquet(self._at("observations", batch))
        logged = self.log().where(F.col("kg_batch") == batch).select("obs_id").distinct()
        done = self.observations().where(F.col("kg_batch") == batch).select("obs_id", "case_id", "ticker")
        done.join(logged, "obs_id", "left_anti").write.mode("append").parquet(self._at("log", batch))

    def roll_back(self, batch: str) -> None:
        """Take out everything of one batch, the log first, so that what breaks off can be resumed."""
        for what, schema in (("log", LOGGED), ("observations", STORED)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._at(what, batch))

    def census(self) -> DataFrame:
        """(kg_batch, observations, logged, companies) of every batch that has rows."""
        o = self.observations().groupBy("kg_batch").agg(F.count("*").alias("observations"), F.countDistinct("ticker").alias("companies"))
        g = self.log().groupBy("kg_batch").agg(F.count("*").alias("logged"))
        return o.join(g, "kg_batch", "full").select("kg_batch", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("observations", "logged", "companies")])


def obs_id(batch: Column) -> Column:
    return F.concat_ws("__", batch, "case_id", "ticker", "metric", F.col("year").cast("string"), F.lpad(F.col("place").cast("string"), 2, "0"))


# merges


def graph_rows(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, on_create, on_set, at) and edges (src, type, dst) that facts (obs_id, ticker, company, metric, display, year, value, unit, at) ask for.

    Empty and null properties are left out of the maps; ``at`` tells which of two writes was earlier.
    """

    def props(**kv: Column) -> Column:
        m = F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
        return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))

    none = F.create_map().cast("map<string,string>")
    node = lambda label, key, create, put: F.struct(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), create.alias("on_create"), put.alias("on_set"))
    nodes = F.array(
        node("Company", "ticker", props(name=F.col("company")), none), node("Metric", "metric", props(display_name=F.col("display")), none), node("FiscalYear", "year", none, none),
        node("Observation", "obs_id", props(created_at=F.col("at")), props(value=F.col("value"), unit=F.col("unit"), ticker=F.col("ticker"))),
    )
    edge = lambda kind, dst: F.struct(F.col("obs_id").alias("src"), F.lit(kind).alias("type"), F.col(dst).cast("string").alias("dst"))
    edges = F.array(edge("MENTIONS_COMPANY", "ticker"), edge("OBSERVES_METRIC", "metric"), edge("OBSERVED_IN_YEAR", "year"))
    return facts.select("at", F.explode(nodes).alias("n")).select("n.*", "at"), facts.select(F.explode(edges).alias("e")).select("e.*")


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(label, id, on_create, on_set, created): properties on creation stay as first written, the others as last written.

    existing: (label, id, on_create, on_set). Rows of a key meet after a partial aggregation, so a year that every fact
    has is no hot group.
    """
    old = existing.select("label", "id", "on_create", "on_set", F.lit(None).cast(new.schema["at"].dataType).alias("at"), F.lit(0).alias("gen"))
    both = old.unionByName(new.select("label", "id", "on_create", "on_set", "at", F.lit(1).alias("gen")))
    at = F.struct("gen", "at")
    return both.groupBy("label", "id").agg(F.min_by("on_create", at).alias("on_create"), F.max_by("on_set", at).alias("on_set"), (F.min("gen") == 1).alias("created"))


def merge_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(src, type, dst, created): each edge once, however often it was there or is written."""
    both = existing.select("src", "type", "dst", F.lit(False).alias("new")).unionByName(new.select("src", "type", "dst", F.lit(True).alias("new")))
    return both.groupBy("src", "type", "dst").agg(F.bool_and("new").alias("created"))


def created_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, created, total) for each label and type of a merge's result."""
    count = lambda df, kind, name: df.groupBy(F.col(name).alias("name")).agg(F.count_if("created").alias("created"), F.count("*").alias("total")).select(F.lit(kind).alias("kind"), "name", "created", "total")
    return count(nodes, "node", "label").unionByName(count(edges, "edge", "type"))


# censuses and checks


def property_census(nodes: DataFrame, edges: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(kind, name, detail, n): what a graph holds, read off its rows.

    node: a label's nodes; edge: a type's edges; target: a type's edges by the label they lead to, null for none;
    key: a label's nodes with and without its key property (``keys``); property: a label's nodes that have a property.
    nodes: (label, id, properties map); edges: (src, type, dst). Labels and types are few; everything is counted by
    partial aggregation before it is dealt.
    """
    line = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name", "detail", "n")
    label = F.col("label").alias("name")
    no = F.lit(None).cast("string").alias("detail")
    by_label = nodes.groupBy(label, no).agg(F.count("*").alias("n"))
    by_type = edges.groupBy(F.col("type").alias("name"), no).agg(F.count("*").alias("n"))
    lead = edges.groupBy("type", "dst").agg(F.count("*").alias("n")).join(nodes.select(F.col("id").alias("dst"), "label").distinct(), "dst", "left")
    by_target = lead.groupBy(F.col("type").alias("name"), F.col("label").alias("detail")).agg(F.sum("n").alias("n"))
    key = F.try_element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), F.col("label"))
    has = F.when(F.try_element_at("properties", key).isNull(), "null").otherwise("set")
    by_key = nodes.where(key.isNotNull()).groupBy(label, has.alias("detail")).agg(F.count("*").alias("n"))
    filled = F.map_filter("properties", lambda _, v: v.isNotNull())
    by_property = nodes.select("label", F.explode(F.map_keys(filled)).alias("detail")).groupBy(label, "detail").agg(F.count("*").alias("n"))
    out = line("node", by_label)
    for kind, df in (("edge", by_type), ("target", by_target), ("key", by_key), ("property", by_property)):
        out = out.unionByName(line(kind, df))
    return out


def integrity(traces: DataFrame, cases: DataFrame, sources: DataFrame, metrics: DataFrame, methods: int, written: int) -> DataFrame:
    """(check, found, expected, ok): one row for each thing that must hold of an evaluated suite.

    traces: (case_id, method); cases: (case_id, company_a, company_b); sources: (case_id, ticker) of the observations a
    case was made from; metrics: (metric) of the observations in the graph, ``written`` of them expected.
    """
    zero = F.lit(0).cast("long")
    one = lambda name, df, found, expected: df.agg(found.alias("found")).select(F.lit(name).alias("check"), "found", expected.cast("long").alias("expected"))
    twice = traces.groupBy("case_id", "method").agg(F.count("*").alias("n"))
    wanted = cases.agg((F.count("*") * methods).alias("n")).first()["n"]  # one number
    sides = cases.select("case_id", F.explode(F.array("company_a", "company_b")).alias("ticker"))
    missing = sides.join(sources.select("case_id", "ticker").distinct(), ["case_id", "ticker"], "left_anti").select("case_id").distinct()
    placeholder = F.count_if(F.coalesce(F.col("metric").startswith(PLACEHOLDER), F.lit(False)))
    bad = F.count_if(~F.coalesce(F.col("metric").rlike(GOOD_NAME), F.lit(False)))
    rows = [
        one("duplicate_case_method", twice.where("n > 1"), F.count("*"), zero), one("trace_rows", traces, F.count("*"), F.lit(wanted)), one("cases_without_a_side", missing, F.count("*"), zero),
        one("observations", metrics, F.count("*"), F.lit(written)), one("placeholder_metrics", metrics, placeholder, zero), one("bad_metric_names", metrics, bad, zero),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("ok", F.col("found") == F.col("expected"))
