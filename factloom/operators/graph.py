"""Fact graphs as node and edge tables: upserts, batches, paths, reachability and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def to_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) and edges (src, dst, type) of facts; an observation is its cell."""
    o = F.concat_ws("/", "ticker", "metric", "year")
    node = lambda c, label: F.struct(c.cast("string").alias("id"), F.lit(label).alias("label"))
    nodes = facts.select(F.explode(F.array(node(F.col("ticker"), "Company"), node(F.col("metric"), "Metric"), node(F.col("year"), "FiscalYear"), node(o, "Observation"))).alias("n"))
    edge = lambda a, b, t: F.struct(a.cast("string").alias("src"), b.cast("string").alias("dst"), F.lit(t).alias("type"))
    edges = facts.select(
        F.explode(F.array(edge(F.col("ticker"), o, "HAS_OBSERVATION"), edge(o, F.col("metric"), "OBSERVES_METRIC"), edge(o, F.col("year"), "OBSERVED_IN_YEAR"))).alias("e")
    )
    return nodes.select("n.*").distinct(), edges.select("e.*").distinct()


def full_chains(edges: DataFrame) -> DataFrame:
    """(ticker, metric, year) that a path company - observation - metric, and year, connects."""
    has = edges.where("type = 'HAS_OBSERVATION'").select(F.col("src").alias("ticker"), F.col("dst").alias("o"))
    metric = edges.where("type = 'OBSERVES_METRIC'").select(F.col("src").alias("o"), F.col("dst").alias("metric"))
    year = edges.where("type = 'OBSERVED_IN_YEAR'").select(F.col("src").alias("o"), F.col("dst").cast("int").alias("year"))
    return has.join(metric, "o").join(year, "o").select("ticker", "metric", "year").distinct()


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str, keep_first: list[str], keep_last: list[str]) -> DataFrame:
    """One row per key: columns set on creation keep the first value ever, the others take the last one written."""
    old = existing.select(*key, *keep_first, *keep_last, F.lit(None).cast(new.schema[order].dataType).alias(order), F.lit(0).alias("gen"))
    both = old.unionByName(new.select(*key, *keep_first, *keep_last, order, F.lit(1).alias("gen")))
    at = F.struct("gen", order)
    return both.groupBy(*key).agg(
        *[F.min_by(c, at).alias(c) for c in keep_first], *[F.max_by(c, at).alias(c) for c in keep_last], F.min("gen").cast("boolean").alias("created")
    )


def patch(rows: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Patched rows are marked deprecated and their replacements added."""
    p = patches.select(*key, F.col("value").alias("new_value"))
    old = rows.join(p, key, "left").withColumn("status", F.when(F.col("new_value").isNotNull(), "deprecated").otherwise("active"))
    new = rows.join(p, key).withColumn("value", F.col("new_value")).withColumn("status", F.lit("replacement"))
    return old.drop("new_value").unionByName(new.drop("new_value"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    b, a = before.select(*key, F.col("value").alias("before")), after.select(*key, F.col("value").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return b.join(a, key, "full").withColumn("change", kind).where("change is not null")


def paths(edges: DataFrame, start: DataFrame, most: int = 4) -> DataFrame:
    """Paths of up to ``most`` edges from the start nodes, without a node twice: (node, path, relations)."""
    step = start.select(F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"))
    found = None
    for _ in range(most):
        step = step.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("type")).alias("relations")).distinct()
        found = step if found is None else found.unionByName(step)
    return found


def route(required: DataFrame, verified: DataFrame, anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """Retrieval mode of each case from its required triples (case_id, side, ticker, metric, year).

    A side is reachable if all its triples are verified and it has an anchor; then come anchors, then texts.
    """
    r = required.join(verified.withColumn("v", F.lit(True)), ["ticker", "metric", "year"], "left")
    r = r.join(anchors.select("ticker").distinct().withColumn("a", F.lit(True)), "ticker", "left").join(texts.select("ticker").distinct().withColumn("t", F.lit(True)), "ticker", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    side = r.groupBy("case_id", "side").agg(F.bool_and(yes("v")).alias("v"), F.bool_or(yes("a")).alias("a"), F.bool_or(yes("t")).alias("t"))
    c = side.groupBy("case_id").agg(
        F.bool_and(F.col("v") & F.col("a")).alias("reach"), F.bool_and("a").alias("anchored"), F.bool_and("t").alias("all_text"), F.bool_or("t").alias("any_text")
    )
    mode = (
        F.when(F.col("reach"), "structural_graph")
        .when(F.col("anchored") & F.col("all_text"), "graph_guided_chunk")
        .when(F.col("all_text"), "vector_topic_fallback")
        .when(F.col("any_text"), "text_only")
        .otherwise("no_go")
    )
    return c.select("case_id", mode.alias("mode"))


def fallback_lookup(cases: DataFrame, facts: DataFrame, most: int = 8) -> DataFrame:
    """Facts of each case's ticker and year: those of its own source if there are any, else all; at most ``most``.

    The most similar come first, by the cosine of the case's embedding and the fact's.
    """
    j = cases.withColumnRenamed("embedding", "question").join(facts, ["ticker", "year"])
    j = j.withColumn("similarity", text.cosine(F.col("question"), F.col("embedding"))).drop("question", "embedding")
    own = F.col("source") == F.col("case_source")
    by = Window.partitionBy("case_id")
    j = j.withColumn("own", own).withColumn("n_own", F.count_if("own").over(by)).where("own or n_own = 0")
    rank = F.row_number().over(by.orderBy(F.desc("similarity"), "metric", "source"))
    return j.withColumn("rank", rank).where(F.col("rank") <= most)
