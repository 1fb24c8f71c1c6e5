"""Summaries over methods, judges, graphs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(c: str | Column) -> Column:
    """Average without nulls to four places, half up; 0 where there is none.

    Values count to six places. The sum and the quotient are exact, so that the order of the rows and the engine don't
    decide how a tie is rounded. For values that aren't negative.
    """
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("decimal(18,0)")
    top = F.sum(F.round(c.cast("double") * 1000000).cast("decimal(20,0)")) * 2 + n * 100
    low = n * 200
    return F.when(n > 0, ((top - top % low) / low).cast("double") / 10000).otherwise(F.lit(0.0))


def by_method(scored: DataFrame) -> DataFrame:
    return scored.groupBy("method").agg(F.count("*").alias("n"), mean("ac").alias("ac"), mean("nc").alias("nc"), mean("tokens").alias("tokens"))


def at_grains(scored: DataFrame, grains: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """The same measures at several grains; ``grain`` tells a total from a missing value."""
    g = scored.groupingSets([[F.col(c) for c in s] for s in grains], *[F.col(c) for c in columns])
    return g.agg(F.grouping_id().cast("long").alias("grain"), F.count("*").alias("n"), mean("ac").alias("ac"))


def cohen(labels: DataFrame) -> DataFrame:
    """Agreement and kappa of every pair of raters over (item, rater, code), on items all raters coded; null if chance alone agrees."""
    raters = labels.select("judge").distinct().count()
    full = complete(labels, raters)
    a = full.select("item", F.col("judge").alias("j1"), F.col("code").alias("c1"))
    p = a.join(full.select("item", F.col("judge").alias("j2"), F.col("code").alias("c2")), "item").where("j1 < j2")
    cells = p.groupBy("j1", "j2", "c1", "c2").agg(F.count("*").alias("n"))
    w = Window.partitionBy("j1", "j2")
    cells = cells.withColumn("all", F.sum("n").over(w))
    one = cells.groupBy("j1", "j2", F.col("c1").alias("code")).agg(F.sum("n").alias("n1"), F.max("all").alias("all"))
    two = cells.groupBy("j1", "j2", F.col("c2").alias("code")).agg(F.sum("n").alias("n2"))
    pe = one.join(two, ["j1", "j2", "code"]).groupBy("j1", "j2").agg(F.sum(F.col("n1") * F.col("n2") / (F.col("all") * F.col("all"))).alias("pe"))
    po = cells.groupBy("j1", "j2").agg((F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0)) / F.max("all")).alias("po"), F.max("all").alias("n"))
    k = F.when(F.abs(1 - F.col("pe")) >= 1e-12, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 4))
    return po.join(pe, ["j1", "j2"]).select("j1", "j2", "n", F.round("po", 4).alias("agreement"), k.alias("kappa"))


def complete(labels: DataFrame, raters: int) -> DataFrame:
    full = labels.where("code is not null").groupBy("item").agg(F.count("*").alias("_k")).where(F.col("_k") == raters).select("item")
    return labels.where("code is not null").join(full, "item")


def fleiss(labels: DataFrame) -> DataFrame:
    """One row: complete items, kappa and the share of items all raters agree on."""
    r = labels.select("judge").distinct().count()
    cells = complete(labels, r).groupBy("item", "code").agg(F.count("*").alias("n"))
    items = cells.groupBy("item").agg(((F.sum(F.col("n") * F.col("n")) - r) / (r * (r - 1))).alias("p"), (F.max("n") == r).alias("same"))
    shares = cells.groupBy("code").agg(F.sum("n").alias("n"))
    top = items.agg(F.avg("p").alias("po"), F.avg(F.col("same").cast("double")).alias("full"), F.count("*").alias("items"))
    pe = shares.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    k = F.when(F.abs(1 - F.col("pe")) >= 1e-12, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 4))
    return top.join(pe).select("items", k.alias("kappa"), F.round("full", 4).alias("full_agreement"))  # one row each


def ledger(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per round and in total; a trace counts in the first file that has it, rows without tokens not."""
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("file"))
    r = rows.withColumn("_r", first).where("_r = 1 and tokens > 0").join(F.broadcast(prices), "model", "left")  # a price for each model
    cost = (F.col("tokens") * F.col("per_million") / 1e6).alias("cost")
    r = r.select("round", "tokens", "model", cost)
    return r.rollup("round").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per label, and edges per type and label of their target."""
    n = nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).withColumn("target", F.lit(""))
    target = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"))
    e = edges.join(target, "dst").groupBy(F.col("type").alias("kind"), "target").agg(F.count("*").alias("n"))
    return n.unionByName(e)


def coverage_cells(facts: DataFrame, most: int) -> DataFrame:
    """The cells (metric, year) that most companies share, two at least, each row with the totals over all facts and cells."""
    cells = facts.groupBy("metric", "year").agg(F.countDistinct("ticker").alias("companies"), F.count("*").alias("observations"))
    total = facts.agg(F.countDistinct("ticker").alias("all_companies"), F.countDistinct("metric").alias("all_metrics"), F.count("*").alias("all_observations"))
    shared = cells.where("companies >= 2")
    total = total.crossJoin(F.broadcast(shared.agg(F.count("*").alias("comparable_cells"))))  # one row each
    return shared.orderBy(F.desc("companies"), F.desc("observations"), "metric", "year").limit(most).crossJoin(F.broadcast(total))


def pivot_means(df: DataFrame, row: str, column: str, names: tuple[str, ...], value: str) -> DataFrame:
    """Mean and number of ``value`` for each row under each of the names, and overall, in one pass; no mean where there is none."""
    out = []
    for n in names:
        v = F.when(F.col(column) == n, F.col(value))
        out += [F.when(F.count(v) > 0, mean(v)).alias(f"{n}_mean"), F.count(v).alias(f"{n}_n")]
    return df.groupBy(row).agg(*out, mean(value).alias("overall_mean"), F.count(value).alias("overall_n"))
