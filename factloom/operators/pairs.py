"""Comparison pairs of companies, and their degree-capped selection."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import value_is_year

DIRECT = ("total_revenue", "gross_profit", "operating_income", "net_income", "operating_expense", "cost_of_sales", "income_tax_expense")
MARGINS = {"gross_profit": "gross_margin", "operating_income": "operating_margin", "net_income": "net_margin"}


def usable(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("ticker") != "") & (F.col("metric") != "") & ~value_is_year(F.col("value")))


def first_value(raw: DataFrame) -> DataFrame:
    """One value per cell: that of the smallest ordinal."""
    return raw.groupBy("ticker", "metric", "year").agg(F.min_by("value", "ordinal").alias("value"))


def last_value(raw: DataFrame) -> DataFrame:
    return raw.groupBy("ticker", "metric", "year").agg(F.max_by("value", "ordinal").alias("value"))


#: Companies of a cell that make one side of a block of pairs at most, and at least where there are more than few, and blocks that keep all cores at work.
BLOCK, SMALL, BLOCKS = 8000, 1000, 400


def in_blocks(values: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the pairs within the cells of values (ticker, *keys, ...), dealt to blocks, and the columns to join them by.

    The companies of a cell are dealt by hash to parts of about BLOCK of the largest cell, smaller ones only where there
    would be few blocks. A block (i, j) is the part i on the left and j, not below i, on the right: two parts meet once, and
    of a block with itself half the pairs count. A join key has about BLOCK rows a side, however large a cell is, and over
    both sides a row goes to one block more than there are parts. Neither side's blocks are put together into fewer tasks.
    """
    n, cells = values.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    enough = math.ceil(math.sqrt(2 * BLOCKS / max(1, cells)))
    parts = max(1, -(-n // BLOCK), min(-(-n // SMALL), enough))
    tasks = max(1, min(cells * parts * (parts + 1) // 2, 10 * BLOCKS))
    part, last = F.col("part"), F.lit(parts - 1).cast("long")
    v = values.withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(parts).cast("long")))
    by = [*keys, "i", "j"]
    left = v.withColumn("i", part).withColumn("j", F.explode(F.sequence(part, last)))
    right = v.withColumn("j", part).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), part)))
    return left.drop("part").repartition(tasks, *by), right.drop("part").repartition(tasks, *by), by


def _pairs(values: DataFrame, keys: list[str]) -> DataFrame:
    """Every two companies that agree in the keys, once, with their columns of values as ..._x and ..._y; no side comes first."""
    left, right, by = in_blocks(stored(values), keys)
    side = lambda df, s: df.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in values.columns if c not in keys])
    return side(left, "x").join(side(right, "y").hint("shuffle_hash"), by).where("i < j or ticker_x < ticker_y").drop("i", "j")


def in_order(x: Column, y: Column) -> Column:
    """Of a pair's x and y that of the company whose name comes first."""
    return F.when(F.col("ticker_x") < F.col("ticker_y"), x).otherwise(y)


def companies() -> list[Column]:
    x, y = F.col("ticker_x"), F.col("ticker_y")
    return [in_order(x, y).alias("company_a"), in_order(y, x).alias("company_b")]


def differences(values: DataFrame, rounded: Callable[[Column], Column]) -> DataFrame:
    """Pairs of a metric and year with unequal values, their difference rounded to four places, and the winner."""
    x, y = F.col("value_x"), F.col("value_y")
    p = _pairs(values.select("ticker", "metric", "year", "value"), ["metric", "year"]).where(x != y).withColumn("d", in_order(x - y, y - x))
    return p.select("metric", "year", *companies(), sure(F.col("d"), rounded(F.col("d"))).alias("difference"), F.when(x > y, F.col("ticker_x")).otherwise(F.col("ticker_y")).alias("winner"))


def sure(c: Column, exact: Column, n: int = 4) -> Column:
    """exact, which is c rounded to n places, by one multiplication wherever that can't differ: c is far from a tie for its size."""
    y = c * 10.0**n
    r = F.floor(y + 0.5)
    return F.when((F.abs(y) < 2.0**40) & (F.abs(y - r) < 0.499), r / 10.0**n).otherwise(exact)


def direct_pairs(cells: DataFrame) -> DataFrame:
    """L1: the same metric and year of two companies, with the winner; equal values go."""
    return differences(usable(cells).where(F.col("metric").isin(*DIRECT)), lambda d: F.round(d, 4))


def winner() -> Column:
    return F.when(F.col("value_a") > F.col("value_b"), F.col("company_a")).otherwise(F.col("company_b")).alias("winner")


def margins(cells: DataFrame) -> DataFrame:
    """(ticker, metric, year, value): profits in percent of revenue; years without revenue go."""
    names = F.create_map(*[F.lit(x) for kv in MARGINS.items() for x in kv])
    rev = cells.where("metric = 'total_revenue' and value <> 0").select("ticker", "year", F.col("value").alias("rev"))
    num = cells.where(F.col("metric").isin(*MARGINS)).join(rev, ["ticker", "year"])
    return num.select("ticker", names[F.col("metric")].alias("metric"), "year", (F.col("value") / F.col("rev") * 100).alias("value"))


def margin_pairs(cells: DataFrame) -> DataFrame:
    """L2: margins are compared and subtracted as they are, and only the difference is rounded."""
    return differences(margins(usable(cells)), places)


def places(c: Column, n: int = 4) -> Column:
    """c to n decimal places, half up, through a decimal: a tie is one however the double was come by."""
    return F.round(c.cast("decimal(38,9)"), n).cast("double")


def between(values: DataFrame, group: list[str]) -> DataFrame | None:
    """Every two companies of different groups, once, as _pairs has those of one; None where there is one group.

    The parts of all groups are numbered on, and a block is two parts of two groups. values are read more than once.
    """
    sizes = [tuple(r) for r in values.groupBy(*group).agg(F.count("*").alias("n")).orderBy(*group).collect()]  # a row a group
    if len(sizes) < 2:
        return None
    size = max(1, min(BLOCK, max(SMALL, -(-sum(r[-1] for r in sizes) // math.ceil(math.sqrt(2 * BLOCKS))))))
    of, parts = [], 0
    for *key, n in sizes:
        first, parts = parts, parts + -(-n // size)
        of.append((*key, first, parts - 1))
    of = values.sparkSession.createDataFrame(of, f"{', '.join(f'{g} {values.schema[g].dataType.simpleString()}' for g in group)}, _first long, _last long")
    v = values.join(F.broadcast(of), group).withColumn("part", F.col("_first") + F.pmod(F.xxhash64("ticker"), F.col("_last") - F.col("_first") + 1))
    tasks = min(parts * (parts - 1) // 2, 10 * BLOCKS)
    left = v.where(F.col("_last") < parts - 1).withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.col("_last") + 1, F.lit(parts - 1).cast("long"))))
    right = v.where("_first > 0").withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_first") - 1)))
    side = lambda df, s: df.repartition(tasks, "i", "j").select("i", "j", *[F.col(c).alias(f"{c}_{s}") for c in values.columns])
    return side(left, "x").join(side(right, "y").hint("shuffle_hash"), ["i", "j"]).drop("i", "j")


def growth_pairs(cells: DataFrame, metric: str = "total_revenue") -> DataFrame:
    """L3: growth between the first and last year that both companies have; equal growth counts for b.

    A company brings all its years in one row, so pairs are made once and never shuffled, and its growth from its first to
    its last year, which is worked out once: companies that begin and end in the same years need no more than that. Those
    that don't are paired by themselves, from the years that both have.
    """
    by_year = F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value"))))  # as many as there are years
    growth = lambda m, s, e: F.when(F.element_at(m, s) != 0, (F.element_at(m, e) - F.element_at(m, s)) / F.abs(F.element_at(m, s)) * 100)
    c = usable(cells).where(F.col("metric") == metric).groupBy("ticker").agg(by_year.alias("value"))
    c = c.withColumn("start_year", F.array_min(F.map_keys("value"))).withColumn("end_year", F.array_max(F.map_keys("value")))
    c = stored(c.withColumn("growth", growth(F.col("value"), F.col("start_year"), F.col("end_year"))).withColumn("rounded", places(F.col("growth"))))

    def rows(p: DataFrame) -> DataFrame:
        """p with growth_x, growth_y and both rounded."""
        x, y = F.col("growth_x"), F.col("growth_y")
        best = F.when(x > y, F.col("ticker_x")).when(y > x, F.col("ticker_y")).otherwise(companies()[1])
        return p.select(*companies(), "start_year", "end_year", in_order(F.col("rounded_x"), F.col("rounded_y")).alias("growth_a"), in_order(F.col("rounded_y"), F.col("rounded_x")).alias("growth_b"), best.alias("winner"))

    same = rows(_pairs(c.where("start_year < end_year and growth is not null").drop("value"), ["start_year", "end_year"]))
    p = between(c.select("ticker", "value", "start_year", "end_year"), ["start_year", "end_year"])
    if p is None:
        return same
    p = p.withColumn("years", F.array_intersect(F.map_keys("value_x"), F.map_keys("value_y")))
    p = p.withColumn("start_year", F.array_min("years")).withColumn("end_year", F.array_max("years")).where("start_year < end_year")
    p = p.select("*", *[growth(F.col(f"value_{s}"), F.col("start_year"), F.col("end_year")).alias(f"growth_{s}") for s in "xy"]).where("growth_x is not null and growth_y is not null")
    return same.unionByName(rows(p.select("*", *[places(F.col(f"growth_{s}")).alias(f"rounded_{s}") for s in "xy"])))


def year_over_year(cells: DataFrame) -> DataFrame:
    """Change in percent against the previous year there is; null for the first and after zero."""
    w = Window.partitionBy("ticker", "metric").orderBy("year")
    c = cells.withColumn("previous", F.lag("value").over(w)).withColumn("previous_year", F.lag("year").over(w))
    change = F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * 100
    return c.select("ticker", "metric", "year", "previous_year", F.round(change, 4).alias("change"))


def capped(pairs: DataFrame, rank: str, target: int, cap: int, first: int | None = None) -> DataFrame:
    """The first ``target`` pairs by rank that a greedy pass keeps if no company may be in more than ``cap`` of them.

    A pair's fate depends on smaller ranks only, so the smallest ``first`` pairs are decided by themselves, and more are
    taken only if these don't give ``target``. In each round a pair is kept if, for both companies, the pairs kept and
    the undecided ones up to it are within the cap; it goes if one company is full. Every round decides the smallest.
    """
    take = first or 4 * target * cap
    while True:
        rows = stored(pairs.orderBy(rank, "company_a", "company_b").limit(take))
        some = rows.select("company_a", "company_b", rank, F.lit(None).cast("boolean").alias("kept"))
        n = rows.count()
        while some.where("kept is null").limit(1).count():
            side = [F.struct(F.col(f"company_{s}").alias("c"), F.col(rank).alias("r"), "company_a", "company_b", "kept") for s in "ab"]
            ends = some.select(F.explode(F.array(*side)).alias("e")).select("e.*")
            w = Window.partitionBy("c").orderBy("r", "company_a", "company_b")
            kept = F.sum(F.when(F.col("kept"), 1).otherwise(0)).over(Window.partitionBy("c"))
            ahead = F.sum(F.when(F.col("kept").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            ends = ends.select("company_a", "company_b", F.col("r").alias(rank), "kept", (kept + ahead <= cap).alias("fits"), (kept >= cap).alias("full"))
            g = ends.groupBy("company_a", "company_b", rank).agg(F.first("kept").alias("was"), F.bool_and("fits").alias("fits"), F.bool_or("full").alias("full"))
            now = F.when(F.col("was").isNotNull(), F.col("was")).when(F.col("full"), False).when(F.col("fits"), True)
            some = stored(g.select("company_a", "company_b", rank, now.alias("kept")))
        chosen = some.where("kept").orderBy(rank, "company_a", "company_b").limit(target)
        if n < take or some.where("kept").count() >= target:
            return rows.join(F.broadcast(chosen.select("company_a", "company_b", rank)), ["company_a", "company_b", rank])  # target rows at most
        take *= 2


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one the session names; in tests, where none is named, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='factloom-')).rstrip('/')}/pairs-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path of a shared folder for what is read and written without Spark."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: texts are stored in a shared folder that is mounted as a file system")
    return uri


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: df is computed once and written to the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
