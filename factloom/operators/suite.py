"""The cross-company case suite: direct, margin and growth comparisons, some of each, chosen in hash order with capped degrees.

A company has a hash in each cell, and the rank of a pair is the sum of both, modulo 2**BITS. So the pairs of smallest
rank can be found by looking up, for each company, the neighbours of its complement, and no cell is paired as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .pairs import DIRECT, MARGINS, capped, stored, usable
from .slots import rounded

BITS = 56
# Pairs of each level, and most pairs of a company within a level.
TARGETS, CAP = {"L1_direct": 40, "L2_derived": 30, "L3_trend": 10}, 8


def cell_hash(*parts: Column) -> Column:
    """The first BITS bits of a SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long")


def low_pairs(values: DataFrame, below: int) -> DataFrame:
    """(cell, company_a, company_b, a, b, rank) of all pairs a < b within a cell whose rank is less than ``below``.

    values: (cell, ticker, h, v) with v whatever a company brings. Hashes are dealt to buckets of ``below``; the
    partners of a company are in three of them, so the join is by cell and bucket and makes about six times the pairs
    it keeps. Where ``below`` is the whole range it pairs everything.
    """
    whole, buckets = 1 << BITS, max(1, -(-(1 << BITS) // below))
    here, there = F.expr(f"h div {below}"), F.expr(f"(({whole} - h) % {whole}) div {below}")
    near = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (there + i) % buckets))
    a = values.select("cell", F.explode(near).alias("bucket"), F.col("ticker").alias("company_a"), F.col("h").alias("ha"), F.col("v").alias("a"))
    b = values.select("cell", here.alias("bucket"), F.col("ticker").alias("company_b"), F.col("h").alias("hb"), F.col("v").alias("b"))
    p = a.join(b, ["cell", "bucket"]).where("company_a < company_b").withColumn("rank", (F.col("ha") + F.col("hb")) % F.lit(whole))
    return p.where(F.col("rank") < below).select("cell", "company_a", "company_b", "a", "b", "rank")


def choose(values: DataFrame, keep, target: int, cap: int = CAP) -> DataFrame:
    """The first ``target`` pairs by rank that ``keep`` (pairs to pairs) leaves, none of a company beyond ``cap``.

    Pairs are made up to a rank that should give some ``4 * target * cap`` of them; twice as far if that isn't enough.
    """
    values = stored(values)
    n = values.groupBy("cell").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    below = int(min(1.0, 4 * target * cap / max(n, 1)) * (1 << BITS)) or 1
    while True:
        some = stored(keep(low_pairs(values, below)))
        chosen = capped(some, "rank", target, cap)
        if below >= 1 << BITS or chosen.count() >= target:
            return chosen
        below = min(below * 2, 1 << BITS)


def _case(level: str, kind: str, prefix: str, key: Column, slots: list[tuple[str, Column]], sources: Column, more: dict[str, Column]) -> list[Column]:
    made = F.array(*[F.struct(F.lit(n).alias("name"), rounded(v).alias("expected")) for n, v in slots])
    return [
        F.concat(F.lit(prefix), text.stable_hash(F.concat(key, "company_a", "company_b"))).alias("case_id"), F.lit(level).alias("level"), F.lit(kind).alias("formula_type"),
        "company_a", "company_b", made.alias("target_slots"), sources.alias("source_fact_numbers"), *[c.alias(k) for k, c in more.items()],
    ]


def _winner(a: Column, b: Column) -> Column:
    return F.when(a > b, F.col("company_a")).otherwise(F.col("company_b"))


def direct_choice(last: DataFrame, target: int, cap: int = CAP) -> DataFrame:
    """(metric, year, company_a, company_b, value_a, value_b, rank): the chosen pairs of one metric and year; equal values go."""
    v = usable(last).where(F.col("metric").isin(*DIRECT))
    v = v.select(F.struct("metric", "year").alias("cell"), "ticker", cell_hash(F.col("metric"), F.col("year").cast("string"), F.col("ticker")).alias("h"), F.col("value").alias("v"))
    p = choose(v, lambda p: p.where("a <> b"), target, cap)
    return p.select("cell.metric", "cell.year", "company_a", "company_b", F.col("a").alias("value_a"), F.col("b").alias("value_b"), "rank")


def direct_cases(last: DataFrame, target: int, cap: int = CAP) -> DataFrame:
    """One metric and year of two companies; last: (ticker, metric, year, value), the last value of each cell."""
    p = direct_choice(last, target, cap)
    a, b, m, y = F.col("value_a"), F.col("value_b"), F.col("metric"), F.col("year")
    slots = [("company_a_value", a), ("company_b_value", b), ("difference", F.abs(a - b))]
    return p.select(*_case("L1_direct", "cross_company_direct_metric", "r14_l1_", F.concat(m, y.cast("string")), slots, F.array(a, b), {"metric": m, "year": y, "start_year": F.lit(None).cast("int"), "winner": _winner(a, b)}))


def margin_cases(first: DataFrame, target: int, cap: int = CAP) -> DataFrame:
    """One margin and year of two companies, in percent of revenue; first: the first value of each cell."""
    u = usable(first)
    names = F.create_map(*[F.lit(x) for kv in MARGINS.items() for x in kv])
    rev = u.where("metric = 'total_revenue' and value <> 0").select("ticker", "year", F.col("value").alias("den"))
    r = u.where(F.col("metric").isin(*MARGINS)).join(rev, ["ticker", "year"]).withColumn("ratio", names[F.col("metric")])
    v = r.select(F.struct(F.col("ratio").alias("metric"), "year").alias("cell"), "ticker", cell_hash(F.col("ratio"), F.col("year").cast("string"), F.col("ticker")).alias("h"), F.struct(F.col("value").alias("num"), "den", (F.col("value") / F.col("den") * 100).alias("r")).alias("v"))
    p = choose(v, lambda p: p.where("a.r <> b.r"), target, cap)
    a, b, m, y = F.col("a.r"), F.col("b.r"), F.col("cell.metric"), F.col("cell.year")
    slots = [("company_a_ratio", a), ("company_b_ratio", b), ("difference", F.abs(a - b))]
    return p.select(*_case("L2_derived", "cross_company_margin", "r14_l2_", F.concat(m, y.cast("string")), slots, F.array("a.num", "a.den", "b.num", "b.den"), {"metric": m, "year": y, "start_year": F.lit(None).cast("int"), "winner": _winner(a, b)}))


def growth_cases(first: DataFrame, target: int, cap: int = CAP, metric: str = "total_revenue") -> DataFrame:
    """Growth of two companies between the first and last year that both have: a row for each company, with its values by year."""
    by_year = F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value"))))  # as many as there are years
    v = usable(first).where(F.col("metric") == metric).groupBy("ticker").agg(by_year.alias("v"))
    v = v.select(F.lit(metric).alias("cell"), "ticker", cell_hash(F.lit(metric), F.col("ticker")).alias("h"), "v")

    def keep(p: DataFrame) -> DataFrame:
        years = F.array_intersect(F.map_keys("a"), F.map_keys("b"))
        p = p.withColumn("y0", F.array_min(years)).withColumn("y1", F.array_max(years)).where("y0 < y1")
        at = lambda s, y: F.element_at(s, F.col(y)).alias(s + y)
        return p.select("company_a", "company_b", "rank", "y0", "y1", at("a", "y0"), at("a", "y1"), at("b", "y0"), at("b", "y1")).where("ay0 <> 0 and by0 <> 0")

    p = choose(v, keep, target, cap)
    grown = lambda s: (F.col(s + "y1") - F.col(s + "y0")) / F.abs(s + "y0") * 100
    a, b = grown("a"), grown("b")
    slots = [("company_a_growth", a), ("company_b_growth", b), ("difference", F.abs(a - b))]
    key = F.concat(F.col("y0").cast("string"), F.col("y1").cast("string"))
    return p.select(*_case("L3_trend", "cross_company_growth_trend", "r14_l3_", key, slots, F.array("ay0", "ay1", "by0", "by1"), {"metric": F.lit(f"{metric}_growth"), "year": F.col("y1"), "start_year": F.col("y0"), "winner": _winner(a, b)}))


def build(first: DataFrame, last: DataFrame, targets: dict[str, int] = TARGETS, cap: int = CAP) -> DataFrame:
    """All three levels: 40 direct, 30 margin and 10 growth comparisons, or what there is."""
    first, last = stored(first), stored(last)
    levels = direct_cases(last, targets["L1_direct"], cap), margin_cases(first, targets["L2_derived"], cap), growth_cases(first, targets["L3_trend"], cap)
    return levels[0].unionByName(levels[1]).unionByName(levels[2])
