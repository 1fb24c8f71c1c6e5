"""Scoring of free-text answers against numeric target slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Marks of a calculation.
CALCULATION = r"/|%|=|ratio|rate|margin|growth|change|formula|program"


def tolerance(expected: Column, wide: Column) -> Column:
    return F.when(wide, F.greatest(F.lit(0.5), 0.02 * F.abs(expected))).otherwise(F.greatest(F.lit(0.1), 0.005 * F.abs(expected)))


def in_unit(value: Column, expected: Column) -> Column:
    """A value that is a hundredfold or a hundredth of the expected one, brought to its unit."""
    r = F.try_divide(value, expected)
    return F.when(r.between(80, 120), value / 100).when(r.between(0.008, 0.012), value * 100).otherwise(value)


def closeness(actual: Column, expected: Column) -> Column:
    """1 less the relative error, within 0 and 1; 0 where there is no number."""
    gap = F.abs(actual - expected) / F.greatest(F.abs(expected), F.lit(1.0))
    return F.round(F.coalesce(1 - F.least(gap, F.lit(1.0)), F.lit(0.0)), 4)


def slots(traces: DataFrame, normalise: bool = False) -> DataFrame:
    """traces with ``best``: the number of the answer that is nearest to the expected one, the first of equals."""
    numbers = text.numbers_in(F.col("answer"))
    t = traces.withColumn("numbers", numbers)
    if normalise:
        t = t.withColumn("numbers", F.transform("numbers", lambda v: in_unit(v, F.col("expected"))))
    gap = F.transform("numbers", lambda v, i: F.struct(F.abs(v - F.col("expected")).alias("gap"), i.alias("i"), v.alias("v")))
    return t.withColumn("best", F.array_min(gap)["v"])


def score(traces: DataFrame, normalise: bool = False) -> DataFrame:
    """AC (all right), closeness, and the reason of a failure."""
    t = slots(traces, normalise)
    hit = F.coalesce(F.abs(F.col("best") - F.col("expected")) <= tolerance(F.col("expected"), F.col("level") == 0), F.lit(False))
    form = (F.col("answer") != "") & (F.col("calculation") != "")
    calc = F.lower("calculation").rlike(CALCULATION)
    t = t.select("*", hit.alias("numeric_ok"), form.alias("format_ok"), calc.alias("calculation_ok"), closeness(F.col("best"), F.col("expected")).alias("nc"))
    right = F.col("numeric_ok") & F.col("format_ok") & F.col("calculation_ok")
    reason = F.when(right, "none").when(~F.col("format_ok"), "answer_format_error").when(~F.col("numeric_ok"), "formula_target_mismatch").otherwise("scoring_uncertain")
    return t.select("*", right.cast("int").alias("ac"), reason.alias("failure_reason"))


def variants(scored: DataFrame) -> DataFrame:
    """Each trace under several readings: as scored, with 2 % tolerance, with partial credit, and without suspects."""
    two = F.coalesce(F.abs(F.col("best") - F.col("expected")) <= F.greatest(F.lit(0.5), 0.02 * F.abs("expected")), F.lit(False)) & F.col("format_ok")
    kinds = F.array(
        F.struct(F.lit("base").alias("variant"), F.col("ac").cast("double").alias("score")),
        F.struct(F.lit("tolerance_2pct").alias("variant"), two.cast("double").alias("score")),
        F.struct(F.lit("partial").alias("variant"), F.when(F.col("ac") == 1, 1.0).when(F.col("nc") >= 0.9, 0.5).otherwise(0.0).alias("score")),
        F.struct(F.lit("no_suspects").alias("variant"), F.when(F.col("case_id") % 7 != 0, F.col("ac").cast("double")).alias("score")),
    )
    return scored.select("trace_id", "method", F.explode(kinds).alias("k")).select("trace_id", "method", "k.variant", "k.score")


def targets_of(answer: Column, sources: Column) -> Column:
    """Numbers of the expected answer that are no source value, near-duplicates left out in order."""
    fresh = F.filter(text.numbers_in(answer), lambda v: ~F.exists(sources, lambda s: F.abs(s - v) <= 0.01 * F.greatest(F.abs(s), F.lit(1.0))))
    start = F.array().cast("array<double>")
    return F.aggregate(fresh, start, lambda acc, v: F.when(F.exists(acc, lambda x: F.abs(x - v) <= 0.001 * F.greatest(F.abs(v), F.lit(1.0))), acc).otherwise(F.concat(acc, F.array(v))))


def token_f1(texts: DataFrame, gold: DataFrame, row: str, key: str) -> DataFrame:
    """(row, f1): token F1 of each of texts (row, key, text) against gold's text of the same key, whole texts, to four places.

    Tokens are runs of a-z and 0-9 in lower case, counted with repeats: per text before they meet those of gold, so that
    no two texts are compared token by token. Two texts without tokens have 0.
    """

    def tokens(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))

    t, g = tokens(texts).select(row, key, "w"), tokens(gold).select(key, "w")
    total = t.select(row, key, F.size("w").alias("n")).join(g.select(key, F.size("w").alias("m")), key)
    have = t.select(row, key, F.explode("w").alias("w")).groupBy(row, key, "w").agg(F.count("*").alias("x"))
    want = g.select(key, F.explode("w").alias("w")).groupBy(key, "w").agg(F.count("*").alias("y"))
    common = have.join(want, [key, "w"]).groupBy(row).agg(F.sum(F.least("x", "y")).alias("c"))
    f1 = F.round(F.try_divide(2.0 * F.coalesce("c", F.lit(0)), F.col("n") + F.col("m")), 4)
    return total.join(common, row, "left").select(row, F.coalesce(f1, F.lit(0.0)).alias("f1"))


def context_checks(context: Column, numbers: Column, metric: Column, companies: Column) -> Column:
    """struct of whether a context holds any expected number, the metric, any company, a number with one of both, and the share of all that it holds.

    Numbers are texts that lose their last zeros and then a point; case and underscores of names don't count; empty names aren't found.
    """
    low = F.lower(F.coalesce(context, F.lit("")))
    name = F.lower(F.coalesce(metric, F.lit("")))
    n = F.size(F.filter(F.transform(numbers, lambda x: F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))), lambda x: (x != "") & F.contains(low, x)))
    c = F.size(F.filter(companies, lambda x: (x != "") & F.contains(low, F.lower(x))))
    m = F.contains(low, F.replace(name, F.lit("_"), F.lit(" "))) | F.contains(low, name)
    share = F.round((n + m.cast("int") + c) / (F.size(numbers) + 1 + F.size(companies)), 4)
    return F.struct((n > 0).alias("expected_number"), m.alias("expected_metric"), (c > 0).alias("expected_company"), ((n > 0) & (m | (c > 0))).alias("matches"), share.alias("overlap"))


def consistency_warnings(answer: Column, calculation: Column, question: Column, years: Column) -> Column:
    """Codes in order: percentages (by sign or word) near a year of the last or this century that differ by over 0.35 from all the calculation has there; inventory turnover, and that without a prior year.

    years are those of the facts; what comes before the first of them is never among them.
    """

    def percents(words: Column, year: Column) -> Column:
        at = F.position(year, words)
        start = F.greatest(F.lit(1), at - 90)
        found = F.regexp_extract_all(F.substring(words, start, at + 180 - start), F.lit(r"(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(?:%|percent)"), F.lit(1))
        return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))

    of = lambda words: F.array_distinct(F.regexp_extract_all(words, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)))

    def differs(year: Column) -> Column:
        there = percents(calculation, year)
        return (F.size(there) > 0) & F.exists(percents(answer, year), lambda v: ~F.exists(there, lambda c: F.abs(v - c) <= 0.35))

    low = F.lower(F.concat_ws("\n", question, answer, calculation))
    inventory = F.contains(low, F.lit("inventory")) & F.contains(low, F.lit("turnover"))
    mismatch = F.exists(F.array_intersect(of(answer), of(calculation)), differs)
    return F.array_compact(
        F.array(
            F.when(inventory, "ambiguous_formula"),
            F.when(mismatch, "final_answer_calculation_mismatch"),
            F.when(inventory & (F.size(years) > 0), "missing_prior_period"),
        )
    )
