"""Validation, repair and filtering of observations, cases and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text


def obs_id(batch: str, case_id: Column, ticker: str, metric: str, year: str, n: Column) -> Column:
    """batch__case__ticker__metric__year__NN."""
    return F.concat_ws("__", F.lit(batch), case_id, ticker, metric, F.col(year).cast("string"), F.lpad(n.cast("string"), 2, "0"))


def parsed_id(c: str) -> list[Column]:
    """Ticker, metric and year of an obs_id, read from its end; the year is null where it is none."""
    p = F.split(c, "__")
    return [F.element_at(p, -4).alias("ticker"), F.element_at(p, -3).alias("metric"), F.element_at(p, -2).try_cast("int").alias("year")]


def verify_quotes(df: DataFrame) -> DataFrame:
    """exact: the evidence holds the quote; verified: it does without ``$`` and white space; repaired: the first line with value and metric."""
    bare = lambda c: F.regexp_replace(c, r"[$\s]", "")
    line = F.filter(F.split("evidence", "\n"), lambda x: F.contains(x, F.col("v")) & F.contains(x, F.col("metric")))
    return df.select("*", F.contains("evidence", "quote").alias("exact"), F.contains(bare("evidence"), bare("quote")).alias("verified"), F.get(line, 0).alias("repaired"))


def fact_context(facts: DataFrame) -> DataFrame:
    """One text per ticker with a line for each fact, by metric and year."""
    line = F.concat_ws(" | ", "metric", "year", F.floor("value"))
    rows = facts.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("metric", "year", line.alias("line")))).alias("l"))
    return rows.select("ticker", F.array_join("l.line", "\n").alias("context"))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows were read, and how many were left after each stage."""
    passed, counts = F.lit(True), [F.count("*").alias("read")]
    for name, keep in stages:
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)


def relabel(df: DataFrame, c: str, names: dict[str, str], default: str, out: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(c)), F.lit(default)))


def first_reason(obs: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` observations of each case with the first reason that speaks against each, or null.

    A null unit is no unit, and a quote that is null or white space is empty.
    """
    by = Window.partitionBy("case_id").orderBy("raw_metric", "year", "ordinal", "value")
    o = obs.withColumn("slug", metrics.slug(F.col("raw_metric"))).withColumn("i", F.row_number().over(by)).where(F.col("i") <= most)
    artifact = F.lit(False)
    for a in text.ARTIFACTS:
        artifact = artifact | F.contains("slug", F.lit(a))
    reason = (
        F.when(artifact, "metric_artifact")
        .when(F.length("slug") < 4, "metric_too_short")
        .when(F.col("year").isNull() | ~F.col("year").between(2000, 2030), "year_out_of_range")
        .when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "invalid_value")
        .when(~F.coalesce("unit", F.lit("")).isin(*text.UNITS), "invalid_unit")
        .when(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s", "") == "", "empty_evidence_quote")
    )
    o = o.withColumn("r", reason)
    again = F.row_number().over(Window.partitionBy("case_id", "slug", "year", "r").orderBy("i")) > 1
    return o.withColumn("reason", F.coalesce("r", F.when(again, "duplicate_observation_id"))).drop("r")


def issues(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with any issue, and the codes of all they have."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return df.withColumn("issues", codes).where(F.size("issues") > 0)


def repair(facts: DataFrame, evidence: DataFrame, latest: int) -> DataFrame:
    """Facts with an exact quote from their evidence, a unit and a period role, and one reason to reject, or null."""
    f = facts.join(evidence, "ticker")
    quote = F.get(F.filter(F.split("evidence", "\n"), lambda x: F.contains(x, F.col("metric"))), 0)
    return f.select(
        "*",
        quote.alias("quote"),
        F.when(F.col("year") == latest, "current").when(F.col("year") >= latest - 6, "prior").otherwise("unknown").alias("period_role"),
        F.when(quote.isNull(), "no_exact_quote").when(F.col("year") < 2000, "bad_year").when(F.col("value") == 0, "zero_value").alias("reject_reason"),
    ).withColumn("unit", F.when(F.col("unit") == "", "currency_millions").otherwise(F.col("unit")))


def isolation_violations(prompts: DataFrame) -> DataFrame:
    """Prompts that hold a section their method must not see."""
    has = lambda name: F.col("prompt").rlike(rf"(?m)^{name}:?\s*$")
    p = prompts.select("doc_id", "method", has("TEXT_CONTEXT").alias("has_text"), has("GRAPH_FACTS_TABLE").alias("has_graph"), has("GOLD_CONTEXT").alias("has_gold"))
    return p.where("has_gold or (method = 'vector' and has_graph) or (method = 'graph' and has_text)")
