"""How well required facts are covered by observations, extractions and retrieved hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .slots import rounded


def tolerance_matches(required: DataFrame, observed: DataFrame) -> DataFrame:
    """(ticker, metric, year, matches): observations of the same ticker and year whose metric contains the other and value is near."""
    o = observed.select("ticker", "year", F.col("metric").alias("m"), "value")
    near = F.abs(F.col("value") - F.col("expected")) <= F.greatest(F.lit(0.01), 1e-4 * F.abs("expected"))
    same = F.contains("m", F.col("metric")) | F.contains("metric", F.col("m"))
    j = required.join(o, ["ticker", "year"], "left")
    return j.groupBy("ticker", "metric", "year").agg(F.count_if(same & near).alias("matches"))


def extraction_status(required: DataFrame, extracted: DataFrame) -> DataFrame:
    j = required.join(extracted.select("ticker", "metric", "year", "value"), ["ticker", "metric", "year"], "left")
    near = F.abs(F.col("value") - F.col("expected")) <= F.when(F.abs("expected") > 1, 0.01 * F.abs("expected")).otherwise(0.05)
    status = F.when(F.col("value").isNull(), "extraction_failed").when(F.col("expected") == 0, "no_contract_fact").when(near, "matched").otherwise("mismatch")
    return j.select("ticker", "metric", "year", status.alias("status"))


def recall(required: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Share of required facts that an observation of the same ticker and year meets.

    Its metric must match by name, and its value be within 1 % of the larger of both, or within 0.01.
    """
    j = required.join(observed.select("ticker", "year", F.col("metric").alias("m"), "value"), ["ticker", "year"], "left")
    met = text.metric_matches(F.col("metric"), F.col("m")) & text.close(F.col("expected"), F.col("value"), 0.01, 0.01)
    hit = F.coalesce(F.bool_or(met), F.lit(False)).cast("double").alias("hit")
    return j.groupBy("ticker", "metric", "year").agg(hit).groupBy(*by).agg(F.round(F.avg("hit"), 4).alias("recall"))


def triage(df: DataFrame) -> DataFrame:
    """All mismatch classes of a missing fact, the first as primary, a proposed patch and its risk."""
    codes = F.array_compact(
        F.array(
            F.when(~F.col("company"), "company_ticker_mismatch"),
            F.when(~F.col("metric_found"), "metric_mismatch"),
            F.when(~F.col("year_found"), "period_mismatch"),
            F.when(~F.col("value_near"), "value_mismatch"),
        )
    )
    d = df.withColumn("classes", codes).withColumn("primary_class", F.coalesce(F.get("classes", 0), F.lit("matched")))
    return d.withColumn("patch", F.when(F.size("classes") == 0, "none").when(F.col("primary_class") == "value_mismatch", "replace_value").otherwise("insert_fact")).withColumn(
        "risk", F.when(F.size("classes") >= 3, "high").when(F.size("classes") == 2, "medium").otherwise("low")
    )


def lookup(cases: DataFrame, facts: DataFrame, batch: str, many: int = 20, least: int = 3, deprecated: str = "deprecated") -> DataFrame:
    """(case_id, fact_id, metric, year, value): facts of each case's ticker, batch and years that aren't deprecated.

    cases: (case_id, ticker, years: array, tags: array); facts: (fact_id, ticker, metric, year, value, kg_batch, status).
    Where a case has more than ``many`` of them, only those whose metric has a word of four letters or more of the tags
    stay, if these are ``least`` or more. Facts without a status are active.
    """
    words = F.filter(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.split(F.replace(F.lower(t), F.lit("_"), F.lit(" ")), " "))), lambda w: F.length(w) >= 4)
    c = cases.select("case_id", "ticker", "years", F.array_distinct(words).alias("words"))
    f = facts.where((F.col("kg_batch") == batch) & (F.coalesce("status", F.lit("")) != deprecated))
    j = c.join(f, "ticker").where(F.array_contains("years", F.col("year")))
    j = j.withColumn("hit", F.exists("words", lambda w: F.contains(F.lower("metric"), w)))
    n = j.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    j = j.join(n, "case_id").where((F.col("n") <= many) | (F.col("h") < least) | F.col("hit"))
    return j.select("case_id", "fact_id", "metric", "year", "value")


def fuzzy_coverage(required: DataFrame, graph: DataFrame) -> DataFrame:
    """(ticker, metric, year, company_found, metric_found, chain_found, coverage) of each required combination.

    required: (ticker, metric, year); graph: (ticker, metric, year) of observations. A metric is found where some
    metric of the graph has the first two of its words of four letters or more; the chain where one of the same company
    and year has them. Metric names are a small vocabulary; chains meet by company and year.
    """
    words = F.filter(F.split(F.coalesce("metric", F.lit("")), "_"), lambda w: F.length(w) >= 4)
    r = required.select("ticker", "metric", "year").distinct().withColumn("w", F.slice(words, 1, 2))
    yes = F.lit(True)
    g = graph.select("ticker", F.lower("metric").alias("m"), "year")
    fits = (F.size("w") > 0) & F.forall("w", lambda w: F.contains(F.col("m"), w))
    names = r.select("metric", "w").distinct().select("metric", "w", F.get("w", F.lit(0)).alias("w1")).where("w1 is not null")
    by_word = g.select("m").distinct().select("m", F.explode(F.split("m", "[^a-z0-9]+")).alias("part"))
    # names that share a word with some metric of the graph first, and then those that have the words within others
    exact = names.join(by_word.distinct(), names["w1"] == by_word["part"]).where(fits).select("metric").distinct()
    rest = names.join(exact, "metric", "left_anti")
    loose = rest.join(F.broadcast(g.select("m").distinct()), F.contains(F.col("m"), F.col("w1"))).where(fits).select("metric").distinct()  # a vocabulary
    found = exact.unionByName(loose).withColumn("metric_found", yes)
    chain = r.where("ticker is not null and year is not null").join(g, ["ticker", "year"]).where(fits).select("ticker", "metric", "year").distinct().withColumn("chain_found", yes)
    out = r.join(graph.select("ticker").distinct().withColumn("company_found", yes), "ticker", "left").join(found, "metric", "left").join(chain, ["ticker", "metric", "year"], "left")
    out = out.select("ticker", "metric", "year", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("company_found", "metric_found", "chain_found")])
    kind = F.when(F.col("company_found") & F.col("metric_found") & F.col("chain_found"), "full").when(~F.col("company_found"), "none").otherwise("partial")
    return out.withColumn("coverage", kind)


def coverage_by_ticker(covered: DataFrame) -> DataFrame:
    """(ticker, company_found, combinations, full, partial, none) of fuzzy_coverage()."""
    n = lambda k: F.count_if(F.col("coverage") == k).alias(k)
    return covered.groupBy("ticker").agg(F.bool_or("company_found").alias("company_found"), F.count("*").alias("combinations"), n("full"), n("partial"), n("none"))


def sides_found(cases: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, a_found, b_found, both_found, fact_recall, share_a, share_b) of what was retrieved for each case.

    cases: (case_id, company_a, company_b); sources: (case_id, ticker, source_id), the observations a case was made
    from; hits: (case_id, source_id, ticker). A side is found where one of its sources or its company is among the hits;
    its share is that of its observations whose source is. Cases without hits or sources have nothing found.
    """
    side = cases.select("case_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("company_a").alias("ticker")), F.struct(F.lit("b").alias("side"), F.col("company_b").alias("ticker")))).alias("x")).select("case_id", "x.*")
    there = hits.select("case_id", "source_id").distinct().withColumn("hit", F.lit(True))
    s = side.join(sources, ["case_id", "ticker"]).join(there, ["case_id", "source_id"], "left").groupBy("case_id", "side").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    named = side.join(hits.select("case_id", "ticker").distinct(), ["case_id", "ticker"]).select("case_id", "side").withColumn("named", F.lit(True))
    j = side.join(s, ["case_id", "side"], "left").join(named, ["case_id", "side"], "left")
    found = (F.coalesce("k", F.lit(0)) > 0) | F.coalesce("named", F.lit(False))
    share = F.coalesce(rounded(F.col("k") / F.col("n")), F.lit(0.0))
    pick = lambda c, k: F.max(F.when(F.col("side") == k, c))
    g = j.groupBy("case_id").agg(pick(found, "a").alias("a_found"), pick(found, "b").alias("b_found"), pick(share, "a").alias("share_a"), pick(share, "b").alias("share_b"))
    recall = (F.col("a_found").cast("double") + F.col("b_found").cast("double")) / 2
    return g.select("case_id", "a_found", "b_found", (F.col("a_found") & F.col("b_found")).alias("both_found"), recall.alias("fact_recall"), "share_a", "share_b")
