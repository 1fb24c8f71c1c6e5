"""Scoring of free-text answers against several target slots per case.

A trace has final_answer, calculation, method and formula_type, and slots: array<struct<name, expected, unit>> with the
expected value as text. Everything is done within the row by higher-order functions, so no slot is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .score import CALCULATION, in_unit

# Formula types with wide tolerances, methods whose numbers are taken as they are.
WIDE = ("finqa_program", "tatqa_arithmetic")
AS_THEY_ARE = ("graph_neo4j_v8", "graph_neo4j_v9")


def rounded(c: Column, n: int = 4) -> Column:
    """c to n places, half away from zero, by one multiplication: the same double in every engine."""
    return F.signum(c) * F.floor(F.abs(c) * 10**n + 0.5) / F.lit(10.0**n)


def tolerance(expected: Column, formula_type: Column) -> Column:
    by_type = lambda least, rel: F.greatest(F.lit(least), rel * F.abs(expected))
    return F.when(formula_type.isin(*WIDE), by_type(0.5, 0.02)).otherwise(by_type(0.1, 0.005))


def slot_results(slots: Column, numbers: Column, method: Column, formula_type: Column) -> Column:
    """array of (name, expected, actual, tolerance, match, unit_normalised), one for each slot.

    The number nearest to the expected one counts, the first of equals; numbers are brought to the expected unit for
    programs only, and not for methods that read numbers from a graph. A slot without a number to expect never matches.
    """
    step = F.coalesce((formula_type == "finqa_program") & ~method.isin(*AS_THEY_ARE), F.lit(False))

    def result(s: Column, ns: Column) -> Column:
        expected = text.parse_number(s["expected"])

        def finish(e: Column) -> Column:
            tries = F.transform(ns, lambda v, i: F.struct(F.abs(F.when(step, in_unit(v, e)).otherwise(v) - e).alias("gap"), i.alias("i"), F.when(step, in_unit(v, e)).otherwise(v).alias("v"), (step & (in_unit(v, e) != v)).alias("moved")))
            best, limit = F.array_min(F.filter(tries, lambda t: t["gap"].isNotNull())), tolerance(e, formula_type)
            match = F.coalesce(best["gap"] <= limit, F.lit(False))
            return F.struct(s["name"].alias("name"), e.alias("expected"), best["v"].alias("actual"), limit.alias("tolerance"), match.alias("match"), F.coalesce(best["moved"], F.lit(False)).alias("unit_normalised"))

        return F.transform(F.array(expected), finish)[0]

    return F.transform(F.array(numbers), lambda ns: F.transform(slots, lambda s: result(s, ns)))[0]


def share(flags: Column) -> Column:
    """Share of true values; 0 of none."""
    return F.when(F.size(flags) > 0, F.size(F.filter(flags, lambda x: x)) / F.size(flags)).otherwise(0.0)


def closeness(results: Column) -> Column:
    """Mean over slots of 1 less the relative error, within 0 and 1; a slot without a number is 0."""
    each = F.transform(results, lambda r: F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(F.abs(r["actual"] - r["expected"]) / F.greatest(F.abs(r["expected"]), F.lit(1.0)), F.lit(1.0))), F.lit(0.0)))
    total = F.aggregate(each, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(results) > 0, rounded(total / F.size(results))).otherwise(0.0)


def both_texts() -> Column:
    return F.concat(F.coalesce("final_answer", F.lit("")), F.lit("\n"), F.coalesce("calculation", F.lit("")))


def well_formed() -> tuple[Column, Column]:
    """Whether both texts are there, and whether the calculation has a mark of one."""
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return said("final_answer") & said("calculation"), F.coalesce(F.lower("calculation").rlike(CALCULATION), F.lit(False))


def score(traces: DataFrame) -> DataFrame:
    """traces with results, ac, nc, recall, matched, missing, failure_reason and note.

    ac: every slot matches, there is at least one, and answer and calculation are well formed. A trace whose provider
    failed (``failed``) scores 0. Where an earlier scorer gave 1 (``earlier_ac``, with ``earlier_nc``) and this one
    doesn't, the earlier success stays and the note says so. All texts, slots and earlier scores may be null.
    """
    slots = F.coalesce("slots", F.array().cast(traces.schema["slots"].dataType))
    t = traces.withColumn("results", slot_results(slots, text.values_of(text.scaled_numbers(both_texts())), F.col("method"), F.coalesce("formula_type", F.lit(""))))
    form, calc = well_formed()
    matches = F.transform("results", lambda r: r["match"])
    numeric = (F.size("results") > 0) & F.forall("results", lambda r: r["match"])
    named = lambda hit: F.array_join(F.transform(F.filter("results", lambda r: r["match"] if hit else ~r["match"]), lambda r: r["name"]), ";")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    t = t.select("*", (numeric & form & calc & ~failed).alias("right"), numeric.alias("numeric_ok"), form.alias("format_ok"), calc.alias("calculation_ok"), rounded(share(matches)).alias("recall"), named(True).alias("matched"), named(False).alias("missing"), closeness(F.col("results")).alias("nc"))
    reason = (
        F.when(failed, "provider_error").when(F.col("right"), "none").when(~F.col("format_ok"), "answer_format_error")
        .when(F.size("results") == 0, "no_target_slots").when(~F.col("numeric_ok"), "formula_target_mismatch").otherwise("scoring_uncertain")
    )
    kept = F.coalesce(F.col("earlier_ac") == 1, F.lit(False)) & ~F.col("right")
    return t.select(
        *traces.columns, "results", "numeric_ok", "format_ok", "calculation_ok", "matched", "missing",
        (F.col("right") | kept).cast("int").alias("ac"), F.when(kept, 1.0).otherwise(F.col("recall")).alias("recall"),
        F.when(kept, F.coalesce("earlier_nc", "nc")).otherwise(F.col("nc")).alias("nc"),
        F.when(kept, "none").otherwise(reason).alias("failure_reason"), F.when(kept, "original_success_preserved").alias("note"),
    )


def fact_recall(facts: Column, numbers: Column, words: Column) -> Column:
    """Share of facts (expected, unit, year) whose value some number agrees with and whose year, if any, is in the words; 0 of none."""

    def found(f: Column, ns: Column) -> Column:
        same = F.exists(text.scaled_numbers(f["expected"]), lambda e: F.exists(ns, lambda a: text.same_number(e, a, f["unit"])))
        return same & F.coalesce(F.contains(words, f["year"].cast("string")), F.lit(True))

    return F.transform(F.array(numbers), lambda ns: share(F.transform(facts, lambda f: found(f, ns))))[0]


def score_by_recall(traces: DataFrame, least: float = 0.8) -> DataFrame:
    """traces with recall (of slots that some number agrees with in the slot's unit), fact_recall, ac without and ac_faithful with the gate that facts are recalled too.

    facts: array<struct<expected, unit, year>>. Both shares must be ``least`` or more; without slots nothing is right.
    """
    t = traces.withColumn("ns", text.scaled_numbers(both_texts()))
    hit = lambda s, ns: F.exists(text.scaled_numbers(s["expected"]), lambda e: F.exists(ns, lambda a: text.same_number(e, a, s["unit"])))
    recall = F.transform(F.array(F.col("ns")), lambda ns: share(F.transform("slots", lambda s: hit(s, ns))))[0]
    form, calc = well_formed()
    t = t.select("*", recall.alias("slot_recall"), fact_recall(F.col("facts"), F.col("ns"), both_texts()).alias("fact_recall"), form.alias("format_ok"), calc.alias("calculation_ok"))
    right = (F.col("slot_recall") >= least) & F.col("format_ok") & F.col("calculation_ok")
    reason = F.when(~F.col("format_ok"), "answer_format_error").when(F.col("slot_recall") < least, "formula_target_mismatch").when(~right, "scoring_uncertain").otherwise("none")
    gated = (
        F.when(~F.col("format_ok"), "answer_format_error").when(F.col("fact_recall") < 0.5, "required_fact_missing").when(F.size("slots") == 0, "expected_answer_ambiguous")
        .when(F.col("slot_recall") < least, "formula_target_mismatch").when(~(right & (F.col("fact_recall") >= least)), "scoring_uncertain").otherwise("none")
    )
    return t.select(*traces.columns, rounded(F.col("slot_recall")).alias("recall"), rounded(F.col("fact_recall")).alias("fact_recall"), right.cast("int").alias("ac"), (right & (F.col("fact_recall") >= least)).cast("int").alias("ac_faithful"), reason.alias("failure_reason"), gated.alias("gated_reason"))
