"""Formula contracts: which formula a question asks for, which of a case's metrics play its roles, and the target slots.

cases: (case_id, question, expected_answer). facts: (case_id, metric, year, value, place), place telling which of two
values of a cell came last. Names are compared as slugs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .slots import rounded

# Words of names that can be revenue.
REVENUE = ("revenue", "net_sales", "total_revenue")
# Formula type, numerator's words and the name without a match, denominator's likewise, template, kind of output.
ROLES = {
    "tax_rate_ratio": (("income_tax", "provision_for_income_taxes", "tax_provision"), "income_tax_provision", ("earnings_before_income_taxes", "income_before_income_taxes", "before_income_taxes"), "earnings_before_income_taxes", "abs(income_tax_provision) / earnings_before_income_taxes * 100", "percentage"),
    "inventory_turnover": (("cost_of_sales",), "cost_of_sales", ("inventories", "inventory"), "inventories", "cost_of_sales / average_inventory", "ratio"),
    "current_ratio": (("current_assets",), "current_assets", ("current_liabilities",), "current_liabilities", "current_assets / current_liabilities", "ratio"),
    "gross_margin": (("gross_profit",), "gross_profit", REVENUE, "revenue", "gross_profit / revenue * 100", "percentage"),
    "operating_margin": (("operating_income",), "operating_income", REVENUE, "revenue", "operating_income / revenue * 100", "percentage"),
    "cost_sga_ratio": (("cost_of_sales",), "cost_of_sales", ("selling_general_and_administrative",), "selling_general_and_administrative_expenses", "cost_of_sales / selling_general_and_administrative_expenses", "ratio"),
    "revenue_growth": (REVENUE, "revenue", (), "prior_period_revenue", "(current_revenue - prior_revenue) / prior_revenue * 100", "percentage"),
    "eps_reconciliation": (("net_income",), "net_income", ("weighted_average", "shares"), "weighted_average_shares", "net_income / weighted_average_shares", "amount"),
}
# Formulas that are defined only where a question and all metrics of the roles agree.
STRICT = {
    "workforce_ratio": ("non_u_s", "total", "", ""),
    "growth_and_eps_change": ("net_income", "", "", "diluted_earnings_per_common_share"),
    "noninterest_expense_ratio": ("total_noninterest_expense", "net_interest_income", "", ""),
    "bank_operating_profit_margin": ("income_before_taxes", "net_interest_income", "total_other_income", ""),
}
AMBIGUOUS = "ambiguous_manual_review"


def bare(name: Column) -> Column:
    """A name in lower case, runs of other than letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def _metrics_of(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """cases with q (the question in lower case), a (the answer likewise) and m, the sorted distinct metric names of each: a vocabulary, whatever the number of facts."""
    m = facts.select("case_id", bare(F.col("metric")).alias("m")).distinct().groupBy("case_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return cases.join(m, "case_id", "left").select("case_id", low("question").alias("q"), low("expected_answer").alias("a"), F.coalesce("m", F.array().cast("array<string>")).alias("m"))


def _first_with(words: tuple[str, ...], other: Column | None = None) -> Column:
    """The first of a case's metrics, by name, that has one of the words, one that isn't ``other`` if there is any; null if none has."""
    if not words:
        return F.lit(None).cast("string")
    found = F.filter("m", lambda m: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(m, w)))
    first = F.get(found, F.lit(0))
    return first if other is None else F.coalesce(F.get(F.filter(found, lambda m: m != F.coalesce(other, F.lit(""))), F.lit(0)), first)


def _asks(*words: str) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("q"), w))


def resolve(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, formula_type, numerator, denominator, template, output, ambiguous) of each case, by the first rule that holds.

    A metric that is the denominator isn't the numerator as well where another can be. A role that none of the case's metrics plays keeps its own name. Null questions and cases without facts are
    ambiguous, as is whatever no rule knows.
    """
    c = _metrics_of(cases, facts)
    kind = (
        F.when(_asks("tax rate", "effective tax"), "tax_rate_ratio").when(_asks("inventory turnover"), "inventory_turnover")
        .when(F.contains("a", F.lit("current ratio")) | _asks("liquidity"), "current_ratio").when(_asks("gross margin", "gpm"), "gross_margin")
        .when(_asks("operating margin") | (_asks("margin") & _first_with(("operating_income",)).isNotNull()), "operating_margin")
        .when(_asks("sg&a", "cost/sga"), "cost_sga_ratio").when(_asks("growth") & _first_with(REVENUE).isNotNull(), "revenue_growth")
        .when(_asks("eps", "per share"), "eps_reconciliation").otherwise(AMBIGUOUS)
    )
    c = c.withColumn("formula_type", kind)

    def pick(of) -> Column:
        out = F.lit("")
        for name, rule in ROLES.items():
            out = F.when(F.col("formula_type") == name, of(rule)).otherwise(out)
        return out

    return c.select(
        "case_id", "formula_type",
        pick(lambda r: F.coalesce(_first_with(r[0], _first_with(r[2])), F.lit(r[1]))).alias("numerator"), pick(lambda r: F.coalesce(_first_with(r[2]), F.lit(r[3]))).alias("denominator"),
        F.lit("").alias("addend"), F.lit("").alias("difference"), pick(lambda r: F.lit(r[4])).alias("template"), pick(lambda r: F.lit(r[5])).alias("output"),
        (F.col("formula_type") == AMBIGUOUS).alias("ambiguous"),
    )


def resolve_strictly(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """The same columns for cases that ask for one of the STRICT formulas and have all of its metrics; others are left out."""
    c = _metrics_of(cases, facts)
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(F.col("m"), n))
    asks_all = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("q"), w))
    kind = (
        F.when(asks_all("distribution", "employee") & has("non_u_s", "total"), "workforce_ratio")
        .when(asks_all("net inc", "growth", "eps"), "growth_and_eps_change")
        .when(asks_all("noninterest exp ratio") & has("total_noninterest_expense", "net_interest_income"), "noninterest_expense_ratio")
        .when(asks_all("operating profit margin") & has("income_before_taxes", "net_interest_income", "total_other_income"), "bank_operating_profit_margin")
    )
    c = c.withColumn("formula_type", kind).where("formula_type is not null")

    def role(k: int) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for name, r in STRICT.items() for x in (name, r[k])]), F.col("formula_type"))

    return c.select("case_id", "formula_type", *[role(k).alias(n) for k, n in enumerate(("numerator", "denominator", "addend", "difference"))], F.lit("").alias("template"), F.lit("percentage").alias("output"), F.lit(False).alias("ambiguous"))


def targets(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, formula_type, slot, expected, unit, years): what each case's formula comes to, year by year.

    A role's value in a year is the last value of any metric whose name has the role's. Ratios need both roles in one
    year, growth the last year before that has the numerator, turnover the inventories of this year and the one
    before, of the latest such year. Denominators of 0 give no slot, and cases without any slot no rows.
    """
    name = bare(F.col("metric"))
    j = facts.where("year is not null and value is not null").join(resolved.where(~F.col("ambiguous")), "case_id")
    last = lambda role: F.max(F.when((F.col(role) != "") & F.contains(name, F.col(role)), F.struct("place", "value")))["value"]
    y = j.groupBy("case_id", "formula_type", "year").agg(last("numerator").alias("n"), last("denominator").alias("d"), last("addend").alias("p"), last("difference").alias("x"))
    w = Window.partitionBy("case_id", "formula_type").orderBy("year")
    before, dated = w.rowsBetween(Window.unboundedPreceding, -1), lambda c: F.when(F.col(c).isNotNull(), F.struct("year", F.col(c).alias("v")))
    y = y.select("*", F.last(dated("n"), ignorenulls=True).over(before).alias("n0"), F.last(dated("x"), ignorenulls=True).over(before).alias("x0"), F.last(dated("d"), ignorenulls=True).over(before).alias("d0"))
    t, year = F.col("formula_type"), F.col("year").cast("string")
    slot = lambda when, name, value, unit, *years: F.when(when, F.struct(name.alias("slot"), rounded(value, 6).alias("expected"), F.lit(unit).alias("unit"), F.array(*years).alias("years")))
    named, both = F.concat_ws("_", t, year), F.col("n").isNotNull() & (F.col("d") != 0)
    against = lambda prefix, ago: F.concat(F.lit(prefix), F.lit("_"), year, F.lit("_vs_"), F.col(ago)["year"].cast("string"))
    growth = lambda prefix, when: slot(when & F.col("n").isNotNull() & (F.col("n0")["v"] != 0), against(prefix, "n0"), (F.col("n") - F.col("n0")["v"]) / F.abs(F.col("n0")["v"]) * 100, "percentage", F.col("year"), F.col("n0")["year"])
    average = (F.col("d") + F.col("d0")["v"]) / 2
    turns = (t == "inventory_turnover") & F.col("n").isNotNull() & (F.col("d0")["year"] == F.col("year") - 1) & (average != 0)
    latest = F.max(F.when(turns, F.col("year"))).over(Window.partitionBy("case_id", "formula_type"))
    total = F.col("d") + F.col("p")
    y = y.withColumn("slots", F.array_compact(F.array(
        slot(t.isin("tax_rate_ratio", "gross_margin", "operating_margin", "net_margin", "operating_expense_ratio", "noninterest_expense_ratio") & both, named, F.abs("n") / F.abs("d") * 100, "percentage", F.col("year")),
        slot((t == "workforce_ratio") & both, F.concat(F.lit("non_us_employee_distribution_"), year), F.col("n") / F.col("d") * 100, "percentage", F.col("year")),
        slot(t.isin("current_ratio") & both, named, F.col("n") / F.col("d"), "ratio", F.col("year")), slot((t == "eps_reconciliation") & both, named, F.col("n") / F.col("d"), "amount", F.col("year")),
        slot((t == "cost_sga_ratio") & both, named, F.abs("n") / F.abs("d"), "ratio", F.col("year")),
        slot(turns & (latest == F.col("year")), named, F.col("n") / average, "ratio", F.col("year"), F.col("year") - 1),
        growth("revenue_growth", t == "revenue_growth"), growth("net_income_growth", t == "growth_and_eps_change"),
        slot((t == "growth_and_eps_change") & F.col("x").isNotNull() & F.col("x0").isNotNull(), against("diluted_eps_change", "x0"), F.col("x") - F.col("x0")["v"], "amount", F.col("year"), F.col("x0")["year"]),
        slot((t == "bank_operating_profit_margin") & F.col("n").isNotNull() & (total != 0), F.concat(F.lit("ibt_to_net_interest_plus_other_income_margin_"), year), F.col("n") / total * 100, "percentage", F.col("year")),
    )))
    return y.select("case_id", "formula_type", F.explode("slots").alias("s")).select("case_id", "formula_type", "s.*")


# Units of scales of amounts.
SCALE_UNITS = {"": "amount", "percent": "percentage", "thousand": "USD_thousands", "million": "USD_millions", "billion": "USD_billions"}
# A number, a constant or an earlier step in a program, and a number in a derivation.
ARGUMENT = r"#\d+|const_m?\d+(?:\.\d+)?|-?\d+(?:\.\d+)?%?"
DERIVED = r"-?\d[\d,]*(?:\.\d+)?"


def derivation_operands(derivation: Column, most: int = 12) -> Column:
    """Numbers of an arithmetic derivation in order, at most ``most``; commas group digits."""
    found = F.regexp_extract_all(F.coalesce(derivation, F.lit("")), F.lit(DERIVED), F.lit(0))
    return F.slice(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), 1, most)


def program_steps(program: Column) -> Column:
    """array of (op, left, right): the steps of a program as ``op(left, right)``; null arguments aren't numbers, constants or steps."""
    steps = F.regexp_extract_all(F.coalesce(program, F.lit("")), F.lit(r"[a-z_]+\([^()]*\)"), F.lit(0))
    of = lambda s, k: F.nullif(F.regexp_extract(F.trim(F.get(F.split(F.regexp_extract(s, r"\(([^()]*)\)", 1), ","), F.lit(k))), rf"^(?:{ARGUMENT})$", 0), F.lit(""))
    return F.transform(steps, lambda s: F.struct(F.regexp_extract(s, r"^[a-z_]+", 0).alias("op"), of(s, 0).alias("left"), of(s, 1).alias("right")))


def run_program(program: Column) -> Column:
    """The result of each step, in order; ``#k`` is the result of step k from 0. What can't be computed is null, and so is all that needs it."""

    def value(arg: Column, done: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(arg, "^const_", ""), "^m", "-"), "%$", "").try_cast("double")
        plain = F.when(arg.endswith("%"), plain / 100).otherwise(plain)
        return F.when(arg.startswith("#"), F.get(done, F.substring(arg, F.lit(2), F.length(arg)).try_cast("int"))).otherwise(plain)

    def step(done: Column, s: Column) -> Column:
        a, b = value(s["left"], done), value(s["right"], done)
        out = (
            F.when(s["op"] == "add", a + b).when(s["op"] == "subtract", a - b).when(s["op"] == "multiply", a * b).when(s["op"] == "divide", F.try_divide(a, b))
            .when(s["op"] == "exp", F.pow(a, b)).when(s["op"] == "greater", (a > b).cast("double"))
        )
        return F.concat(done, F.array(out))

    return F.aggregate(program_steps(program), F.array().cast("array<double>"), step)


def from_derivations(cases: DataFrame, most_program: int = 8, most_derivation: int = 12) -> DataFrame:
    """(case_id, kind, facts, slot, expected, unit, tolerance, computed, reason) of cases (case_id, program, derivation, scale, answer).

    A program's facts are its first ``most_program`` numbers, a derivation's its first ``most_derivation``. ``computed``
    is what the last step of a program comes to. Cases with fewer than two numbers, or without an expected number, have
    no facts and a reason.
    """
    program = F.coalesce("program", F.lit("")) != ""
    numbers = F.when(program, F.slice(text.operands(F.col("program")), 1, most_program)).otherwise(derivation_operands(F.col("derivation"), most_derivation))
    every = F.when(program, F.size(text.operands(F.col("program")))).otherwise(F.size(derivation_operands(F.col("derivation"), most_derivation)))
    c = cases.select("*", program.alias("_p"), F.filter(numbers, lambda x: x.isNotNull()).alias("_n"), every.alias("_k"), text.parse_number(F.col("answer")).alias("expected"))
    unit = F.when(F.col("_p"), F.when(F.contains(F.col("answer"), F.lit("%")), "percentage").otherwise("amount")).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALE_UNITS.items() for x in kv]), F.coalesce("scale", F.lit(""))), F.lit("amount")))
    size = F.abs("expected")
    limit = F.when(~F.col("_p"), F.greatest(F.lit(0.5), 0.02 * size)).when(unit == "percentage", 0.1).otherwise(F.greatest(F.lit(0.05), 0.005 * size))
    reason = F.when(F.col("expected").isNull(), "answer_not_numeric").when(F.col("_k") < 2, "too_few_operands")
    prefix = F.when(F.col("_p"), "program_operand_").otherwise("operand_")
    made = F.transform("_n", lambda v, i: F.struct(F.concat(prefix, F.lpad((i + 1).cast("string"), 2, "0")).alias("metric"), v.alias("value")))
    ok = reason.isNull()
    return c.select(
        "case_id", F.when(F.col("_p"), "finqa_program").otherwise("tatqa_arithmetic").alias("kind"), F.when(ok, made).otherwise(F.slice(made, 1, 0)).alias("facts"),
        F.when(ok, F.when(F.col("_p"), "finqa_program_answer").otherwise("final_result")).alias("slot"), F.when(ok, F.col("expected")).alias("expected"), unit.alias("unit"),
        F.when(ok, limit).alias("tolerance"), F.when(F.col("_p"), F.element_at(F.concat(F.array(F.lit(None).cast("double")), run_program(F.col("program"))), -1)).alias("computed"), reason.alias("reason"),
    )


def merge(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, origin, slots, filled): one contract for each case, its slots filled from facts where it has none.

    sources: (case_id, origin, priority, overrides, slots: array<struct<name, expected, unit>>). A source that overrides
    wins over the others, the last of them by priority; else the first by priority that has slots, else the first.
    facts: (case_id, metric, year, value, unit, place) fill what is left, in order of place, each (metric, year, value)
    once, as ``source_<metric>_<year>_<number>``.
    """
    w = F.struct((~F.col("overrides")).alias("o"), F.when(~F.col("overrides"), F.size("slots") == 0).alias("empty"), F.when(F.col("overrides"), -F.col("priority")).otherwise(F.col("priority")).alias("p"), "origin")
    one = sources.withColumn("slots", F.coalesce("slots", F.array().cast(sources.schema["slots"].dataType))).groupBy("case_id").agg(F.min_by(F.struct("origin", "slots"), w).alias("x")).select("case_id", "x.*")
    bare_ = one.where(F.size("slots") == 0).select("case_id")
    f = facts.join(bare_, "case_id", "left_semi").groupBy("case_id", "metric", "year", "value").agg(F.min_by("unit", "place").alias("unit"), F.min("place").alias("place"))
    f = f.withColumn("i", F.row_number().over(Window.partitionBy("case_id").orderBy("place", "metric")))
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = F.concat_ws("_", F.lit("source"), text_of("metric"), text_of("year"), F.lpad(F.col("i").cast("string"), 2, "0"))
    made = f.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("i", named.alias("name"), F.col("value").cast("string").alias("expected"), F.coalesce("unit", F.lit("")).alias("unit")))).alias("m"))  # the distinct facts of a case
    out = one.join(made, "case_id", "left")
    filled = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["expected"].alias("expected"), x["unit"].alias("unit")))
    return out.select("case_id", "origin", F.when(F.col("m").isNotNull(), filled).otherwise(F.col("slots")).alias("slots"), F.col("m").isNotNull().alias("filled"))
