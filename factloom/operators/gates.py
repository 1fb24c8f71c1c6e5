"""Rules that keep or reject: the repair of facts, leakage, provenance of arms, missing facts, warnings, and gates over whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .slots import rounded

# the repair gate

# Phrases of table headers, and words of periods, units and roles.
HEADERS = ("birth years between", "in millions except", "in millions, except", "at_the_end_of", "at the end of", "year ended", "years ended", "consolidated statements", "statement of operations", "table of contents")
BIRTH, EXPIRY, MATURITY = r"\b(birth|born|age|ages)\b", r"\b(expire|expires|expiration|cba|contract)\b", r"\b(matur|note|debt|principal)\b"
PER_SHARE_WORDS = ("eps", "earnings per share", "per share")
STAFF_WORDS = ("employee", "workforce", "headcount")
MONEY_WORDS = ("revenue", "sales", "income", "profit", "earnings", "expense", "cost", "tax", "premium")
DENOMINATORS = ("revenue", "sales", "premium", "net int", "other inc", "assets")
NUMERATORS = ("income", "profit", "earnings", "loss", "tax", "expense", "cost")
#: Characters after a metric's name within which its value must be.
REACH = 2200


def has(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def variants(value: Column) -> Column:
    """The spellings of a value, the longest first: with and without commas, dollars, percent, and in parentheses if negative."""
    size = F.abs(value)
    short = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    base, plain = short(F.format_string("%,.4f", size)), short(F.format_string("%.4f", size))

    def spelt(x: Column) -> Column:
        base, plain = x["base"], x["plain"]
        usual = F.array(base, plain, F.concat(F.lit("$"), base), F.concat(F.lit("$ "), base), F.concat(base, F.lit("%")))
        negative = F.array(F.concat(F.lit("("), base, F.lit(")")), F.concat(F.lit("("), plain, F.lit(")")), F.concat(F.lit("$("), base, F.lit(")")), F.concat(F.lit("("), base, F.lit(")%")))
        return F.when(value < 0, F.concat(usual, negative)).otherwise(usual)

    found = F.array_distinct(F.transform(F.array(F.struct(base.alias("base"), plain.alias("plain"))), spelt)[0])
    by_length = F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(by_length, lambda x: x["v"])


def exact_quote(evidence: Column, metric: Column, value: Column) -> Column:
    """The part of the evidence from the metric's name, in any case and spacing, to the first spelling of the value behind it; null if there is none.

    Of several places the first counts, and there the longest spelling.
    """
    name = F.concat(F.lit(r"\Q"), F.regexp_replace(F.trim(metric), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))

    def find(x: Column) -> Column:
        there = F.filter(variants(value), lambda v: F.contains(x["low"], F.lower(v)))  # the others can't match, and each pattern is one to compile
        tries = F.transform(there, lambda v, i: F.struct(F.regexp_substr(evidence, F.concat(x["name"], v, F.lit(r"\E"))).alias("q"), i.alias("i")))
        placed = F.transform(F.filter(tries, lambda t: t["q"].isNotNull()), lambda t: F.struct(F.position(t["q"], evidence).alias("at"), t["i"].alias("i"), t["q"].alias("q")))
        return F.array_min(placed)["q"]

    head = F.concat(F.lit(r"(?is)"), name, F.lit(f".{{0,{REACH}}}?"), F.lit(r"\Q"))
    found = F.transform(F.array(F.struct(head.alias("name"), F.lower(evidence).alias("low"))), find)[0]
    return F.when((F.coalesce(F.trim(metric), F.lit("")) != "") & evidence.isNotNull(), found)


def repair_facts(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """facts with quote, period_role, repaired_unit, role and reject_reason: null for those that stay, else the first reason that holds.

    facts: (case_id, fact_id, metric_raw, metric_canonical, year, value, unit, fact_role); cases: (case_id, question,
    expected_answer, evidence). Nulls in texts count as empty.
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    j = facts.join(cases, "case_id", "left")
    j = j.withColumn("quote", exact_quote(F.col("evidence"), F.col("metric_raw"), F.col("value")))
    asked = F.lower(F.concat_ws(" ", e("question"), e("expected_answer")))
    said = F.concat_ws(" ", F.lower(e("quote")), asked)
    metric = F.lower(F.concat_ws(" ", e("metric_raw"), e("metric_canonical")))
    dated = F.col("year").isNotNull()
    period = (
        F.when(dated & said.rlike(BIRTH), "birth_year_range").when(dated & said.rlike(EXPIRY), "expiration_year").when(dated & said.rlike(MATURITY), "maturity_year")
        .when(F.col("year").between(2000, 2035), "reporting_period").otherwise("other")
    )
    j = j.withColumn("period_role", period)
    p = F.col("period_role")
    artifact = (
        F.when(has(metric, HEADERS), "metric_header_phrase").when(p.isin("birth_year_range", "expiration_year"), F.concat(F.lit("non_reporting_"), p))
        .when(p == "maturity_year", "debt_maturity_year_excluded_from_reporting_period").when(F.col("year") < 2000, "pre_2000_year_not_reporting_period")
        .when((F.col("unit") == "USD_per_share") & has(metric, ("revenue", "sales", "premium")), "unit_metric_mismatch")
        .when((F.col("value") < 0) & F.lower(e("quote")).rlike(r"\d+(?:\.\d+)?\s*%\s*(?:-|to|through)\s*\d+(?:\.\d+)?\s*%"), "negative_percentage_range_artifact")
    )
    scope = F.lower(F.concat_ws("\n", e("quote"), F.substring(e("evidence"), F.lit(1), F.lit(1200))))
    money = F.when(F.col("unit").isin("USD_millions", "USD_thousands"), F.col("unit")).otherwise("USD_millions")
    unit = (
        F.when(has(metric, PER_SHARE_WORDS), "USD_per_share").when(has(scope, STAFF_WORDS), "employees").when(F.contains(e("quote"), F.lit("%")) | F.contains(metric, F.lit("percent")), "percent")
        .when(F.contains(scope, F.lit("in millions")), "USD_millions").when(F.contains(scope, F.lit("in thousands")), "USD_thousands").when(has(metric, MONEY_WORDS), money).otherwise(F.coalesce("unit", F.lit("numeric")))
    )
    j = j.withColumn("repaired_unit", unit)
    raw = F.lower(e("metric_raw"))
    mismatch = (F.col("repaired_unit") == "USD_per_share") & has(raw, MONEY_WORDS) & ~has(raw, ("per share", "eps"))
    role = (
        F.when(has(asked, ("margin", "ratio")) & has(metric, DENOMINATORS), "denominator").when(has(asked, ("margin", "ratio")) & has(metric, NUMERATORS), "numerator")
        .when(F.contains(metric, F.lit("total")), "total").when(F.col("fact_role").isin("numerator", "denominator", "total"), F.col("fact_role")).otherwise("component")
    )
    reason = F.coalesce(artifact, F.when(F.col("quote").isNull(), "exact_quote_recovery_failed").when(p != "reporting_period", F.concat(F.lit("period_role_not_reporting_period:"), p)).when(mismatch, "unit_metric_mismatch_after_repair"))
    return j.select(*facts.columns, "quote", "period_role", "repaired_unit", role.alias("role"), reason.alias("reject_reason"))


# leakage, provenance, failures


def leaks(contracts: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, leaked_slots, derived_as_source, ok): target values that the visible contract shows, and facts that are derived but count as sources.

    contracts: (case_id, visible: text, slots: array<struct<name, expected: text>>); facts: (case_id, derived, source).
    """
    shown = F.filter("slots", lambda s: (s["expected"] != "") & F.contains(F.coalesce("visible", F.lit("")), s["expected"]))
    c = contracts.select("case_id", F.transform(F.coalesce(shown, F.array().cast(contracts.schema["slots"].dataType)), lambda s: s["name"]).alias("leaked_slots"))
    d = facts.groupBy("case_id").agg(F.count_if(F.col("derived") & F.col("source")).alias("n"))
    out = c.join(d, "case_id", "left").select("case_id", "leaked_slots", (F.coalesce("n", F.lit(0)) > 0).alias("derived_as_source"))
    return out.withColumn("ok", (F.size("leaked_slots") == 0) & ~F.col("derived_as_source"))


def provenance(method: Column) -> Column:
    """struct of what is known of an arm by its name: classification, scope, granularity, verdict, whether the name is honest, and the label it should have."""
    kind = lambda c, scope, grain, verdict, honest, label: F.struct(F.lit(c).alias("classification"), F.lit(scope).alias("corpus_scope"), F.lit(grain).alias("granularity"), F.lit(verdict).alias("verdict"), F.lit(honest).alias("naming_honest"), label.alias("label"))
    text_only = F.replace(method, F.lit("vector_only"), F.lit("case_text_only"))
    per_case = lambda verdict: kind("per_case_evidence_only", "per_case", "none", verdict, False, text_only)
    return (
        F.when(method == "vector_only_scaled", kind("gold_context_no_retrieval", "gold_only", "none", "needs_reclassification", False, F.lit("gold_text_only")))
        .when(method.isin("vector_single_v14", "vector_multi_by_company_v14"), kind("real_retrieval_full_corpus", "full_corpus", "document_level", "ok_but_weak_retriever", True, F.concat(method, F.lit(" (keep; document-level in-memory baseline)"))))
        .when(method.rlike("^vector_only_v.*(8|9|10)$") | (method == "vector_only_v7"), per_case("mislabeled"))
        .when(method.rlike("^(vector_only_v|hybrid_vector_graph)"), per_case("mislabeled_or_legacy_prompt_arm"))
        .otherwise(kind("unknown", "unknown", "unknown", "blocker_unknown", False, F.lit("unknown")))
    )


def failure_type(ac: Column, contains_match: Column, both_found: Column, contains_number: Column, failure_reason: Column, answer: Column) -> Column:
    """Why an answer failed, the first that holds; what isn't known counts as not so."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    said = yes(answer != "")
    return (
        F.when(yes(ac == 1), "none").when(~yes(contains_match) | ~yes(both_found), "retrieval_miss").when(yes(failure_reason == "answer_format_error"), "answer_format_error")
        .when(said, "retrieved_but_reasoning_error").when(said & ~yes(contains_number), "possible_hallucination").otherwise("scorer_uncertain")
    )


def triage(facts: DataFrame) -> DataFrame:
    """facts with classes (all that hold, in order), primary, patch_type and risk.

    facts: (coverage_status, observations, company_sensitive, metric_sensitive, value_sensitive, unit, year, period_label,
    exact_quote, company, ticker); what is null isn't so, and no number of observations means none.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    company = F.coalesce(F.col("coverage_status") == "needs_company_ticker_review", F.lit(False)) | yes("company_sensitive")
    rules = (
        ("KGEntity_mapping_issue", company), ("case_id_source_id_mismatch", company), ("missing_observation", F.coalesce("observations", F.lit(0)) == 0), ("metric_alias_mismatch", yes("metric_sensitive")),
        ("value_mismatch", yes("value_sensitive")), ("unit_mismatch", none("unit")), ("year_or_period_mismatch", none("year") & none("period_label")), ("evidence_quote_mismatch", ~yes("exact_quote")),
    )
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    d = facts.withColumn("classes", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unresolved_manual_review"))))
    has_ = lambda n: F.array_contains(F.col("classes"), n)
    patch = (
        F.when(has_("KGEntity_mapping_issue"), "manual_approve_link_company_case_and_observation_kgentity").when(has_("missing_observation"), "manual_approve_create_financial_observation_kgentity")
        .otherwise("manual_approve_normalize_existing_observation_properties")
    )
    mild = F.array(*map(F.lit, ("KGEntity_mapping_issue", "case_id_source_id_mismatch", "metric_alias_mismatch", "value_mismatch")))
    risk = F.when(has_("evidence_quote_mismatch") | none("company") | none("ticker"), "high").when(yes("exact_quote") & (F.size(F.array_except("classes", mild)) == 0), "medium").otherwise("medium_high")
    return d.select("*", F.col("classes")[0].alias("primary"), patch.alias("patch_type"), risk.alias("risk"))


# Warnings that keep a row out of clean claims.
EXCLUDING = ("ambiguous_formula", "missing_prior_period", "final_answer_calculation_mismatch")


def case_flags(rows: DataFrame) -> DataFrame:
    """(case_id, methods_flagged, warnings, excluded) of rows (case_id, method, warnings: array): sorted names, and whether any warning excludes."""
    w = F.coalesce("warnings", F.array().cast("array<string>"))
    r = rows.select("case_id", "method", w.alias("w")).withColumn("bad", F.arrays_overlap("w", F.array(*map(F.lit, EXCLUDING))))
    each = r.select("case_id", "method", F.explode_outer("w").alias("w"), "bad")
    return each.groupBy("case_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("w").isNotNull(), F.col("method")))).alias("methods_flagged"), F.array_sort(F.collect_set("w")).alias("warnings"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("excluded")
    )


def clean_means(rows: DataFrame, methods: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """(method, clean, each measure's mean) over rows without an excluding warning, a row for each of the methods; 0 where none is left."""
    keep = ~F.arrays_overlap(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*map(F.lit, EXCLUDING)))
    all_ = rows.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    g = rows.where(keep).groupBy("method").agg(F.count("*").alias("clean"), *[average(F.col(m)).alias(m) for m in measures])
    return F.broadcast(all_).join(g, "method", "left").select("method", F.coalesce("clean", F.lit(0)).alias("clean"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures])  # a row for each method


# gates over runs


def average(c: Column) -> Column:
    """Mean without nulls to four places, half away from zero, of values to six: exact sums, so that neither order nor engine decides a tie. 0 where there is none."""
    n = F.count(c).cast("decimal(20,0)")
    total = F.sum(F.round(c.cast("double") * 1000000).cast("decimal(28,0)"))
    top = F.abs(total) * 2 + n * 100
    whole = ((top - top % (n * 200)) / (n * 200)).cast("double")
    return F.when(F.count(c) > 0, F.signum(total).cast("double") * whole / 10000).otherwise(F.lit(0.0))


def method_summary(rows: DataFrame, *by: str) -> DataFrame:
    """(n, ac, nc, both_found, fact_recall, tokens) of each method, or of whatever ``by`` names."""
    return rows.groupBy(*(by or ("method",))).agg(F.count("*").alias("n"), *[average(F.col(c).cast("double")).alias(c) for c in ("ac", "nc", "both_found", "fact_recall", "tokens")])


def hypotheses(rows: DataFrame, graph: str, guided: str, single: str, multi: str) -> DataFrame:
    """One row: whether the graph beats one retrieval, is no worse than retrieval by company, guided text is no worse than the graph, the graph finds both companies more often, and how often a failed single retrieval lacked one."""
    s = rows.agg(*[average(F.when(F.col("method") == m, F.col(c).cast("double"))).alias(f"{k}_{c}") for k, m in (("g", graph), ("t", guided), ("s", single), ("m", multi)) for c in ("ac", "both_found")],
        average(F.when((F.col("method") == single) & (F.col("ac") == 0), (~F.coalesce(F.col("both_found"), F.lit(False))).cast("double"))).alias("h5"))
    return s.select(
        (F.col("g_ac") > F.col("s_ac")).alias("h1_graph_gt_single"), (F.col("g_ac") >= F.col("m_ac") - 0.0001).alias("h2_graph_ge_multi"), (F.col("t_ac") >= F.col("g_ac") - 0.0001).alias("h3_guided_ge_graph"),
        (F.col("g_both_found") > F.col("s_both_found")).alias("h4_graph_coverage_gt_single"), F.col("h5").alias("h5_single_failures_missing_a_company"),
    )


def smoke_gate(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """One row of figures and ``passes``: placeholders, share mapped, years per case, values that are years, quotes verified, agreement of repeated cells.

    rows: (case_id, raw_count), one for each case; observations: (case_id, ticker, metric, year, value, verified, place).
    Repeated cells agree if all values are within max(1 %, 0.1) of the first by place.
    """
    o = observations
    years = o.select("case_id", "year").distinct().groupBy("case_id").agg(F.count("*").alias("years"))
    r = rows.join(years, "case_id", "left").agg(F.count("*").alias("cases"), F.coalesce(F.sum("raw_count"), F.lit(0)).alias("raw"), average(F.coalesce("years", F.lit(0)).cast("double")).alias("years_per_case"))
    f = o.agg(F.count("*").alias("observations"), F.count_if(F.coalesce(F.col("metric").startswith("source_value"), F.lit(False))).alias("placeholders"), F.count_if(F.coalesce(text.value_is_year(F.col("value")), F.lit(False))).alias("value_as_year"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"))
    cell = o.groupBy("ticker", "metric", "year").agg(F.count("*").alias("n"), F.min_by("value", "place").alias("base"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 1")
    near = lambda v: F.abs(v - F.col("base")) <= F.greatest(F.abs("base") * 0.01, F.lit(0.1))
    d = cell.agg(F.count("*").alias("checked"), F.count_if(near(F.col("lo")) & near(F.col("hi"))).alias("agree"))
    share = lambda a, b, none: F.when(F.col(b) > 0, rounded(F.col(a) / F.col(b))).otherwise(F.lit(none))
    one = r.crossJoin(f).crossJoin(d)  # one row each
    one = one.select("cases", "observations", F.col("raw").alias("raw_count"), "placeholders", share("observations", "raw", 0.0).alias("mapped_ratio"), "years_per_case", "value_as_year", share("verified", "observations", 0.0).alias("verified_ratio"), share("agree", "checked", 1.0).alias("duplicate_consistency"))
    passes = (F.col("placeholders") == 0) & (F.col("mapped_ratio") >= 0.7) & (F.col("years_per_case") >= 2) & (F.col("value_as_year") <= 1) & (F.col("verified_ratio") >= 0.9) & (F.col("duplicate_consistency") >= 0.95)
    return one.withColumn("passes", passes)


def input_audit(rows: DataFrame, manifest: DataFrame, used: DataFrame, first_slice: str, least: int = 100) -> DataFrame:
    """(kind, name, n): counts of the input, and of each slice its ids and those never used; the last row is the gate, 1 if it is passed.

    rows: (id, evidence, answer); manifest: (slice, id); used: (id). The gate: no id twice, none of the manifest missing,
    and ``least`` fresh ids in the first slice.
    """
    blank = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "")
    ids = rows.groupBy("id").agg(F.count("*").alias("n"), blank("evidence").alias("e"), blank("answer").alias("a"))
    c = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_ids"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicate_ids"), F.coalesce(F.sum("e"), F.lit(0)).alias("missing_evidence"), F.coalesce(F.sum("a"), F.lit(0)).alias("missing_answer"))
    names = ("rows", "unique_ids", "duplicate_ids", "missing_evidence", "missing_answer")
    counts = c.select(F.explode(F.array(*[F.struct(F.lit("input").alias("kind"), F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("x.*")
    m = manifest.select("id").distinct().join(ids.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("input").alias("kind"), F.lit("manifest_ids_missing").alias("name"), "n")
    s = manifest.join(used.select("id").distinct().withColumn("u", F.lit(True)), "id", "left").groupBy("slice").agg(F.count("*").alias("total"), F.count_if(F.col("u").isNull()).alias("fresh"))
    slices = s.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.col("slice").alias("name"), F.col("total").alias("n")), F.struct(F.lit("fresh").alias("kind"), F.col("slice").alias("name"), F.col("fresh").alias("n")))).alias("x")).select("x.*")
    out = counts.unionByName(m).unionByName(slices)
    of = lambda kind, name: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("n"))), F.lit(0))
    gate = (of("input", "duplicate_ids") == 0) & (of("input", "manifest_ids_missing") == 0) & (of("fresh", first_slice) >= least)
    return out.unionByName(out.agg(gate.cast("long").alias("n")).select(F.lit("gate").alias("kind"), F.lit("passes").alias("name"), "n"))
