"""Tickers allowed, issues of cases and facts, facts split by dictionary, graphs of clean cases, dictionary reports, facts covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text

# What is no company or ticker, words of questions and of headers, and roles a fact may have.
NO_COMPANY = ("", "unknown", "employees", "employee", "na", "n/a", "long-term debt", "values", "principles", "governance", "values/principles/governance")
NO_TICKER = ("", "NA", "N/A", "LT", "FY", "US", "UK", "SEC", "EPS", "USD", "GAAP")
SECTIONS = ("long-term debt", "values", "principles", "governance", "employees", "risk factors", "results of operations")
QUESTION_WORDS = (
    "impact", "impacts", "comparison", "ratio", "ratios", "growth", "margin", "distribution", "breakdown", "strategy", "strategies", "analysis", "analyzing", "trends", "effects", "effect",
    "revenue", "headcount", "workforce", "employee", "employees", "cost", "costs", "sales force", "succession", "union", "retirement", "maturity", "litigation", "capital allocation",
)
HEADERS = (
    "birth years between", "in millions except", "in millions, except", "at_the_end_of", "at the end of", "year ended", "years ended", "number of employees", "consolidated statements",
    "statement of operations", "table of contents",
)
ROLES = ("numerator", "denominator", "base_year_value", "current_year_value", "component", "total", "explanatory_context")
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "were", "was", "are", "into", "total", "year", "years", "million", "millions", "calculated", "approximately", "using", "based",
)
WORD = r"[A-Za-z][A-Za-z0-9&'-]{2,}"
ANY_NUMBER = r"\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?"
OTHER_DATE = r"\b(?:born|birth|birth years?|ages?|maturity|expires?|expiration)\b[^.\n]{0,80}\b"
PERCENT_RANGE = r"\d+(?:\.\d+)?\s*%\s*(?:-|to|through)\s*\d+(?:\.\d+)?\s*%"
NAME = r"^[a-z][a-z0-9_]{3,}$"
NO_NAMES = ("source_value", "program_operand", "operand", "value", "amount", "number")


def or_empty(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes whose rule holds, each once, by name; a null rule doesn't hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))))


def allowed_tickers(df: DataFrame, ticker: str, deny: tuple[str, ...], allow: DataFrame | None = None) -> DataFrame:
    """df with ``ticker`` normalised; rows whose ticker is none, denied, or not in the list ``allow``, where there is one, go.

    The list is a column of any size that may repeat its tickers and hold nulls; it is normalised too.
    """
    ok = df.withColumn(ticker, text.valid_ticker(F.col(ticker), deny)).where(F.col(ticker).isNotNull())
    if allow is None:
        return ok
    return ok.join(allow.select(text.valid_ticker(F.col(allow.columns[0]), ()).alias(ticker)), ticker, "left_semi")


def company_issues(cases: DataFrame) -> DataFrame:
    """Cases (company, ticker, question, ...) with anything that speaks against their company or ticker, and all ``issues``."""
    company = text.strip(or_empty("company"))
    low, ticker = F.lower(company), text.strip(or_empty("ticker"))
    rules = [
        ("bad_company_exact_or_unknown", low.isin(*NO_COMPANY)),
        ("company_looks_like_section_heading", has_any(low, SECTIONS)),
        ("company_looks_like_question_phrase", (F.length(company) > 45) | has_any(low, QUESTION_WORDS)),
        ("company_prefix_matches_question_phrase", (company != "") & F.startswith(F.lower(or_empty("question")), F.left(low, F.lit(25)))),
        ("bad_or_missing_ticker", F.upper(ticker).isin(*NO_TICKER)),
    ]
    return cases.withColumn("issues", codes(rules)).where(F.size("issues") > 0)


def words(c: Column) -> Column:
    """Distinct words of three letters or more, in lower case, without common ones."""
    found = F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def answer_numbers(c: Column) -> Column:
    """The numbers of an answer to four places; parentheses around one negate it."""

    def read(t: Column) -> Column:
        v = F.regexp_replace(F.btrim(t, F.lit("()")), "[$,%]", "").try_cast("double")
        return F.round(F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v), 4)

    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(ANY_NUMBER), F.lit(0)), read), lambda v: v.isNotNull())


def fact_issues(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """Facts with all codes that speak against them (``issues``), and those that point to the parser (``artifacts``).

    facts: case_id, metric_raw, metric, year, value, unit, quote, role, derived, source; cases: case_id, question,
    expected_answer, evidence. Nulls count as empty texts, as no year, no value and false. Facts of no case go.
    """
    q, a = or_empty("question"), or_empty("expected_answer")
    c = cases.select("case_id", F.concat(q, F.lit(" "), a).alias("_qa"), or_empty("evidence").alias("_e"), words(F.concat(q, F.lit(" "), a)).alias("_w"), answer_numbers(a).alias("_n"))  # read once a case
    f = facts.join(c, "case_id")
    quote, unit, raw = or_empty("quote"), or_empty("unit"), text.strip(or_empty("metric_raw"))
    names = F.lower(F.concat(raw, F.lit(" "), text.strip(or_empty("metric"))))
    year = F.col("year").cast("string")
    wanted = F.arrays_overlap("_w", words(raw)) | F.coalesce(F.contains("_qa", year), F.lit(False))
    wanted = wanted | F.coalesce(F.array_contains("_n", F.round("value", 4)), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    header, per_share = has_any(names, HEADERS), (unit == "USD_per_share") & has_any(names, ("revenue", "premium", "sales"))
    old = yes(F.col("year") < 2000)
    dated = yes(F.contains("_e", year)) & yes(F.rlike("_e", F.concat(F.lit("(?i)" + OTHER_DATE), year, F.lit(r"\b"))))
    spread = yes(F.col("value") < 0) & F.rlike("_e", F.lit("(?i)" + PERCENT_RANGE))
    issues = [
        ("missing_evidence_quote", quote == ""),
        ("evidence_quote_is_synthetic_not_exact_excerpt", (quote != "") & ~F.contains("_e", quote)),
        ("fact_not_clearly_needed_for_expected_answer", ~wanted),
        ("metric_looks_like_header_or_section_phrase", header),
        ("unit_conflicts_with_metric", per_share),
        ("year_is_before_2000_reporting_period", old),
        ("year_looks_like_birth_maturity_or_expiration_date", dated),
        ("negative_value_may_be_percentage_range_artifact", spread),
        ("derived_answer_value_marked_as_source_fact", yes(F.col("derived")) & yes(F.col("source"))),
        ("unclear_fact_role", ~or_empty("role").isin(*ROLES)),
        ("unit_too_generic_for_eval_ready_fact", unit == "numeric"),
    ]
    artifacts = [
        ("metric_header_phrase", header), ("usd_per_share_revenue_conflict", per_share), ("pre_2000_reporting_period", old), ("non_reporting_year_used_as_period", dated),
        ("negative_percentage_range_artifact", spread),
    ]
    return f.withColumn("issues", codes(issues)).withColumn("artifacts", codes(artifacts)).where(F.size("issues") > 0).drop("_qa", "_e", "_w", "_n")


def formula_types(df: DataFrame, question: str, evidence: str, most: int = 600) -> DataFrame:
    """df with the ``formula_type`` of each question and the first ``most`` characters of its evidence, by keywords; nulls are empty."""
    q = F.lower(F.concat(or_empty(question), F.lit(" "), F.left(or_empty(evidence), F.lit(most))))
    both = df.withColumn("q", q).withColumn("n_years", F.size(text.years_in(F.col("q"))))
    return both.withColumn("formula_type", F.expr(text.FORMULA_SQL)).drop("q", "n_years")


def split_by_dictionary(checked: DataFrame) -> DataFrame:
    """Rows of first_reason() that are valid, or artifacts whose name maps all the same, with ``metric`` and ``mapped``.

    A cost of products or services that isn't a total is no cost of sales and stays unmapped. Mapped rows of a case
    that agree in ticker, metric, year and value (to six places) count once: the first valid one by ``i``, then the
    first that was recovered. Unmapped rows all stay.
    """
    o = metrics.canonical(checked.withColumnRenamed("slug", "_slug"), out="_metric")
    valid, low = F.col("reason").isNull(), F.lower(or_empty("quote"))
    ok = F.col("year").between(2000, 2030) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    ok = ok & F.col("unit").isin(*text.UNITS) & (text.strip(or_empty("quote")) != "")
    recovered = F.coalesce((F.col("reason") == "metric_artifact") & F.col("_metric").isNotNull() & ok, F.lit(False))
    shown = F.replace(F.when(valid, F.col("_slug")).otherwise(F.col("_metric")), F.lit("_"), F.lit(" "))
    part = ~F.contains(low, F.lit("total")) & (has_any(low, ("cost of products", "cost of services")) | has_any(shown, ("cost of product", "cost of service")))
    o = o.where(valid | recovered).withColumn("recovered", ~valid)
    kept = F.when(F.col("_metric").rlike(NAME) & ~((F.col("_metric") == "cost_of_sales") & part), F.col("_metric"))
    o = o.withColumn("metric", kept).withColumn("mapped", F.col("metric").isNotNull())
    once = Window.partitionBy("case_id", "ticker", "metric", "year", F.round("value", 6), F.when(~F.col("mapped"), F.col("i"))).orderBy("recovered", "i")
    return o.withColumn("_place", F.row_number().over(once)).where("_place = 1").drop("_place", "_slug", "_metric")


def fact_problems(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, fact_id, reason): everything that keeps a fact's case out of the graph, a row for each reason.

    facts: case_id, fact_id, exact, quote, derived, review, company, ticker; cases: case_id, evidence. Nulls count as
    false and empty.
    """
    f = facts.join(cases.select("case_id", or_empty("evidence").alias("_e")), "case_id")
    yes = lambda c: F.coalesce(c, F.lit(False))
    quote = or_empty("quote")
    rules = [
        ("quote flag false", ~yes(F.col("exact"))), ("quote not substring", (quote == "") | ~F.contains("_e", quote)), ("derived answer value", yes(F.col("derived"))),
        ("manual review", yes(F.col("review"))), ("missing company/ticker", (or_empty("company") == "") | (or_empty("ticker") == "")),
    ]
    return f.select("case_id", "fact_id", F.explode(codes(rules)).alias("reason"))


def case_graph(facts: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, name) and edges (src, dst, type) of the facts whose case has no problem.

    An observation is a fact; of a node that several facts name, the last fact's name stays (by fact_id).
    """
    f = facts.join(problems.select("case_id").distinct(), "case_id", "left_anti")
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    ids = {k: F.concat(F.lit(f"{k}::"), or_empty(c)) for k, c in (("company", F.col("ticker")), ("metric", F.col("metric")), ("year", year), ("obs", F.col("fact_id")))}
    node = lambda k, label, name: F.struct(ids[k].alias("id"), F.lit(label).alias("label"), or_empty(name).alias("name"))
    nodes = [node("company", "Company", F.col("company")), node("metric", "Metric", F.col("metric_raw")), node("year", "Year", year), node("obs", "Observation", F.col("quote"))]
    edge = lambda a, b, t: F.struct(ids[a].alias("src"), ids[b].alias("dst"), F.lit(t).alias("type"))
    edges = [edge("company", "obs", "HAS_OBSERVATION"), edge("obs", "metric", "OBSERVES_METRIC"), edge("obs", "year", "OBSERVED_IN_YEAR")]
    n = f.select("fact_id", F.explode(F.array(*nodes)).alias("n")).select("fact_id", "n.*")
    n = n.groupBy("id", "label").agg(F.max(F.struct("fact_id", "name"))["name"].alias("name"))
    return n, f.select(F.explode(F.array(*edges)).alias("e")).select("e.*").distinct()


def dictionary_report(entries: DataFrame) -> DataFrame:
    """(check, item, n): what is wrong with a dictionary of entries (canonical_name, label, definition, aliases).

    Malformed and placeholder names, names and labels that several entries have, entries without label or definition,
    and aliases (names and labels included, as slugs) that lead to more than one name. A clean dictionary gives no rows.
    """
    e = entries.select(or_empty("canonical_name").alias("name"), or_empty("label").alias("label"), or_empty("definition").alias("definition"), "aliases")
    found = lambda check, item, df: df.groupBy(item.alias("item")).agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "item", "n")
    bad = found("malformed_name", F.col("name"), e.where(~F.col("name").rlike(NAME) | F.col("name").isin(*NO_NAMES)))
    names = found("duplicate_name", F.col("name"), e).where("n > 1")
    labels = found("duplicate_label", F.col("label"), e).where("n > 1")
    missing = found("missing_label_or_definition", F.col("name"), e.where("label = '' or definition = ''"))
    every = F.concat(F.array("name", "label"), F.coalesce("aliases", F.array().cast("array<string>")))
    alias = e.select("name", F.explode(every).alias("a")).select("name", metrics.slug(F.col("a")).alias("item")).where("item <> ''").distinct()
    clash = found("alias_of_several", F.col("item"), alias).where("n > 1")
    return bad.unionByName(names).unionByName(labels).unionByName(missing).unionByName(clash)


def token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9.%-]+", "_"), F.lit("_"))


def case_keys(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, case_key): the source of the case's first fact that has one, else what follows the last underscore of its id, else the id."""
    source = text.strip(or_empty("source_id"))
    first = facts.where(source != "").groupBy("case_id").agg(F.min_by(source, "fact_id").alias("_s"))
    tail = F.element_at(F.split("case_id", "_"), -1)
    return cases.select("case_id").distinct().join(first, "case_id", "left").select("case_id", F.coalesce("_s", F.nullif(tail, F.lit("")), "case_id").alias("case_key"))


def fact_matches(facts: DataFrame, keys: DataFrame, observed: DataFrame) -> DataFrame:
    """facts with ``matches``: how many observations of the case's key agree in metric, year, unit and value.

    facts: case_id, fact_id, metric, metric_raw, year, unit, value; observed: case_key, metric, year, unit, value. What a
    fact doesn't state, agrees. A metric or unit agrees if the observation's holds it; a year likewise; a value within
    the larger of 0.01 and a ten thousandth, whatever its sign. The year is an exact key where it is stated, so a case
    is spread by its years; observations are counted before they meet the facts. Equal rows of a fact become one, with
    the matches of all.
    """
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    o = observed.select("case_key", F.lower(or_empty("metric")).alias("_m"), F.col("year").alias("_y"), F.lower(or_empty("unit")).alias("_u"), F.abs("value").alias("_v"))
    o = o.groupBy("case_key", "_m", "_y", "_u", "_v").agg(F.count("*").alias("_n"))
    f = facts.join(keys, "case_id").withColumn("_metric", F.coalesce(F.nullif(token(F.col("metric")), F.lit("")), token(F.col("metric_raw"))))
    f = f.withColumn("_raw", token(F.col("metric_raw"))).withColumn("_unit", token(F.col("unit")))
    within = F.greatest(F.lit(0.01), F.abs("value") * 0.0001)
    same = (F.col("_metric") == "") | F.contains("_m", F.col("_metric")) | F.contains("_m", F.col("_raw")) | F.contains(spaced(F.col("_m")), spaced(F.col("_metric")))
    unit = (F.col("_unit") == "") | F.contains(spaced(F.col("_u")), spaced(F.col("_unit")))
    value = F.col("value").isNull() | F.coalesce(F.abs(F.col("_v") - F.abs("value")) <= within, F.lit(False))
    agree = F.coalesce(same & unit & value, F.lit(False))
    dated = f.where("year is not null").join(o.withColumnRenamed("_y", "year"), ["case_key", "year"], "left")
    undated = f.where("year is null").join(o.drop("_y"), "case_key", "left").select(dated.columns)
    n = F.coalesce(F.sum(F.when(agree, F.col("_n"))), F.lit(0)).alias("matches")
    return dated.unionByName(undated).groupBy(*facts.columns, "case_key").agg(n)


def case_status(cases: DataFrame, matched: DataFrame) -> DataFrame:
    """(case_id, required, matched, status) of every case: ready, or what to look at first in the facts that are missing."""
    open_ = F.col("matches") == 0
    any_ = lambda c: F.coalesce(F.bool_or(open_ & c), F.lit(False))
    named = (or_empty("metric") != "") | (or_empty("metric_raw") != "")
    s = matched.groupBy("case_id").agg(
        F.count("*").alias("required"), F.count_if(~open_).alias("matched"), any_(or_empty("ticker") != "").alias("t"), any_(named).alias("m"), any_(F.col("value").isNotNull()).alias("v")
    )
    s = cases.select("case_id").distinct().join(s, "case_id", "left")
    required, done = F.coalesce("required", F.lit(0)), F.coalesce("matched", F.lit(0))
    status = (
        F.when(required == 0, "needs_human_review").when(required == done, "ready_for_eval").when(F.col("t"), "needs_company_ticker_review")
        .when(F.col("m"), "needs_metric_normalization").when(F.col("v"), "needs_value_patch").otherwise("needs_human_review")
    )
    return s.select("case_id", required.alias("required"), done.alias("matched"), status.alias("status"))
