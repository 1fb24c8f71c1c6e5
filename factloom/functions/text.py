"""Numbers, years, tickers, units and formula types in free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NUMBER = r"\(?\$?\s*-?\d[\d,]*(?:\.\d+)?\)?\s*%?"
PLAIN_NUMBER = r"\d[\d,]*(?:\.\d+)?"
YEAR = r"\b(19[89]\d|20[0-3]\d)\b"
BONUS = r"(?i)\b(margin|ratio|percent|percentage|growth|change|increase|decrease|divided|per share)\b"
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Words that hold ids, and numbers with their scale word or percent sign.
ID_WORD = r"(?i)\b(?:round3|baseline|control|dev|test|fact|trace|case|source|evidence|prompt|sha|id)[-_A-Za-z0-9]*\b"
SCALED_NUMBER = r"-?\(?\$?\d[\d,]*(?:\.\d+)?\)?\s*(?:%|percent|percentage|million|millions|billion|billions|thousand|thousands)?"
SCALES = (("billion", 1e9), ("million", 1e6), ("thousand", 1e3))
UNITS = ("currency_millions", "currency_billions", "count", "percentage", "ratio", "currency_per_share")
ARTIFACTS = ("at_the_", "during_the_", "_of_", "march_", "june_", "december_", "generation_x", "birth_year")
JUNK = r"^at_the_|^during_|^in_the_|^for_the_|^as_of_|^march_|^june_|^december_|^january_|^generation_x|birth_year|expiration|^the_|^and_|^or_|^of_the_"
# Keyword rules of a question's formula type over its lower-case text q; the first that holds decides.
FORMULA_SQL = """CASE WHEN contains(q, 'gross margin') THEN 'gross_margin' WHEN contains(q, 'operating margin') THEN 'operating_margin'
  WHEN contains(q, 'net margin') THEN 'net_margin' WHEN contains(q, 'tax rate') OR contains(q, 'effective tax') THEN 'effective_tax_rate'
  WHEN contains(q, 'revenue') AND (contains(q, 'change') OR contains(q, 'growth') OR contains(q, 'increase') OR contains(q, 'decrease') OR contains(q, 'year-over-year') OR contains(q, 'yoy')) THEN 'yoy_revenue_change'
  WHEN contains(q, 'segment') OR contains(q, 'business unit') THEN 'segment_comparison'
  WHEN contains(q, 'eps') OR contains(q, 'earnings per share') THEN 'eps_dilution'
  WHEN contains(q, 'debt') OR contains(q, 'interest coverage') OR contains(q, 'leverage') THEN 'debt_metrics'
  WHEN contains(q, 'capital expenditure') OR contains(q, 'capex') THEN 'capex_intensity'
  WHEN (contains(q, 'ratio') OR contains(q, 'margin')) AND contains(q, 'margin') AND n_years >= 2 THEN 'multi_year_margin'
  WHEN contains(q, 'ratio') OR contains(q, 'margin') THEN 'ratio_trend'
  WHEN contains(q, 'income') AND contains(q, 'operating') THEN 'income_vs_ops' ELSE 'other' END"""


def strip(c: Column) -> Column:
    """c without white space of any kind around it."""
    return F.trim(c, F.lit(WHITE))


def number_of(token: Column) -> Column:
    """The double of one token: parentheses around all of it negate, ``$ , %`` go; null where that is no number."""
    t = F.trim(token)
    minus = t.startswith("(") & t.endswith(")")
    bare = F.when(minus, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    value = F.trim(F.regexp_replace(bare, r"[$,%]", "")).try_cast("double")
    return F.when(minus, -F.abs(value)).otherwise(value)


def parse_number(text: Column) -> Column:
    """The first money or percent number in a text."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), NUMBER, 0)
    return F.when(found != "", number_of(found))


def parse_scaled(text: Column) -> Column:
    """struct(value, scaled, is_percent, ratio): the first number, times its scale word, and as a ratio if a percentage."""
    value, low = parse_number(text), F.lower(text)
    factor = F.lit(1.0)
    for word, by in reversed(SCALES):
        factor = F.when(F.contains(low, F.lit(word)), F.lit(by)).otherwise(factor)
    percent = F.contains(text, F.lit("%")) | F.contains(low, F.lit("percent"))
    return F.struct(value.alias("value"), (value * factor).alias("scaled"), percent.alias("is_percent"), F.when(percent, value / 100).otherwise(value).alias("ratio"))


def numbers_in(text: Column) -> Column:
    """Distinct numbers in a text in first-seen order, without bare years; a percentage counts also as its hundredth."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLAIN_NUMBER + "%?"), F.lit(0))
    found = F.filter(found, lambda t: ~t.rlike(r"^20\d\d$"))
    value = lambda t: F.regexp_replace(t, "[,%]", "").try_cast("double")
    both = F.transform(found, lambda t: F.when(t.endswith("%"), F.array(value(t), value(t) / 100)).otherwise(F.array(value(t))))
    return F.array_distinct(F.transform(F.flatten(both), lambda v: F.round(v, 8)))


def signed_numbers(text: Column) -> Column:
    """Distinct numbers in a text in first-seen order, years and signs included.

    Parentheses around one negate it; a percentage counts also as its hundredth.
    """

    def values(token: Column) -> Column:
        t = strip(token)
        v = F.replace(F.trim(t, F.lit("()%$ ")), F.lit(","), F.lit("")).try_cast("double")
        v = F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v)
        return F.when(t.endswith("%"), F.array(v, v / 100)).otherwise(F.array(v))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.flatten(F.transform(found, values)), lambda v: v.isNotNull()), lambda v: F.round(v, 8)))


def scaled_numbers(text: Column) -> Column:
    """array of (value, scaled, percent): the numbers of a text in order, in the text's own unit and times their scale word.

    Words that hold ids don't count, nor do digits right after a letter or underscore, nor bare years of this century.
    Parentheses around all of a number negate it. What is no number in spite of its looks is left out.
    """

    def signed(t: Column) -> Column:
        bare = F.regexp_replace(F.btrim(t, F.lit("()")), r"[$,%]|percent|millions?|billions?|thousands?", "")
        return F.struct(t.alias("t"), (F.trim(bare).try_cast("double") * F.when(t.startswith("(") & t.endswith(")"), -1).otherwise(1)).alias("v"))

    def read(x: Column) -> Column:
        t, v = x["t"], x["v"]
        factor = F.lit(1.0)
        for word, by in reversed(SCALES):
            factor = F.when(F.contains(t, F.lit(word)), F.lit(by)).otherwise(factor)
        percent = F.contains(t, F.lit("%")) | F.contains(t, F.lit("percent"))
        return F.struct(v.alias("value"), (v * factor).alias("scaled"), percent.alias("percent"))

    without_ids = F.regexp_replace(F.coalesce(text, F.lit("")), ID_WORD, " ")
    found = F.regexp_extract_all(without_ids, F.lit(r"(?i)(?<![A-Za-z_])" + SCALED_NUMBER), F.lit(0))
    plain = F.transform(F.filter(found, lambda t: ~F.trim(t).rlike(r"^20\d\d$")), lambda t: F.lower(F.trim(t)))
    # one step after the other, so that each token is read once
    return F.filter(F.transform(F.transform(plain, signed), read), lambda n: n["value"].isNotNull())


def values_of(numbers: Column) -> Column:
    """Values and scaled values of scaled_numbers(), each once, in order."""
    return F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.array(n["value"], n["scaled"]))))


def isclose(a: Column, b: Column, rel: float, abs_: float) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def same_number(expected: Column, actual: Column, unit: Column) -> Column:
    """Whether two of scaled_numbers() agree in a unit: percentages by 0.1 points or as ratios, small ratios and amounts by a hundredth, others by half a percent."""
    e, a = expected, actual
    as_unit = unit == "percentage"
    points = lambda n, sure: F.when(sure | n["percent"] | (F.abs(n["value"]) > 1), n["value"]).otherwise(n["value"] * 100)
    ratio = lambda n: F.when(n["percent"], n["value"] / 100).otherwise(n["value"])
    percent = isclose(points(e, as_unit), points(a, F.lit(False)), 1e-9, 0.1) | isclose(ratio(e), ratio(a), 0.01, 0.0015)
    small = unit.isin("ratio, amount", "ratio", "amount") & (F.abs(e["value"]) < 100) & (F.abs(a["value"]) < 100)
    other = isclose(e["scaled"], a["scaled"], 0.005, 0.01) | isclose(e["value"], a["value"], 0.005, 0.01)
    return F.when(as_unit | e["percent"] | a["percent"], percent).when(small, isclose(e["value"], a["value"], 0.01, 0.01)).otherwise(other)


def years_in(text: Column) -> Column:
    """Distinct years in a text, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def value_is_year(v: Column) -> Column:
    return (v == F.floor(v)) & v.between(2015, 2030)


def ticker_in(question: Column) -> Column:
    """In parentheses; at the end after a comma; after "for"; before FY and a year; else C and five digits of a hash."""
    tries = (r"\(([A-Z]{1,5})\)", r",\s*([A-Z]{1,5})\.?\s*$", r"\bfor\s+([A-Z]{1,5})\b", r"\b([A-Z]{1,5})\s+FY\d{2,4}\b", r"\b([A-Z]{1,5})\s+\d{4}\b")
    found = [F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in tries]
    return F.coalesce(*found, F.concat(F.lit("C"), F.upper(F.substring(F.sha2(question.cast("binary"), 256), 1, 5))))


# Capital words of financial questions that are no tickers.
NO_TICKERS = ("FY", "US", "EPS", "GAAP", "CEO", "CFO", "Q", "YOY", "ROE", "ROA", "CAPEX", "EBIT", "R", "D", "AND", "THE", "A", "I", "IT", "OF", "IN")


def ticker_of(question: Column, deny: tuple[str, ...] = NO_TICKERS) -> Column:
    """The ticker a question names: in parentheses; at its end, after "for", before a fiscal or plain year, or before a measure; the only capital word; the first five letters of its first name; else C and five digits of a hash.

    Words of ``deny`` are none. A null question is taken as empty.
    """
    q = F.coalesce(question, F.lit(""))
    good = lambda t: F.when(F.upper(t).rlike("^[A-Z]{1,5}$") & ~F.upper(t).isin(*deny), F.upper(t))
    first = lambda found: F.get(F.filter(F.transform(found, good), lambda t: t.isNotNull()), F.lit(0))
    inside = first(F.regexp_extract_all(q, F.lit(r"\(([A-Z]{1,5})\)"), F.lit(1)))
    places = (r",\s*([A-Z]{1,5})\.?\s*$", r"\bfor\s+([A-Z]{1,5})\b", r"\b([A-Z]{1,5})\s+FY\d{2,4}\b", r"\b([A-Z]{1,5})\s+\d{4}\b", r"^([A-Z]{1,5})\s+(?:EPS|revenue|sales|margin|income|operating|net)\b")
    placed = [good(F.nullif(F.regexp_extract(q, p, 1), F.lit(""))) for p in places]
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(q, F.lit(r"\b[A-Z]{1,5}\b"), F.lit(0)), good), lambda t: t.isNotNull()))
    only = F.when(F.size(words) == 1, words[0])
    name = good(F.substring(F.nullif(F.regexp_extract(F.trim(q), r"^([A-Z][A-Za-z&.\-]+)", 1), F.lit("")), 1, 5))
    return F.coalesce(inside, *placed, only, name, F.concat(F.lit("C"), F.upper(F.substring(F.sha2(q.cast("binary"), 256), 1, 5))))


def company_of(evidence: Column, ticker: Column) -> Column:
    """The first line that isn't blank, without "and Subsidiaries" or "Consolidated" and what follows, if it has letters and 2 to 100 characters; else the ticker, or Unknown."""
    lines = F.filter(F.transform(F.split(F.coalesce(evidence, F.lit("")), r"[\r\n]"), strip), lambda x: x != "")
    line = F.regexp_replace(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"\s+and\s+Subsidiaries.*", ""), r"\s+Consolidated.*", "")
    return F.when(F.length(line).between(2, 100) & line.rlike("[A-Za-z]"), F.btrim(line, F.lit(" ,."))).otherwise(F.coalesce(F.nullif(ticker, F.lit("")), F.lit("Unknown")))


def valid_ticker(c: Column, deny: tuple[str, ...]) -> Column:
    """The normalised ticker, or null."""
    t = F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("."), F.lit(""))
    return F.when(t.rlike("^[A-Z]{1,5}$") & ~t.isin(*deny), t)


def unit_of(metric: Column, text: Column) -> Column:
    has = lambda *w: F.coalesce(*[F.when(F.contains(metric, F.lit(x)), True) for x in w], F.lit(False))
    return (
        F.when(has("per_share") | metric.endswith("_eps"), "currency_per_share")
        .when(has("margin", "rate", "percentage"), "percentage")
        .when(has("share"), "count")
        .when(F.contains(F.lower(text), F.lit("in billions")), "currency_billions")
        .otherwise("currency_millions")
    )


def stable_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def close(expected: Column, actual: Column, rel: float, abs_: float) -> Column:
    """Within rel of the larger magnitude, or within abs_."""
    return F.abs(expected - actual) <= F.greatest(rel * F.greatest(F.abs(expected), F.abs(actual)), F.lit(abs_))


def close_in_unit(expected: Column, actual: Column, percent: Column) -> Column:
    """Percentages by 0.1 points or a ratio's hundredth, small amounts by 0.01, others by half a percent."""
    as_pct = lambda v: F.when(F.abs(v) > 1, v).otherwise(v * 100)
    return (
        F.when(percent, close(as_pct(expected), as_pct(actual), 1e-9, 0.1) | close(as_pct(expected) / 100, as_pct(actual) / 100, 0.01, 0.0015))
        .when((F.abs(expected) < 100) & (F.abs(actual) < 100), close(expected, actual, 0.01, 0.01))
        .otherwise(close(expected, actual, 0.005, 0.01))
    )


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def metric_matches(required: Column, got: Column) -> Column:
    """Names in lower case with underscores: equal, one within the other, or min(2, n) shared words.

    Words have four letters or more, and n is how many of them ``required`` has. An empty name matches nothing.
    """
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    long_ = lambda c: F.array_distinct(F.filter(F.split(c, "_"), lambda w: F.length(w) >= 4))
    a, b = bare(required), bare(got)
    x = long_(a)
    words = (F.size(x) > 0) & (F.size(F.array_intersect(x, long_(b))) >= F.least(F.lit(2), F.size(x)))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | words)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two multisets of words, each word once for every time both have it."""
    x, y = words_of(a), words_of(b)
    count = lambda words, w: F.size(F.filter(words, lambda t: t == w))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, w: acc + F.least(count(x, w), count(y, w)))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, F.round(2.0 * common / total, 4)).otherwise(0.0)


def number_overlap(numbers: Column, gold: Column) -> Column:
    """Share of gold numbers that some number is within max(0.5, 2 %) of; 0 where there is no gold."""
    near = F.filter(gold, lambda g: F.exists(numbers, lambda v: F.abs(v - g) <= F.greatest(F.lit(0.5), 0.02 * F.abs(g))))
    return F.when(F.size(gold) > 0, F.round(F.size(near) / F.size(gold), 4)).otherwise(0.0)


def quality(reasoning: Column, text: Column, question: Column, answer: Column) -> Column:
    """Weight of the reasoning, capped shares of numbers, years and length, and points for words of change and numeric answers."""
    kind = F.trim(F.coalesce(reasoning, F.lit("")))
    weight = F.when(kind == "Calculation", 3.0).when(kind == "Compositional", 2.8).when(kind.isin("Subtraction", "Subtract"), 2.4).otherwise(1.0)
    return F.round(
        weight
        + F.least(F.lit(4.0), F.regexp_count(text, F.lit(PLAIN_NUMBER)) / 8.0)
        + F.least(F.lit(3.0), F.lit(0.8) * F.size(years_in(F.concat_ws(" ", text, question))))
        + F.least(F.lit(2.0), F.length(text) / 1200.0)
        + F.when(F.concat_ws(" ", question, answer).rlike(BONUS), 2.0).otherwise(0.0)
        + F.when(parse_number(answer).isNotNull(), 2.0).otherwise(0.0),
        4,
    )


def derivation_quality(evidence: Column, question: Column, derivation: Column) -> Column:
    """Capped shares of numbers in the evidence and of the lengths of derivation and question."""
    return F.round(F.least(F.lit(6.0), F.regexp_count(evidence, F.lit(PLAIN_NUMBER)) / 5.0) + F.least(F.lit(3.0), F.length(derivation) / 20.0) + F.least(F.lit(3.0), F.length(question) / 40.0), 4)


# Weights of ways of reasoning, and words of a calculated answer.
REASONING = {"Compositional": 3.0, "Division": 2.2, "Addition": 2.0, "Subtraction": 2.0, "Multiplication": 1.8}
CALCULATED = r"(?i)\b(calculated|minus|divided|increase|decrease|margin|ratio|percentage|growth|sum)\b"


def case_scores(category: Column, reasoning: Column, text: Column, question: Column, answer: Column, facts: Column) -> Column:
    """struct(quality, fairness) of a case with so many required facts, each to three places."""
    core = category.isin("Financials", "Company Overview")
    weight = F.lit(0.4)
    for k, v in REASONING.items():
        weight = F.when(reasoning == k, v).otherwise(weight)
    numbers = F.regexp_count(text, F.lit(PLAIN_NUMBER))
    quality_ = (
        F.when(core, 3.0).otherwise(1.0) + weight + F.least(F.lit(3.0), F.size(years_in(text)) * 0.8) + F.least(F.lit(3.0), facts * 0.55) + F.least(F.lit(3), F.floor(numbers / 12))
        + F.when(answer.rlike(CALCULATED), 1.2).otherwise(0.0) + F.when(F.length(question).between(20, 180), 0.6).otherwise(0.0) + F.when(facts >= 2, 1.0).otherwise(0.0)
    )
    fairness = F.when(core, 1.5).otherwise(0.8) + F.when((text != "") & (answer != ""), 1.0).otherwise(0.0) + F.when(facts >= 2, 1.0).otherwise(0.0) + F.when(reasoning == "None", 0.8).otherwise(0.4) + F.when(F.contains(F.lower(answer), F.lit("calculated")), 0.7).otherwise(0.0)
    return F.struct(F.round(quality_, 3).alias("quality"), F.round(fairness, 3).alias("fairness"))


def verdict_of(text: Column) -> Column:
    """struct(verdict, score) of the first JSON object in a model's text; parse_fail and null where there is no valid one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    j = F.from_json(found, "verdict string, score double")
    good = j["verdict"].isin("correct", "partial", "incorrect") & j["score"].isin(0.0, 0.5, 1.0)
    return F.struct(F.when(good, j["verdict"]).otherwise("parse_fail").alias("verdict"), F.when(good, j["score"]).alias("score"))


def chunks(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """array of (i, start, end, chunk): windows of ``size`` characters, each begun ``overlap`` before the last one's end.

    The text loses the white space around it first, and so does each chunk, which keeps its place; blank ones go.
    """
    step = size - overlap

    def of(t: Column) -> Column:
        n = F.length(t)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")

        def window(i: Column) -> Column:
            return F.struct(i.alias("i"), (i * step).alias("start"), F.least(n, i * step + size).alias("end"), strip(F.substring(t, i * step + 1, F.lit(size))).alias("chunk"))

        all_ = F.transform(F.sequence(F.lit(0), count - 1), window)
        return F.filter(F.when(n > 0, all_).otherwise(F.slice(all_, 1, 0)), lambda c: c["chunk"] != "")

    return F.transform(F.array(strip(text)), of)[0]  # bound by the lambda, so that the text is stripped once


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def operands(program: Column) -> Column:
    """Numbers and const_N of an arithmetic program, in order; N may be m1 for -1."""
    found = F.regexp_extract_all(program, F.lit(r"const_m?\d+(?:\.\d+)?|-?\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, "const_", ""), "^m", "-").try_cast("double"))
