"""Evidence for facts in answers: value, year, metric and entity, and the recall of facts by answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .slots import rounded

# Numbers with a sign inside their parentheses, years, and the share of a name's words that must be there.
NUMBER = r"(?i)\(?-?\$?\d[\d,]*(?:\.\d+)?\)?\s*(?:%|percent|percentage|million|millions|billion|billions|thousand|thousands)?"
ANY_YEAR, LEAST = r"^(?:19|20)\d\d$", 0.45


def scale_of(words: Column) -> Column:
    """What a scale word in a text multiplies by."""
    factor = F.lit(1.0)
    for word, by in reversed(text.SCALES):
        factor = F.when(F.contains(words, F.lit(word)), F.lit(by)).otherwise(factor)
    return factor


def numbers(c: Column) -> Column:
    """array of (value, percent) of a text's numbers that aren't years; a scale word multiplies, parentheses negate."""

    def read(t: Column) -> Column:
        bare = F.regexp_replace(F.btrim(t, F.lit("()")), r"[$,%]|percent|millions?|billions?|thousands?", "")
        v = F.trim(bare).try_cast("double") * scale_of(t)
        v = v * F.when(t.startswith("(") & t.endswith(")"), -1).otherwise(1)
        return F.struct(v.alias("value"), (F.contains(t, F.lit("%")) | F.contains(t, F.lit("percent"))).alias("percent"))

    found = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda r: ~F.trim(r).rlike(ANY_YEAR))
    return F.filter(F.transform(F.transform(found, lambda r: F.lower(F.trim(r))), read), lambda n: n["value"].isNotNull())


def agrees(value: Column, unit: Column, percent: Column, n: Column) -> Column:
    """Whether a number stands for a fact's value in its unit: percentages by a quarter point, others by half a percent, in units or in the millions or billions that the unit names."""
    points = lambda v, is_percent: F.when(is_percent, v).otherwise(v * 100)
    low = F.lower(unit)
    v = value * scale_of(low)
    a, b = points(v, percent), points(n["value"], n["percent"])
    near = lambda x: text.isclose(x, n["value"], 0.005, 0.02)
    scaled = lambda word, by: F.contains(low, F.lit(word)) & (near(v / by) | near(v * by))
    return F.when(percent | n["percent"], text.isclose(a, b, 1e-9, 0.25) | text.isclose(a / 100, b / 100, 1e-9, 0.0025)).otherwise(near(v) | scaled("million", 1e6) | scaled("billion", 1e9))


def name_words(c: Column) -> Column:
    """Distinct words of two letters or digits and more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1))


def matches(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """(trace_id, fact_id, case_id, value_found, year_found, metric_found, entity_found, matched) of every fact and answer of a case.

    facts: (case_id, fact_id, metric, entity, year, value, unit); answers: (trace_id, case_id, text). A name is found
    where 45 % of its words are: an answer's distinct words are made once and go along with its text. A fact without a year, name or entity has that evidence; a match needs
    the value, the year, and the metric or the entity. A null text is empty.
    """
    f = facts.select("case_id", "fact_id", F.coalesce("metric", F.lit("")).alias("metric"), F.coalesce("entity", F.lit("")).alias("entity"), F.col("year").cast("string").alias("year"), "value", F.coalesce("unit", F.lit("")).alias("unit"))
    f = f.withColumn("m", name_words(F.col("metric"))).withColumn("e", name_words(F.col("entity")))
    text_ = F.coalesce("text", F.lit(""))
    read = answers.select("trace_id", "case_id", F.lower(text_).alias("low"), numbers(text_).alias("ns"), name_words(text_).alias("ws"))
    j = read.join(f, "case_id")
    percent = F.contains(F.lower("unit"), F.lit("percent"))
    value = F.exists("ns", lambda n: agrees(F.col("value"), F.col("unit"), percent, n))
    year = F.col("year").isNull() | F.contains("low", F.col("year"))
    share = lambda words: F.size(F.array_intersect(words, "ws")) >= LEAST * F.greatest(F.size(words), F.lit(1))
    metric = (F.size("m") == 0) | share("m")
    entity = (F.col("entity") == "") | F.contains("low", F.lower("entity")) | (F.size("e") == 0) | share("e")
    j = j.select("trace_id", "fact_id", "case_id", F.coalesce(value, F.lit(False)).alias("value_found"), F.coalesce(year, F.lit(True)).alias("year_found"), metric.alias("metric_found"), entity.alias("entity_found"))
    return j.withColumn("matched", F.col("value_found") & F.col("year_found") & (F.col("metric_found") | F.col("entity_found")))


def recall(found: DataFrame) -> DataFrame:
    """(trace_id, facts, matched, recall) of matches()."""
    g = found.groupBy("trace_id").agg(F.count("*").alias("facts"), F.count_if("matched").alias("matched"))
    return g.withColumn("recall", rounded(F.col("matched") / F.col("facts")))
