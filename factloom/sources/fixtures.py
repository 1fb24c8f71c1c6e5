"""The tables the operators work on, derived from the star schema, events, documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("total_revenue", "operating_expense", "income_tax_expense", "cost_of_sales", "gross_profit", "operating_income", "net_income")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums(spark, sf_dir: str, *by: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"),
        (F.year("l_shipdate") + 20).alias("year"),
        F.col("l_returnflag").alias("ordinal"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("p"),
        F.col("l_discount").cast("decimal(4,2)").alias("d"),
        F.col("l_tax").cast("decimal(4,2)").alias("t"),
        F.col("l_quantity").cast("decimal(12,2)").alias("q"),
    )
    one = F.lit(1).cast("decimal(1,0)")
    return line.groupBy("ticker", "year", *by).agg(
        F.sum(F.col("p") * (one - F.col("d"))).cast("double").alias("total_revenue"),
        F.sum(F.col("p") * F.col("d")).cast("double").alias("operating_expense"),
        F.sum(F.col("p") * F.col("t")).cast("double").alias("income_tax_expense"),
        F.sum(F.col("q") * F.lit(100).cast("decimal(3,0)")).cast("double").alias("cost_of_sales"),
    )


def facts_raw(spark, sf_dir: str) -> DataFrame:
    """(ticker, year, ordinal, metric, value): up to three values per cell, in the order of ordinal."""
    return _sums(spark, sf_dir, "ordinal").unpivot(["ticker", "year", "ordinal"], list(METRICS[:4]), "metric", "value")


def facts(spark, sf_dir: str) -> DataFrame:
    """(ticker, year, metric, value): one value per cell."""
    s = _sums(spark, sf_dir)
    s = s.withColumn("gross_profit", F.col("total_revenue") - F.col("cost_of_sales"))
    s = s.withColumn("operating_income", F.col("gross_profit") - F.col("operating_expense"))
    s = s.withColumn("net_income", F.col("operating_income") - F.col("income_tax_expense"))
    return s.unpivot(["ticker", "year"], list(METRICS), "metric", "value")


def traces(spark, sf_dir: str) -> DataFrame:
    """One model answer per event: (case_id, method) is unique; the answer is near the expected number or off it."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 7 - 3
    cents = F.floor(F.col("value") * (1 + k * F.lit(0.005)) * 100).cast("long")
    number = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    answer = (
        F.when(F.col("event_id") % 11 == 0, "")
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: $"), number))
        .when(F.col("event_id") % 3 == 1, F.concat(number, F.lit("%")))
        .otherwise(F.concat(number, F.lit(" in FY 2020")))
    )
    return e.select(
        F.col("event_id").alias("trace_id"),
        F.floor(F.col("event_id") / 5).cast("long").alias("case_id"),
        F.concat(F.lit("m"), F.col("event_id") % 5).alias("method"),
        F.col("event_type").alias("dataset"),
        (F.col("user_id") % 3).cast("int").alias("level"),
        F.round("value", 2).alias("expected"),
        answer.alias("answer"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise("a / b = c").alias("calculation"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


def judgments(spark, sf_dir: str) -> DataFrame:
    """Four judges' verdicts on each document: item, judge, code (0, 1, 2; null where the answer could not be parsed)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    code = ((F.col("doc_id") * (2 * F.col("j") + 1) + F.col("n_chars")) % 3).cast("int")
    return d.select(
        F.col("doc_id").alias("item"),
        F.concat(F.lit("m"), F.col("doc_id") % 4).alias("method"),
        F.concat(F.lit("j"), "j").alias("judge"),
        F.when((F.col("doc_id") + F.col("j")) % 97 != 0, code).alias("code"),
    )


def observations(spark, sf_dir: str) -> DataFrame:
    """facts_raw with what can be wrong with extracted rows: odd names, units, years, values and empty quotes."""
    f = facts_raw(spark, sf_dir).withColumn("s", F.substring("ticker", 2, 20).cast("int"))
    raw = (
        F.when((F.col("metric") == "total_revenue") & (F.col("s") % 3 == 0), "Net Sales")
        .when((F.col("metric") == "cost_of_sales") & (F.col("s") % 2 == 0), "cost of goods sold")
        .when((F.col("metric") == "operating_expense") & (F.col("s") % 5 == 0), "G&A")
        .otherwise(F.col("metric"))
    )
    return f.select(
        F.concat(F.lit("case_"), "s").alias("case_id"),
        "ticker",
        raw.alias("raw_metric"),
        F.when(F.col("s") % 13 == 0, 1999).otherwise(F.col("year")).alias("year"),
        F.when((F.col("s") % 17 == 0) & (F.col("ordinal") == "A"), F.col("year").cast("double")).otherwise(F.round("value", 2)).alias("value"),
        F.when(F.col("s") % 11 == 0, "").otherwise("currency_millions").alias("unit"),
        F.when((F.col("s") % 7 == 0) & (F.col("ordinal") == "N"), "").otherwise(F.concat("metric", F.lit(" was reported"))).alias("quote"),
        "ordinal",
    )


def slotted_traces(spark, sf_dir: str, every_line: bool = False) -> DataFrame:
    """A trace for each order, with up to four slots from its lines, or one for every line, and an answer that has them right, in another unit, a little off, or not at all."""
    p = F.col("l_extendedprice").cast("decimal(12,2)")
    times = lambda v, kind: (p * F.lit(v).cast(kind)).cast("string")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    said = (
        F.when(k == 0, F.concat(F.lit("$"), p.cast("string"))).when(k == 1, F.concat(times("0.01", "decimal(3,2)"), F.lit("%"))).when(k == 2, times("1.003", "decimal(4,3)"))
        .when(k == 3, times("1.015", "decimal(4,3)")).when(k == 4, "not given").otherwise(F.concat(times("0.001", "decimal(4,3)"), F.lit(" thousand")))
    )
    expected = F.when((F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 5 == 0), "n/a").otherwise(p.cast("string"))
    line = F.struct(F.col("l_linenumber").alias("n"), said.alias("said"), expected.alias("expected"))
    of = read(spark, sf_dir, "lineitem")
    of = of if every_line else of.where("l_linenumber <= 4 and l_quantity >= 15")
    lines = F.array_sort(F.collect_list(line))
    lines = of.groupBy(F.col("l_orderkey").alias("trace_id")).agg((lines if every_line else F.slice(lines, 1, 4)).alias("lines"))
    o = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(o.alias("trace_id"), "o_orderstatus").join(lines, "trace_id", "left")
    t = t.withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    i = F.col("trace_id")
    part = lambda odd: F.array_join(F.transform(F.filter("lines", lambda x: x["n"] % 2 == odd), lambda x: x["said"]), "; ")
    kind = F.when(i % 3 == 0, "finqa_program").when(i % 3 == 1, "revenue_growth").otherwise("tatqa_arithmetic")
    method = F.when(i % 4 == 0, "graph_neo4j_v8").when(i % 4 == 1, "graph_neo4j_v9").when(i % 4 == 2, "vector_only").otherwise("hybrid")
    unit = F.when(i % 2 == 0, "amount").otherwise("percentage")
    return t.select(
        "trace_id", F.col("o_orderstatus").alias("dataset"), method.alias("method"), kind.alias("formula_type"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("case_"), i.cast("string"), F.lit(" in 2020: "), part(1))).alias("final_answer"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.when(i % 7 == 0, "").otherwise("ratio: "), part(0))).alias("calculation"),
        F.transform("lines", lambda x: F.struct(F.concat(F.lit("slot_"), x["n"].cast("string")).alias("name"), x["expected"].alias("expected"), unit.alias("unit"))).alias("slots"),
        F.transform("lines", lambda x: F.struct(x["expected"].alias("expected"), F.lit("amount").alias("unit"), F.when(i % 5 > 0, 2020).alias("year"))).alias("facts"),
        (i % 19 == 0).alias("failed"), F.when(i % 17 == 0, 1.0).alias("earlier_ac"), F.when(i % 34 == 0, 0.875).alias("earlier_nc"),
    )


#: What a case of each kind asks, and how it calls some of its metrics.
FORMULA_QUESTIONS = (
    "What was the effective tax rate?", "How did Inventory Turnover develop?", "Assess liquidity over the years.", "Compare gross margin.", "Is the margin improving?",
    "How does the cost/SG&A ratio move?", "What drove growth?", "Reconcile EPS.", "Who audits the company?", "Explain the effective tax charge.",
    "Net Inc growth and EPS impact?", "What is the Noninterest Exp ratio?", "Operating profit margin of the bank?",
)
FORMULA_NAMES = {
    (0, "income_tax_expense"): "Provision for Income Taxes", (0, "operating_income"): "Income before income taxes", (1, "operating_expense"): "Inventories", (2, "total_revenue"): "Current Assets",
    (2, "cost_of_sales"): "current_liabilities", (5, "operating_expense"): "Selling, General and Administrative", (7, "cost_of_sales"): "weighted_average_shares", (9, "income_tax_expense"): "levies",
    (10, "cost_of_sales"): "diluted_earnings_per_common_share", (11, "operating_expense"): "total_noninterest_expense", (11, "total_revenue"): "net_interest_income",
    (12, "operating_income"): "income_before_taxes", (12, "total_revenue"): "net_interest_income", (12, "gross_profit"): "total_other_income",
}


def formula_cases(spark, sf_dir: str) -> DataFrame:
    """A case for each customer, of thirteen kinds: (case_id, kind, ticker, question, expected_answer)."""
    k = F.col("c_custkey")
    kind = (k % len(FORMULA_QUESTIONS)).cast("int")
    question = F.get(F.array(*map(F.lit, FORMULA_QUESTIONS)), kind)
    return read(spark, sf_dir, "customer").select(k.alias("case_id"), kind.alias("kind"), F.concat(F.lit("S"), k % 10 + 1).alias("ticker"), question.alias("question"), F.when(k % 26 == 8, "The Current Ratio fell.").alias("expected_answer"))


#: Cases to a task where each gets all facts of its ticker.
CASES = 20_000


def facts_of_cases(cases: DataFrame, f: DataFrame) -> DataFrame:
    """cases (case_id, ticker, ...) with the facts f of their tickers.

    Many cases may share a ticker, so cases are dealt by case_id, at most about CASES to a task, and not by ticker: no task
    has all cases of one, and what is grouped by case afterwards stays where it is. Only the facts of tickers that cases
    have go along; they are made once, and as Spark knows their size it joins few of them without a shuffle.
    """
    from ..operators.pairs import stored

    parts = max(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cases.count() // CASES))
    f = stored(f.join(F.broadcast(cases.select("ticker").distinct()), "ticker", "left_semi"))  # companies at most
    return cases.repartition(parts, "case_id").join(f, "ticker")


def formula_facts(spark, sf_dir: str) -> DataFrame:
    """The facts of each case: its ticker's values by ordinal and in total, the total last, under the case's names."""
    f = facts_raw(spark, sf_dir).select("ticker", "metric", "year", "value", F.ascii("ordinal").alias("place")).unionByName(facts(spark, sf_dir).withColumn("place", F.lit(1000)))
    j = facts_of_cases(formula_cases(spark, sf_dir).select("case_id", "kind", "ticker"), f)
    name = F.col("metric")
    for (kind, metric), other in FORMULA_NAMES.items():
        name = F.when((F.col("kind") == kind) & (F.col("metric") == metric), other).otherwise(name)
    return j.select("case_id", name.alias("metric"), "year", "value", "place")


def derivation_cases(spark, sf_dir: str) -> DataFrame:
    """A case for each order: a program of three steps or a derivation, some with too few numbers or an answer that is none."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    program = F.concat(F.lit("subtract("), price, F.lit(", const_100), divide(#0, "), price, F.lit("), multiply(#1, const_m2)"))
    derivation = F.concat(F.lit("("), F.regexp_replace(price, r"(\d)(\d{3})\.", "$1,$2."), F.lit(" - 1,250) / "), k.cast("string"), F.lit(" - 7.5"))
    return read(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.when(k % 3 == 0, F.when(k % 9 == 0, "add(5)").otherwise(program)).alias("program"), F.when(k % 3 == 1, derivation).when(k % 3 == 2, "12 only").alias("derivation"),
        F.when(k % 5 == 0, "million").when(k % 5 == 1, "percent").when(k % 5 == 2, "").when(k % 5 == 3, "dozen").alias("scale"),
        F.when(k % 7 == 0, "yes").when(k % 7 == 1, F.concat((k % 100).cast("string"), F.lit("%"))).otherwise(price).alias("answer"),
    )


def suite_facts(spark, sf_dir: str) -> DataFrame:
    """(ticker, metric, year, ordinal, value): up to three values of the reported metrics in each cell, and one of the profits."""
    profits = facts(spark, sf_dir).where(F.col("metric").isin(*METRICS[4:])).withColumn("ordinal", F.lit("T"))
    return facts_raw(spark, sf_dir).unionByName(profits)


def upkeep_facts(spark, sf_dir: str) -> DataFrame:
    """The valid observations, numbered within their case, with their company and name as written."""
    from pyspark.sql import Window

    o = observations(spark, sf_dir).where("unit <> '' and quote <> ''")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("raw_metric", "year", "ordinal"))
    return o.select("case_id", "ticker", F.col("raw_metric").alias("metric"), "year", "value", "unit", "quote", "ordinal", place.alias("place"), F.concat(F.lit("Company "), "ticker").alias("company"))


def answered_facts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts of each order (a case) from its lines, and an answer that gives some of them: in millions, in percent, negated, or without its year or names."""
    p = F.col("l_extendedprice").cast("decimal(12,2)")
    k = (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 7
    names = F.array(*map(F.lit, ("total_revenue", "cost_of_sales", "net_income", "operating_expense", "gross_profit", "long_term_debt_of_the_group", "")))
    metric, year = F.get(names, ((F.col("l_linenumber") - 1) % 7).cast("int")), (2014 + F.col("l_linenumber")).cast("int")
    entity = F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))
    unit = F.when(k == 1, "currency_millions").when(k == 2, "percentage").otherwise("amount")
    # dealt by order once: facts and answers of a case are made and later joined where its lines are
    lines = read(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("l_extendedprice"), F.min("l_suppkey").alias("l_suppkey"))
    number = p.cast("string")
    said = (
        F.when(k == 0, F.concat(metric, F.lit(" was $"), number)).when(k == 1, F.concat(F.lit("Total Revenue and Net: "), number, F.lit(" million"))).when(k == 2, F.concat(number, F.lit("% of sales")))
        .when(k == 3, F.concat(F.lit("("), number, F.lit(") lost"))).when(k == 4, F.concat(entity, F.lit(" had "), (p * F.lit("1.004").cast("decimal(4,3)")).cast("string"))).when(k == 5, F.concat(metric, F.lit(" near "), (p * F.lit("1.2").cast("decimal(2,1)")).cast("string"))).otherwise("nothing")
    )
    said = F.when(k == 6, said).otherwise(F.concat(said, F.when(F.col("l_linenumber") != 3, F.concat(F.lit(" in "), year.cast("string"))).otherwise("")))
    facts = lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("fact_id"), metric.alias("metric"), entity.alias("entity"), F.when(F.col("l_orderkey") % 6 > 0, year).alias("year"), p.cast("double").alias("value"), unit.alias("unit"))
    texts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("s")))).alias("x"))
    answers = texts.select(F.col("l_orderkey").alias("trace_id"), F.col("l_orderkey").alias("case_id"), F.when(F.col("l_orderkey") % 23 > 0, F.array_join("x.s", "; ")).alias("text"))
    return facts, answers


def pool_candidates(spark, sf_dir: str) -> DataFrame:
    """A candidate for each order: source_id, company, ticker, category, slice, facts, quality, fairness."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    return read(spark, sf_dir, "orders").select(
        k.alias("source_id"), F.when(F.col("o_custkey") % 17 == 0, "Unknown").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))).alias("company"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), pick(("Financials", "Company Overview", "Risk", "Legal", "Accounting"), k % 5).alias("category"),
        pick(("S1_FIN_COMP", "S3_CO_COMP", "S6_BASELINE_SINGLE", "S9_OTHER"), F.floor(k / 5) % 4).alias("slice"), (k % 4).cast("int").alias("facts"),
        F.floor(F.col("o_totalprice") / 50000).cast("int").alias("quality"), (k * 7 % 101).cast("int").alias("fairness"),
    )
