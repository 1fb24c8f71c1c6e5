"""Rules of the functions and operators against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import metrics, text
from factloom.operators import coverage, graph, pairs, report, score, select, validate, vectors
from factloom.streaming import ingest


def test_observations_with_nulls(spark):
    rows = [("a", 1, None, "x"), ("b", 2, "currency_millions", None), ("c", 3, "currency_millions", " \n"), ("d", 4, "currency_millions", "ok")]
    obs = spark.createDataFrame(rows, "case_id string, value int, unit string, quote string").select("*", F.lit("total_revenue").alias("raw_metric"), F.lit(2020).alias("year"), F.lit("A").alias("ordinal"))
    got = {r.case_id: r.reason for r in validate.first_reason(obs.withColumn("value", F.col("value").cast("double"))).collect()}
    assert got == {"a": "invalid_unit", "b": "empty_evidence_quote", "c": "empty_evidence_quote", "d": None}


def test_wholesales_are_no_sales(spark):
    df = spark.createDataFrame([("wholesales",), ("net_sales",), ("Unit Sales",)], "raw_metric string")
    got = {r.raw_metric: r.metric for r in metrics.canonical(df).collect()}
    assert got["wholesales"] is None and got["net_sales"] == "total_revenue" and got["Unit Sales"] == "total_revenue"


def test_operands(spark):
    p = spark.createDataFrame([("add(const_1.5, const_m2), subtract(3, 4.25)",)], "p string")
    assert p.select(text.operands(F.col("p"))).first()[0] == [1.5, -2.0, 3.0, 4.25]


def test_means_round_ties_up(spark):
    df = spark.createDataFrame([("a", 0.6648), ("a", 0.6647), ("b", None), ("c", 1.0), ("c", 0.0)], "k string, v double")
    assert {r.k: r.m for r in df.groupBy("k").agg(report.mean("v").alias("m")).collect()} == {"a": 0.6648, "b": 0.0, "c": 0.5}


def test_difference_is_rounded_once(spark):
    df = spark.createDataFrame([(0.45504999999999995,), (-0.12345,), (1.0,)], "v double")
    assert [r[0] for r in df.select(pairs.places(F.col("v"))).collect()] == [0.4551, -0.1235, 1.0]


def test_token_f1_of_whole_texts(spark):
    texts = spark.createDataFrame([(1, 0, "the cat " + "sat " * 500 + "Dog"), (2, 0, None), (3, 1, ""), (4, 9, "x")], "id long, k long, text string")
    gold = spark.createDataFrame([(0, "a cat, a dog"), (1, "")], "k long, text string")
    got = {r.id: r.f1 for r in score.token_f1(texts, gold, "id", "k").collect()}
    assert got == {1: round(2 * 2 / (503 + 4), 4), 2: 0.0, 3: 0.0}


def test_retrieval_of_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 1, [1.0]), (4, 1, None), (5, 1, [1.0, None]), (6, 1, [float("nan"), 1.0]), (7, 1, [])]
    e = spark.createDataFrame(rows, "id int, label int, embedding array<double>")
    q, c = e.selectExpr("id as query_id", "label as entity", "embedding"), e.selectExpr("id as chunk_id", "label as source", "embedding")
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 4)) for r in vectors.top_k(q, c, 2).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 0.7071), (2, 1, 2, 1.0), (2, 2, 1, 0.7071), (3, 1, 3, 1.0)]


@pytest.mark.parametrize(("calculation", "ok"), [("Growth Rate", True), ("none", False)])
def test_calculation_in_any_case(spark, calculation, ok):
    t = spark.createDataFrame([(1, 0, 5.0, "5.0", calculation)], "trace_id int, level int, expected double, answer string, calculation string")
    assert score.score(t).first()["calculation_ok"] is ok


@pytest.mark.parametrize(
    ("raw", "metric"),
    [("SG&A", "selling_general_admin_expense"), ("EBT", "income_before_taxes"), ("sales and marketing", "selling_general_admin_expense"), ("source_value revenue", None), ("Amount", None), ("", None), (None, None)],
)
def test_canonical_names(spark, raw, metric):
    assert metrics.canonical(spark.createDataFrame([(raw,)], "raw_metric string")).first()["metric"] == metric


def test_numbers_with_years_and_signs(spark):
    df = spark.createDataFrame([("In 2020 (1,234) fell to -5 and $ 7.5%, 2020 again",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(text.signed_numbers(F.col("t"))).collect()] == [[2020.0, -1234.0, -5.0, 7.5, 0.075], [], []]


def test_a_metric_must_have_what_is_required(spark):
    rows = [("Net Sales", "net_sales_total"), ("operating_income", "operating_expense"), ("research costs development", "research_and_development"), ("research_and_development", "research"), ("income", "tax"), ("", "x"), (None, "x"), ("long_term_debt", "term_long"), ("debt", "total_debts_due")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(text.metric_matches(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, True, False, False, False, True, True]


def test_chunks_lose_their_margins(spark):
    df = spark.createDataFrame([(" \n" + "a" * 9 + "\t\u00a0b" + "c" * 8 + "\r\n",), ("\n \t",), ("",), (None,), ("xy",)], "t string")
    got = [[tuple(c) for c in r[0] or []] for r in df.select(text.chunks(F.col("t"), 11, 2)).collect()]
    assert got == [[(0, 0, 11, "a" * 9), (1, 9, 20, "b" + "c" * 8)], [], [], [], [(0, 0, 2, "xy")]]


def test_quality_counts_whole_words(spark):
    df = spark.createDataFrame([("Subtract", "x", "Percentage rise", "n/a"), ("Other", "x", "growths", "n/a"), (None, "", "earnings PER SHARE", "5")], "r string, t string, q string, a string")
    got = [r[0] for r in df.select(text.quality(F.col("r"), F.col("t"), F.col("q"), F.col("a"))).collect()]
    assert got == [4.4008, 1.0008, 5.0]


def test_recall_by_fuzzy_metric(spark):
    need = spark.createDataFrame([("A", "net_sales", 2020, 100.0), ("A", "net_income", 2020, 5.0), ("A", "net_income", 2021, 5.0), ("B", "debt", 2020, 0.0)], "ticker string, metric string, year int, expected double")
    have = spark.createDataFrame([("A", "Net Sales (total)", 2020, 100.9), ("A", "net_income", 2020, 6.0), ("B", "total_debt", 2020, 0.01)], "ticker string, metric string, year int, value double")
    assert {r.ticker: r.recall for r in coverage.recall(need, have, ["ticker"]).collect()} == {"A": 0.3333, "B": 1.0}


def test_each_bucket_has_its_quota(spark):
    df = spark.range(20)
    got = select.first_per_bucket(df, [("even", F.col("id") % 2 == 0, 3), ("third", F.col("id") % 3 == 0, 1)], "id").collect()
    assert sorted((r.bucket, r.place, r.id) for r in got) == [("even", 1, 0), ("even", 2, 2), ("even", 3, 4), ("third", 1, 3)]


def test_totals_of_later_batches_replace_earlier_ones(spark, tmp_path):
    line = '{{"trace_id": {}, "model": "m", "tokens": 10, "ts": "2024-01-01 00:00:00"}}\n'
    run = lambda: ingest.run_once(spark, f"{tmp_path}/logs", f"{tmp_path}/state", f"{tmp_path}/totals", {"m": 1.0}, 0.5).collect()
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.json").write_text(line.format(1) * 2)
    assert [(r.calls, r.tokens) for r in run()] == [(1, 10)]
    (tmp_path / "logs/b.json").write_text(line.format(1) + line.format(2))
    assert [(r.calls, r.tokens) for r in run()] == [(2, 20)]
    assert [(r.calls, r.tokens) for r in run()] == [(2, 20)]


def test_cells_with_totals(spark):
    f = spark.createDataFrame([("A", "x", 2020), ("B", "x", 2020), ("A", "y", 2020), ("A", "x", 2021), ("C", "x", 2021)], "ticker string, metric string, year int")
    assert [tuple(r) for r in report.coverage_cells(f, 1).collect()] == [("x", 2020, 2, 2, 3, 2, 5, 2)]


def test_what_a_context_holds(spark):
    df = spark.createDataFrame([("In 2020 Net Income of Acme was 12.5",), ("nothing",), (None,)], "t string")
    x = score.context_checks(F.col("t"), F.array(F.lit("12.50"), F.lit("7.0")), F.lit("net_income"), F.array(F.lit("ACME"), F.lit("")))
    assert [tuple(r[0]) for r in df.select(x).collect()] == [(True, True, True, True, 0.6), (False, False, False, False, 0.0), (False, False, False, False, 0.0)]


@pytest.mark.parametrize(
    ("answer", "calculation", "question", "years", "codes"),
    [
        ("2020: 5.0%", "in 2020 5.3 %", "Margin?", [2020], []),
        ("2020: 5.0%", "in 2020 5.4 %", "Margin?", [2020], ["final_answer_calculation_mismatch"]),
        ("2020: 5.0%", "in 2021 5.4 %", "Margin?", [2020], []),
        ("2020: 5.0%", "in 2020 nothing", "Inventory Turnover", [2020, 2021], ["ambiguous_formula", "missing_prior_period"]),
        ("", "", "inventory turnover", [], ["ambiguous_formula"]),
    ],
)
def test_warnings(spark, answer, calculation, question, years, codes):
    df = spark.createDataFrame([(answer, calculation, question, years)], "a string, c string, q string, y array<int>")
    assert df.select(score.consistency_warnings(*map(F.col, "acqy"))).first()[0] == codes


def test_similar_facts_first(spark):
    cases = spark.createDataFrame([(1, "A", 2020, "x", [1.0, 0.0]), (2, "A", 2020, "z", [0.0, 1.0])], "case_id int, ticker string, year int, case_source string, embedding array<double>")
    rows = [("A", 2020, "m1", "x", [0.0, 1.0]), ("A", 2020, "m2", "x", [1.0, 0.1]), ("A", 2020, "m3", "y", [1.0, 0.0]), ("A", 2021, "m4", "x", [1.0, 0.0])]
    facts = spark.createDataFrame(rows, "ticker string, year int, metric string, source string, embedding array<double>")
    got = sorted((r.case_id, r["rank"], r.metric) for r in graph.fallback_lookup(cases, facts, 2).collect())
    assert got == [(1, 1, "m2"), (1, 2, "m1"), (2, 1, "m1"), (2, 2, "m2")]


def test_means_by_mode(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 0), ("a", "y", 1), ("b", "y", None)], "r string, c string, v int")
    got = {r.r: tuple(r)[1:] for r in report.pivot_means(df, "r", "c", ("x", "y"), "v").collect()}
    assert got == {"a": (0.5, 2, 1.0, 1, 0.6667, 3), "b": (None, 0, None, 0, 0.0, 0)}


@pytest.mark.parametrize(
    ("answer", "calculation", "codes"),
    [
        ("In 1975 it was 12 percent", "1975: 12.5 Percentage points", ["final_answer_calculation_mismatch"]),
        ("In 1975 it was 12 percent", "1975: 12.3 %", []),
        ("In 2055 it was 12%", "2055: 14 percent", ["final_answer_calculation_mismatch"]),
    ],
)
def test_percent_in_words_and_years_of_two_centuries(spark, answer, calculation, codes):
    df = spark.createDataFrame([(answer, calculation, "q", [1])], "a string, c string, q string, y array<int>")
    assert df.select(score.consistency_warnings(*map(F.col, "acqy"))).first()[0] == codes
