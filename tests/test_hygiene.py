"""Hand-worked values of the hygiene operators, nulls and repeated rows included."""

import pytest

from factloom.operators import hygiene, validate


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=str)


def test_allowed_tickers(spark):
    df = spark.createDataFrame([(1, " b.rk "), (2, "FY"), (3, "TOOLONG"), (4, None), (5, "ibm"), (6, "XY")], "n int, ticker string")
    listed = spark.createDataFrame([("BRK",), ("ibm.",), ("IBM",), (None,)], "t string")
    assert rows(hygiene.allowed_tickers(df, "ticker", ("FY",), listed), "n", "ticker") == [(1, "BRK"), (5, "IBM")]
    assert rows(hygiene.allowed_tickers(df, "ticker", ("FY",)), "n", "ticker") == [(1, "BRK"), (5, "IBM"), (6, "XY")]
    assert rows(hygiene.allowed_tickers(df, "ticker", ("FY",), listed.where("false")), "n") == []


def test_company_issues(spark):
    data = [(1, "Acme", "ACM", "What did Acme earn?"), (2, None, None, None), (3, "Acme", "ACM", "acme grew"), (4, "Results of Operations", "n/a", "x"), (5, "Trends in cost", "T", "")]
    got = dict(rows(hygiene.company_issues(spark.createDataFrame(data, "n int, company string, ticker string, question string")), "n", "issues"))
    assert got == {
        2: ["bad_company_exact_or_unknown", "bad_or_missing_ticker"],
        3: ["company_prefix_matches_question_phrase"],
        4: ["bad_or_missing_ticker", "company_looks_like_question_phrase", "company_looks_like_section_heading"],  # "operations" holds "ratio"
        5: ["company_looks_like_question_phrase"],
    }


def test_fact_issues(spark):
    cases = spark.createDataFrame([("c", "How did sales grow in 2020?", "To (1,250.50) from 7%", "Sales were 5. Bonds with maturity in 2031. 3% to 4% of it."), ("n", None, None, None)], "case_id string, question string, expected_answer string, evidence string")
    kind = "case_id string, fact_id int, metric_raw string, metric string, year int, value double, unit string, quote string, role string, derived boolean, source boolean"
    facts = [
        ("c", 1, "Sales", "total_revenue", 2019, 5.0, "count", "Sales were 5", "total", False, True),
        ("c", 2, "costs", "", 2018, -1250.5, "numeric", "Sales were 6", "component", True, True),
        ("c", 3, "Earned premium", "at_the_end_of", 1998, 1.0, "USD_per_share", None, "total", None, None),
        ("c", 4, "bonds", "bonds", 2031, 7.0, "count", "Bonds", "total", True, False),
        ("n", 5, None, None, None, None, None, None, None, None, None),
        ("x", 6, "of no case", "", 2020, 1.0, "count", "", "", False, False),
    ]
    got = {r.fact_id: (r.issues, r.artifacts) for r in hygiene.fact_issues(spark.createDataFrame(facts, kind), cases).collect()}
    assert got == {
        2: (
            ["derived_answer_value_marked_as_source_fact", "evidence_quote_is_synthetic_not_exact_excerpt", "negative_value_may_be_percentage_range_artifact", "unit_too_generic_for_eval_ready_fact"],
            ["negative_percentage_range_artifact"],
        ),
        3: (
            ["fact_not_clearly_needed_for_expected_answer", "metric_looks_like_header_or_section_phrase", "missing_evidence_quote", "unit_conflicts_with_metric", "year_is_before_2000_reporting_period"],
            ["metric_header_phrase", "pre_2000_reporting_period", "usd_per_share_revenue_conflict"],
        ),
        4: (["year_looks_like_birth_maturity_or_expiration_date"], ["non_reporting_year_used_as_period"]),
        5: (["fact_not_clearly_needed_for_expected_answer", "missing_evidence_quote", "unclear_fact_role"], []),
    }


@pytest.mark.parametrize(
    ("question", "evidence", "expected"),
    [
        ("How did it do?", "Gross margin rose", "gross_margin"),
        ("How did it do?", "x" * 600 + "gross margin", "other"),
        ("margin", "of 2020 and 2021", "multi_year_margin"),
        ("margin", "of 2020", "ratio_trend"),
        (None, None, "other"),
        ("Revenue", "showed an increase", "yoy_revenue_change"),
    ],
)
def test_formula_types(spark, question, evidence, expected):
    df = spark.createDataFrame([(question, evidence)], "question string, evidence string")
    assert hygiene.formula_types(df, "question", "evidence").first().formula_type == expected


def test_split_by_dictionary(spark):
    kind = "case_id string, ticker string, raw_metric string, year int, value double, unit string, quote string, ordinal int"
    data = [
        ("c", "T", "Total Revenue", 2020, 5.0, "count", "Revenue 5", 0),
        ("c", "T", "cost revenue", 2020, 3.0, "count", "Cost of products 3", 0),
        ("c", "T", "cost revenue", 2021, 4.0, "count", "Total cost of products 4", 0),
        ("c", "T", "cost of sales", 2021, 4.0, "count", "cost 4", 0),
        ("c", "T", "cost of sales", 2022, 6.0, "count", "cost 6", 0),
        ("c", "T", "cost of sales", 2023, 6.0, "dozen", "cost 6", 0),
        ("c", "T", "some odd name", 2020, 1.0, "count", "odd", 0),
        ("c", "T", "some odd name", 2021, 1.0, "count", "odd", 0),
        ("c", "T", "net income", 1999, 1.0, "count", "old", 0),
        ("d", "T", "Total Revenue", 2020, 5.0, "count", "Revenue 5", 0),
    ]
    got = hygiene.split_by_dictionary(validate.first_reason(spark.createDataFrame(data, kind)))
    assert rows(got, "case_id", "raw_metric", "year", "metric", "mapped", "recovered") == sorted(
        [
            ("c", "Total Revenue", 2020, "total_revenue", True, False),
            ("c", "cost revenue", 2020, None, False, False),
            ("c", "cost revenue", 2021, "cost_of_sales", True, False),
            ("c", "cost of sales", 2022, "cost_of_sales", True, True),
            ("c", "some odd name", 2020, None, False, False),
            ("c", "some odd name", 2021, None, False, False),
            ("d", "Total Revenue", 2020, "total_revenue", True, False),
        ],
        key=str,
    )


def test_case_graph(spark):
    kind = "case_id string, fact_id string, ticker string, company string, metric string, metric_raw string, year int, quote string, exact boolean, derived boolean, review boolean"
    data = [
        ("a", "1", "T", "Old", "m", "M", 2020, "five", True, False, None),
        ("a", "2", "T", "New", "m", "M2", None, "six", True, None, False),
        ("b", "3", "T", "Newest", "m", "M3", 2020, "five", True, False, False),
        ("b", "4", "", "X", "m", "M", 2020, "seven", None, True, True),
    ]
    facts = spark.createDataFrame(data, kind)
    cases = spark.createDataFrame([("a", "five and six"), ("b", "five")], "case_id string, evidence string")
    problems = hygiene.fact_problems(facts, cases)
    assert rows(problems, "case_id", "fact_id", "reason") == [("b", "4", r) for r in ("derived answer value", "manual review", "missing company/ticker", "quote flag false", "quote not substring")]
    nodes, edges = hygiene.case_graph(facts, problems)
    assert rows(nodes, "id", "label", "name") == [
        ("company::T", "Company", "New"), ("metric::m", "Metric", "M2"), ("obs::1", "Observation", "five"), ("obs::2", "Observation", "six"), ("year::", "Year", ""), ("year::2020", "Year", "2020"),
    ]
    assert edges.count() == 6
    assert rows(edges.where("src = 'company::T'"), "dst") == [("obs::1",), ("obs::2",)]


def test_dictionary_report(spark):
    data = [("net_income", "Net Income", "d", ["profit"]), ("net_income", "Net Income", "d", None), ("gross_profit", "Gross Profit", None, ["Profit "]), ("Bad", "", "d", []), ("amount", "Amount", "d", None)]
    df = spark.createDataFrame(data, "canonical_name string, label string, definition string, aliases array<string>")
    assert rows(hygiene.dictionary_report(df), "check", "item", "n") == [
        ("alias_of_several", "profit", 2), ("duplicate_label", "Net Income", 2), ("duplicate_name", "net_income", 2), ("malformed_name", "Bad", 1), ("malformed_name", "amount", 1),
        ("missing_label_or_definition", "Bad", 1), ("missing_label_or_definition", "gross_profit", 1),
    ]
    assert hygiene.dictionary_report(df.where("canonical_name = 'none'")).count() == 0


def test_case_coverage(spark):
    kind = "case_id string, fact_id int, source_id string, ticker string, metric string, metric_raw string, year int, unit string, value double"
    facts = spark.createDataFrame(
        [
            ("x_k1", 1, None, "T", "Net Income", None, 2020, "Count", -100.0),
            ("x_k1", 2, None, None, None, None, None, None, None),
            ("x_k2", 1, " ", None, "net_income", "", 2020, None, 100.0),
            ("x_k2", 2, "src", None, "net_income", "", 2020, None, 100.02),
            ("y_", 1, None, None, None, None, 2020, None, 3.0),
        ],
        kind,
    )
    cases = spark.createDataFrame([("x_k1",), ("x_k2",), ("y_",), ("none_k1",)], "case_id string")
    observed = spark.createDataFrame(
        [("k1", "net_income_total", 2020, "count of", 100.009), ("k1", "other", 2021, "ratio", None), ("src", "net_income", 2020, None, 100.0), ("src", "net_income", 2020, None, 100.0), ("y_", "m", 2020, "", 4.0)],
        "case_key string, metric string, year int, unit string, value double",
    )
    keys = hygiene.case_keys(cases, facts)
    assert rows(keys, "case_id", "case_key") == [("none_k1", "k1"), ("x_k1", "k1"), ("x_k2", "src"), ("y_", "y_")]
    matched = hygiene.fact_matches(facts, keys, observed)
    assert rows(matched, "case_id", "fact_id", "matches") == [("x_k1", 1, 1), ("x_k1", 2, 2), ("x_k2", 1, 2), ("x_k2", 2, 0), ("y_", 1, 0)]
    assert rows(hygiene.case_status(cases, matched), "case_id", "required", "matched", "status") == [
        ("none_k1", 0, 0, "needs_human_review"), ("x_k1", 2, 2, "ready_for_eval"), ("x_k2", 2, 1, "needs_metric_normalization"), ("y_", 1, 0, "needs_value_patch"),
    ]
