"""Gates, lookups, coverage, merges, samples and readers against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import contracts, coverage, gates, select
from factloom.sources import io


def one(spark, expression, *values, kind="string"):
    row = [tuple(values)]
    return spark.createDataFrame(row, ", ".join(f"c{k} {kind}" for k in range(len(values)))).select(expression(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


def test_spellings_of_a_value(spark):
    of = lambda v: one(spark, gates.variants, v, kind="double")
    assert of(1234.5) == ["$ 1,234.5", "$1,234.5", "1,234.5%", "1,234.5", "1234.5"]
    assert set(of(-7.0)) == {"7", "$7", "$ 7", "7%", "(7)", "$(7)", "(7)%"}


@pytest.mark.parametrize(
    ("evidence", "metric", "value", "quote"),
    [
        ("Net  income\nwas $1,234.5 then", "net income", 1234.5, "Net  income\nwas $1,234.5"),
        ("net income fell. Net income 5", "net income", 5.0, "net income fell. Net income 5"),
        ("net income" + " " * 2300 + "5, later net income 5", "net income", 5.0, "net income 5"),
        ("sales 5", "net income", 5.0, None), ("net income", "net income", 5.0, None), ("x (5) a.b 5", "a.b", 5.0, "a.b 5"), (None, "x", 5.0, None), ("5", "", 5.0, None),
    ],
)
def test_exact_quote(spark, evidence, metric, value, quote):
    df = spark.createDataFrame([(evidence, metric, value)], "e string, m string, v double")
    assert df.select(gates.exact_quote(F.col("e"), F.col("m"), F.col("v"))).first()[0] == quote


def test_repair_of_nulls(spark):
    f = spark.createDataFrame([(1, 1, None, None, None, None, None, None), (2, 2, "sales", "", 2020, 5.0, None, "total")], "case_id int, fact_id int, metric_raw string, metric_canonical string, year int, value double, unit string, fact_role string")
    c = spark.createDataFrame([(2, None, None, "sales 5")], "case_id int, question string, expected_answer string, evidence string")
    got = {r.fact_id: (r.period_role, r.repaired_unit, r.role, r.reject_reason) for r in gates.repair_facts(f, c).collect()}
    assert got == {1: ("other", "numeric", "component", "exact_quote_recovery_failed"), 2: ("reporting_period", "USD_millions", "total", None)}


@pytest.mark.parametrize(("method", "classification", "label"), [("vector_only_v7", "per_case_evidence_only", "case_text_only_v7"), ("vector_only_v18", "per_case_evidence_only", "case_text_only_v18"), ("vector_single_v15", "unknown", "unknown"), (None, "unknown", "unknown")])
def test_provenance(spark, method, classification, label):
    r = one(spark, gates.provenance, method)
    assert (r["classification"], r["label"]) == (classification, label)


def test_average_of_negative_values(spark):
    df = spark.createDataFrame([(-0.00005,), (-0.0001,), (None,)], "v double")
    assert df.agg(gates.average(F.col("v"))).first()[0] == -0.0001
    assert df.where("v is null").agg(gates.average(F.col("v"))).first()[0] == 0.0
    assert spark.createDataFrame([(3e14,), (4e14,)], "v double").agg(gates.average(F.col("v"))).first()[0] == 3.5e14


def test_triage_of_nulls(spark):
    schema = "coverage_status string, observations int, company_sensitive boolean, metric_sensitive boolean, value_sensitive boolean, unit string, year int, period_label string, exact_quote boolean, company string, ticker string"
    rows = [(None,) * 11, ("x", 1, None, None, None, "u", 2020, None, True, "c", "t")]
    got = [(r.classes, r.primary, r.patch_type.split("_")[2], r.risk) for r in gates.triage(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(["missing_observation", "unit_mismatch", "year_or_period_mismatch", "evidence_quote_mismatch"], "missing_observation", "create", "high"), (["unresolved_manual_review"], "unresolved_manual_review", "normalize", "medium_high")]


def test_flags_and_clean_means(spark):
    df = spark.createDataFrame([(1, "a", ["rounding"], 1.0), (1, "b", ["ambiguous_formula"], 0.0), (2, "a", None, 0.5), (2, "b", [], None)], "case_id int, method string, warnings array<string>, m double")
    assert {r.case_id: tuple(r)[1:] for r in gates.case_flags(df).collect()} == {1: (["a", "b"], ["ambiguous_formula", "rounding"], True), 2: ([], [], False)}
    assert {r.method: (r.clean, r.m) for r in gates.clean_means(df, ("a", "b", "c"), ("m",)).collect()} == {"a": (2, 0.75), "b": (1, 0.0), "c": (0, 0.0)}


def test_gate_and_audit_of_empty_inputs(spark):
    rows, o = spark.createDataFrame([], "case_id string, raw_count int"), spark.createDataFrame([], "case_id string, ticker string, metric string, year int, value double, verified boolean, place int")
    r = gates.smoke_gate(rows, o).first()
    assert (r.cases, r.observations, r.mapped_ratio, r.duplicate_consistency, r.passes) == (0, 0, 0.0, 1.0, False)
    a = gates.input_audit(spark.createDataFrame([], "id int, evidence string, answer string"), spark.createDataFrame([], "slice string, id int"), spark.createDataFrame([], "id int"), "S")
    assert {(r.kind, r.name): r.n for r in a.collect()} == {("input", n): 0 for n in ("rows", "unique_ids", "duplicate_ids", "missing_evidence", "missing_answer", "manifest_ids_missing")} | {("gate", "passes"): 0}


def test_lookup_thresholds(spark):
    facts = spark.createDataFrame([(f"f{k}", "T", "net_income" if k < 3 else f"m{k}", 2020, 1.0, "b", None) for k in range(22)] + [("old", "T", "m", 2020, 1.0, "b", "deprecated"), ("other", "T", "m", 2020, 1.0, "c", None)], "fact_id string, ticker string, metric string, year int, value double, kg_batch string, status string")
    cases = spark.createDataFrame([(1, "T", [2020], ["Net_Income"]), (2, "T", [2020], ["net"]), (3, "T", [2020], None), (4, "T", [2019], ["income"])], "case_id int, ticker string, years array<int>, tags array<string>")
    count = lambda f: {r.case_id: r["count"] for r in coverage.lookup(cases, f, "b").groupBy("case_id").count().collect()}
    assert count(facts) == {1: 3, 2: 22, 3: 22}
    assert count(facts.where("fact_id <> 'f0'")) == {1: 21, 2: 21, 3: 21}  # two hits are too few
    assert count(facts.where("metric <> 'm9' and metric <> 'm8'")) == {1: 20, 2: 20, 3: 20}  # twenty are not too many


def test_sides_without_hits(spark):
    cases = spark.createDataFrame([(1, "A", "B"), (2, "A", "A")], "case_id int, company_a string, company_b string")
    sources = spark.createDataFrame([(1, "A", 10), (1, "A", 11), (1, "B", 12), (2, "A", 13)], "case_id int, ticker string, source_id int")
    hits = spark.createDataFrame([(1, 10, "x"), (1, 10, "x"), (1, 99, "B")], "case_id int, source_id int, ticker string")
    got = {r.case_id: tuple(r)[1:] for r in coverage.sides_found(cases, sources, hits).collect()}
    assert got == {1: (True, True, True, 1.0, 0.5, 0.0), 2: (False, False, False, 0.0, 0.0, 0.0)}


def test_merged_contracts(spark):
    slot = "array<struct<name:string,expected:string,unit:string>>"
    s = spark.createDataFrame([(1, "clean", 0, False, []), (1, "dev", 1, False, [("s", "1", "")]), (2, "clean", 0, False, [("a", "1", "")]), (2, "test", 2, True, []), (3, "clean", 0, False, None)], f"case_id int, origin string, priority int, overrides boolean, slots {slot}")
    f = spark.createDataFrame([(2, "m", 2020, 5.0, "u", 2), (2, "k", None, 6.0, None, 1), (2, "m", 2020, 5.0, "u", 3), (1, "m", 2020, 5.0, "u", 1)], "case_id int, metric string, year int, value double, unit string, place int")
    got = {r.case_id: (r.origin, [tuple(x) for x in r.slots], r.filled) for r in contracts.merge(s, f).collect()}
    assert got == {1: ("dev", [("s", "1", "")], False), 2: ("test", [("source_k__01", "6.0", ""), ("source_m_2020_02", "5.0", "u")], True), 3: ("clean", [], False)}


def test_samples_pass_on_what_is_full(spark):
    df = spark.createDataFrame([(k, k % 2 == 0) for k in range(6)], "i int, even boolean")
    got = sorted((r.bucket, r.i, r.place) for r in select.samples_in_turn(df, [("even", F.col("even"), 1), ("any", F.lit(True), 3), ("even2", F.col("even"), 5)], ["i"]).collect())
    assert got == [("any", 1, 1), ("any", 2, 2), ("any", 3, 3), ("even", 0, 1), ("even2", 4, 1)]


@pytest.mark.parametrize(("question", "ticker"), [("x (EPS) (GOOG)", "GOOG"), ("sales, IBM.", "IBM"), ("growth for T and US", "T"), ("MSFT 2021", "MSFT"), ("how did NVDA do", "NVDA"), ("Apple rose", "APPLE"), ("IBM or HP", "IBM"), (None, "CE3B0C"), ("who grew?", None)])
def test_tickers(spark, question, ticker):
    got = one(spark, text.ticker_of, question)
    assert got == ticker if ticker else got.startswith("C") and len(got) == 6


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "text": "t", "question": "q", "answer": "5"}, {"_id": "2", "references": "r", "type": "Addition", "expected_answer": "6"}], indent=1))
    got = sorted(tuple(r) for r in io.read_json_cases(spark, str(tmp_path / "*.json")).collect())
    assert got == [("1", "", "", "t", "q", "5"), ("2", "", "Addition", "r", "", "6")]
    logs = tmp_path / "logs" / "deep"
    logs.mkdir(parents=True)
    (logs / "x.md").write_text("id_1\nid_2 id_1")
    (logs.parent / "y.csv").write_text("APD\nid_1")
    got = {(r.case_id, r.category): len(r.sources) for r in io.exposures(spark, str(tmp_path / "logs"), r"id_\d", "apd", ("seen", "informed")).collect()}
    assert got == {("id_1", "seen"): 1, ("id_2", "seen"): 1, ("id_1", "informed"): 1}
    t = spark.createDataFrame([([["a", None], ["b", "1"]], None, ["x", "y"])], "t array<array<string>>, pre array<string>, post array<string>")
    assert t.select(io.table_evidence("t", "pre", "post")).first()[0] == "a | \nb | 1\nx y"
    assert t.select(io.context_evidence("t", "post")).first()[0] == "TABLE\na\t\nb\t1\n\nCONTEXT\nx\ny"
