"""Slots, contracts, graph upkeep, the case suite, evidence, pools and the bounded stream against values worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import contracts, evidence, select, slots, suite, upkeep
from factloom.streaming import ingest

SLOTS = "array<struct<name:string,expected:string,unit:string>>"
TRACE = f"trace_id int, method string, formula_type string, final_answer string, calculation string, slots {SLOTS}, failed boolean, earlier_ac double, earlier_nc double"


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c"))).first()[0]


def test_scaled_numbers(spark):
    got = one(spark, text.scaled_numbers, "case_12 in 2020: (1,234.5), $5 million, -3%, a7 x-8 20201 4 percent")
    assert [tuple(n) for n in got] == [(-1234.5, -1234.5, False), (5.0, 5e6, False), (-3.0, -3.0, True), (8.0, 8.0, False), (20201.0, 20201.0, False), (4.0, 4.0, True)]
    assert one(spark, text.scaled_numbers, None) == []


def scored(spark, **kv):
    row = {"trace_id": 1, "method": "vector", "formula_type": "finqa_program", "final_answer": "x", "calculation": "a / b", "slots": [], "failed": None, "earlier_ac": None, "earlier_nc": None} | kv
    names = [c.split()[0] for c in TRACE.split(", ")]
    return slots.score(spark.createDataFrame([tuple(row[n] for n in names)], TRACE)).first()


@pytest.mark.parametrize(
    ("kv", "ac", "recall", "reason"),
    [
        ({"final_answer": "10.4", "slots": [("a", "10", "")]}, 1, 1.0, "none"),
        ({"final_answer": "10.4", "formula_type": "ratio", "slots": [("a", "10", "")]}, 0, 0.0, "formula_target_mismatch"),
        ({"final_answer": "1000", "slots": [("a", "10", "")]}, 1, 1.0, "none"),  # a hundredfold
        ({"final_answer": "1000", "method": "graph_neo4j_v9", "slots": [("a", "10", "")]}, 0, 0.0, "formula_target_mismatch"),
        ({"final_answer": "10", "calculation": "20 = 20", "slots": [("a", "10", ""), ("b", "20", ""), ("c", "70", "")]}, 0, 0.6667, "formula_target_mismatch"),
        ({"final_answer": "10", "calculation": "20", "slots": [("a", "10", ""), ("b", "20", "")]}, 0, 1.0, "scoring_uncertain"),
        ({"final_answer": "10", "calculation": "", "slots": [("a", "10", "")]}, 0, 1.0, "answer_format_error"),
        ({"final_answer": "10", "slots": []}, 0, 0.0, "no_target_slots"),
        ({"final_answer": "10", "slots": None}, 0, 0.0, "no_target_slots"),
        ({"final_answer": "10", "slots": [("a", "n/a", "")]}, 0, 0.0, "formula_target_mismatch"),
        ({"final_answer": "10", "failed": True, "slots": [("a", "10", "")]}, 0, 1.0, "provider_error"),
        ({"final_answer": None, "calculation": None, "earlier_ac": 1.0, "earlier_nc": 0.5, "slots": [("a", "10", "")]}, 1, 1.0, "none"),
    ],
)
def test_slots(spark, kv, ac, recall, reason):
    r = scored(spark, **kv)
    assert (r.ac, r.recall, r.failure_reason) == (ac, recall, reason)
    assert r.note == ("original_success_preserved" if kv.get("earlier_ac") else None)


def test_closeness_is_the_mean_over_slots(spark):
    r = scored(spark, final_answer="9", slots=[("a", "10", ""), ("b", "n/a", "")])
    assert r.nc == 0.45 and r.matched == "" and r.missing == "a;b"


def test_recall_by_unit(spark):
    schema = f"final_answer string, calculation string, slots {SLOTS}, facts array<struct<expected:string,unit:string,year:int>>"
    rows = [("12.34%", "ratio", [("a", "0.1234", "x")], [("5", "amount", 2020)]), ("5 million in 2020", "=", [("a", "5000000", "amount")], [("5", "amount", 2020)]), ("1", "=", [], [])]
    got = slots.score_by_recall(spark.createDataFrame(rows, schema)).select("recall", "fact_recall", "ac", "ac_faithful", "gated_reason").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 1, 0, "required_fact_missing"), (1.0, 1.0, 1, 1, "none"), (0.0, 0.0, 0, 0, "required_fact_missing")]


def case_facts(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "case_id int, metric string, year int, value double, place int")


def test_roles_and_targets(spark):
    cases = spark.createDataFrame([(1, "How did Inventory Turnover go?", None), (2, "What drove growth?", ""), (3, "EPS?", None), (4, None, None), (5, "Liquidity", None), (6, "tax rate", None)], "case_id int, question string, expected_answer string")
    facts = case_facts(spark, [
        (1, "cost_of_sales", 2023, 90.0), (1, "Inventories", 2023, 10.0), (1, "inventories", 2022, 20.0), (1, "inventories", 2021, 5.0), (1, "cost_of_sales", 2022, 50.0),
        (2, "Total Revenue", 2019, -10.0), (2, "Total Revenue", 2021, 5.0), (2, "Total Revenue", 2022, 0.0), (2, "Total Revenue", 2023, 7.0),
        (3, "net_income", 2020, 1.0), (3, "net_income", 2020, 6.0), (3, "diluted_shares", 2020, 4.0), (3, "diluted_shares", 2021, 4.0),
        (5, "current_assets", 2020, 3.0), (5, "current_liabilities", 2020, 0.0),
        (6, "income_tax_expense", 2020, -2.0), (6, "earnings_before_income_taxes", 2020, 8.0),
    ])
    roles = contracts.resolve(cases, facts)
    got = {r.case_id: (r.formula_type, r.numerator, r.denominator, r.ambiguous) for r in roles.collect()}
    assert got == {
        1: ("inventory_turnover", "cost_of_sales", "inventories", False), 2: ("revenue_growth", "total_revenue", "prior_period_revenue", False), 3: ("eps_reconciliation", "net_income", "diluted_shares", False),
        4: ("ambiguous_manual_review", "", "", True), 5: ("current_ratio", "current_assets", "current_liabilities", False), 6: ("tax_rate_ratio", "income_tax_expense", "earnings_before_income_taxes", False),
    }
    slots_ = sorted((r.case_id, r.slot, r.expected, r.unit, r.years) for r in contracts.targets(roles, facts).collect())
    assert slots_ == [
        (1, "inventory_turnover_2023", 6.0, "ratio", [2023, 2022]), (2, "revenue_growth_2021_vs_2019", 150.0, "percentage", [2021, 2019]), (2, "revenue_growth_2022_vs_2021", -100.0, "percentage", [2022, 2021]),
        (3, "eps_reconciliation_2020", 1.5, "amount", [2020]), (6, "tax_rate_ratio_2020", 25.0, "percentage", [2020]),
    ]


def test_programs_and_derivations(spark):
    run = lambda p: one(spark, contracts.run_program, p)
    assert run("subtract(5, 3), divide(#0, const_4), multiply(#1, const_m2)") == [2.0, 0.5, -1.0]
    assert run("divide(5, 0), add(#0, 1), add(#9, 1), greater(3, 2), add(50%, 1)") == [None, None, None, 1.0, 1.5]
    assert run(None) == [] and run("no steps") == []
    assert one(spark, contracts.derivation_operands, "(1,234.5 - 7) / -3 " + "+ 1 " * 20) == [1234.5, 7.0, -3.0] + [1.0] * 9


def store_facts(spark, rows):
    return spark.createDataFrame(rows, "case_id string, ticker string, metric string, year int, value double, unit string, quote string, place int")


def test_resume_and_roll_back(spark, tmp_path):
    store = upkeep.Store(spark, f"file://{tmp_path}/graph")
    a = store_facts(spark, [("c1", "aa", "net_income", 2020, 1.0, "u", "q", 1), ("c1", "aa", "net_income", 2021, 2.0, "u", "q", 2)])
    b = store_facts(spark, [("c2", "bb", "net_income", y, float(y), "u", "q", y - 2000) for y in range(2010, 2020)])
    state = lambda: (sorted(map(tuple, store.observations().collect())), sorted(map(tuple, store.log().collect())))
    assert state() == ([], [])
    store.write(a, "b1")
    first = state()
    assert [r[0] for r in first[0]] == ["b1__c1__AA__net_income__2020__01", "b1__c1__AA__net_income__2021__02"] and len(first[1]) == 2
    with pytest.raises(ValueError, match="there already"):
        store.write(b, "b1")
    store.write(b.limit(4), "b2")
    store.write(b, "b2", resume=True)
    store.write(b, "b2", resume=True)
    assert {r.kg_batch: (r.observations, r.logged, r.companies) for r in store.census().collect()} == {"b1": (2, 2, 1), "b2": (10, 10, 1)}
    store.roll_back("b2")
    assert state() == first
    store.write(b, "b2")
    assert store.written("b2").count() == 10
    with pytest.raises(ValueError, match="name of a batch"):
        store.roll_back("b2/../b1")


def test_a_log_that_broke_off_is_completed(spark, tmp_path):
    store = upkeep.Store(spark, f"file://{tmp_path}/graph")
    b = store_facts(spark, [("c2", "bb", "net_income", y, 1.0, "u", "q", 1) for y in range(2010, 2014)])
    store.write(b, "b2")
    spark.createDataFrame([], upkeep.LOGGED).write.mode("overwrite").parquet(f"file://{tmp_path}/graph/log/kg_batch=b2")
    store.write(b, "b2", resume=True)
    assert store.log().count() == store.observations().count() == 4


def test_merged_nodes_and_edges(spark):
    schema = "obs_id string, ticker string, company string, metric string, display string, year int, value double, unit string, at int"
    f1 = spark.createDataFrame([("o1", "T", "First", "m", "M", 2020, 1.0, "u", 1), ("o2", "T", "Second", "m", "", 2020, 2.0, None, 2)], schema)
    f2 = spark.createDataFrame([("o2", "T", "Third", "m", "X", 2020, 3.0, "v", 3), ("o3", "S", None, "k", "K", 2021, 4.0, "w", 4)], schema)
    (n1, e1), (n2, e2) = upkeep.graph_rows(f1), upkeep.graph_rows(f2)
    one_n, one_e = upkeep.merge_nodes(n1.limit(0), n1), upkeep.merge_edges(e1.limit(0), e1)
    n, e = upkeep.merge_nodes(one_n, n2), upkeep.merge_edges(one_e, e2)
    got = {(r.label, r.id): (r.on_create, r.on_set, r.created) for r in n.collect()}
    assert got["Company", "T"] == ({"name": "First"}, {}, False) and got["Company", "S"] == ({}, {}, True)
    assert got["Observation", "o2"] == ({"created_at": "2"}, {"value": "3.0", "unit": "v", "ticker": "T"}, False)
    assert got["Metric", "m"][0] == {"display_name": "M"} and len(got) == 9
    counts = {(r.kind, r.name): (r.created, r.total) for r in upkeep.created_counts(n, e).collect()}
    assert counts == {("node", "Company"): (1, 2), ("node", "Metric"): (1, 2), ("node", "FiscalYear"): (1, 2), ("node", "Observation"): (1, 3), ("edge", "MENTIONS_COMPANY"): (1, 3), ("edge", "OBSERVES_METRIC"): (1, 3), ("edge", "OBSERVED_IN_YEAR"): (1, 3)}
    census = {(r.kind, r.name, r.detail): r.n for r in upkeep.property_census(n.select("label", "id", F.map_concat("on_create", "on_set").alias("properties")), e, {"Company": "name"}).collect()}
    assert census["key", "Company", "set"] == census["key", "Company", "null"] == 1 and census["target", "OBSERVES_METRIC", "Metric"] == 3 and census["property", "Observation", "unit"] == 3


def test_integrity(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "case_id int, method string")
    c = spark.createDataFrame([(1, "x", "y"), (2, "x", "z")], "case_id int, company_a string, company_b string")
    s = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "case_id int, ticker string")
    m = spark.createDataFrame([("net_income",), ("source_value_1",), ("X",), (None,)], "metric string")
    got = {r.check: (r.found, r.expected, r.ok) for r in upkeep.integrity(t, c, s, m, 2, 4).collect()}
    assert got == {"duplicate_case_method": (1, 0, False), "trace_rows": (3, 4, False), "cases_without_a_side": (1, 0, False), "observations": (4, 4, True), "placeholder_metrics": (1, 0, False), "bad_metric_names": (2, 0, False)}


@pytest.mark.parametrize("below", [1, 1 << 40, (1 << 56) // 3, (1 << 56) // 7, 1 << 56])
def test_low_pairs_are_all_pairs_below_a_rank(spark, below):
    rng = random.Random(below)
    rows = [(c, f"t{i}", rng.choice([0, 1, (1 << 56) - 1, rng.randrange(1 << 56)]), float(i)) for c in ("x", "y") for i in range(30)]
    got = suite.low_pairs(spark.createDataFrame(rows, "cell string, ticker string, h long, v double"), below)
    want = sorted((c, a, b, (ha + hb) % (1 << 56)) for (c, a, ha, _), (d, b, hb, _) in itertools.product(rows, rows) if c == d and a < b and (ha + hb) % (1 << 56) < below)
    assert sorted((r.cell, r.company_a, r.company_b, r["rank"]) for r in got.collect()) == want


def test_suite_makes_no_full_pair_table(spark):
    values = spark.range(20000).select(F.lit("c").alias("cell"), F.concat(F.lit("t"), "id").alias("ticker"), suite.cell_hash(F.col("id").cast("string")).alias("h"), F.rand(1).alias("v"))
    pairs = suite.low_pairs(values, int((1 << 56) * 1280 / (20000 * 19999 / 2)))
    assert 1000 < pairs.count() < 1600
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "bucket" in plan


def test_suite(spark):
    rows = [(f"t{i}", m, y, float(10 * i + y - 2000 + len(m))) for i in range(6) for m in ("total_revenue", "gross_profit") for y in (2001, 2002)]
    f = spark.createDataFrame(rows, "ticker string, metric string, year int, value double")
    s = suite.build(f, f, {"L1_direct": 5, "L2_derived": 4, "L3_trend": 3}, 2).collect()
    assert [sum(r.level == k for r in s) for k in ("L1_direct", "L2_derived", "L3_trend")] == [5, 4, 3]
    value = {(t, m, y): v for t, m, y, v in rows}
    for r in s:
        a, b, d = (x.expected for x in r.target_slots)
        assert d >= 0 and abs(d - abs(a - b)) < 2e-4 and r.winner == (r.company_a if a > b else r.company_b)
        if r.level == "L1_direct":
            assert r.source_fact_numbers == [value[r.company_a, r.metric, r.year], value[r.company_b, r.metric, r.year]]
        for t in {r.company_a, r.company_b}:
            assert sum(t in (x.company_a, x.company_b) for x in s if x.level == r.level) <= 2


def test_evidence(spark):
    facts = spark.createDataFrame([(1, 1, "total_revenue", "Acme", 2020, 5.0, "currency_millions"), (1, 2, "net_margin", None, None, 12.5, "percent"), (1, 3, "x", "Acme", 2019, 7.0, None), (2, 4, "a", "b", 1, 1.0, "")], "case_id int, fact_id int, metric string, entity string, year int, value double, unit string")
    answers = spark.createDataFrame([(10, 1, "ACME had Total revenue of 5 million in 2020; margin 12.4%"), (11, 1, None)], "trace_id int, case_id int, text string")
    got = {(r.trace_id, r.fact_id): (r.value_found, r.year_found, r.metric_found, r.entity_found, r.matched) for r in evidence.matches(facts, answers).collect()}
    assert got[10, 1] == (True, True, True, True, True) and got[10, 2] == (True, True, True, True, True) and got[10, 3] == (False, False, True, True, False)
    assert got[11, 1] == (False, False, False, False, False) and got[11, 2] == (False, True, False, True, False) and len(got) == 6
    assert {r.trace_id: r.recall for r in evidence.recall(evidence.matches(facts, answers)).collect()} == {10: 0.6667, 11: 0.0}


def test_pools(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Unknown", *"abcdef"]), rng.choice(["P", "Q", "R"]), rng.choice(["Financials", "Company Overview", "Risk"]), rng.choice(["S1_FIN_COMP", "S3_CO_COMP", "S6_BASELINE_SINGLE"]), rng.randrange(4), rng.randrange(5, 12), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "source_id long, company string, ticker string, category string, slice string, facts int, quality int, fairness int")
    quotas = {"dev": 8, "test": 8, "control": 3, "demo": 4, "overview": 3, "per_ticker": 1}
    got = select.pools(df, ("P", "Q"), 8, quotas).collect()
    by = {k: [r for r in got if r.split == k] for k in ("dev", "test", "control", "demo", "rejected")}
    assert sum(map(len, by.values())) == len(got) == 300 and len({r.source_id for r in got}) == 300
    assert len(by["dev"]) == 8 and len(by["test"]) == 8 and len(by["control"]) == 3 and len(by["demo"]) == 2
    firms = [r.company for r in by["test"] if r.company != "Unknown"]
    assert len(firms) == len(set(firms)) and all(r.reason for r in by["rejected"]) and not any(r.reason for k in by if k != "rejected" for r in by[k])
    # the sequential choice over all rows
    best = sorted((r for r in rows if r[5] >= 2 and r[6] >= 8 and r[4] != "S6_BASELINE_SINGLE"), key=lambda r: (-r[6], -r[7], r[0]))
    want = select.deal_in_turn([(r[0], r[1]) for r in best if r[3] == "Company Overview"], [(r[0], r[1]) for r in best if r[3] == "Financials"], quotas)
    assert {r.source_id: r.split for k in ("dev", "test") for r in by[k]} == want


def log(spark, path, rows):
    spark.createDataFrame(rows, "trace_id long, model string, tokens long, ts string").coalesce(1).write.mode("append").json(path)


def test_stream_with_a_watermark(spark, tmp_path):
    args = (spark, f"{tmp_path}/logs", f"{tmp_path}/state", f"{tmp_path}/totals", {"m": 1e5}, 3.0)
    (tmp_path / "logs").mkdir()
    assert ingest.run_once(*args).collect() == []
    for n in range(4):
        log(spark, args[1], [(n, "m", 10, f"2024-01-01 0{n}:00:00"), (n, "m", 10, f"2024-01-01 0{n}:00:00"), (0, "m", 10, "2024-01-01 00:00:00")])
        got = [tuple(r) for r in ingest.run_once(*args).collect()]
        assert got == [("m", n + 1, 10 * (n + 1), float(n + 1), n + 1 > 3)]
    assert len(ingest.versions(spark, args[3])) == 2  # older totals are gone


def test_stream_stops_at_the_limit(spark, tmp_path):
    args = (spark, f"{tmp_path}/logs", f"{tmp_path}/state", f"{tmp_path}/totals", {"m": 1e5}, 3.0)
    for n in range(6):
        log(spark, args[1], [(n, "m", 10, f"2024-01-01 0{n}:00:00")])
    for _ in range(2):
        with pytest.raises(ingest.OverLimit):
            ingest.run_once(*args, files=1, stop=True)
        assert ingest.newest(spark, args[3]).first()["calls"] == 4
