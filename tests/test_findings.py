"""Cases by hand for what reviews found."""

import datetime
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import checks, evidence, gates, pairs, select, suite
from factloom.plans import registry
from factloom.sources import fixtures as fx
from tests.test_plans import plain

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def line(order, number, price, supplier=1, flag="A", year=1995, quantity=20.0):
    return (order, 1, supplier, number, quantity, price, 0.05, 0.02, flag, "O", datetime.datetime(year, 3, 1))


def twins_agree(spark, folder, name, **tables):
    """Whether query and twin give the same rows over these tables, and the rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return got, got == sorted(tuple(plain(v) for v in r) for r in want)


def test_a_percentage_is_also_read_as_a_ratio(spark, tmp_path):
    """100000 percent stands for 1000 as a ratio, so the first slot's answer is right for two slots of three."""
    orders = [(1, 1, "O", 1.0, datetime.datetime(1995, 1, 1), "1")]
    lines = [line(1, 1, 100000.0), line(1, 2, 1004.0), line(1, 3, 50000.0)]
    got, same = twins_agree(
        spark, tmp_path, "sc12_slot_self_test", lineitem=(lines, LINE),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
    )
    assert same
    assert ("1", "wrong_year", "True", "0.6667") in [tuple(r) for r in got]


@pytest.mark.parametrize("block", [2, 1000])
def test_blocks_make_every_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    cells = spark.createDataFrame([(f"c{i}", m, y, float(10 * i + y)) for i in range(7) for m in ("net_income", "total_revenue") for y in (1, 2, 3) if (i + y) % 5], "ticker string, metric string, year int, value double")
    rows = [r.asDict() for r in cells.collect()]
    want = sorted((a["metric"], a["year"], a["ticker"], b["ticker"]) for a in rows for b in rows if (a["metric"], a["year"]) == (b["metric"], b["year"]) and a["ticker"] < b["ticker"])
    assert sorted(tuple(r)[:4] for r in pairs.direct_pairs(cells).collect()) == want
    years = {t: sorted(r["year"] for r in rows if r["ticker"] == t and r["metric"] == "total_revenue") for t in {r["ticker"] for r in rows}}
    both = {(a, b): sorted(set(years[a]) & set(years[b])) for a in years for b in years if a < b}
    want = sorted((a, b, y[0], y[-1]) for (a, b), y in both.items() if len(y) > 1)
    assert sorted(tuple(r)[:4] for r in pairs.growth_pairs(cells).collect()) == want


def test_growth_pairs_are_not_shuffled(spark):
    cells = spark.createDataFrame([("a", "total_revenue", 1, 1.0), ("a", "total_revenue", 2, 3.0), ("b", "total_revenue", 1, 2.0), ("b", "total_revenue", 2, 2.5)], "ticker string, metric string, year int, value double")
    plan = pairs.growth_pairs(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_the_capped_pairs_are_the_suite_s_direct_ones(spark):
    """Both take the first pairs of the same order, which the suite's twin finds among all pairs."""
    sf = "/root/testdata/sf0.001"
    cells = pairs.last_value(fx.facts_raw(spark, sf))
    h = suite.cell_hash(F.col("metric"), F.col("year").cast("string"), F.col("ticker"))
    rows = [tuple(r) for r in pairs.usable(cells).select("metric", "year", "ticker", "value", h.alias("h")).collect()]
    edges = [((a[4] + b[4]) % (1 << suite.BITS), a[2], b[2], a[0], a[1]) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and a[3] != b[3]]
    used, want = {}, []
    for rank, a, b, m, y in sorted(edges):
        if len(want) < 40 and used.get(a, 0) < 8 and used.get(b, 0) < 8:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((m, y, a, b, rank))
    got = registry.queries()["w5_capped_pairs"](spark, sf).select("metric", "year", "company_a", "company_b", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_suite_s_values_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    v = spark.createDataFrame([(f"c{i}", float(i)) for i in range(12)], "ticker string, v double")

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    v = v.mapInPandas(count, v.schema).select(F.lit("x").alias("cell"), "ticker", suite.cell_hash(F.col("ticker")).alias("h"), "v")
    assert suite.choose(v, lambda p: p, 3).count() == 3
    assert seen.value == 12


def test_cases_of_one_ticker_are_in_several_tasks(spark):
    f = fx.formula_facts(spark, "/root/testdata/sf0.001").where("case_id % 10 = 0")
    assert f.select(F.spark_partition_id()).distinct().count() > 1


def test_words_of_answers_are_not_shuffled(spark):
    plan = evidence.matches(*fx.answered_facts(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_read_once(spark):
    df = spark.createDataFrame([("1 million",)], "t string")
    assert plan_of(df.select(text.scaled_numbers(F.col("t")).alias("n"))).count("|percent|millions?") == 1


def test_only_spellings_in_the_evidence_become_patterns(spark):
    df = spark.createDataFrame([("Net  income: 1,234.5 or $ 1,234.5", "net income", 1234.5), ("Net income: (7)", "net income", -7.0), ("Net income 8", "net income", 9.0)], "e string, m string, v double")
    q = df.select(gates.exact_quote(F.col("e"), F.col("m"), F.col("v")).alias("q"))
    assert [r.q for r in q.collect()] == ["Net  income: 1,234.5 or $ 1,234.5", "Net income: (7)", None]  # at the first place the longest spelling
    assert "contains" in plan_of(q).lower()


def test_questions_are_read_once_a_case(spark):
    df = registry.queries()["fp7_fact_issues"](spark, "/root/testdata/sf0.001")
    above = plan_of(df).split("Join")[0]
    assert above.count("regexp_extract_all") <= 2  # the fact's own names: in the filter and in the result


def test_contexts_of_cases_with_many_and_with_empty_documents(spark, tmp_path, monkeypatch):
    """Groups of a few links, texts without and of more than 7000 characters."""
    monkeypatch.setattr(select, "LINKS", 4)
    docs = [(i, None if i == 3 else "xyz"[i % 3] * (7100 if i == 1 else i)) for i in range(7)]
    orders = [(k, k % 4, "O", 1.0, datetime.datetime(1995, 1, 1), "1") for k in range(30)] + [(3, 9, "O", 1.0, datetime.datetime(1995, 1, 1), "1")]
    got, same = twins_agree(
        spark, tmp_path, "j16_guided_lookup", documents=(docs, "doc_id long, text string"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
    )
    assert same and len(got) == 5


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def test_the_self_test_has_every_check_and_line(spark, tmp_path):
    """Lines of any number and quantity are slots, all seven answers are tried, and large values have no exponent."""
    orders = [(k, 1, "O", 1.0, datetime.datetime(1995, 1, 1), "1") for k in range(1, 12)]
    lines = [line(k, n, price * k, quantity=float(n)) for k in range(2, 11) for n, price in enumerate([50.0, 40.0, 62.9, 1e7 - 8, 2020.0, 0.5, -3.0, 9e8], 1) if n <= k]
    got, same = twins_agree(spark, tmp_path, "sc12_slot_self_test", lineitem=(lines, LINE), orders=(orders, ORDER))
    assert same and len(got) == 11 * 7
    assert ("10", "correct", "True", "1.0") not in [tuple(r) for r in got] and ("8", "correct", "True", "1.0") in [tuple(r) for r in got]  # the fourth of 10 is no number


def test_all_sources_are_in_the_answer(spark):
    slot = "array<struct<name:string,expected:string,unit:string>>"
    rows = [(1, [("a", "700", "amount")], [("m", 2020, str(100 * i), "u") for i in range(1, 8)])]
    df = spark.createDataFrame(rows, f"case_id int, slots {slot}, facts array<struct<metric:string,year:int,value:string,unit:string>>")
    assert [(r.score, r.passes) for r in checks.self_test(df).where("check = 'source_only'").collect()] == [(1.0, False)]


CELLS = "ticker string, metric string, year int, value double"


def test_a_row_goes_to_one_block_more_than_there_are_parts(spark, monkeypatch):
    """Two parts meet once, so both sides together hold half the copies."""
    monkeypatch.setattr(pairs, "BLOCK", 3)
    cells = spark.createDataFrame([(f"c{i}", m, 1, float(i)) for i in range(12) for m in ("net_income", "total_revenue")], CELLS)
    left, right, by = pairs.in_blocks(cells, ["metric", "year"])
    assert left.count() + right.count() == 24 * (4 + 1) and left.where("i > j").count() == right.where("i > j").count() == 0


@pytest.mark.parametrize("v", [0.00005, -0.00005, 0.12345, 1.00015, -2.5e-5, 123456.78905, 1e12 + 0.3, 7.5e8 + 0.00004999, 0.0, -0.00001, float("inf"), 2.0**40 / 1e4 + 0.00005])
def test_fast_rounding_is_the_exact_one(spark, v):
    d = F.col("v")
    r = spark.createDataFrame([(v,)], "v double").select(pairs.sure(d, F.round(d, 4)).alias("a"), F.round(d, 4).alias("b")).first()
    assert repr(r.a) == repr(r.b)


def test_growth_of_companies_with_the_same_years_is_worked_out_once(spark):
    cells = spark.createDataFrame([(t, "total_revenue", y, float(v)) for t, vs in {"a": (1, 3), "b": (2, 2.5), "c": (0, 7)}.items() for y, v in enumerate(vs)], CELLS)
    p = pairs.growth_pairs(cells)
    assert "array_intersect" not in plan_of(p)
    assert [tuple(r) for r in p.collect()] == [("a", "b", 0, 1, 200.0, 25.0, "a")]  # c begins with nothing


@pytest.mark.parametrize("size", [2, 8000])
def test_growth_of_companies_with_other_years(spark, monkeypatch, size):
    """Of the years that both have, with equal growth, zeros at either end, and one year or none in common."""
    monkeypatch.setattr(pairs, "BLOCK", size)
    monkeypatch.setattr(pairs, "SMALL", min(size, 1000))
    rows = [(f"c{i}", "total_revenue", y, float((i * 7 + y * y * 3) % 11) * (-1) ** i) for i in range(24) for y in range(i % 4, 6) if (i * y) % 5 != 1 or y == 5 - i % 3]
    years, want = {}, []
    for t, _, y, v in rows:
        years.setdefault(t, {})[y] = v
    for a in years:
        for b in years:
            both = sorted(set(years[a]) & set(years[b]))
            if a < b and len(both) > 1 and years[a][both[0]] and years[b][both[0]]:
                ga, gb = ((years[t][both[-1]] - years[t][both[0]]) / abs(years[t][both[0]]) * 100 for t in (a, b))
                want.append((a, b, both[0], both[-1], round(ga, 4), round(gb, 4), a if ga > gb else b))
    got = pairs.growth_pairs(spark.createDataFrame(rows, CELLS)).collect()
    assert sorted((*r[:4], round(r[4], 4), round(r[5], 4), r[6]) for r in got) == sorted(want)


def test_texts_are_not_sent_to_cases(spark, tmp_path, monkeypatch):
    """Whatever the number of groups, a text is stored once; texts of one id, null, empty and missing ones, and cases without any."""
    monkeypatch.setattr(select, "LINKS", 3)
    docs = [(1, "bé"), (1, "a"), (2, None), (4, ""), (5, "x" * 10), (None, "y")]
    links = [(c, i) for c in range(40) for i in (1, 2, 3, 4, 5) if (c + i) % 3] + [(1, 5), (50, 2), (51, 3), (52, None), (None, 5)]
    df = select.contexts(spark.createDataFrame(links, "case_id long, doc_id long"), spark.createDataFrame(docs, "doc_id long, t string"))
    assert "FlatMapCoGroups" not in plan_of(df)
    want = set()
    for c in {c for c, _ in links}:
        ts = [t for i in sorted({i for k, i in links if k == c and i}) for j, t in sorted(docs, key=lambda x: (x[0] or 0, x[1] or "")) if j == i]
        real = [t for t in ts if t is not None]
        if ts:
            want.add((c, len(ts), sum(map(len, real)) if real else None, hashlib.sha256("\n".join(real).encode()).hexdigest()[:16] if real else None))
    assert {tuple(r) for r in df.collect()} == want
