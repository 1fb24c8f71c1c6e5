"""Every query against its DuckDB twin on the smallest tables; the few without one against plain Python."""

import math
import random

import duckdb
import pytest

from factloom.operators import extract, pairs, report
from factloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)


def greedy(edges, target, cap):
    used, out = {}, []
    for r, a, b in sorted(edges):
        if len(out) < target and used.get(a, 0) < cap and used.get(b, 0) < cap:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize(("seed", "first"), [(1, None), (2, 5)])
def test_capped_pairs_equal_the_sequential_choice(spark, seed, first):
    rng = random.Random(seed)
    edges = [(rng.random(), f"c{a}", f"c{b}") for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.7]
    df = spark.createDataFrame([(a, b, r) for r, a, b in edges], "company_a string, company_b string, rank double")
    got = pairs.capped(df, "rank", 6, 2, first).select("company_a", "company_b").collect()
    assert sorted(tuple(r) for r in got) == greedy(edges, 6, 2)


def test_extracted_facts():
    text = "Balance\n2021 2020\nRevenue 1,200 (30)\nCosts\n$5\n7\nnote without numbers\n2019\nRevenue 9"
    assert extract.facts_in(text) == [("Revenue", 2021, 1200.0), ("Revenue", 2020, -30.0), ("Costs", 2021, 5.0), ("Costs", 2020, 7.0), ("Revenue", 2019, 9.0)]


def test_case_ids_are_looked_for_in_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 500 + " case_77 and " + "y" * 500, "web"), (2, "case_77 first", "book")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["io5_case_ids_in_texts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("case_1", "web"), ("case_2", "book"), ("case_77", "book,web")]


def test_kappa_of_a_textbook_table(spark):
    counts = {(0, 0): 20, (0, 1): 5, (1, 0): 10, (1, 1): 15}
    rows = [(i, j, c) for i, pair in enumerate(p for p, n in counts.items() for _ in range(n)) for j, c in zip(("a", "b"), pair)]
    got = report.cohen(spark.createDataFrame(rows, "item int, judge string, code int")).first()
    assert (got.n, got.agreement, got.kappa) == (50, 0.7, 0.4)
