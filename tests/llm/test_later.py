"""Operators 11 to 13 against brute force, held-out labels, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import near, quality, registry, sharding, trie, vectors, whitening

SF = "/root/testdata/sf0.001"


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# 11


@pytest.mark.parametrize("kind", ["gauss", "eye", "zero", "diagonal", "few rows", "graded", "multiple", "cluster", "one", "rank one"])
def test_directions(kind):
    rng = np.random.default_rng(1)
    g, q = rng.standard_normal((64, 64)), np.linalg.qr(rng.standard_normal((64, 64)))[0]
    r = {
        "gauss": np.linalg.qr(rng.standard_normal((1000, 64)), mode="r"), "eye": np.eye(64), "zero": np.zeros((8, 8)), "diagonal": np.diag([3.0, 3, 2, 2, 1, 0, 0, 0]),
        "few rows": np.vstack([g[:5], np.zeros((59, 64))]), "graded": g * 10.0 ** (-np.arange(64) / 4), "multiple": (q * np.repeat([5, 4, 3, 2], 16)) @ q,
        "cluster": (q * (5 + 1e-9 * np.arange(64))) @ q, "one": np.array([[2.0]]), "rank one": np.ones((4, 4)),
    }[kind]
    sigma, v = whitening.directions(r, 32)
    want = np.linalg.svd(r, compute_uv=False)
    assert len(sigma) == min(32, (want > 1e-12 * want[0]).sum())
    if len(sigma):
        assert np.abs(sigma / want[: len(sigma)] - 1).max() < 1e-12
        assert np.abs(r.T @ (r @ v) - v * sigma**2).max() < 1e-12 * want[0] ** 2
        assert np.abs(v.T @ v - np.eye(len(sigma))).max() < 1e-11


def check_whitened(rows, vectors):
    """vectors: (vec_id, list of floats), all of one length."""
    x = np.floor(64 * np.array([v for _, v in vectors], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    cov = c.T @ c / n
    want = np.linalg.eigvalsh(cov)[::-1]
    k = min(32, int((want > 1e-9 * want[0]).sum()))
    assert len(rows) == n * k
    by = defaultdict(list)
    for r in rows:
        by[r.vec_id].append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (want[r.component - 1] / want.sum()) - 1) < 1e-9
    ids = [i for i, _ in vectors]
    if len(set(ids)) == n:
        y = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in ids])
        assert all(by[i][0].deviation == d for i, d in zip(ids, ((n * x - s) ** 2).sum(1).tolist()))
        v = np.linalg.lstsq(c, y * np.sqrt(want[:k]), rcond=None)[0]  # the directions, from the projections
        assert np.abs(cov @ v - v * want[:k]).max() < 1e-8 * want[0]


def test_op11(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in e if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check_whitened(registry.queries()["op11_qd_whitening"](spark, SF).collect(), good)


def test_op11_odd_rows(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int, n long, x int, width int"
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, [1.0, nan, 2.0]), (92, [inf, 0.0, 0.0]), (93, [None, 1.0, 2.0]), (94, [])]
    good = [(i, [float(i % 5), float(i * i % 7) / 3, float(i % 2)]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in bad + good], schema)
    check_whitened(registry.queries()["op11_qd_whitening"](spark, write(spark, tmp_path, embeddings=df)).collect(), good)
    repeated = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in good + good[:3] + [(None, good[0][1])]], schema)
    check_whitened(whitening.whiten(repeated).collect(), good + good[:3] + [(None, good[0][1])])
    lengths = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in good + [(i + 50, v[:2]) for i, v in good]], schema)
    rows = whitening.whiten(lengths).collect()
    check_whitened([r for r in rows if r.vec_id < 50], good)
    check_whitened([r for r in rows if r.vec_id >= 50], [(i + 50, v[:2]) for i, v in good])
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []  # one vector has no variance
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0], 1, 2, 3, 4) for i in range(4)], schema)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(Exception, match="quantised range"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 1, 2, 3, 4)], schema)).collect()


def test_op11_factors_meet_in_a_tree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(150)
    check_whitened(whitening.whiten(df).collect(), rows)


# 12


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    full = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(conv.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^ \t-\r]+", k[-1][1])) if k else 0
        leaves = sum(out[j][5] for j in children[k]) if children[k] else 1
        saved = sum(out[j][6] for j in children[k]) + (len(members[k]) - 1) * words
        ends = ",".join(str(c) for c in members[k] if len(full[c]) == len(k))
        out[k] = (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in registry.queries()["op12_prefix_trie"](spark, SF).collect()]
    assert sorted(got, key=str) == brute_trie(rows)


def odd_conversations():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "x:y", "é ü"])) for c in range(-45, 90) for t in range(rng.randrange(5))]
    rows += [(c, t, "user", f"turn {t}") for c in (100, 101, 102, 103, 104) for t in range(200 - (c == 104))]  # several units, one shorter
    rows += [(c, t, "user", f"turn {t}" if t < 130 else f"other {t}") for c in (105, 106) for t in range(140)]
    rows += [(c, 0, "user", "the same") for c in range(1000, 1300)]  # a hot first turn, and a hot whole conversation
    rows += [(2000, None, "user", "null turn"), (2000, 0, "user", "b"), (2000, 0, "user", "a"), (2000, 0, "user", "a"), (2000, None, None, None), (None, 0, "user", "x")]
    rows += [(2020, 0, "user", "w " * 20000), (2021, 0, "user", "w " * 20000), (2021, 1, "", "")]
    return rows


def test_op12_odd_rows(spark, tmp_path):
    rows = odd_conversations()
    schema = "conv_id long, turn long, role string, text string, n int, p int, key string, block int, depth int"
    df = spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], schema)
    path = write(spark, tmp_path, conversations=df)
    want = brute_trie(rows)
    assert sorted((tuple(r) for r in registry.queries()["op12_prefix_trie"](spark, path).collect()), key=str) == want
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(trie.OP12_SQL).fetchall(), key=str) == want
    empty = write(spark, tmp_path / "empty", conversations=df.limit(0))
    assert registry.queries()["op12_prefix_trie"](spark, empty).collect() == []


def test_op12_does_not_depend_on_the_deal(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    few, many = [], []
    for n, out in ((1, few), (40, many)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", n == 1)
        out += sorted((tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.ordered(df))).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.enabled", True)
    assert few == many == brute_trie(rows)


# 13


def labelled(spark, n=400):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice("the of and to in is that for it was on are as with".split()) + rng.choice(["", "", ","]) + " " + "".join(rng.choice("abcdeilnorst") for _ in range(5)) for _ in range(60)) + "."
    bad = lambda: rng.choice([" | ".join("".join(rng.choice("abcdeilnorst") for _ in range(6)) for _ in range(60)), "spam " * rng.randrange(50, 200), "$$$ %%% &&& " * 30])
    rows = [(i, (good if i % 4 else bad)(), int(i % 4 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, 1, "h", 2.0) for i, t, _ in rows], "doc_id long, text string, quality int, hash string, family double")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), rows


def test_op13_held_out(spark, tmp_path):
    docs, labels, rows = labelled(spark)
    got = {r.doc_id: r for r in registry.queries()["op13_zstd_quality"](spark, write(spark, tmp_path, documents=docs, labels=labels)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and len(held) == sum(r.held_out for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([r.predicted == q for r, q in held]) >= 0.95


def test_op13_equals_scoring_by_hand(spark):
    docs, labels, rows = labelled(spark, 120)
    model = quality.fit_on(docs, labels)
    for r in quality.score_table(docs, model).collect():
        ws = [rows[r.doc_id][1].encode()[k : k + 512] for k in range(0, len(rows[r.doc_id][1].encode()), 512)]
        g, b = (np.array([max(1, len(quality._compressor(d)(w)) - 9) for w in ws]) for d in (model.good, model.bad))
        n = np.array([len(w) for w in ws])
        x = np.array([1, 10 * (b - g).sum() / (b + g).sum(), n[b < g].sum() / n.sum(), n[np.minimum(g, b) < 0.15 * n].sum() / n.sum()])
        assert abs(r.score - 1 / (1 + np.exp(-(x @ model.weights)))) < 1e-12


def test_op13_labels_held_out_are_never_read(spark):
    docs, labels, _ = labelled(spark, 120)
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit_on(docs, labels), quality.fit_on(docs, turned)
    assert one.good == two.good and one.bad == two.bad and (one.weights == two.weights).all()


def test_op13_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    odd = spark.createDataFrame([(900, None, 1, "h", 2.0), (901, "", 1, "h", 2.0), (902, "spam " * 100_000, 1, "h", 2.0), (None, "text", 1, "h", 2.0), (3, "another text of an id", 1, "h", 2.0), (5, "twice", 1, "h", 2.0), (5, "twice", 1, "h", 2.0)], docs.schema)
    more = spark.createDataFrame([(0, 1, 0), (900, 1, 0), (None, 1, 0), (901, None, 0), (902, 7, 0), (5, 1, 0), (5, 1, 0)], labels.schema)
    model = quality.fit_on(docs.unionByName(odd), labels.unionByName(more))
    got = quality.score_table(docs.unionByName(odd), model).collect()
    assert len(got) == 127 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[902] < 0.7
    none = quality.fit_on(docs, labels.limit(0))
    assert {r.score for r in quality.score_table(docs, none).collect()} == {0.5}
    ones = quality.fit_on(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.score_table(docs, ones).collect()}) == 1
    assert quality.score_table(docs.limit(0), model).collect() == []


# mends of earlier operators


def test_op7_tells_query_variants_apart(spark):
    rows = [(100, [-1 / 1024, 0.0]), (100, [-2 / 1024, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 30)]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = []
    for v in (-1, -2):
        hits = sorted((-v * 1024 * i, i) for i in range(1, 30))[:10]
        want += [(100, k + 1, i, -s) for k, (s, i) in enumerate(hits)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_op7_scores_are_bigints(spark, tmp_path):
    op7 = registry.queries()["op7_bit_sliced_topk"]
    rows = [(100 * i, [float(i), 1.0]) for i in range(5)]
    large = spark.createDataFrame([*rows, (7, [3e9, -1.0]), (9, [-3e9, 1.0])], "vec_id long, embedding array<double>")
    got = op7(spark, write(spark, tmp_path / "a", embeddings=large))
    assert got.schema["score"].dataType.simpleString() == "bigint" and got.where("query_id = 200 and rank = 1").first().score == 2048 * math.floor(3e9 * 1024) - 1024 * 1024
    too_large = spark.createDataFrame([*rows, (700, [3e9, 3e9]), (9, [3e9, 3e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a bigint"):
        op7(spark, write(spark, tmp_path / "b", embeddings=too_large)).collect()


@pytest.mark.parametrize("module", ["toxicity", "quality"])
def test_labelled_ids_bring_one_row_each_to_the_driver(spark, monkeypatch, module):
    from factloom.llm import toxicity

    rows = [(i % 40, f"text {i} of " + ("scum " if i % 40 < 8 else "plain words ") * (i % 9 + 3)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 8), int(i < 8)) for i in range(40)], "doc_id long, quality int, toxic int")
    seen, plain = [], type(docs).toPandas

    def spy(self):
        out = plain(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "toPandas", spy)
    {"toxicity": toxicity, "quality": quality}[module].fit_on(docs, labels)
    assert seen and max(seen) <= 40


@pytest.mark.parametrize("percent", [49, 0, 101])
def test_op6_refuses_similarities_it_would_lose_links_at(spark, percent):
    with pytest.raises(ValueError, match="percent"):
        near.jaccard_join(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), 3, percent)


def test_near_copies_of_rows_that_share_ids(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect())) == [(3, a), (5, b)]


@pytest.mark.parametrize(("shards", "vnodes", "slack"), [(4, 3, 0.0), (5, 8, 0.25)])
def test_op3_equals_a_walk_row_by_row(spark, shards, vnodes, slack):
    keys = [None if i % 50 == 7 else i % 90 if i % 3 else 5 for i in range(400)]  # a third of all rows have one key
    df = spark.createDataFrame([(k, i % 4) for i, k in enumerate(keys)], "k long, a int")
    got = sharding.bounded_ring(df, "k", ["a"], shards, vnodes, slack).collect()

    where, owner = sharding.ring(shards, vnodes)
    hashed = df.select("k", "a", F.when(F.col("k").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("k")).alias("h")).collect()
    waiting = sorted(hashed, key=lambda r: (sum(p < r.h for p in where) % len(where), r.h, r.k is not None, r.k or 0, r.a))
    n = len(waiting)
    room = [-(-int(n * (1 + slack)) // shards) if slack else n // shards + (s < n % shards) for s in range(shards)]
    shard_of, filled = [], [0] * shards
    for hop in range(len(where)):
        later = []
        for r in waiting:
            s = int(owner[(sum(p < r.h for p in where) + hop) % len(where)])
            if filled[s] < room[s]:
                shard_of.append((r.k, r.a, s, filled[s]))
                filled[s] += 1
            else:
                later.append(r)
        waiting = later
    assert not waiting
    assert sorted(shard_of, key=str) == sorted(((r.k, r.a, r.shard, r.slot) for r in got), key=str)


def test_op3_columns_of_the_query(spark, tmp_path):
    texts = ["", None, "gr\u00fcn", "a" * 100_000, "same", "same"]
    df = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op3_bounded_ring(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i % 5, size(t), crc(t)) for i, t in enumerate(texts))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(r.slot == 0 for r in got) and len({r.shard for r in got}) == len(texts)


def test_op8_equals_its_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({vectors.OP8_SQL})").fetchall()
    got = vectors.op8_cover_tree_dedup(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op6_equals_its_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, n_shingles, component_id from ({near.OP6_SQL})").fetchall()
    assert sorted(map(tuple, near.op6_token_group_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)
