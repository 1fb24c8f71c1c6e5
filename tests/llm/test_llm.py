"""The numbered operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, chat, lm, near, packing, registry, sharding, suffix, toxicity, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, cid long, bucket string, n int, doc long"
LINE = "the same line again and again and again, fifty bytes or more\n"


def odd_documents():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "É <|endoftext|> x  y", "ab" * 200, "-" * 120, "lorem ipsum dolor sit amet " * 40, LINE, LINE * 4, "z" * 30000]
    rows = [(i, rng.choice(texts) if i % 3 else " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(40))) for i in range(40)]
    rows += [(3, "one two three four five six"), (3, "one two three four five six"), (3, "other words of the same id"), (None, LINE), (None, None)]
    return [(i, t, 1, "b", 2, 3) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^ \t-\r]+", low(text))


def read(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1


def check_pieces(rows, docs):
    lib, _ = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in docs:
        want[(i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [0]))] += 1
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for (i, ids), k in want.items():
        mine = [p for p in pieces if p[0] == i and p[4] == len(ids) and p[3] == zlib.crc32(np.array(ids[p[1] : p[1] + p[2]], "<u4").tobytes())]
        assert sum(p[2] * pieces[p] for p in mine) >= k * len(ids)
    assert sum(r.length for r in rows) == sum(k * len(ids) for (_, ids), k in want.items())


def test_packing(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_pieces(packing.pack_table(odd, path).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    docs = read(spark)
    check_pieces(packing.pack_table(docs, path).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack_table(odd.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack_covers_every_token(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 127, 128, 129, 700, 1023, 1024, 1025, 5000, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 200))]
    seen = [[] for _ in lengths]
    for row in packing.pack(lengths):
        total = sum(n for _, _, n in row)
        assert total & (total - 1) == 0 and 0 < total <= 1024
        for d, s, n in row:
            seen[d].append((s, n))
    for want, got in zip(lengths, seen):
        at = 0
        for s, n in sorted(got):
            assert s == at
            at += n
        assert at == want


# 2


def brute_spans(docs):
    lowest, out = {}, []
    place = lambda i: suffix.LAST if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            lowest[b[k : k + 50]] = min(lowest.get(b[k : k + 50], 1 << 70), place(i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if lowest[b[k : k + 50]] < place(i):
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, odd, tmp_path):
    d = write(spark, tmp_path, documents=odd)
    got = [tuple(r) for r in suffix.op2_suffix_dedup(spark, d).collect()]
    assert sorted(got, key=str) == brute_spans([(r.doc_id, r.text) for r in odd.collect()])
    got = [tuple(r) for r in suffix.op2_suffix_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute_spans([(r.doc_id, r.text) for r in read(spark).collect()])
    e = write(spark, tmp_path / "e", documents=odd.limit(0))
    assert suffix.op2_suffix_dedup(spark, e).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", b"a"])
def test_classes_share_prefixes(letters):
    rng = random.Random(1)
    t = bytes(rng.choice(letters) for _ in range(400)) * 2 + b"\xff"
    order, cls = suffix.classes(np.frombuffer(t, np.uint8), 20)
    heads = [t[i : i + 20] for i in order]
    assert all((heads[k] == heads[k - 1]) == (cls[k] == cls[k - 1]) for k in range(1, len(heads)))


# 3


def test_bounded_ring(spark, odd, tmp_path):
    for df in (odd, read(spark)):
        rows = sharding.bounded_ring(df.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "doc_id", ["size"]).collect()
        assert len(rows) == df.count()
        count = Counter(r.shard for r in rows)
        assert max(count.values()) - min(count.get(s, 0) for s in range(16)) <= 1
        for s, n in count.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    e = write(spark, tmp_path, documents=odd.limit(0))
    assert sharding.op3_bounded_ring(spark, e).count() == 0


def test_few_rows_move_when_a_shard_is_added(spark):
    df = spark.range(4000).withColumnRenamed("id", "k").withColumn("a", F.lit(1))
    a, b = (sharding.bounded_ring(df, "k", ["a"], n, slack=0.25).select("k", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    assert a.join(b, "k").where("s16 <> s17").count() < 1000


# 4


def test_chat_fold(spark):
    log = [(1, 1, "start", 0, "user", "hi"), (1, 2, "start", 1, "assistant", "wro"), (1, 3, "delta", 1, None, "ng"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "<|end|>"), (1, 6, "edit", 0, None, "ho"), (1, 7, "delta", 0, None, "la")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {(r.msg, r.role): r.text for r in chat.fold(df).collect()}
    assert got == {(0, "user"): "hola", (1, "assistant"): "<|end|>"}
    r = chat.render(chat.fold(df)).withColumn("back", chat.parse(F.col("formatted"))).first()
    assert [tuple(x) for x in r.back] == [("user", "hola"), ("assistant", "<|end|>")]
    assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == ["&lt;&bar;end&bar;&gt;".replace("&gt;", ">")]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a & <|turn|> b\n"), (1, 1, "assistant", "a & <|turn|> b\n"), (2, None, None, "é" * 2000), (None, 1, "assistant", "x"), (3, 0, "assistant", "")]
    d = write(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)))
    for where in (SF, d):
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{where}/conversations.parquet{'/*.parquet' if where == d else ''}'")
        want = sorted(map(str, con.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({chat.OP4_SQL})").fetchall()))
        got = chat.op4_event_chat(spark, where).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        assert sorted(str(tuple(r)) for r in got.collect()) == want
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


# 5


def test_kneser_ney(spark, odd, tmp_path):
    d = write(spark, tmp_path, documents=odd)
    docs = [(r.doc_id, words(r.text) + ["</s>"]) for r in odd.collect()]
    train = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    ends, n, v = Counter(w for _, w in bi), sum(uni.values()), len(uni)
    how, many = Counter(bi.values()), Counter(ends.values())
    dd, ee = (lm.discounts([c[k] for k in (1, 2, 3, 4)]) for c in (how, many))
    total = {**uni, "<s>": len(train)}
    cut = lambda x, q: max(0.0, x - ([0.0, *q])[min(x, 3)])
    spare = sum(e * sum(c for k, c in many.items() if k == j or j == 3 < k) for j, e in zip((1, 2, 3), ee)) / len(bi)

    def p(c, w):
        base = cut(ends[w], ee) / len(bi) + spare / (v + 1)
        if not total.get(c):
            return base
        after = [sum(1 for (a, _), x in bi.items() if a == c and (x == j or j == 3 < x)) for j in (1, 2, 3)]
        return cut(bi[c, w], dd) / total[c] + sum(x * y for x, y in zip(dd, after)) / total[c] * base

    got = sorted(lm.op5_kneser_ney(spark, d).collect(), key=str)
    want = sorted(((i, len(t), sum(uni[w] > 0 for w in t), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(c, w)) for c, w in zip(["<s>", *t], t))) for i, t in docs), key=lambda x: (str(x[0]), x[1], x[4]))
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    for r, (i, k, known, base, score) in zip(got, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, k, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)
    e = write(spark, tmp_path / "e", documents=odd.limit(0))
    assert lm.op5_kneser_ney(spark, e).count() == 0


def test_model_sums_to_one(spark):
    model = lm.train(spark.createDataFrame([("a b a c",), ("b b d",)], "text string"))
    h, _ = lm.word_hashes(["a b c d unseen"])
    outcomes = np.append(h, lm.END)
    for c in (*h, lm.START):  # the end of a text is no context
        lp, _, _ = lm.Reader(model).score(np.full(len(outcomes), c), outcomes)
        assert math.isclose((10**lp).sum(), 1.0, rel_tol=1e-9)


# 6


def brute_components(docs, k, percent):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                root[top(a)] = top(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[top(a)] = min(least.get(top(a), i), i)
    return sorted(((i, len(s), least.get(top(a)) if s and i is not None else i) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, odd, k, percent):
    for df in (odd, read(spark)):
        got = sorted([tuple(r) for r in near.jaccard_join(df, k, percent).collect()], key=str)
        assert got == brute_components([(r.doc_id, r.text) for r in df.collect()], k, percent)


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)  # clusters larger than a task go block by block
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    got = near.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_components(docs, 3, 80)


def test_jaccard_join_of_nothing(spark, odd):
    assert near.jaccard_join(odd.limit(0)).count() == 0


# 7, 8


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[30:50] = x[:20] + rng.normal(scale=0.03, size=(20, 8))
    rows = [(100 * (i // 6) if i % 6 == 0 else i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(500, None, 0), (501, [float("nan")] * 8, 0), (502, [0.0] * 8, 1), (503, [None] * 8, 1), (504, x[0].tolist(), 0), (504, x[0].tolist(), 0), (505, x[0].tolist(), None), (None, x[0].tolist(), 0), (600, [1e30] * 8, 0), (506, [], 0), (507, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rb", F.lit("x"))


def test_top_k(spark, monkeypatch):
    df = odd_vectors(spark)
    rows = [(r.vec_id, tuple(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    ints = [(i, [math.floor(1024 * v) for v in e]) for i, e in rows]  # every row is a candidate, repeated ones too
    want = []
    for q, v in ints:
        if q % 100 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(v) == len(w))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(hits)]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    assert sorted(tuple(r) for r in vectors.top_k(df).collect()) == sorted(want)
    assert vectors.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize(("large", "kind"), [(20000.5, "bigint"), (3e9, "decimal(38,0)"), (1e300, None)])
def test_top_k_of_large_components(spark, large, kind):
    rng = np.random.default_rng(4)
    rows = [(10 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))]
    rows += [(500, [large, -1.0, 2.0, 0.5]), (7, [large, 0.25, 0.0, -large]), (9, [-large * 1.5, large, 0.0, 1.0])]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    if kind is None:
        with pytest.raises(Exception, match="does not fit"):
            got.collect()
        return
    assert got.schema["score"].dataType.simpleString() == kind
    ints, want = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows], []
    for q, v in ints:
        if q % 100 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(hits)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_cover_trees(spark):
    df = odd_vectors(spark)
    rows = df.collect()

    def unit(r):
        e = r.embedding
        if r.vec_id is None or r.label is None or not e or not all(v is not None and math.isfinite(v) for v in e) or not any(e):
            return None
        v = np.array(e, float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    u = [unit(r) for r in rows]
    links = [[b for b in range(len(rows)) if b != a and u[a] is not None and u[b] is not None and rows[a].label == rows[b].label and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98] for a in range(len(rows))]
    want = []
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        c = min(rows[b].vec_id for b in seen) if r.vec_id is not None else None
        want.append((r.vec_id, len(links[a]), c, c is None or c == r.vec_id))
    for size in (4, 2048):
        got = vectors.near_duplicates(df, rows=size).select("vec_id", "n_links", "component_id", "kept")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# 9


def test_toxicity(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_zstd_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.8
    assert (got.predicted[got.toxic == 0] == 1).mean() < 0.02
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for df in (odd, odd.limit(0)):
        d = write(spark, tmp_path / str(df.count()), documents=df, labels=labels)
        rows = toxicity.op9_zstd_toxicity(spark, d).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_is_fitted_on_whole_texts(spark):
    rng = random.Random(2)
    name = lambda k: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(k))
    plain, bad = [name(3) for _ in range(400)], ["zyxq" + name(2) for _ in range(8)]
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    last = "quokka wombats and bandicoots juggle vexing xylophones by the jetty"
    rows = []
    for i in range(400):
        rows.append((i, int(i % 2), f"{prose(1300)} " + (" ".join(rng.choice(bad) for _ in range(12)) if i % 2 else last)))
    docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    assert min(len(r[2]) for r in rows) > 9000
    model = toxicity.fit_on(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert b"by the jetty" in model.ordinary  # ends of texts are trained on
    assert any(w.encode() in model.toxic for w in bad)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all((model.score(t) >= 0.5) == bool(y) for _, y, t in held)


# 10


def test_bpe(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = bpe.codec(path).lib
    texts = ["İ É é 日本語 it's we'll 12,3!! \x1cfoo\x1c", "a" * 3000, "Σας 's ' t<|startoftext|>x", "  ​ x"]
    df = odd.select("doc_id", "text").unionByName(read(spark).select("doc_id", "text")).unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = Counter(tuple(r) for r in bpe.encode_table(df, path).collect())
    want = Counter()
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_table(odd.limit(0), path).count() == 0


# pipeline


def test_pipeline(spark, odd, tmp_path):
    docs = read(spark)
    model_kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert model_kept.columns == docs.columns
    held = read(spark, "labels").where("toxic = 0").join(docs, "doc_id")
    assert held.join(model_kept, "doc_id", "left_anti").count() <= 0.02 * held.count()
    near_kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    comp = dict((r[0], r[2]) for r in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80))
    assert {r.doc_id for r in near_kept.collect()} == {i for i, c in comp.items() if i == c}
    cut = corpus_pipeline.drop_repeats(spark, docs, SF)
    left = {i: h for i, _, _, _, h in brute_spans([(r.doc_id, r.text) for r in docs.collect()])}
    assert cut.columns == docs.columns
    same = sum(hashlib.sha256((r.text or "").encode()).hexdigest() == left[r.doc_id] for r in cut.collect())
    assert same >= 0.95 * docs.count()  # but for characters that were cut through
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    for df in (odd, odd.limit(0)):
        d = write(spark, tmp_path / f"p{df.count()}", documents=df, labels=labels)
        rows = corpus_pipeline.run(spark, d)
        assert (rows.count() > 0) == (df.count() > 0)


def test_registry_names():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{n}" for n in range(1, 14)]
    json.dumps(registry.oracle_sql())
