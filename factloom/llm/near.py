"""N-gram Jaccard join through a token-group matrix.

Signatures. Sets whose sizes allow the similarity fall into the same or the next of a series of size levels. At each
level the token space is cut by hash into more parts than the number of tokens in which two linked sets can differ, so
linked sets agree in a whole part. A set's signatures are the hashes of its parts; sets that share one are candidates.

Groups. In a first round every set is compared with the centre it shares most signatures with, which joins most
similar documents; the components so found are the matrix's groups. Where a signature still spans several of them, its
sets are screened by parity sketches: two sets' sketches differ in at most as many bits as the sets do in tokens, so
what is screened out cannot be linked. Sets that remain close to a set of another group are brought together; a task
stores each group's union of tokens, bounds the overlap of each query with each union, and opens only groups that
qualify. No pair of sets of one component is compared again, and none of the others is missed.

Shingles, sets and signatures are 64-bit hashes. Two different shingles of one comparison have equal hashes with a
probability below (tokens of both)^2 / 2^65, 1e-12 for sets of 3,000; two different sets of N in all have equal ids
with one below N^2 / 2^65. Equal signatures of different parts only add comparisons.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash, table, text_bytes, tune
from .lm import _pack, _sums, _unpack
from .tokens import mix, pair, pieces, word_hashes

#: Bytes of text for each bucket of signatures; signatures that a task gathers before it sends them; sets of one block,
#: and sketches of one.
BUCKET_BYTES, HELD, BLOCK, SKETCH_BLOCK = 8 << 20, 800_000, 256, 2048


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after another, and how many each has.

    A text with fewer words than a shingle has its whole sequence as the only one; without words it has none.
    """
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    s = h.copy()
    for k in range(1, words):
        s[: len(s) - k] = pair(s[: len(s) - k], h[k:]) if len(s) > k else s[: len(s) - k]
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(h)) - first[doc] <= n[doc] - words
    for d in np.flatnonzero((n > 0) & (n < words)):
        x = h[first[d] : first[d] + 1] + np.uint64(n[d])
        for k in range(1, n[d]):
            x = pair(x, h[first[d] + k : first[d] + k + 1])
        s[first[d]], whole[first[d]] = x[0], True
    s, doc = s[whole], doc[whole]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(n))


def class_ids(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for the empty one."""
    ends = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return np.where(n > 0, mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)), np.uint64(0))


@lru_cache(maxsize=8)
def levels(percent: int, most: int = 1 << 33) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least size of each level, the tokens in which two linked sets can differ, and its number of parts."""
    low, differ, at = [], [], 1
    while at < most:
        top = at * 100 // percent
        low.append(at)
        differ.append((100 - percent) * top // percent)
        at = top + 1
    d = np.array(differ)
    return np.array(low), d, np.where(d > 0, (11 * (d + 1) + 9) // 10, 1)


def signatures(s: np.ndarray, n: np.ndarray, cid: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, id) of every set at its own level and the one below.

    A set that has tokens in more parts than linked sets can differ in shares one of those with each set it is linked
    with; only where there are fewer, its parts without tokens have signatures too.
    """
    low, differ, parts = levels(percent)
    own = np.searchsorted(low, n, side="right") - 1
    doc = np.repeat(np.arange(len(n)), n)
    spread, value, out = mix(s), mix(s ^ np.uint64(0x3C3C3C3C3C3C3C3C)), []
    for down in (0, 1):
        level = own - down
        use = (n > 0) & (level >= 0)
        k = np.where(use, parts[np.maximum(level, 0)], 0)
        use &= k > 1  # one part is the whole set, and equal sets are one class already
        k = np.where(use, k, 0)
        base = np.cumsum(k) - k
        sums = np.zeros(k.sum(), np.uint64)
        inside = use[doc]
        part = ((spread[inside] >> np.uint64(32)) * k[doc[inside]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = base[doc[inside]] + part
        order = np.argsort(at, kind="stable")
        at = at[order]
        if len(at):
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[cut]] = np.add.reduceat(value[inside][order], cut)
        owner = np.repeat(np.arange(len(n)), k)
        full = np.bincount(at, minlength=len(owner)) > 0
        many = np.bincount(owner[full], minlength=len(n)) > differ[np.maximum(level, 0)]
        sent = full | ~many[owner]
        tag = (level[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(owner)) - base[owner]).astype(np.uint64)
        out.append((pair(sums, mix(tag + np.uint64(1)))[sent], cid[owner][sent]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _texts(batch, k: int) -> list[str]:
    return [t or "" for t in batch.column(k).to_pylist()]


def sizes_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tkey, n, cid) of each row; tkey is a hash of the text."""

    def run(batches):
        for b in batches:
            texts, n, cid = _texts(b, 2), [], []
            for a, z in pieces(texts):
                s, m = shingle_sets(texts[a:z], words)
                n.append(m)
                cid.append(class_ids(s, m).view(np.int64))
            if texts:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(cid))], ["doc_id", "tkey", "n", "cid"])

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, "doc_id long, tkey long, n long, cid long")


def signature_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, centre, cid) of every signature that more than one set has; the centre is the group's smallest id."""
    buckets = max(12, -(-text_bytes(docs) // BUCKET_BYTES))

    def send(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            (sig, cid), _ = _sums((np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), ())
            cut = np.searchsorted((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            k = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            blobs = [_pack(np.diff(sig[cut[b] : cut[b + 1]], prepend=np.uint64(0)), cid[cut[b] : cut[b + 1]]) for b in k]
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            texts = _texts(b, 0)
            for a, z in pieces(texts):
                s, n = shingle_sets(texts[a:z], words)
                held.append(signatures(s, n, class_ids(s, n), percent))
                size += len(held[-1][0])
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, "<u8", "<u8") for x in g["blob"]]
        (sig, cid), _ = _sums((np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])), ())
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        keep = np.repeat(size > 1, size)
        centre = np.repeat(cid[first], size)
        return pd.DataFrame({"sig": sig[keep].view(np.int64), "centre": centre[keep].view(np.int64), "cid": cid[keep].view(np.int64)})

    sent = docs.select("text").mapInArrow(send, "bucket int, blob binary").repartition(buckets, "bucket")
    return sent.groupBy("bucket").applyInPandas(meet, "sig long, centre long, cid long")


def sketch(tokens: np.ndarray) -> bytes:
    """The parities of the numbers of tokens in each of four to eight times as many cells, a power of two."""
    cells = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def sets_of(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(cid, n, tokens, sketch) of the chosen (doc_id, cid): shingle hashes in ascending order, eight bytes each.

    A row that is repeated has its set repeated; to compare it once more changes nothing.
    """

    def run(batches):
        for b in batches:
            texts, want = _texts(b, 1), b.column(0).to_pylist()
            rows = []
            for a, z in pieces(texts):
                s, n = shingle_sets(texts[a:z], words)
                cid, ends = class_ids(s, n).view(np.int64), np.cumsum(n)
                for k in range(z - a):
                    if cid[k] == want[a + k]:
                        tokens = s[ends[k] - n[k] : ends[k]]
                        rows.append((want[a + k], int(n[k]), tokens.tobytes(), sketch(tokens)))
            cols = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["cid", "n", "tokens", "sketch"])

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("cid", "text")
    return found.mapInArrow(run, "cid long, n long, tokens binary, sketch binary")


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct tokens have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def screen(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): every set of g that may be linked with one of another group, with the smallest it hangs together with.

    g has cid, comp, n and sketch, and ``second`` where only sets with different values are compared. Sketches of
    different sizes are compared at the smaller one, to which the larger is folded.
    """
    g = g.sort_values("cid", kind="stable")
    cid, comp, n, side = (g[c].to_numpy() for c in ("cid", "comp", "n", "second"))
    size = g["sketch"].map(len).to_numpy()
    apart, label = bool(side.any()), np.arange(len(cid))
    for cells in np.unique(size):
        x = np.flatnonzero(size == cells)
        y = np.flatnonzero(size == 2 * cells)
        own = np.frombuffer(b"".join(g["sketch"].iloc[x]), np.uint64).reshape(len(x), cells // 8)
        above = np.frombuffer(b"".join(g["sketch"].iloc[y]), np.uint64).reshape(len(y), cells // 4)
        above = above[:, : above.shape[1] // 2] ^ above[:, above.shape[1] // 2 :]
        both, bits = np.concatenate([x, y]), np.concatenate([own, above]) if len(y) else own
        for i, q in enumerate(x):
            rest = both[i + 1 :]  # what hangs together with q already needn't be looked at
            use = np.flatnonzero((comp[rest] != comp[q]) & (label[rest] != label[q]) & ((side[rest] != side[q]) | (not apart)))
            if len(use):
                differ = np.bitwise_count(bits[i + 1 + use] ^ own[i]).sum(1, dtype=np.int64)
                near = rest[use[differ * (100 + percent) <= (n[rest[use]] + n[q]) * (100 - percent)]]
                if len(near):
                    names = np.unique(np.append(label[near], label[q]))
                    label[np.isin(label, names)] = names[0]
    hit = np.flatnonzero(np.bincount(label, minlength=len(cid))[label] > 1)
    return pd.DataFrame({"a": cid[hit], "b": cid[label[hit]]}).astype("int64")


def open_groups(g: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the groups of a task's sets, enough to join all that belong together.

    g has cid, comp (the set's group) and tokens, and ``second`` where only sets with different values are compared.
    """
    sets = [_tokens(x) for x in g["tokens"]]
    cid, side = g["cid"].to_numpy(), g["second"].to_numpy()
    size_of, apart = np.array([len(x) for x in sets]), bool(side.any())
    names, group = np.unique(g["comp"].to_numpy(), return_inverse=True)
    row = np.concatenate(sets)
    of = np.repeat(group, [len(x) for x in sets])
    order = np.lexsort((of, row))
    row, of = row[order], of[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1])
    row, of = row[new], of[new]  # the matrix: each group's union of tokens, by token
    root, links = np.arange(len(names)), []
    members = [np.flatnonzero(group == k) for k in range(len(names))]

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for q, tokens in enumerate(sets):
        a, b = np.searchsorted(row, tokens, side="left"), np.searchsorted(row, tokens, side="right")
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        overlap = np.bincount(of[at], minlength=len(names))
        for k in np.flatnonzero(overlap * 100 >= percent * len(tokens)):
            if top(k) == top(group[q]):
                continue
            m = members[k]
            fits = (np.minimum(size_of[m], len(tokens)) * 100 >= percent * np.maximum(size_of[m], len(tokens))) & ((side[m] != side[q]) | (not apart))
            for j in m[fits]:
                if similar(tokens, sets[j], percent):
                    links.append((int(cid[q]), int(cid[j])))
                    root[top(k)] = top(group[q])
                    break
    return links


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """(key, t1, t2, second, cid, comp) of rows (key, cid, comp): the tasks that see all pairs of different groups.

    A key with ``block`` rows at most is one task. The rows of a larger one are dealt to blocks by hash: those of its
    largest group, which needn't be compared among themselves, to some, the others to others; a task has two blocks.
    """
    rows = rows.distinct()
    groups = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    keys = groups.groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("comp", F.struct("m", "comp")).alias("major"))
    few = F.ceil((F.col("n") - F.col("most")) / block).cast("int")
    keys = keys.select("key", "major", few.alias("minors"), (few + F.ceil(F.col("most") / block)).cast("int").alias("blocks"), (F.col("n") <= block).alias("small"))
    hashed, inside = F.xxhash64("cid"), F.col("comp") == F.col("major")
    t = F.when(F.col("small"), F.lit(0)).when(inside, F.col("minors") + F.pmod(hashed, F.col("blocks") - F.col("minors"))).otherwise(F.pmod(hashed, F.col("minors")))
    last = F.when(F.col("small"), F.lit(0)).when(inside, F.col("minors") - 1).otherwise(F.col("blocks") - 1)
    rows = rows.join(keys, "key").select("key", "cid", "comp", t.cast("int").alias("t"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("o"))
    return rows.select("key", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), (F.col("t") > F.col("o")).alias("second"), "cid", "comp")


def linked_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, cid) of each row: documents linked where 100 * common >= percent * union.

    Rows without an id are linked with nothing and have no component; empty texts are linked with nothing. Equal
    sets are one class, whose id is cid, and linked. tkey is a hash of the text. Repeated rows are each returned; an empty table gives no rows.
    A percent below 50 is refused, as sketches are compared at one size or its double.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent {percent}: similarities from 50 to 100 can be asked for")
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = stash(sizes_of(docs, words))
    real = base.where("n > 0 and doc_id is not null")
    reps = real.groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    groups = stash(signature_groups(docs.where("doc_id is not null"), words, percent))
    sets = stash(sets_of(docs, groups.select("cid").distinct().join(reps, "cid").select("doc_id", "cid"), words))

    # first round: each set against the centre it shares most signatures with, a block of sets with their centre a task
    shared = groups.where("cid <> centre").groupBy("cid", "centre").agg(F.count("*").alias("k"))
    best = shared.groupBy("cid").agg(F.max_by("centre", F.struct("k", "centre")).alias("centre"))
    sizes = best.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = best.join(sizes, "centre").select("cid", "centre", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("t"))
    centres = sizes.select(F.col("centre").alias("cid"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"))

    def around(g: pd.DataFrame) -> pd.DataFrame:
        own = g["cid"] == g["centre"]
        if not own.any():
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        middle = _tokens(g["tokens"][own].iloc[0])
        hit = [similar(_tokens(x), middle, percent) for x in g["tokens"]]
        return pd.DataFrame({"a": g["cid"][hit], "b": g["centre"][hit]})

    stars = members.unionByName(centres).join(sets.select("cid", "tokens"), "cid")
    edges = stash(stars.groupBy("centre", "t").applyInPandas(around, "a long, b long"))
    comp = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("comp"))

    # second round: signatures that still span several components. Those that meet in them are a cluster, whose sketches
    # one task reads once; of a cluster that is too large for a task, each signature is taken by itself. Signatures with
    # the same sets, by two hashes of all of them, count once.
    placed = groups.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).select("sig", "cid", "comp")
    open_ = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "lo")
    rest = stash(placed.join(open_, "sig"))
    cluster = components(rest.select(F.col("comp").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    rest = rest.join(cluster, "comp").select("sig", "cid", "comp", "cluster")
    sizes = rest.select("cluster", "cid").distinct().groupBy("cluster").agg(F.count("*").alias("n"))
    rest = stash(rest.join(sizes, "cluster"))
    small = rest.where(F.col("n") <= SKETCH_BLOCK).select(F.lit(0).alias("kind"), F.col("cluster").alias("id"), "cid", "comp")
    large = rest.where(F.col("n") > SKETCH_BLOCK)
    alike = large.groupBy("sig").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
    alike = alike.groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    large = large.join(alike, "sig").select(F.lit(1).alias("kind"), F.col("sig").alias("id"), "cid", "comp")
    rest = dealt(small.unionByName(large).select(F.struct("kind", "id").alias("key"), "cid", "comp"), SKETCH_BLOCK)
    rest = rest.join(sets.select("cid", "n", "sketch"), "cid")
    maybe = stash(rest.groupBy("key", "t1", "t2").applyInPandas(lambda g: screen(g, percent), "a long, b long"))

    # third round: the matrix of each cluster of sets that may be linked across groups
    cluster = components(maybe).select(F.col("node").alias("cid"), F.col("component").alias("key"))
    rest = cluster.join(comp, "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    rest = dealt(rest, BLOCK).join(sets.select("cid", "tokens"), "cid")

    def task(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(open_groups(g, percent), columns=["a", "b"]).astype("int64")

    more = stash(rest.groupBy("key", "t1", "t2").applyInPandas(task, "a long, b long"))
    comp = components(edges.union(more)).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    of = reps.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "comp").select("cid", "component_id")
    out = real.join(of, "cid").select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id", "cid")
    alone = base.where("not (n > 0 and doc_id is not null)").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cid")
    return out.unionByName(alone)


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, as linked_classes() finds them."""
    return linked_classes(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def op6_token_group_join(spark, sf_dir: str) -> DataFrame:
    """Documents linked by distinct three-word shingles at a similarity of 0.9."""
    return jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
