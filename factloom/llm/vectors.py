"""Exact top-k search by a bit-sliced index, and near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, stash, table

#: Bits of a quantised attribute and of a query's weight in the index; rows of one block, and queries of one block.
ATTRIBUTE_BITS, WEIGHT_BITS, BLOCK_ROWS, BLOCK_QUERIES = 6, 5, 4096, 4096
#: Rows with a quantised component beyond this are not indexed, but compared one by one.
NEAR = 1 << 24
#: Scores of this size and more don't fit decimal(38,0).
TOO_LARGE = 10**38 - 1
#: Vectors of one cover tree, and tasks that pairs of trees are dealt to at most.
TREE_ROWS, MOST_TASKS = 2048, 1 << 15


def usable(c: str) -> Column:
    """A vector that is not null, not empty, and holds neither nulls nor values that aren't finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))


class BitSlicedIndex:
    """Bitmaps of the bits of each attribute of a block of integer vectors, most significant rows first to answer.

    Attributes are shifted to ATTRIBUTE_BITS bits. A query's weights are shifted to WEIGHT_BITS bits; where a weight is
    negative the attribute's complement is added. The sum of all shifted slices is made by carry-save addition of
    bitmaps, and comes out as slices too.
    """

    def __init__(self, x: np.ndarray):
        self.x, (n, dims) = x, x.shape
        self.n = n
        low, high = x.min(0), x.max(0)
        self.shift = np.maximum(0, np.ceil(np.log2(np.maximum(high - low, 1) + 1)) - ATTRIBUTE_BITS).astype(np.int64)
        self.low = low
        u = (x - low) >> self.shift
        words = -(-n // 64) * 8
        self.slices = np.zeros((dims, ATTRIBUTE_BITS, words // 8), np.uint64)
        for b in range(ATTRIBUTE_BITS):
            bits = np.packbits((u >> b & 1).astype(bool).T, axis=1, bitorder="little")
            self.slices[:, b] = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, words - bits.shape[1])))).view(np.uint64)
        self.all = np.pad(np.packbits(np.ones(n, bool), bitorder="little"), (0, words - -(-n // 8))).view(np.uint64)

    def add(self, q: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Slices of the approximate score, least significant first, in units of 2**unit; and how far it can be off."""
        # weight of attribute i's unit: q_i * 2**shift_i
        scaled = q.astype(np.float64) * np.exp2(self.shift)
        unit = 2.0 ** max(0, int(np.ceil(np.log2(max(1.0, np.abs(scaled).max())))) - WEIGHT_BITS)
        w = np.rint(np.abs(scaled) / unit).astype(np.int64)
        columns: list[list[np.ndarray]] = []

        def drop(place: int, bits: np.ndarray) -> None:
            while len(columns) <= place:
                columns.append([])
            columns[place].append(bits)

        for i in np.flatnonzero(w):
            own = self.slices[i] if scaled[i] > 0 else ~self.slices[i] & self.all
            for j in range(int(w[i]).bit_length()):
                if w[i] >> j & 1:
                    for b in range(ATTRIBUTE_BITS):
                        drop(b + j, own[b])
        place = 0
        while place < len(columns):
            c = columns[place]
            while len(c) > 2:  # a full adder: three bitmaps become a sum here and a carry above
                x, y, z = c.pop(), c.pop(), c.pop()
                half = x ^ y
                c.insert(0, half ^ z)
                drop(place + 1, x & y | half & z)
            if len(c) == 2:
                x, y = c.pop(), c.pop()
                c.append(x ^ y)
                drop(place + 1, x & y)
            place += 1
        top = float(2**ATTRIBUTE_BITS - 1)
        # the weight's rounding times the attribute's range, and the bits below the attribute's lowest slice
        off = (np.abs(np.abs(scaled) / unit - w) * top).sum() + (np.abs(q) * (np.exp2(self.shift) - 1)).sum() / unit
        return [c[0] if c else np.zeros_like(self.all) for c in columns], float(off)

    def top(self, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """Rows that can be among the k best for q, own rows excluded: from the most significant slice downward."""
        candidates = self.all.copy() if own is None else self.all & ~own
        alive = int(np.bitwise_count(candidates).sum())
        if alive <= k:
            return self.rows(candidates)
        slices, off = self.add(q)
        sure, maybe, value, need = np.zeros_like(self.all), candidates.copy(), 0, k
        for place in range(len(slices) - 1, -1, -1):  # the k-th best approximate score, bit by bit
            hit = maybe & slices[place]
            n = int(np.bitwise_count(hit).sum())
            if n >= need:
                maybe, value = hit, value | 1 << place
            else:
                sure, need, maybe = sure | hit, need - n, maybe & ~slices[place]
        bound = value - int(np.ceil(2 * off)) - 1
        if bound <= 0:
            return self.rows(candidates)
        above, equal = np.zeros_like(self.all), candidates.copy()
        for place in range(max(len(slices), bound.bit_length()) - 1, -1, -1):
            s = slices[place] if place < len(slices) else np.zeros_like(self.all)
            if bound >> place & 1:
                equal = equal & s
            else:
                above, equal = above | equal & s, equal & ~s
        return self.rows(above | equal)

    def rows(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=self.n, bitorder="little"))


def best_in_block(vec_ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query; boundary rows are resolved by exact integer products."""
    index, order = BitSlicedIndex(x), np.argsort(vec_ids, kind="stable")
    ordered = vec_ids[order]
    parts = []
    for i, (qid, v) in enumerate(zip(query_ids, q)):
        a, b = np.searchsorted(ordered, [qid, qid + 1])
        own = None
        if b > a:
            mark = np.zeros(len(index.all) * 64, bool)
            mark[order[a:b]] = True
            own = np.packbits(mark, bitorder="little").view(np.uint64)
        rows = index.top(v, k, own)
        score = x[rows] @ v
        best = np.lexsort((vec_ids[rows], -score))[:k]
        parts.append((np.full(len(best), i), vec_ids[rows][best], score[best]))
    at, ids, scores = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"_q": at, "vec_id": ids, "score": scores})


def quantised(big: np.ndarray) -> list[int]:
    """1024 * x of components that are multiples of 1 / 1024, as Python integers."""
    return [int(x) * 1024 if abs(x) >= 2.0**53 else int(x * 1024) for x in big.tolist()]


def best_one_by_one(vec_ids: np.ndarray, x: list, query_ids: np.ndarray, q: list, k: int) -> list[tuple[int, int, int]]:
    """(index of the query, vec_id, score) of the k best rows for each query; int64 only where no sum can overflow."""
    if not len(x) or not len(q):
        return []
    reach = len(q[0]) * max(abs(int(c)) for v in x for c in v) * max(abs(int(c)) for v in q for c in v)
    kind, out = np.int64 if reach < 1 << 63 else object, []
    x = np.array([[int(c) for c in v] for v in x], kind)
    for i, v in enumerate(q):
        score = x @ np.array([int(c) for c in v], kind)
        hits = sorted((-int(s), int(r)) for s, r in zip(score, vec_ids) if r != query_ids[i])[:k]
        out += [(i, r, -s) for s, r in hits]
    return out


def top_k(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for each vec_id divisible by ``every``.

    Vectors that aren't usable, rows without an id, and pairs of vectors of different lengths take no part. Repeated
    rows are candidates each; a query that is repeated is answered once. Where one id has several vectors, each that is a
    query is answered by itself, and none of them is a candidate for the others. An empty table gives no rows. Rows and
    queries are dealt to blocks by hash; every pair of blocks is searched by one task.

    Components are floor(1024 * x) for every finite x. Rows with one beyond NEAR are few and compared one by one, in
    int64 where no sum can overflow and in Python integers elsewhere. The score is a bigint where no score can exceed
    one, and else a decimal(38,0); a score among the k best that doesn't fit that either is an error.
    """
    far = F.exists("embedding", lambda x: F.abs(x.cast("double")) > NEAR / 1024)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("int"))
    large = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 2.0**53, x.cast("double")).otherwise(F.floor(x.cast("double") * 1024) / F.lit(1024.0)))
    rows = df.where(usable("embedding") & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long"), F.when(~far, ints).alias("v"), F.when(far, large).alias("big"))
    rows = stash(rows)
    size = F.greatest(F.coalesce(F.size("v"), F.lit(0)), F.coalesce(F.size("big"), F.lit(0)))
    most = F.greatest(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.array_max(F.transform("big", lambda c: F.abs(c) * 1024)))
    n, width, most = rows.agg(F.count("*"), F.max(size), F.max(most)).first()
    wide = bool(n) and width * most * most >= 2.0**62
    number = "decimal(38,0)" if wide else "long"
    blocks, qblocks = -(-n // BLOCK_ROWS) or 1, -(-n // (every * BLOCK_QUERIES)) or 1
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    left = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v", "big", F.monotonically_increasing_id()), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(qblocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = [F.col(c).cast("int").alias(c) for c in ("rb", "qb")]  # of one type on both sides, or they are dealt differently
    left, right = left.select(*key, "vec_id", "v", "big"), right.select(*key, "vec_id", "v", "big", F.xxhash64("v", "big").alias("variant"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names, out = ["query_id", "variant", "vec_id", "score"], []

        def widths(g: pd.DataFrame) -> pd.Series:
            return g["v"].where(g["v"].notna(), g["big"]).map(len)

        def add(q: pd.DataFrame, at, vec_ids, scores) -> None:
            out.append(pd.DataFrame({"query_id": q["vec_id"].to_numpy()[at], "variant": q["variant"].to_numpy()[at], "vec_id": vec_ids, "score": pd.Series(scores, dtype=object if wide else "int64")}))

        def parts(g: pd.DataFrame) -> list[tuple[pd.DataFrame, list]]:
            near, far = g[g["v"].notna()], g[g["v"].isna()]
            return [(near, near["v"].to_list()), (far, [quantised(v) for v in far["big"]])]

        wa, wb = widths(a), widths(b)
        for width in set(wb) & set(wa):
            for i, (x, xs) in enumerate(parts(a[wa == width])):
                for j, (q, qs) in enumerate(parts(b[wb == width])):
                    if not len(x) or not len(q):
                        continue
                    if i == j == 0 and width * NEAR * NEAR < 1 << 63:
                        got = best_in_block(x["vec_id"].to_numpy(), np.stack(xs).astype(np.int64), q["vec_id"].to_numpy(), np.stack(qs).astype(np.int64), k)
                        add(q, got["_q"].to_numpy(), got["vec_id"].to_numpy(), got["score"].to_list())
                    elif got := best_one_by_one(x["vec_id"].to_numpy(), xs, q["vec_id"].to_numpy(), qs, k):
                        at, ids, scores = zip(*got)
                        add(q, np.array(at), np.array(ids), list(scores))
        found = pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names})
        found = found.astype({c: "int64" for c in names[:3]})
        if wide:  # what is too large is marked, and is an error if it stays among the k best
            return found.assign(score=[Decimal(max(-TOO_LARGE, min(TOO_LARGE, int(s)))) for s in found["score"]])
        return found.astype({"score": "int64"})

    tasks = blocks * qblocks
    found = left.repartition(tasks, "rb", "qb").groupBy("rb", "qb").cogroup(right.repartition(tasks, "rb", "qb").groupBy("rb", "qb"))
    found = found.applyInPandas(search, f"query_id long, variant long, vec_id long, score {number}")
    w = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if wide:
        beyond = F.raise_error(F.lit("a score does not fit decimal(38,0)")).cast(number)
        found = found.withColumn("score", F.when(F.abs("score") >= F.lit(Decimal(TOO_LARGE)), beyond).otherwise(F.col("score")))
    return found.select("query_id", "rank", "vec_id", "score")


def op7_bit_sliced_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector, by integer inner products; odd rows as in top_k(), and a best score beyond a bigint is an error."""
    found = top_k(table(spark, sf_dir, "embeddings"))
    beyond = F.raise_error(F.lit("a score does not fit a bigint")).cast("long")
    fits = F.col("score").cast("decimal(38,0)").between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63 - 1)))
    return found.withColumn("score", F.when(fits, F.col("score").cast("long")).otherwise(beyond))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


class CoverTree:
    """Levels of nested centres with halving radii over unit vectors, and each node's exact covering radius.

    ``levels[k]`` is (centres, offsets, radius): node j covers ``order[offsets[j]:offsets[j+1]]`` of level k, within
    2 / 2**k of its centre by construction. Node j's children in the next level cover a part of the same stretch.
    """

    def __init__(self, u: np.ndarray, least: float):
        self.u = u
        order, nodes = np.arange(len(u)), [(0, 0, len(u))]  # (centre, begin, end)
        self.levels = [self._level(nodes, order)]
        self.children: list[np.ndarray] = []
        radius = 2.0
        while radius > least:
            radius /= 2
            below, first = [], []
            order = order.copy()
            for centre, a, b in nodes:
                first.append(len(below))
                if b - a == 1:
                    below.append((centre, a, b))
                    continue
                left, at, c = order[a:b].copy(), a, centre
                while len(left):
                    near = ((u[left] - u[c]) ** 2).sum(1) <= radius * radius
                    near |= left == c
                    take = left[near]
                    order[at : at + len(take)] = take
                    below.append((c, at, at + len(take)))
                    at, left = at + len(take), left[~near]
                    c = left[0] if len(left) else -1
            self.children.append(np.array([*first, len(below)]))
            nodes = below
            self.levels.append(self._level(nodes, order))

    def _level(self, nodes, order):
        """(centres, begin, end, covering radius, order)."""
        c, a, b = (np.array(x) for x in zip(*nodes))
        far = np.sqrt(((self.u[order] - self.u[np.repeat(c, b - a)]) ** 2).sum(1))
        return c, a, b, np.maximum.reduceat(far, a), order


def linked(p: CoverTree, q: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine at least the threshold, i of p's vectors and j of q's, by dual traversal.

    A pair of nodes is pruned where the distance of its centres exceeds both covering radii and the threshold's own
    distance together; what is left at the last level is compared exactly.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    pairs = [(0, 0)]
    for k in range(len(p.levels) - 1):
        (c, _, _, rc, _), (d, _, _, rd, _) = p.levels[k + 1], q.levels[k + 1]
        below = []
        for i, j in pairs:
            x, y = slice(p.children[k][i], p.children[k][i + 1]), slice(q.children[k][j], q.children[k][j + 1])
            near = np.maximum(0, 2 - 2 * (p.u[c[x]] @ q.u[d[y]].T))
            s, t = np.nonzero(near <= (rc[x][:, None] + rd[y][None, :] + reach) ** 2)
            below += zip((s + x.start).tolist(), (t + y.start).tolist())
        pairs = below
    (_, a, b, _, o), (_, e, f, _, r) = p.levels[-1], q.levels[-1]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pairs:
        x, y = o[a[i] : b[i]], r[e[j] : f[j]]
        s, t = np.nonzero(p.u[x] @ q.u[y].T >= cosine)
        left.append(x[s])
        right.append(y[t])
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    while (root[root] != root).any():
        root = root[root]
    return root


def near_duplicates(df: DataFrame, cosine: float = 0.98, rows: int = TREE_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label are dealt to cover trees of bounded size; every pair of trees of a label is a group, and the
    groups are dealt to tasks by label and trees, so a label that holds a third of all rows becomes many tasks. Equal vectors of a label are one class and are
    not expanded into pairs: a class's links are its other members and the members of the classes it links with.
    Vectors that are null, zero or hold values that aren't finite, and rows without a label or an id, have no links and
    are their own component. Vectors of different lengths are not linked. Rows that repeat an id count as vectors of
    their own. An empty table gives no rows.
    """
    df = df.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    fit = usable("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = stash(df.where(fit).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("cls", F.xxhash64("label", "v")))
    per_label = classes.groupBy("label").agg(F.ceil(F.count("*") / rows).cast("int").alias("trees"))
    tasks = per_label.agg(F.sum(F.expr("cast(trees as long) * (trees + 1) div 2"))).first()[0] or 1
    dealt = classes.join(per_label, "label").withColumn("t", F.pmod(F.xxhash64("v"), F.col("trees")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("o")
    dealt = dealt.select("label", "cls", "copies", "v", "t", other)
    dealt = dealt.select("label", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), (F.col("t") > F.col("o")).alias("second"), "cls", "copies", "v")

    def traverse(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        g = g.sort_values("cls", kind="stable").reset_index(drop=True)
        width = g["v"].map(len)
        for w in sorted(set(width)):
            part = g[width == w].reset_index(drop=True)
            x = np.stack(part["v"].to_list())
            big = np.abs(x).max(1, keepdims=True)
            u = x / big
            u /= np.sqrt((u * u).sum(1, keepdims=True))
            copies, reach = part["copies"].to_numpy(), np.sqrt(2 - 2 * cosine)
            side = part["second"].to_numpy()
            one = np.flatnonzero(~side)
            two = np.flatnonzero(side) if part["t1"].iloc[0] != part["t2"].iloc[0] else one
            if not len(one) or not len(two):
                continue
            p = CoverTree(u[one], reach / 2)
            q = CoverTree(u[two], reach / 2) if two is not one else p
            a, b = linked(p, q, cosine)
            a, b = one[a], two[b]
            a, b = a[keep := a != b], b[keep]
            links = np.bincount(a, copies[b], len(part)) + (np.bincount(b, copies[a], len(part)) if two is not one else 0)
            root = local_roots(len(part), a, b)
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"cls": part["cls"].to_numpy()[hit], "links": links[hit].astype("int64"), "root": part["cls"].to_numpy()[root[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")

    # by all three, as a deal by label alone, which the join leaves behind, would do for the grouping too
    dealt = dealt.repartition(int(min(max(tasks, 1), MOST_TASKS)), "label", "t1", "t2")
    pairs = dealt.groupBy("label", "t1", "t2").applyInPandas(traverse, "cls long, links long, root long")
    found = stash(pairs)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    of_class = classes.join(links, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = df.where(fit).join(of_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = df.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_cover_tree_dedup(spark, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.98 or more within each label; odd rows as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 ELSE false END
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""
