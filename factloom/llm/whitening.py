"""Whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced to one triangular factor by QR of blocks, whose factors meet in a tree. Householder reflections
make that factor bidiagonal; dqds finds the singular values to high relative accuracy; twisted factorisations of the
shifted bidiagonal give their vectors, which the reflections carry back to whitening directions.

Vectors are quantised to integers, so sums, means and deviations are exact; only centred rows become doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table, tune
from .vectors import usable

#: Quantised entries are floor(SCALE * c) + OFFSET; components returned at most.
SCALE, OFFSET, MOST = 64, 1_000_000, 32
#: Triangular factors that meet in one step of the tree, and rows of a block that is reduced at a time.
FAN_IN, BLOCK_ROWS = 64, 4096
#: Singular values below this share of the largest are 0: no direction whitens them.
ZERO = 1e-13
EPS = np.finfo(float).eps


# the dense steps, on one matrix of dims x dims


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta): I - tau v v' takes x to beta times the first unit vector."""
    norm = np.sqrt((x * x).sum())
    if norm == 0 or (len(x) == 1):
        return np.zeros_like(x), 0.0, float(x[0]) if len(x) else 0.0
    beta = -np.copysign(norm, x[0])
    v = x.copy()
    v[0] -= beta
    v /= np.abs(v).max()
    return v, 2 / float((v * v).sum()), float(beta)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, p): diagonal and upper diagonal of q' r p, with p orthogonal, by Householder reflections of both sides."""
    a, n = r.copy(), r.shape[1]
    p = np.eye(n)
    d, e = np.zeros(n), np.zeros(max(0, n - 1))
    for k in range(n):
        v, tau, d[k] = reflector(a[k:, k])
        a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v, tau, e[k] = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= tau * np.outer(a[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= tau * np.outer(p[:, k + 1 :] @ v, v)
    return d, e, p


def dqds(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by the differential qd algorithm with shifts.

    A shift is taken back if a transform with it would turn negative, so every transform keeps high relative accuracy.
    """
    scale = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    if scale == 0:
        return np.zeros(len(d))
    found = []
    blocks = [((d / scale) ** 2, (e / scale) ** 2, 0.0)]
    while blocks:
        q, f, shift = blocks.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            small = np.flatnonzero(f <= EPS * EPS * (shift + q[1:]))
            if len(small):
                at = small[-1] + 1
                blocks.append((q[:at], f[: at - 1], shift))
                q, f = q[at:], f[at:]
                continue
            tau = _shift(q, f)
            while True:
                qq, ff = np.empty(n), np.empty(n - 1)
                x = q[0] - tau
                for i in range(n - 1):
                    qq[i] = x + f[i]
                    if x < 0 or qq[i] == 0:
                        break
                    t = q[i + 1] / qq[i]
                    ff[i] = f[i] * t
                    x = x * t - tau
                else:
                    qq[n - 1] = x
                    if x >= 0:
                        break
                tau = 0.0 if tau < 1e-300 else tau / 4
            if not np.isfinite(qq).all():  # a diagonal entry of 0: its singular value is 0
                qq, ff = _deflate(q, f)
            q, f, shift = qq, ff, shift + tau
    return np.sort(np.maximum(np.array(found), 0.0))[::-1] * scale * scale


def _shift(q: np.ndarray, f: np.ndarray) -> float:
    """A lower bound of the smallest eigenvalue, or 0: Gershgorin's of the last rows, and Newton's from the last pivots."""
    n = len(q)
    a, b, c = q[n - 1], f[n - 2], q[n - 2]
    half = (c + b + a) / 2
    low = a * c / (half + np.sqrt(max(0.0, half * half - a * c))) if half > 0 else 0.0
    edge = np.sqrt(f[n - 3] * q[n - 2]) if n > 2 else 0.0
    return max(0.0, low - edge) * (1 - 8 * EPS)


def _deflate(q: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of QR without a shift, which takes a zero on the diagonal, where a qd transform would divide by 0, to the end."""
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(f), 1)
    d, e, _ = bidiagonalise(np.linalg.qr(b.T, mode="r"))
    return d * d, e * e


def twisted(d: np.ndarray, e: np.ndarray, lam: float, rhs: np.ndarray | None = None) -> np.ndarray:
    """A unit vector near the null space of B'B - lam, B bidiagonal, from its twisted factorisation.

    The stationary transform gives L D L' from the top, the progressive one U D U' from the bottom; the twist is where
    both meet with the smallest pivot. With a right-hand side, one step of inverse iteration by the same factors.
    """
    n = len(d)
    q, f = d * d, e * e
    diag = q + np.concatenate([[0.0], f])
    off = d[:-1] * e
    tiny = EPS * max(diag.max(initial=0.0), 1e-300) * EPS
    top, low, stat, prog = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    stat[0] = -lam
    for i in range(n):  # L D L' = B'B - lam
        top[i] = q[i] + stat[i] or tiny
        if i < n - 1:
            stat[i + 1] = stat[i] * (f[i] / top[i]) - lam
    prog[n - 1] = q[n - 1] - lam
    for i in range(n - 2, -1, -1):  # U D U'
        low[i + 1] = f[i] + prog[i + 1] or tiny
        prog[i] = prog[i + 1] * (q[i] / low[i + 1]) - lam
    low[0] = prog[0] or tiny
    gamma = stat + prog + lam
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if rhs is None:
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -off[i] / top[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -off[i] / low[i + 1] * z[i]
    else:
        y = rhs.copy()
        for i in range(k):
            y[i + 1] -= off[i] / top[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= off[i - 1] / low[i] * y[i]
        z[k] = y[k] / (gamma[k] if gamma[k] != 0 else tiny)
        for i in range(k - 1, -1, -1):
            z[i] = (y[i] - off[i] * z[i + 1]) / top[i]
        for i in range(k, n - 1):
            z[i + 1] = (y[i + 1] - off[i] * z[i]) / low[i + 1]
    z /= np.abs(z).max()
    return z / np.sqrt((z * z).sum())


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of r, at most ``most``, falling, without those that are 0.

    Vectors of values that lie close together are orthogonalised against each other, each after steps of inverse
    iteration, so that a value that occurs often has as many vectors.
    """
    d, e, p = bidiagonalise(r)
    lam = dqds(d, e)
    lam = lam[lam > ZERO * ZERO * lam[0]][:most] if len(lam) and lam[0] > 0 else lam[:0]
    scale = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), 1e-300)
    d, e, lam1 = d / scale, e / scale, lam / scale / scale
    v, start, rng = np.zeros((len(d), len(lam))), 0, np.random.default_rng(0)
    for k in range(len(lam)):
        if k and lam1[k - 1] - lam1[k] > 1e-3 * lam1[0]:
            start = k
        z = twisted(d, e, lam1[k])
        if k > start:
            near = v[:, start:k]
            z = z - near @ (near.T @ z)
            if np.abs(z).max() < 1e-6:
                z = rng.standard_normal(len(d))
            for _ in range(3):
                z = z - near @ (near.T @ z)
                z = twisted(d, e, lam1[k], z / np.sqrt((z * z).sum()))
            for _ in range(2):
                z = z - near @ (near.T @ z)
                z /= np.sqrt((z * z).sum())
        v[:, k] = z
    return np.sqrt(lam), p @ v


# the work on all rows


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, x): vectors without nulls and values that aren't finite, entries as floor(SCALE * c) + OFFSET. Entries of 2**40 and more are an error."""
    whole = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + OFFSET)
    too_large = F.exists("embedding", lambda c: F.abs(c.cast("double")) >= 2.0**40)
    x = F.when(too_large, F.raise_error(F.lit("an entry does not fit the quantised range"))).otherwise(whole)
    return df.select(F.col("vec_id").cast("long"), "embedding").where(usable("embedding")).select("vec_id", x.alias("x"))


def _blocks(batch: pa.RecordBatch):
    """(rows, matrix) of the vectors of each length in a batch, BLOCK_ROWS at a time."""
    xs = batch.column(batch.schema.get_field_index("x"))
    width = xs.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = xs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(width)])
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for k in range(0, len(rows), BLOCK_ROWS):
            some = rows[k : k + BLOCK_ROWS]
            yield some, flat[at[some][:, None] + np.arange(w)].astype(np.int64)


def _sums(batches):
    """A row (width, n, low, high, sums) for each batch and length."""
    for b in batches:
        for _, x in _blocks(b):
            one = [[x.shape[1]], [len(x)], [int(x.min())], [int(x.max())], [x.sum(0).tolist()]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in one[:4]), pa.array(one[4], pa.list_(pa.int64()))], ["width", "n", "low", "high", "sums"])


def _qr(stack: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of blocks one above the other, square."""
    a = np.vstack(stack)
    if len(a) < a.shape[1]:
        a = np.vstack([a, np.zeros((a.shape[1] - len(a), a.shape[1]))])
    return np.linalg.qr(a, mode="r")


def _fan_in(width: int) -> int:
    """Factors that meet at once: FAN_IN, or fewer so that they take some 32 MB."""
    return max(2, min(FAN_IN, (32 << 20) // (8 * width * width)))


def _reduced(rows: DataFrame, centre: dict) -> dict[int, np.ndarray]:
    """The triangular factor of the centred rows of each length: one for each task, which meet in a tree of tasks."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(centre)  # sums of each dimension
    schema, names = "width int, task long, r array<double>", ["width", "task", "r"]

    def of(w, task, r):
        return pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([task], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names)

    def factors(batches):
        from pyspark import TaskContext

        have: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _blocks(b):
                w = x.shape[1]
                n, s = held.value[w]
                block = (n * x - s) / n
                have[w] = _qr([have[w], block] if w in have else [block])
        for w, r in have.items():
            yield of(w, TaskContext.get().partitionId(), r)

    def meet(batches):
        stacks: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for w, task, r in zip(*(c.to_pylist() for c in b.columns)):
                r = np.array(r).reshape(w, w)
                stacks[w, task] = _qr([stacks[w, task], r]) if (w, task) in stacks else r
        for (w, task), r in stacks.items():
            yield of(w, task, r)

    found = stash(rows.mapInArrow(factors, schema))
    while True:
        most = found.groupBy("width").agg(F.count("*").alias("n"), F.max("task").alias("task")).collect()  # a row for each length
        if all(m.n == 1 for m in most):
            break
        step = F.element_at(F.create_map(*[F.lit(v) for m in most for v in (m.width, _fan_in(m.width))]), F.col("width"))
        dealt = found.select("width", F.floor(F.col("task") / step).cast("long").alias("task"), "r")
        found = stash(dealt.repartition("width", "task").sortWithinPartitions("width", "task").mapInArrow(meet, schema))
    return {f.width: np.array(f.r).reshape(f.width, f.width) for f in found.collect()}  # a matrix of dims x dims for each length


def whiten(df: DataFrame, most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to ``most``.

    Vectors that are null, empty, or hold nulls or values that aren't finite are left out; repeated rows, and rows
    without an id, count each. Vectors of each length are a list of their own. Components whose variance is 0 have no
    direction and give no rows, so fewer vectors than dimensions, or one vector alone, give fewer components or none; an
    empty table gives no rows. A deviation that does not fit a bigint, or quantised sums that don't, are an error.
    The driver holds a matrix of dims x dims for each length, however many rows there are.
    """
    spark = df.sparkSession
    tune(spark)
    rows = quantised(df)
    parts = rows.mapInArrow(_sums, "width long, n long, low long, high long, sums array<long>")
    totals = parts.groupBy("width").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("s"))
    each = parts.select("width", F.posexplode("sums").alias("pos", "s")).groupBy("width", "pos").agg(F.sum("s").alias("s"))
    both = totals.unionByName(each, allowMissingColumns=True).collect()  # dims + 1 rows for each length
    centre = {}
    for t in (t for t in both if t.pos == -1):
        if t.n * max(abs(t.low), abs(t.high)) >= 1 << 62:
            raise ValueError("too many rows, or too large entries, for exact sums in a bigint")
        centre[int(t.width)] = (t.n, np.array([r.s for r in sorted((r for r in both if r.width == t.width and r.pos >= 0), key=lambda r: r.pos)], np.int64))
    models = {}
    for w, r in (_reduced(rows, centre) if centre else {}).items():
        n, s = centre[w]
        sigma, v = directions(r, most)
        models[w] = (n, s, v * (np.sqrt(n) / sigma), sigma * sigma / (r * r).sum())
    held = spark.sparkContext.broadcast(models)  # dims x most numbers for each length

    def moments(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for _, x in _blocks(b):
                n, s, v, _ = held.value[x.shape[1]]
                y = ((n * x - s) / n) @ v
                first, second = sums.get(x.shape[1], (0.0, 0.0))
                sums[x.shape[1]] = (first + y.sum(0), second + y.T @ y)
        for w, (first, second) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([[*first.tolist(), *second.ravel().tolist()]], pa.list_(pa.float64()))], ["width", "m"])

    found = rows.mapInArrow(moments, "width int, m array<double>").select("width", F.posexplode("m").alias("pos", "m"))
    found = found.groupBy("width", "pos").agg(F.sum("m").alias("m")).collect() if models else []  # most + most**2 rows for each length
    errors = {}
    for w, (n, _, v, _) in models.items():
        k = v.shape[1]
        m = np.array([f.m for f in sorted((f for f in found if f.width == w), key=lambda f: f.pos)]) / n
        errors[w] = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max(initial=0.0))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def project(batches):
        for b in batches:
            for at, x in _blocks(b):
                n, s, v, explained = held.value[x.shape[1]]
                k, dev = v.shape[1], n * x - s
                if (dev.astype(float) ** 2).sum(1).max() >= 9.2e18:
                    raise ValueError("a deviation does not fit a bigint")
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                one = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), n, np.int64)),
                    pa.array(np.repeat((dev * dev).sum(1), k)), pa.array(((dev / n) @ v).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(k * len(x), errors[x.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(one, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(project, schema)


def op11_qd_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings projected on up to 32 whitening directions; odd rows as in whiten()."""
    return whiten(table(spark, sf_dir, "embeddings"))
