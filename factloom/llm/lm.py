"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Counting: tasks count their own bigrams first; what they found is dealt by context and four bits of the word, so that
a very common context is many groups. A first reduce sums bigrams and stores them; it passes on, for each word, how
many bigrams it ends and with how many of each count it begins. A second reduce sums those and stores the words.
Scoring: workers map the stored arrays into memory and look up the sorted hashes of a batch.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_path, shared_dir, table, text_bytes, tune
from .tokens import mix, pair, pieces, word_hashes

#: Bytes of text for each bucket of the model; bigrams that a task gathers before it sends them on.
BUCKET_BYTES, HELD = 16 << 20, 3_000_000
START, END = np.uint64(0x5151515151515151), np.uint64(0xE0E0E0E0E0E0E0E1)
WORD = np.dtype([("count", "<u8"), ("ends", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _gram_bucket(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(mix(context + (word & np.uint64(15))), buckets)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each cut into its bytes' planes and compressed together."""
    z = zstandard.ZstdCompressor(level=1)
    return z.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def _sums(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]):
    """Distinct keys in ascending order, and the sums of each of the values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), tuple(np.add.reduceat(v[order].astype(np.int64), at) if len(at) else v.astype(np.int64) for v in values)


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word) of every token of every text, its end included, and the number of tokens of each text."""
    h, n = word_hashes(texts)
    at = np.cumsum(n)
    word = np.insert(h, at, END)
    first = at - n + np.arange(len(n))
    context = np.concatenate([[START], word[:-1]]) if len(word) else word
    context[first] = START
    return context, word, n + 1


def _save(path: str, name: str, a: np.ndarray) -> None:
    """Whole files only: a task that is repeated, or runs twice at once, writes the same once more."""
    part = f"{path}/{name}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, f"{path}/{name}.npy")


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney's discounts of counts 1, 2 and more, from how many entries have counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [float(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1]))) if n[k - 1] else 0.0 for k in (1, 2, 3)]


def train(docs: DataFrame) -> dict:
    """Count docs (text) and store the model; what comes back is its folder and a handful of numbers."""
    spark = docs.sparkSession
    tune(spark)
    buckets = max(12, -(-text_bytes(docs) // BUCKET_BYTES))
    path = local_path(shared_dir(spark))
    os.makedirs(path)

    def count(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            (c, w), (n,) = _sums((np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])), (np.concatenate([x[2] for x in held]),))
            b = _gram_bucket(c, w, buckets)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            for k in range(buckets):
                o = order[cut[k] : cut[k + 1]]
                if len(o):
                    yield k, _pack(np.diff(c[o], prepend=np.uint64(0)), w[o], n[o].astype("<u4"))

        def rows(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, z in pieces(texts):
                c, w, _ = bigrams(texts[a:z])
                (c, w), (n,) = _sums((c, w), (np.ones(len(c), np.int64),))
                held.append((c, w, n))
                size += len(c)
            if size >= HELD:
                yield rows(flush())
                held, size = [], 0
        if held:
            yield rows(flush())

    def grams(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, "<u8", "<u8", "<u4") for x in g["blob"]]
        (c, w), (n,) = _sums((np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])), (np.concatenate([p[2] for p in parts]),))
        h = pair(c, w)
        order = np.argsort(h)
        _save(path, f"gram{key[0]}", h[order])
        _save(path, f"count{key[0]}", n[order].astype("<u4"))
        (ends,), (types, tokens) = _sums((w,), (np.ones(len(w), np.int64), n))
        (begins,), (n1, n2, n3) = _sums((c,), (n == 1, n == 2, n > 2))
        z, y = np.zeros(len(ends), np.int64), np.zeros(len(begins), np.int64)
        (word,), stats = _sums((np.concatenate([ends, begins]),), tuple(np.concatenate(x) for x in ((tokens, y), (types, y), (z, n1), (z, n2), (z, n3))))
        b = _bucket(word, buckets)  # ascending, as the words are
        cut = np.searchsorted(b, np.arange(buckets + 1))
        out = []
        for k in range(buckets):
            s = slice(cut[k], cut[k + 1])
            if cut[k + 1] > cut[k]:
                out.append((k, _pack(np.diff(word[s], prepend=np.uint64(0)), stats[0][s].astype("<u8"), *[x[s].astype("<u4") for x in stats[1:]])))
        shares = [int((n == k).sum()) for k in range(1, 5)]
        frame = pd.DataFrame(out, columns=["bucket", "blob"])
        for k in range(4):
            frame[f"n{k + 1}"] = [shares[k] if i == 0 else 0 for i in range(len(frame))]
        return frame

    def words(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, "<u8", "<u8", "<u4", "<u4", "<u4", "<u4") for x in g["blob"]]
        (word,), stats = _sums((np.concatenate([np.cumsum(p[0]) for p in parts]),), tuple(np.concatenate([p[k] for p in parts]) for k in range(1, 6)))
        table_ = np.zeros(len(word), WORD)
        for name, x in zip(WORD.names, stats):
            table_[name] = x
        _save(path, f"word{key[0]}", word)
        _save(path, f"stat{key[0]}", table_)
        count_, ends = stats[0], stats[1]
        row = {"tokens": count_.sum(), "vocabulary": (count_ > 0).sum(), "types": ends.sum(), "docs": count_[word == END].sum()}
        row |= {f"e{k}": (ends == k).sum() for k in range(1, 5)} | {"e5": (ends > 4).sum()} | {f"n{k}": g[f"n{k}"].sum() for k in range(1, 5)}
        return pd.DataFrame([{k: int(v) for k, v in row.items()}])

    n4 = ", ".join(f"n{k} long" for k in range(1, 5))
    sent = docs.select("text").mapInArrow(count, "bucket int, blob binary")
    sent = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(grams, f"bucket int, blob binary, {n4}")
    kinds = f"tokens long, vocabulary long, types long, docs long, {', '.join(f'e{k} long' for k in range(1, 6))}, {n4}"
    sums = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(words, kinds)
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns]).first().asDict()
    e = [total[f"e{k}"] for k in range(1, 5)]
    return total | {
        "path": path,
        "buckets": buckets,
        "pair_discounts": discounts([total[f"n{k}"] for k in range(1, 5)]),
        "word_discounts": discounts(e),
        "more": e[2] + e[3] + total["e5"],
    }


@lru_cache(maxsize=4096)
def _mapped(path: str, name: str) -> np.ndarray | None:
    """An array of the model, mapped and not read; None where the bucket is empty."""
    file = f"{path}/{name}.npy"
    return np.load(file, mmap_mode="r") if os.path.exists(file) else None


class Reader:
    """Probabilities from a stored model."""

    def __init__(self, model: dict):
        self.m = model

    def find(self, keys: str, values: str, bucket: np.ndarray, h: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """The value of each hash; ``empty`` where it isn't stored."""
        out = np.repeat(empty, len(h))
        order = np.lexsort((h, bucket))
        cut = np.searchsorted(bucket[order], np.arange(self.m["buckets"] + 1))
        for k in np.flatnonzero(np.diff(cut)):
            o = order[cut[k] : cut[k + 1]]
            stored = _mapped(self.m["path"], f"{keys}{k}")
            if stored is None or not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, h[o]), len(stored) - 1)
            hit = stored[at] == h[o]
            out[o[hit]] = _mapped(self.m["path"], f"{values}{k}")[at[hit]]
        return out

    def words(self, w: np.ndarray) -> np.ndarray:
        return self.find("word", "stat", _bucket(w, self.m["buckets"]), w, np.zeros(1, WORD))

    def score(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: log10 of its probability, log10 of the base probability, and its count in training."""
        m = self.m
        known, at = np.unique(np.concatenate([word, context]), return_inverse=True)
        stats = self.words(known)
        s, c = stats[at[: len(word)]], stats[at[len(word) :]]
        total = np.where(context == START, m["docs"], c["count"]).astype(float)
        (gc, gw), place = self._distinct(context, word)
        n = self.find("gram", "count", _gram_bucket(gc, gw, m["buckets"]), pair(gc, gw), np.zeros(1, "<u4"))[place].astype(float)
        d, e = np.array([0.0, *m["pair_discounts"]]), np.array([0.0, *m["word_discounts"]])
        cut = lambda x, d: np.maximum(x - d[np.minimum(x, 3).astype(int)], 0.0)
        spare = e[1] * m["e1"] + e[2] * m["e2"] + e[3] * m["more"]
        if m["types"]:
            low = cut(s["ends"].astype(float), e) / m["types"] + spare / m["types"] / (m["vocabulary"] + 1)
        else:
            low = np.full(len(word), 1.0 / (m["vocabulary"] + 1))
        back = (d[1] * c["n1"] + d[2] * c["n2"] + d[3] * c["n3"]) / np.maximum(total, 1)
        p = np.where(total > 0, cut(n, d) / np.maximum(total, 1) + back * low, low)
        base = np.log10((s["count"] + 1.0) / (m["tokens"] + m["vocabulary"] + 1.0))
        return np.log10(np.maximum(p, 1e-300)), base, s["count"]

    @staticmethod
    def _distinct(context: np.ndarray, word: np.ndarray):
        _, first, place = np.unique(pair(context, word), return_index=True, return_inverse=True)
        return (context[first], word[first]), place


def score_table(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; a null text is its end alone."""

    def run(batches):
        reader = Reader(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sums = [np.zeros(0)] * 4
            for a, z in pieces(texts):
                c, w, n = bigrams(texts[a:z])
                lp, base, count = reader.score(c, w)
                first = np.cumsum(n) - n
                got = (n, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(lp, first))
                sums = [np.concatenate([x, y]) for x, y in zip(sums, got)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x.astype(np.int64)) for x in sums[:2]], pa.array(np.full(len(texts), model["tokens"], np.int64)), *[pa.array(x.astype(float)) for x in sums[2:]]],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    tune(docs.sparkSession)
    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def remainder(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose crc32(doc_id) mod 7 is not 2. Rows without an id are scored, not learnt from."""
    docs = table(spark, sf_dir, "documents")
    scored = score_table(docs, train(docs.where(remainder(F.col("doc_id"), 7) != 2)))
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
