"""Quality by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is taken apart into windows of
WINDOW bytes, each compressed with either dictionary. What the bad dictionary needs more than the good one, over both
sizes together, is the normalised difference; a score is a calibrated function of that difference over the whole text,
of the share of bytes whose window is nearer to bad text, and of the share that either dictionary squeezes to next to
nothing (text that repeats itself, whose difference says nothing).

Fitting: at most FIT_ROWS labelled rows, those with the smallest hash of their id, and of these whole texts in that order
until FIT_BYTES are reached; a text that would go beyond is left out whole. Copies and near copies count once. Half of
these texts train the dictionaries and the other half, which the dictionaries have not seen, the calibration. Scores
cover whole texts of all documents.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table, tune
from .toxicity import _family

#: Bounds of the labelled rows a model is fitted on and of their bytes.
FIT_ROWS, FIT_BYTES = 12_000, 64 << 20
#: Bytes of a window and of each dictionary; shorter windows train no dictionary.
WINDOW, DICTIONARY_BYTES, LEAST_WINDOW, LEVEL = 512, 112_640, 40, 3
#: Bytes of a compressed frame that hold no text, and the ratio below which a window repeats itself.
FRAME, REPEATED = 9, 0.15
PASS = 0.7


def windows(text: str) -> list[bytes]:
    """The whole text's bytes, WINDOW at a time; an empty text has none."""
    b = text.encode()
    return [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on all windows of the texts; the windows themselves where they are too few to train on."""
    samples = [w for t in texts for w in windows(t) if len(w) >= LEAST_WINDOW]
    samples = [samples[i] for i in np.random.default_rng(0).permutation(len(samples))]
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, level=LEVEL).as_bytes()
    except (zs.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[:DICTIONARY_BYTES]


@lru_cache(maxsize=4)
def _compressor(content: bytes):
    p = zs.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=WINDOW)
    if not content:
        return zs.ZstdCompressor(compression_params=p).compress
    d = zs.ZstdCompressionDict(content)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p).compress


class Model:
    """Both dictionaries and the calibration; of a fixed size, and picklable."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def features(self, text: str) -> list[float]:
        """A text's normalised difference, and the shares of its bytes that are nearer to bad text and that repeat."""
        ws = windows(text)
        if not ws:
            return [1.0, 0.0, 0.0, 0.0]
        good, bad = _compressor(self.good), _compressor(self.bad)
        n = np.array([len(w) for w in ws])
        g = np.maximum(1, np.array([len(good(w)) for w in ws]) - FRAME)
        b = np.maximum(1, np.array([len(bad(w)) for w in ws]) - FRAME)
        total = n.sum()
        return [1.0, 10 * float((b - g).sum() / (b + g).sum()), float(n[b < g].sum() / total), float(n[np.minimum(g, b) < REPEATED * n].sum() / total)]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.array(self.features(text)) @ self.weights, -30, 30))))


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
    return w


def _families(batches):
    for b in batches:
        texts = b.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_family(t) for t in texts], pa.int64())], [*b.schema.names, "family"])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out, within the bounds above.

    Ids with contradicting labels teach nothing; of several texts of one id the one with the smallest hash counts. The
    driver gets id, hashes and size of at most FIT_ROWS texts, the texts of the dictionaries' half (FIT_BYTES at most), and the features of the other
    half. Where a class is missing, every score is the share of good rows, or a half without any labels.
    """
    spark = docs.sparkSession
    tune(spark)
    of_id = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other"))
    of_id = of_id.where((F.col("quality") == F.col("other")) & (fold(F.col("doc_id")) != 2)).drop("other")
    chosen = F.broadcast(of_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))  # bounded by FIT_ROWS
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one for each id
    texts = texts.groupBy(F.xxhash64("text").alias("hash"), "text").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"), F.min("doc_id").cast("long").alias("doc_id"))
    texts = texts.where("quality = other").select("hash", "doc_id", "quality", "text")
    rows = stash(texts.mapInArrow(_families, "hash long, doc_id long, quality int, text string, family long"))
    each = rows.select("hash", "doc_id", "quality", "family", F.octet_length("text").cast("long").alias("size")).toPandas()
    each["order"] = [zlib.crc32(b"order %d" % i) for i in each["doc_id"]]
    each = each.sort_values(["order", "doc_id", "hash"]).drop_duplicates(["quality", "family"])
    room, kept = FIT_BYTES, []
    for n in each["size"]:
        kept.append(n <= room)
        room -= n if kept[-1] else 0
    each = each[np.array(kept, bool)]
    each["half"] = each.groupby("quality").cumcount() % 2
    n = each["quality"].value_counts()
    if n.get(0, 0) < 2 or n.get(1, 0) < 2:
        share = (n.get(1, 0) + 1) / (len(each) + 2)
        return Model(b"", b"", np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))

    def only(half: int) -> DataFrame:
        ids = spark.createDataFrame(pd.DataFrame({"hash": each["hash"][each["half"] == half]}), "hash long")
        return rows.join(F.broadcast(ids), "hash")  # bounded by FIT_ROWS

    some = only(0).select("hash", "quality", "text").toPandas().sort_values(["hash", "text"])
    model = Model(*(_dictionary(some["text"][some["quality"] == q].to_list()) for q in (1, 0)), np.zeros(4))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["hash", "quality", "x"])

    seen = only(1).select("hash", "quality", "text").mapInArrow(run, "hash long, quality int, x array<double>").toPandas().sort_values("hash")
    model.weights = _calibrated(np.stack(seen["x"].to_list()), seen["quality"].to_numpy(float))
    return model


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text, repeated rows and rows without an id included; a null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches):
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t or "") for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op13_zstd_quality(spark, sf_dir: str) -> DataFrame:
    """Every document scored; fitted without those whose crc32(doc_id) mod 4 is 2. Odd rows as in fit_on() and score_table()."""
    docs = table(spark, sf_dir, "documents")
    scored = score_table(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
