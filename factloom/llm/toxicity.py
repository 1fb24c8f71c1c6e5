"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what sets toxic text apart. Windows of a word
each, set in a fixed carrier, are compressed with the ordinary dictionary and with both together; the bytes that the
toxic dictionary saves are the window's distance. A document's score is a calibrated function of how often and how
strongly its windows are nearer to toxic text.

Fitting: at most FIT_ROWS labelled rows, those with the smallest hash of their id, taken alike at every size. Near
copies count once among them, and so does each id. Their whole texts are read, in Spark tasks: words are counted, and features made, where
the rows are. The ordinary dictionary is trained on a sample: windows spread evenly over the whole texts of
ORDINARY_ROWS of the plain ones. Everything else covers whole texts of all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash, table, tune
from .tokens import pieces

#: Bound of the labelled rows a model is fitted on; of the plain ones among them that the ordinary dictionary is trained on, and of the windows drawn from each.
FIT_ROWS, ORDINARY_ROWS, ORDINARY_WINDOWS = 12_000, 1500, 40
ORDINARY_BYTES, TOXIC_BYTES, LEVEL, WINDOW_BYTES = 8192, 2048, 3, 64
#: Follows each window, as no match may start in the last bytes of an input. Long enough for the block to be stored compressed whatever the window holds.
CARRIER = b"#0!1$2%3&4(5)6*7+8/9:<;=>?@[]^_`{|}~#!$%&()*+/"
#: Distances of this many bytes and more count as hits.
HIT = 3
#: Distances of words that a task keeps.
CACHE = 60_000
_TRIM = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def words(text: str) -> list[str]:
    """The text's windows: its words in lower case."""
    return _TRIM.findall(text.lower())


def _family(text: str) -> int:
    """The smallest hash of the text's word triples, which near copies share."""
    w = text.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content of a trained dictionary; where the samples are too few to train on, the samples themselves."""
    joined = b"".join(samples)
    try:
        trained = zs.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
        return trained[-max(size - 400, size // 2) :]
    except (zs.ZstdError, ValueError, MemoryError):
        return joined[-size:]


class Model:
    """Dictionaries and calibration; small, and picklable."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def __reduce__(self):
        return Model, (self.ordinary, self.toxic, self.weights)

    @property
    def meter(self) -> Meter:
        return _meter(self.ordinary, self.toxic)

    def features(self, ws: list[str], counts: list[int] | None = None) -> np.ndarray:
        """Of a text with these words, each as often as counts says, or once."""
        g = self.meter.distances(ws)
        if not len(g):
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        n = np.ones(len(g), np.int64) if counts is None else np.array(counts, np.int64)
        hits, strong, total = n[g >= HIT].sum(), n[g >= HIT + 2].sum(), n.sum()
        return np.array([1.0, np.log1p(hits), 30 * min(0.1, hits / total), min(8, max(0, g.max())) / 4, 30 * min(0.1, strong / total)])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(words(text)) @ self.weights, -30, 30))))


class Meter:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        base = CARRIER + ordinary
        # the faster strategies index only some positions of a dictionary
        p = zs.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(base) + len(toxic), source_size=128, min_match=4, strategy=zs.STRATEGY_LAZY)

        def compressor(content: bytes):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zs.ZstdCompressor(dict_data=d, compression_params=p).compress

        self.plain, self.both, self.cache = compressor(base), compressor(base + toxic), {}

    def distances(self, ws: list[str]) -> np.ndarray:
        """A window longer than WINDOW_BYTES is taken apart and counts by its largest part."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in set(ws).difference(cache):
            b = w.encode()
            parts = [b] if len(b) <= WINDOW_BYTES else [b[i : i + WINDOW_BYTES] for i in range(0, len(b), WINDOW_BYTES // 2)]
            cache[w] = max(len(self.plain(x)) - len(self.both(x)) for x in (b" " + y + b" " + CARRIER for y in parts))
        return np.array([cache[w] for w in ws], np.int64)


@lru_cache(maxsize=4)
def _meter(ordinary: bytes, toxic: bytes) -> Meter:
    return Meter(ordinary, toxic)


def spread(text: str) -> list[bytes]:
    """At most ORDINARY_WINDOWS of the text's windows of WINDOW_BYTES, evenly from its first to its last."""
    b = text.lower().encode()
    n = -(-len(b) // WINDOW_BYTES)
    at = np.unique(np.linspace(0, n - 1, min(n, ORDINARY_WINDOWS)).astype(int)) * WINDOW_BYTES
    return [b[i : i + WINDOW_BYTES] for i in at.tolist()]


def _windows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spread(t) for t in b.column(1).to_pylist()], pa.list_(pa.binary()))], ["row", "windows"])


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton steps."""
    w, ridge = np.zeros(5), np.diag([1e-3, 0.1, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
    return w


def _read(batches):
    """Of each row (row, doc_id, toxic, text) the family, the words of the whole text and how often each is there."""
    for whole in batches:
        for a, z in pieces([t or "" for t in whole.column(3).to_pylist()]):  # so that few words are held at a time
            b = whole.slice(a, z - a)
            texts = b.column(3).to_pylist()
            counts = [Counter(words(t)) for t in texts]
            columns = [*b.columns, pa.array([_family(t) for t in texts], pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "family", "words", "counts"])


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most FIT_ROWS rows of docs that have a label and aren't held out.

    Of each row only its id, family and features come to the driver, and the windows that the ordinary dictionary is
    trained on. Of several texts of one id the one with the smallest hash counts; an id with both labels counts as either.
    With fewer than two classes nothing is rejected: every score is a quarter.
    """
    spark = docs.sparkSession
    tune(spark)
    labelled = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labelled = labelled.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_ROWS))  # bounded by FIT_ROWS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one for each id
    rows = rows.select(F.xxhash64("doc_id", "toxic").alias("row"), "doc_id", "toxic", "text")
    rows = stash(rows.mapInArrow(_read, "row long, doc_id long, toxic int, text string, family long, words array<string>, counts array<long>"))
    each = rows.select("row", "doc_id", "toxic", "family", F.xxhash64("text").alias("hash")).toPandas()
    each = each.sort_values(["toxic", "doc_id", "hash"], ascending=[False, True, True]).drop_duplicates(["toxic", "family"])  # one of each family of near copies
    n, plain = int((each["toxic"] == 1).sum()), each["row"][each["toxic"] == 0].to_numpy()
    if not n or not len(plain):
        return Model(b"", b"", np.array([np.log(1 / 3), 0.0, 0.0, 0.0, 0.0]))

    def only(ids) -> DataFrame:
        return rows.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"row": ids}), "row long")), "row")

    kept = only(each["row"].to_numpy())
    by_word = kept.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("p"))
    least = max(3, round(0.005 * n))
    apart = by_word.where((F.col("t") >= least) & (F.col("t") / n >= 10 * (F.col("p") + 0.5) / len(plain))).toPandas()
    rng = np.random.default_rng(0)
    samples = [f" {w} ".encode().ljust(12, b"\n") for w, t in sorted(zip(apart["w"], apart["t"])) for _ in range(int(t))]  # the trainer skips short samples
    samples = [samples[i] for i in rng.permutation(len(samples))]
    some = plain[rng.permutation(len(plain))[:ORDINARY_ROWS]]  # bounded by ORDINARY_ROWS
    drawn = only(some).select("row", "text").mapInArrow(_windows, "row long, windows array<binary>").toPandas().set_index("row")["windows"].loc[some]
    windows = [bytes(w) for ws in drawn for w in ws]
    model = Model(_train(windows, ORDINARY_BYTES, 64, 8), _train(samples, TOXIC_BYTES, 12, 6), np.zeros(5))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            x = [m.features(w, c).tolist() for w, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["row", "x"])

    x = kept.select("row", "words", "counts").mapInArrow(run, "row long, x array<double>").toPandas().set_index("row")["x"].loc[each["row"]]
    model.weights = _calibrated(np.stack(x.to_list()), each["toxic"].to_numpy(float))
    return model


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text; a null text is scored as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches):
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t or "") for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])
        m.meter.cache.clear()  # the worker goes on to other stages

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """docs without the rows that score ``at`` or more; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            k = b.schema.get_field_index("text")
            yield b.filter(pa.array([m.score(t or "") < at for t in b.column(k).to_pylist()], pa.bool_()))
        m.meter.cache.clear()  # the worker goes on to other stages
        release()

    tune(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_zstd_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document scored; fitted without those whose crc32(doc_id) mod 5 is 0."""
    docs = table(spark, sf_dir, "documents")
    scored = score_table(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
