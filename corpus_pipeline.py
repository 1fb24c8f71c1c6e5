"""A corpus pipeline of four stages: toxic documents go, one of each near-duplicate group stays, repeated passages go,
and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. Where the input is empty so is the result; null
texts count as empty; rows without an id stay until the packing; further columns are passed on unchanged.
"""

from __future__ import annotations

from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import near, packing, suffix, toxicity
from factloom.llm.common import release, settings, stash, table

#: No SQL twin: compression, byte-level removal and packing aren't expressible; tests compare with brute force.
ORACLE_SQL = None

#: The stages run in the same executors and Python workers one after another, so each must leave room: bytes of an Arrow
#: batch, rows that the Parquet reader holds at a time, and entries of a worker's cache of words while it packs.
STAGE_BYTES, PACK_BYTES, READ_ROWS, PACK_CACHE = 2 << 20, 4 << 20, 512, 100_000


def lean(batch_bytes: int):
    """A stage with these bounds. Those of batches and of the reader stay set in the session, as results are lazy."""

    def bound(stage):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, *args, **more) -> DataFrame:
            spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
            with settings(spark, factloom__batchBytes=str(batch_bytes)):
                return stage(spark, docs, *args, **more)

        return run

    return bound


@lean(STAGE_BYTES)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go; it learns from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


@lean(STAGE_BYTES)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the document with the smallest id stays.

    Rows that repeat the id and text of one that stays, stay with it; where texts of one group share its smallest id, the
    one of the smallest class stays. A text whose id another text has too is judged by itself.
    """
    rows = near.linked_classes(docs, words=5, percent=80).where("n_shingles > 0 and doc_id is not null")
    first = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("cid").alias("first"))
    gone = rows.join(first, "component_id").where("doc_id <> component_id or cid <> first")
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("tkey").alias("__tkey")).distinct()
    same = (docs["doc_id"].cast("long") == gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__tkey"])
    return docs.join(gone, same, "left_anti")


@lean(STAGE_BYTES)
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 50 bytes that a smaller id has go from the texts; characters cut through go whole."""
    marked, columns = suffix.with_spans(docs), docs.columns

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            spans = b.column(b.schema.get_field_index("__spans")).to_pylist()
            texts = []
            for t, s in zip(b.column(k).to_pylist(), spans):
                texts.append(suffix.cut_spans(t.encode(), s)[0].decode(errors="ignore") if t and s else t)
            cols = {n: b.column(n) for n in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                n = [len(t) if s else m for t, s, m in zip(texts, spans, cols["n_chars"].to_pylist())]
                cols["n_chars"] = pa.array(n, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], columns)
        release()

    return marked.mapInArrow(run, docs.schema)


@lean(PACK_BYTES)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_table(docs, path, cache=PACK_CACHE, keep=False)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", drop_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
