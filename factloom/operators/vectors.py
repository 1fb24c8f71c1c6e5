"""Exact top-k cosine retrieval: blocks of queries against blocks of the corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held in memory together; more are dealt to several blocks.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 8192


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, entity, rank, chunk_id, source, score): the k chunks of highest cosine, ties to the smaller chunk_id.

    Both sides are dealt to blocks, each pair of blocks is one matrix product, and k rows of each leave it. Vectors that
    are null, empty or hold nulls or values that aren't finite take no part, nor do pairs of different lengths.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    queries, corpus = queries.where(fit), corpus.where(fit)
    n, m = queries.count(), corpus.count()
    q_blocks, c_blocks = -(-n // BLOCK_QUERIES) or 1, -(-m // BLOCK_ROWS) or 1
    deal = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = queries.select(deal("query_id", q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.size("embedding").alias("w"), "query_id", "entity", F.col("embedding").alias("x"))
    b = corpus.select(every(q_blocks).alias("qb"), deal("chunk_id", c_blocks).alias("cb"), F.size("embedding").alias("w"), "chunk_id", "source", F.col("embedding").alias("y"))

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "entity", "chunk_id", "source", "score"]
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in names})
        unit = lambda v: (lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300))(np.stack(v.to_list()).astype(float))
        scores = unit(x["x"]) @ unit(y["y"]).T
        ids, out = y["chunk_id"].to_numpy(), []
        for i, row in enumerate(scores):
            cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            near = np.flatnonzero(row >= cut)
            best = near[np.lexsort((ids[near], -row[near]))][:k]
            out.append(pd.DataFrame({"query_id": x["query_id"].iloc[i], "entity": x["entity"].iloc[i], "chunk_id": ids[best], "source": y["source"].to_numpy()[best], "score": row[best]}))
        return pd.concat(out)[names]

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, entity {queries.schema['entity'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, source {corpus.schema['source'].dataType.simpleString()}, score double"
    found = a.groupBy("qb", "cb", "w").cogroup(b.groupBy("qb", "cb", "w")).applyInPandas(block, kinds)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
