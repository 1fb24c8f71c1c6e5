"""Incremental ingest of trace logs: new files, each trace once, running calls and cost per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io

SCHEMA = "trace_id long, model string, tokens long, ts timestamp"
TOTALS = "model string, calls long, tokens long, cost double, over_limit boolean"
#: How long a trace may come again and still be known: the state holds no more than that.
WATERMARK = "7 days"


class OverLimit(RuntimeError):
    """The cost of some model went over the limit; what had been taken is in the totals."""


def _cost(prices: dict[str, float]):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), F.col("model")), F.lit(0.0))


def totals(rows: DataFrame, prices: dict[str, float], limit: float) -> DataFrame:
    """Calls, tokens and cost per model, and whether a model is over the limit; models without a price cost nothing."""
    t = rows.where("tokens > 0").groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return priced(t, prices, limit)


def priced(t: DataFrame, prices: dict[str, float], limit: float) -> DataFrame:
    t = t.select("model", "calls", "tokens", F.round(F.col("tokens") * _cost(prices) / 1e6, 6).alias("cost"))
    return t.withColumn("over_limit", F.col("cost") > limit)


def stream(spark: SparkSession, path: str, watermark: str | None = WATERMARK, files: int | None = None) -> DataFrame:
    """New rows of JSON lines under path, each trace_id once within the watermark, which bounds the state; without one, for ever."""
    s = spark.readStream.schema(SCHEMA)
    s = (s.option("maxFilesPerTrigger", files) if files else s).json(path)
    return s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["trace_id"]) if watermark else s.dropDuplicates(["trace_id"])


def run_once(spark: SparkSession, path: str, checkpoint: str, table: str, prices: dict[str, float], limit: float, watermark: str | None = WATERMARK, files: int | None = None, stop: bool = False) -> DataFrame:
    """Take what is new, add it to the running totals, and return the newest.

    Each batch adds to the totals of the one before and writes its own version; one that is run again replaces its own,
    and versions older than the one before are removed. With ``stop`` nothing is taken after the batch whose totals are
    over the limit, in this run or a later one, and OverLimit is raised. A folder without files gives no rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        new = batch.where("tokens > 0").groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
        before = versions(spark, table, below=n)
        if before:
            old = spark.read.schema(TOTALS).parquet(f"{table}/batch={before[-1]}")
            if stop and old.where("over_limit").limit(1).count():
                raise OverLimit
            new = new.unionByName(old.select("model", "calls", "tokens")).groupBy("model").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
        priced(new, prices, limit).coalesce(1).write.mode("overwrite").parquet(f"{table}/batch={n}")  # a row for each model
        for k in before[:-1]:
            io.remove(spark, f"{table}/batch={k}")

    q = stream(spark, path, watermark, files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception as e:
        if "OverLimit" in str(e):
            raise OverLimit(f"{table}: a model's cost is over {limit}") from e
        raise
    return newest(spark, table)


def versions(spark: SparkSession, table: str, below: int | None = None) -> list[int]:
    """Numbers of the batches whose totals are there."""
    found = sorted(int(p.rpartition("batch=")[2]) for p in io.listed(spark, table) if "batch=" in p)
    return [n for n in found if below is None or n < below]


def newest(spark: SparkSession, table: str) -> DataFrame:
    """The totals of the newest batch; no rows where there is none."""
    found = versions(spark, table)
    return spark.read.schema(TOTALS).parquet(f"{table}/batch={found[-1]}") if found else spark.createDataFrame([], TOTALS)
