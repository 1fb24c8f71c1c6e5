"""Readers and writers: lenient JSON lines, QA data sets, nested documents, trace logs and vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a broken line is a row with its text in ``_bad``, blank ones are skipped."""
    row = F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select("r.*")


def line_report(df: DataFrame) -> DataFrame:
    """How many lines could be read, and how many were broken."""
    return df.agg(F.count_if(F.col(BAD).isNull()).alias("read"), F.count_if(F.col(BAD).isNotNull()).alias("broken"))


def unify_cases(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under one name each: the first alias that is there and not null."""
    return df.select(*[F.coalesce(*[F.col(a) for a in names if a in df.columns], F.lit(None)).alias(k) for k, names in aliases.items()])


def unwrap_references(c: str) -> F.Column:
    """A text, or a JSON list of texts, as one text."""
    items = F.from_json(c, "array<string>")
    return F.when(F.ltrim(c).startswith("["), F.coalesce(F.array_join(items, "\n"), F.col(c))).otherwise(F.col(c))


def read_json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of files that each hold one JSON array: (id, category, reasoning_type, text, question, expected_answer), every field from the first of its names that isn't empty."""
    schema = "id string, _id string, category string, reasoning_type string, type string, text string, references string, question string, expected_answer string, answer string"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    return r.select(
        F.coalesce(F.nullif("id", F.lit("")), "_id").alias("id"), F.coalesce("category", F.lit("")).alias("category"), first("reasoning_type", "type").alias("reasoning_type"),
        first("text", "references").alias("text"), first("question", "text").alias("question"), first("expected_answer", "answer").alias("expected_answer"),
    )


def table_evidence(table: str, before: str, after: str) -> F.Column:
    """A table's lines, then the texts before and after it, each part that isn't blank on lines of its own."""
    parts = F.array(linearise(table), F.array_join(before, " "), F.array_join(after, " "))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), lambda p: F.trim(p) != ""), "\n")


def context_evidence(table: str, paragraphs: str) -> F.Column:
    """A table's cells by tabs under TABLE, and paragraphs, an array of texts, under CONTEXT."""
    rows = F.array_join(F.transform(F.coalesce(table, F.array().cast("array<array<string>>")), lambda r: F.array_join(r, "\t", "")), "\n")
    return F.concat(F.lit("TABLE\n"), rows, F.lit("\n\nCONTEXT\n"), F.array_join(F.coalesce(paragraphs, F.array().cast("array<string>")), "\n", ""))


def exposures(spark: SparkSession, path: str, pattern: str, special: str, names: tuple[str, str]) -> DataFrame:
    """(case_id, category, sources): ids that whole files below a folder mention, with the files' paths.

    A file is of the second category if its text has ``special`` in any case, else of the first.
    """
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("source"))
    category = F.when(F.contains(F.lower("value"), F.lit(special)), names[1]).otherwise(names[0])
    found = t.select("source", category.alias("category"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)))).alias("case_id"))
    return found.groupBy("case_id", "category").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def linearise(table: str) -> F.Column:
    """An array of rows of cells as lines with bars."""
    return F.array_join(F.transform(table, lambda row: F.array_join(row, " | ", "")), "\n")


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All trace files under a folder, with the file each row came from."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def case_ids(texts: DataFrame, pattern: str) -> DataFrame:
    """(case_id, sources): every id that the texts (source, text) mention."""
    found = texts.select("source", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("case_id"))
    return found.groupBy("case_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def write_fields(df: DataFrame, path: str, fields: list[str], kind: str = "json") -> None:
    """The given columns only, missing ones null."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def save_index(chunks: DataFrame, path: str, model: str, size: int, overlap: int) -> None:
    """Chunks with their vectors, and a manifest of one row."""
    chunks.write.parquet(f"{path}/chunks")
    n = chunks.sparkSession.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    n.select(F.lit(model).alias("model"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "chunks", "vectors").write.parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks; refused where the manifest says that some have no vector, or where the counts differ."""
    m = spark.read.parquet(f"{path}/manifest").first()
    df = spark.read.parquet(f"{path}/chunks")
    if m["chunks"] != m["vectors"] or df.count() != m["chunks"]:
        raise ValueError(f"{path}: {m['chunks']} chunks, {m['vectors']} vectors in the manifest")
    return df


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; nothing where it isn't there."""
    fs, p = _file_system(spark, path)
    return [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Take a folder away, if it is there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
