"""What the pipeline's stages leave to each other: bounds of batches, and nothing kept in the Python workers."""

import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from factloom.llm import common, packing

SF = "/root/testdata/sf0.001"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def words_kept(spark, path, most):
    """Cached words of each worker that answers."""

    def run(batches):
        for b in batches:
            held = packing._encoder(path, most)[1]
            yield pa.RecordBatch.from_arrays([pa.array([len(held.new) + len(held.old)] * b.num_rows, pa.int64())], ["n"])

    return [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(run, "n long").collect()]


def test_packing_leaves_no_words(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    most = corpus_pipeline.PACK_CACHE
    want = packing.pack_table(docs, path, cache=most).collect()
    assert sum(words_kept(spark, path, most)) > 0
    assert sorted(corpus_pipeline.pack(spark, docs, SF).collect()) == sorted(want)
    for _ in range(3):  # each worker that kept words has packed again by then
        corpus_pipeline.pack(spark, docs.repartition(16), SF).collect()
    assert max(words_kept(spark, path, most)) == 0


def test_small_cache_same_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([" ".join(f"w{i} x{k * i % 97}," for i in range(40)) for k in range(30)])
    large, small = packing.Encoder(path), packing.Encoder(path, 20)
    for a in range(0, 30, 5):
        x, y = large.encode(texts.slice(a, 5)), small.encode(texts.slice(a, 5))
        assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist()
    assert len(small.new) < len(large.new)


def test_stages_bound_their_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, most in ((corpus_pipeline.drop_toxic, 2 << 20), (corpus_pipeline.drop_repeats, 2 << 20), (corpus_pipeline.pack, 4 << 20)):
        stage(spark, docs, SF)
        assert int(spark.conf.get(BYTES)) == most < common.BATCH_BYTES
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) < 4096
    packing.pack_table(docs, public_tokenizers.path("byte_bpe_50k.json"))  # elsewhere the bound is as it was
    assert int(spark.conf.get(BYTES)) == common.BATCH_BYTES
