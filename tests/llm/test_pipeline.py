"""The stages one after the other, each against what it should do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from cellstrata.llm import pii

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"kinds": F.lit("mine"), "score": F.lit(9)})
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "jaccard", "decontamination", "pii", "bpe"]
    good = steps["quality"](spark, docs, SF).cache()
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    judged = good.join(marks, "doc_id")
    assert good.columns == docs.columns and judged.where("quality = 0").count() <= 0.1 * marks.where("quality = 0").count()
    assert judged.where("quality = 1").count() >= 0.95 * marks.where("quality = 1").count()
    one = steps["jaccard"](spark, good, SF).cache()
    assert one.columns == docs.columns and one.select("text").distinct().count() == one.count() < good.count()
    clean = steps["decontamination"](spark, one, SF).cache()
    leak = one.join(F.broadcast(spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("b"))), F.col("text").contains(F.col("b")), "left_semi")
    assert clean.join(leak, "doc_id").count() == 0 and clean.count() >= one.count() - 2 * leak.count() - 2
    safe = steps["pii"](spark, clean, SF).cache()
    assert safe.columns == docs.columns and safe.where("kinds = 'mine' and score = 9").count() == clean.count()
    assert not safe.where(F.regexp_count("text", F.lit(pii.PATTERNS["email"])) > 0).where(~F.col("text").rlike("user\\d{12}@|USER\\d{12}@")).count()
    assert steps["bpe"](spark, safe, SF).count() == clean.count()


def test_documents_with_a_stretched_item_are_dropped(spark, tmp_path):
    from test_llm import stretched

    docs, items = stretched()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    clean = dict(corpus_pipeline.STAGES)["decontamination"](spark, d, str(tmp_path))
    assert sorted(x.doc_id for x in clean.collect()) == list(range(100, 125))


def test_whole_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
