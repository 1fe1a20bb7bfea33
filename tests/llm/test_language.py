"""Language identification: held-out accuracy and what has no language."""

import corpus
from pyspark.sql import functions as F

from voltpoint.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.digest(docs)
    truth = docs.select("doc_id", "lang")
    right = found.join(truth, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"))
    assert all(r.share > 0.98 for r in right.collect())
    score = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= score[0] <= score[1] <= 1


def test_the_label_is_no_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    blind = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, language.digest(docs).collect())) == sorted(map(tuple, language.digest(blind).collect()))


def test_texts_without_letters(spark):
    found = {(r.doc_id, r.lang_pred) for r in language.digest(corpus.awkward(spark)).collect()}
    assert {(5, "und"), (6, "und"), (None, "und")} <= found
    assert all(name in ("und", "en", "de", "fr", "xx") for _, name in found)
    unlabelled = corpus.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.digest(unlabelled).collect()} == {"und"}


def test_families_first():
    assert language.family_of("de") == language.family_of("en-GB") != language.family_of("fr")
    assert language.family_of("qqq") == "other"
