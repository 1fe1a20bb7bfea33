"""Awkward rows and empty tables in every operator and stage."""

import collections

import corpus
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voltpoint.llm import decontaminate, language, licenses, manifest, mixing, neardup, quality, secrets, sharding, substrings, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark):
    return spark.createDataFrame([("i", "aaa bbb"), (None, None)], "item_id string, text string")


DIGESTS = {
    "licenses": lambda s, d: licenses.digest(d),
    "language": lambda s, d: language.digest(d),
    "mixing": lambda s, d: mixing.digest(d),
    "sharding": lambda s, d: sharding.digest(d, 1000),
    "tokens": lambda s, d: tokens.digest(d, BPE),
    "quality": lambda s, d: quality.digest(d),
    "secrets": lambda s, d: secrets.digest(d),
    "substrings": lambda s, d: substrings.digest(d),
    "benchmark": lambda s, d: decontaminate.digest(d, benchmark(s)),
    "neardup": lambda s, d: neardup.digest(d),
    "manifest": lambda s, d: manifest.digest(d),
}


@pytest.mark.parametrize("name", list(DIGESTS))
def test_one_row_for_each_document(spark, tmp_path, name):
    docs = corpus.stored(corpus.awkward(spark), tmp_path / "d")
    got = DIGESTS[name](spark, docs)
    ids = collections.Counter(r.doc_id for r in got.collect())
    assert ids == collections.Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", list(DIGESTS))
def test_empty_tables(spark, name):
    assert DIGESTS[name](spark, corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("name", list(DIGESTS))
def test_a_very_long_text(spark, tmp_path, name):
    """Three million characters in one text, most of them unlike each other."""
    words = [f"w{(i * 7919) % 99991:x}" for i in range(500_000)]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(words[:60]), "en", "a"), (3, "short", "de", "b")]
    docs = corpus.stored(corpus.awkward(spark, rows), tmp_path / "d")
    assert sorted(r.doc_id for r in DIGESTS[name](spark, docs).collect()) == [1, 2, 3]


def test_equal_rows_without_an_id_are_dealt_out(spark):
    rows = [(None, f"text {i} of many", "en", "a") for i in range(500)]
    sized = mixing._sized(corpus.awkward(spark, rows), "source", ["doc_id"])
    assert sized.select("h").distinct().count() == 500


def test_mixture(spark, sf_dir, tmp_path):
    docs = corpus.stored(corpus.awkward(spark), tmp_path / "d")
    plan = mixing.mix_plan(docs).collect()
    for source in {r["doc"].source for r in plan}:
        mine = [r for r in plan if r["doc"].source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    total = sum(r.size for r in plan)
    targets = {r["doc"].source: r.target for r in plan}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    assert order.count() == sum(len(r.positions) for r in plan)
    assert all(0 <= p <= 1 for r in plan for p in r.positions)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once, again = (sorted(map(tuple, mixing.digest(t).collect())) for t in (table, table.repartition(7)))
    assert once == again


def test_curriculum_follows_the_schedule(spark):
    rows = [(i, " ".join(["w"] * 10), "en", "abc"[i % 3]) for i in range(6000)]
    plan = mixing.mix_plan(corpus.awkward(spark, rows)).select("doc.source", F.explode("positions").alias("t"))
    early = {r.source: r.early for r in plan.groupBy("source").agg(F.avg((F.col("t") < 0.5).cast("int")).alias("early")).collect()}
    # The weight 1 + s (2 t - 1) gives (1 - s / 2) / 2 of a source by half time.
    for source, slope in zip("abc", mixing.SLOPES):
        assert early[source] == pytest.approx((1 - slope / 2) / 2, abs=0.01)


def test_shards_fit(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "en", "a") for i in range(500)] + [(None, "same row", "en", "a")] * 300 + [(7, "y" * 5000, "en", "a")]
    docs = corpus.stored(corpus.awkward(spark, rows), tmp_path / "d")
    got = sharding.shard_documents(docs, 400).collect()
    assert len(got) == len(rows)
    size, shards = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.n_bytes
        shards[r.shard].append(r)
    for shard, mine in shards.items():
        assert {r.shard_bytes for r in mine} == {size[shard]} and len(shard) == mine[0].depth
        assert size[shard] <= 400 or len(mine) == 1 and mine[0].oversized
    # Only oversized buckets split: a shard and its sibling do not fit together.
    for shard in shards:
        if shard:
            assert sum(n for other, n in size.items() if other.startswith(shard[:-1])) > 400
    # No shard lies below another.
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)


@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_pipeline_stages(spark, tmp_path, rows):
    docs = corpus.stored(getattr(corpus, rows)(spark), tmp_path / "docs")
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus.stored(stage(spark, docs, str(tmp_path)), tmp_path / name)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {"shard", "shard_bytes"} <= set(docs.columns)
    assert (docs.count() > 0) == (rows == "awkward")


def test_pipeline_against_the_operators(spark, sf_dir):
    """Each stage's decisions, worked out once more from its own input."""
    from test_exact import brute_components, brute_counts

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, table, sf_dir).collect()
    kept = {r.doc_id for r in quality.digest(table).where("kept").collect()}
    assert {r.doc_id for r in good} == kept
    assert not any(brute_counts(r.text)[-1] for r in good)
    good_frame = spark.createDataFrame(good, table.schema)
    unique = stages["near_duplicates"](spark, good_frame, sf_dir).collect()
    assert {r.doc_id for r in unique} == {doc for doc, _, _, k in brute_components([(r.doc_id, r.text) for r in good], 80) if k}
    clean = stages["benchmark_decontamination"](spark, spark.createDataFrame(unique, table.schema), sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert clean.count() == len(unique)
    assert decontaminate.digest(clean, items).where("contaminated").count() == 0
    result = corpus_pipeline.run(spark, sf_dir)
    taken = mixing.digest(clean).agg(F.sum((F.col("taken") > 0).cast("int"))).first()[0]
    assert result.select("doc_id").distinct().count() == taken
