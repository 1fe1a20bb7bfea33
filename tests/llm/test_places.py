"""Rows keep their numbers where a later scan is cut into other partitions."""

import collections

import pytest
from pyspark.sql import functions as F

from voltpoint.llm import common, neardup, sharding, substrings


def several_files(spark, path):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30 + 5 * (i % 17)))
    rows = [(i, text(i if i % 3 else 0)) for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("wide_first", [True, False])
def test_numbers_outlive_other_partitions(spark, tmp_path, conf, wide_first):
    docs = several_files(spark, str(tmp_path / "d"))
    key = "spark.sql.files.openCostInBytes"
    before, after = ("1", str(1 << 30)) if wide_first else (str(1 << 30), "1")
    conf(key, before)
    stays, found = neardup.one_of_each(docs), substrings.repeats(docs, 40, 16)
    conf(key, after)
    assert sorted(r.doc_id for r in stays.collect()) == [0, *(i for i in range(90) if i % 3)]
    got = collections.Counter(r.doc_id for r in found.where(F.size("found") > 0).collect())
    assert got == collections.Counter(range(0, 90, 3))


@pytest.mark.parametrize("wide_first", [True, False])
def test_shards_outlive_other_partitions(spark, tmp_path, conf, wide_first):
    # Equal rows are told apart by their place alone.
    rows = [(1, "the same text")] * 300 + [(i, f"text {i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    key = "spark.sql.files.openCostInBytes"
    before, after = ("1", str(1 << 30)) if wide_first else (str(1 << 30), "1")
    conf(key, before)
    placed = sharding.shard_documents(docs, 60)
    conf(key, after)
    found = placed.collect()
    assert len(found) == len(rows) and all(r.shard is not None for r in found)
    size = collections.Counter()
    for r in found:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 60 and all(size[r.shard] == r.shard_bytes for r in found)


def test_tables_on_the_way_to_a_result_go(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(common._folders, spark.sparkContext.applicationId, str(tmp_path / "work"))
    stays = neardup.one_of_each(several_files(spark, str(tmp_path / "d")))
    assert {p.name.split("-")[0] for p in (tmp_path / "work").iterdir()} == {"rows", "gone"}
    assert stays.count() == 61
    with pytest.raises(ZeroDivisionError):
        common.settled(lambda: 1 / 0, "nothing")
    assert not common._on_the_way
