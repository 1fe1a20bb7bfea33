"""Registered queries: SQL where there is some, and the agreed columns."""

import __spark_entry__ as contract
import corpus_pipeline
import oracle
import pytest

from voltpoint.llm import queries as Q
from voltpoint.llm import sharding
from voltpoint.llm.oracle import ORACLE

COLUMNS = {
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_substrings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_benchmark": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    ours = Q.queries()[name](spark, sf_dir).toArrow()
    theirs = oracle.connect(sf_dir).sql(ORACLE[name]).to_arrow_table()
    assert theirs.num_rows > 0
    assert oracle.differences(ours, theirs) == []


def test_the_registered_shards_split(spark):
    shards = Q.op4_sharding(spark, "/root/testdata/sf0.01").select("depth", "shard").distinct().collect()
    assert len(shards) >= 4 and min(r.depth for r in shards) > 0


def test_small_shards_equal_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for limit in (300, 20_000, 200_000):
        ours = sharding.digest(docs, limit).toArrow()
        theirs = oracle.connect(sf_dir).sql(ORACLE["op4_sharding"].replace(str(Q.SHARD_BYTES), str(limit)))
        assert oracle.differences(ours, theirs.to_arrow_table()) == []
        assert len(set(ours["shard"].to_pylist())) > 1


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    found = dict(Q.queries()[name](spark, sf_dir).dtypes)
    wanted = dict(c.strip().split(" ") for c in COLUMNS[name].split(","))
    assert {c: found.get(c) for c in wanted} == wanted


def test_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
