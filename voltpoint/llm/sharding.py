"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash. A bucket that holds more
bytes than a shard may is split on its next bit, the others stay as they are.
Each round takes the open buckets several bits deeper in one aggregation, which
also gives the sizes on the way down, so a bucket closes at the first bit at
which it fits. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpoint.llm.common import n_bytes, numbered, staged

#: Bits of the hash: of the document, then of its place in the input, which only
#: equal rows ever come to.
CONTENT_BITS, PLACE_BITS = 44, 16
BITS = CONTENT_BITS + PLACE_BITS
#: Bits that one round goes deeper.
ROUND_BITS = 6


def content_bits(doc_id: Column, text: Column) -> Column:
    """44 bits of the id and the text's bytes."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, CONTENT_BITS // 4), 16, 10).cast("bigint")


def _hash(text: Column, place: Column) -> Column:
    content = content_bits(F.col("doc_id"), text)
    place = F.pmod(F.xxhash64(place), F.lit(1 << PLACE_BITS))
    return F.shiftleft(content, PLACE_BITS) + place


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of ``h`` as a number."""
    return F.shiftright("h", BITS - depth)


def directory(sizes: DataFrame, shard_bytes: int) -> list[tuple[int, DataFrame]]:
    """The directory of ``(h, size)`` rows: for every round its depth in bits
    and its entries ``key, depth, prefix, bytes, rows``, ``key`` being each
    number of that many bits below the shard. Later rounds hold the shards below
    the few buckets that earlier ones leave open.

    A bucket closes when it fits or has one row, or when no bit is left."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    even = math.ceil(math.log2(max(1.0, total / shard_bytes)))
    start, depth = 0, min(BITS, even + ROUND_BITS)
    rounds = []
    while True:
        fine = sizes.groupBy(_prefix(depth).alias("key")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth))))
        nodes = levels.groupBy("depth", F.expr(f"shiftright(key, {depth} - depth)").alias("prefix"))
        nodes = nodes.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        nodes = staged(nodes, "buckets")
        fits = (F.col("bytes") <= shard_bytes) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        split = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        # A shard fits below a bucket that does not; above `start` all are open.
        below = nodes.where(fits & (F.col("depth") > start)).withColumn("parent", F.shiftright("prefix", 1))
        shards = nodes.where(fits & (F.col("depth") == start)).unionByName(
            below.join(split, ["depth", "parent"], "left_semi").drop("parent")
        )
        first = F.expr(f"shiftleft(prefix, {depth} - depth)")
        last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
        rounds.append((depth, shards.select(F.explode(F.sequence(first, last)).alias("key"), "depth", "prefix", "bytes", "rows")))
        still = nodes.where(~fits & (F.col("depth") == depth)).select(F.col("prefix").alias("open"))
        if still.isEmpty():
            return rounds
        sizes = sizes.join(still, _prefix(depth) == F.col("open"), "left_semi")
        start, depth = depth + 1, min(BITS, depth + ROUND_BITS)


def shard_documents(docs: DataFrame, shard_bytes: int, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns named by ``carry``, by default all), ``n_bytes`` and
    the shard: ``depth``, its bits ``shard``, ``shard_bytes``, ``oversized``.

    The size is the text's UTF-8 bytes; null and empty texts have none and are
    placed like others. Only a single document above the limit makes a larger
    shard. Ids that are null or repeat are told apart by the text, equal rows by
    their place in one written copy of the input. An empty table has no shard."""
    columns, whole = docs.columns if carry is None else carry, carry is None or "text" in carry
    # Whole rows are read several times: their places come from one written table.
    text, place = F.col("text"), F.monotonically_increasing_id()
    rows = docs.select(F.struct(*columns).alias("doc"), "doc_id", *([] if whole else ["text"]))
    if whole:
        rows, text, place = numbered(rows), F.col("doc.text"), F.col("rid")
    hashed = rows.select("doc", _hash(text, place).alias("h"), n_bytes(text).alias("size"))
    slim = staged(hashed.select("h", "size") if whole else hashed, "hashes")
    found = hashed if whole else slim
    place = F.lit(None).cast("struct<depth:int,prefix:bigint,bytes:bigint,rows:bigint>")
    found = found.withColumn("place", place)
    for depth, entries in directory(slim.select("h", "size"), shard_bytes):
        # What an earlier round has placed gets keys that no entry has.
        key = F.when(F.col("place").isNull(), _prefix(depth)).otherwise(-1 - F.pmod("h", F.lit(1024)))
        entry = F.struct(F.col("depth").cast("int").alias("depth"), "prefix", "bytes", "rows")
        found = (
            found.withColumn("key", key)
            .join(entries.select("key", entry.alias("entry")), "key", "left")
            .select("doc", "h", "size", F.coalesce("place", "entry").alias("place"))
        )
    bits = F.expr("if(place.depth = 0, '', lpad(bin(place.prefix), place.depth, '0'))")
    return found.select(
        "doc",
        F.col("size").alias("n_bytes"),
        F.col("place.depth").alias("depth"),
        bits.alias("shard"),
        F.col("place.bytes").alias("shard_bytes"),
        (F.col("place.bytes") > shard_bytes).alias("oversized"),
    )


def digest(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, depth, shard, shard_bytes,
    oversized``."""
    return shard_documents(docs, shard_bytes, carry=["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), "*").drop("doc")
