"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle falls into one of t bins with a value that
starts with i, and each bin keeps its smallest. Rounds go on until no bin is
empty; from round t on, round t + j fills bin j, so 2 t rounds always do. Few
rounds fill the sketch of a long text, and each coordinate agrees between two
sets as often as they are similar.

Documents with one set of shingles are one class. Classes that share a band
meet; what hangs together by shared bands is a cluster, and inside a cluster all
pairs that share a band and are not linked yet are compared on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import binary_texts, mix, numbered, settled, staged
from voltpoint.llm.graph import connected_components

#: Words of a shingle, and least similarity of a link in percent.
SHINGLE, PERCENT = 5, 85


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band with which a pair at ``percent`` shares no band
    in one of 10**8 cases, as many rows as 64 bands allow."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1e-8) / math.log1p(-((percent / 100) ** rows)))
        if bands <= 64:
            break
    return bands, rows


#: Texts of a cluster that one task holds together.
BLOCK = 2048

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lowered; a text of
    fewer words is one shingle."""
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = text.lower().split()
        hashes = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            hashes[i] = value
        with np.errstate(over="ignore"):
            take = min(size, len(words))
            total = np.full(max(0, len(words) - take + 1) if take else 0, take, np.uint64)
            for k in range(take):
                total = mix(total) + hashes[k : k + len(total)]
        out.append(np.unique(mix(total)))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates for every set; none of them may be empty."""
    filled = np.full((len(sets), t), _EMPTY, np.uint64)
    flat = filled.reshape(-1)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for number in range(2 * t):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            h = mix(elements + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h & np.uint64(0xFFFFFFFF)) | np.uint64(number << 32)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if number < t else number - t
        np.minimum.at(flat, owner * t + bins, value)
        done = np.zeros(len(sets), bool)
        active = np.unique(owner)
        done[active] = (filled[active] != _EMPTY).all(axis=1)
        elements, owner = elements[~done[owner]], owner[~done[owner]]
    return filled


def band_keys(sets: list[np.ndarray], percent: int) -> np.ndarray:
    bands, rows = banding(percent)
    sketches = sketch(sets, bands * rows)
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketches), bands))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key) + parts[:, :, k]
    return mix(key)


def _keys(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = shingle_sets(binary_texts(batch))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys([sets[i] for i in full], percent).view(np.int64)
            # Empty sets get a key of their own, so that they lie apart.
            first, second, bands = batch.column("rid").to_pylist(), [None] * len(sets), [None] * len(sets)
            for row, i in enumerate(full):
                digest = xxhash.xxh3_128_digest(sets[i].tobytes())
                first[i], second[i] = np.frombuffer(digest, np.int64).tolist()
                bands[i] = keys[row]
            made = {"n_shingles": [len(s) for s in sets], "k1": first, "k2": second, "bands": bands}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema
            )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def link(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, percent: int) -> list[int]:
    """For each set one of those that a chain of links joins it to, the same one
    for all of them. ``side``: sets of different sides meet, or all if there is
    one side."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    one_side = bool((side == side[0]).all()) if len(side) else True
    for x in range(1, len(sets)):
        shared = (keys[:x] == keys[x]).sum(axis=1)
        meet = np.flatnonzero((shared > 0) & (one_side | (side[:x] != side[x])))
        for y in meet[np.argsort(-shared[meet], kind="stable")].tolist():
            if find(x) != find(y) and similar(sets[x], sets[y], percent):
                root[find(x)] = find(y)
    return [find(x) for x in range(len(sets))]


def _link_group(table: pa.Table, percent: int) -> pa.Table:
    """Edges from each linked node to the smallest of those it is joined to."""
    batch = table.combine_chunks().to_batches()[0]
    sets = shingle_sets(binary_texts(batch))
    keys = np.concatenate([band_keys(sets[i : i + 512], percent) for i in range(0, len(sets), 512)])
    nodes, side = batch.column("node").to_numpy(), batch.column("block").to_numpy()
    group = np.array(link(sets, keys, side, percent), np.int64)
    smallest = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, nodes)
    hangs = smallest[group] < nodes
    return pa.table({"a": nodes[hangs], "b": smallest[group][hangs]})


def _links(texts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Verified links between classes; a class is named by its first row."""
    classes = rows.where(F.col("n_shingles") > 0).groupBy("k1", "k2").agg(F.min("rid").alias("node"))
    one_each = staged(rows.join(classes.select("node"), F.col("rid") == F.col("node"), "left_semi").select("rid", "bands"), "bands")
    banded = one_each.select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = staged(shared, "shared")
    meets = banded.join(shared, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    clusters = staged(connected_components(meets.distinct()), "clusters")
    # A cluster beyond a block is dealt to tasks by pairs of its blocks.
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(staged(sizes, "sizes"), "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    texts = texts.join(placed, F.col("rid") == F.col("node")).select("component", "node", "block", "text", other.alias("other"))
    texts = texts.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    linked = texts.groupBy("component", "low", "high").applyInArrow(lambda t: _link_group(t, percent), "a bigint, b bigint")
    return staged(linked, "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rid, doc_id, n_shingles, component_id, kept, keep`` for every row.

    Rows are linked whose sets of five-word shingles are similar by ``percent``
    or more. ``rid`` is a number that the row is given once. ``component_id`` is the smallest id reachable over links, ``kept``
    says that it is the row's own, and ``keep`` is true for just one row of each
    component, even where rows repeat.

    Null, empty and blank texts have no shingle and stand alone. Null ids are
    passed over for ``component_id`` and never ``kept``; a component of null ids
    has a null one. An empty table has no rows."""
    return _judged(numbered(docs.select("doc_id", "text")), percent)


def _judged(texts: DataFrame, percent: int) -> DataFrame:
    """`near_duplicates` of ``rid, doc_id, text``, a written table."""
    schema = T.StructType(
        [texts.schema["doc_id"], *T.StructType.fromDDL("rid bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")]
    )
    rows = staged(texts.mapInArrow(lambda b: _keys(b, percent, to_arrow_schema(schema)), schema), "sketches")
    components = connected_components(_links(texts, rows, percent))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    classes = rows.where(F.col("n_shingles") > 0).groupBy("k1", "k2").agg(F.min("rid").alias("node"), best.alias("best"))
    classes = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = staged(classes, "classes")
    first = staged(classes.groupBy("component").agg(F.min("best").alias("first")), "first")
    named = staged(classes.join(first, "component").select("k1", "k2", "first"), "named")
    alone = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    return (
        rows.drop("bands")
        .join(named, ["k1", "k2"], "left")
        .withColumn("first", F.coalesce("first", alone))
        .select(
            "rid",
            "doc_id",
            "n_shingles",
            F.col("first.doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False)).alias("kept"),
            (F.col("rid") == F.col("first.rid")).alias("keep"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, without near-duplicates of one that stays."""
    rows = numbered(docs.select(F.struct("*").alias("doc")))

    def others() -> DataFrame:
        judged = _judged(rows.select("rid", "doc.doc_id", "doc.text"), percent)
        return judged.where(~F.col("keep")).select(F.col("rid").alias("gone"))

    gone = settled(others, "gone")
    return rows.join(gone, F.col("rid") == F.col("gone"), "left_anti").select("doc.*")
