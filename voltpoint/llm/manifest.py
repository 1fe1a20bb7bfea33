"""A Merkle manifest of a dataset: leaves, subroots, root and proofs.

Each row is a leaf; the leaves of a source, in order, form a tree whose nodes
are hashes of three consecutive nodes below, and the subroots of all sources, in
order, form one more. Only every fourth level is written. A proof needs the
levels between, so they are worked out again: the nodes of a written level fall
into aligned subtrees of 81, each subtree comes to one task with the path of its
top, makes its inner nodes anew, hands every node below its siblings followed by
that path, and forgets them.

Leaves get their numbers from one sort by range: a row's place in its partition
plus the rows of its source in the partitions before. So one source with most of
the rows is dealt over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import numbered, staged, union_all

#: Nodes below a node; levels from one written level to the next.
FANOUT, SPAN = 3, 4
SUBTREE = FANOUT**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Batches = Iterator[pa.RecordBatch]


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(fields[f]) for f in FIELDS]), 256)


# --- numbers ---------------------------------------------------------------------


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their number ``i`` in their group, from 0, and the group's
    rows ``n``; nulls come first. Rows that are equal in all of ``order`` take
    their numbers in any order."""
    rows = numbered(rows, "unordered")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "rid")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("rid")
    placed = numbered(placed, "ordered").withColumn("part", F.shiftright("rid", 33))
    runs = placed.groupBy(F.col(group).alias("run_of"), "part").agg(F.min("rid").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("run_of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "run_of",
        F.col("part").alias("in_part"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("run_of")).alias("n"),
    )
    joined = placed.join(runs, (F.col("part") == F.col("in_part")) & F.col(group).eqNullSafe(F.col("run_of")))
    return joined.select(*[c for c in rows.columns if c != "rid"], (F.col("rid") + F.col("shift")).alias("i"), "n")


# --- trees -----------------------------------------------------------------------


def combine(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _up(nodes: list[str]) -> list[str]:
    return [combine(nodes[at : at + FANOUT]) for at in range(0, len(nodes), FANOUT)]


def _width(n: int, level: int) -> int:
    """Nodes of a level above ``n`` leaves."""
    return -(-n // FANOUT**level)


def _subtrees(batches: Batches, keys: list[str]) -> Iterator[dict]:
    """The rows of one subtree at a time, as columns, from rows sorted by keys."""
    held, of = None, None
    for batch in batches:
        columns = batch.to_pydict()
        names = list(columns)
        for key, *row in zip(zip(*[columns[k] for k in keys]), *[columns[c] for c in names]):
            if key != of or held is None:
                if held is not None:
                    yield held
                held, of = {c: [] for c in names}, key
            for c, value in zip(names, row):
                held[c].append(value)
    if held is not None:
        yield held


def _tops(batches: Batches, level: int, schema: pa.Schema) -> Batches:
    out = {f.name: [] for f in schema}

    def flush():
        batch = pa.RecordBatch.from_pydict(out, schema=schema)
        for values in out.values():
            values.clear()
        return batch

    for rows in _subtrees(batches, ["g", "block"]):
        nodes, n = rows["h"], rows["n"][0]
        for step in range(SPAN):
            if _width(n, level + step) > 1:
                nodes = _up(nodes)
        out["g"].append(rows["g"][0])
        out["i"].append(rows["block"][0])
        out["n"].append(n)
        out["h"].append(nodes[0])
        if len(out["h"]) == 4096:
            yield flush()
    yield flush()


def _in_subtrees(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", *order)


def _block() -> Column:
    return F.call_function("div", F.col("i"), F.lit(SUBTREE)).alias("block")


def build(leaves: DataFrame) -> list[DataFrame]:
    """Every fourth level of the trees over ``leaves``, rows ``g, i, n, h`` (the
    tree, the place in the level, the tree's leaves, the hash), the leaves first.
    A tree ends at the first of these levels at which it has one node."""
    levels = [leaves.select("g", "i", "n", "h")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    schema = levels[0].schema
    arrow = to_arrow_schema(schema)
    level = 0
    while _width(most, level) > 1:
        below = levels[-1].where(F.col("n") > FANOUT**level).select("*", _block())
        tops = _in_subtrees(below, "i").mapInArrow(lambda b, at=level: _tops(b, at, arrow), schema)
        levels.append(staged(tops, "level"))
        level += SPAN
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``g, h``: the one node at the top of each tree."""
    tops = [nodes.where(F.col("n") <= FANOUT ** (SPAN * k)) for k, nodes in enumerate(levels)]
    return union_all(t.select("g", "h") for t in tops)


# --- proofs ----------------------------------------------------------------------


def _siblings(nodes: list[str], n: int, level: int) -> list[str]:
    """For each node of a subtree the siblings on the way to its top."""
    found, at, row = [""] * len(nodes), list(range(len(nodes))), nodes
    for step in range(SPAN):
        if _width(n, level + step) <= 1:
            break
        others = []
        for k in range(len(row)):
            low = k - k % FANOUT
            others.append("".join(row[low:k] + row[k + 1 : low + FANOUT]))
        found = [f + others[k] for f, k in zip(found, at)]
        at = [k // FANOUT for k in at]
        row = _up(row)
    return found


def _extract(batches: Batches, level: int, carried: list[str], schema: pa.Schema) -> Batches:
    out = {f.name: [] for f in schema}
    for rows in _subtrees(batches, ["g", "block"]):
        # The subtree's top comes first, with the path above it.
        above, nodes = rows["path"][0], rows["h"][1:]
        out["path"] += [s + above for s in _siblings(nodes, rows["n"][1], level)]
        for c in carried:
            out[c] += rows[c][1:]
        if len(out["path"]) >= 2048:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            out = {f.name: [] for f in schema}
    yield pa.RecordBatch.from_pydict(out, schema=schema)


def paths(levels: list[DataFrame], leaves: DataFrame, above: DataFrame, finish: Callable | None = None, fields: T.StructType | None = None) -> DataFrame:
    """``leaves`` (``g, i, n, h`` and more) with ``path``: the siblings from each
    leaf to the root, level by level, left to right, as one text. ``above`` has
    the path that follows at the top of each tree, ``g, path``. ``finish``, if
    given, turns the batches of this result into those of ``fields``."""
    tops = None
    for k in reversed(range(len(levels))):
        rows = leaves if k == 0 else levels[k]
        carried = rows.columns
        schema = T.StructType([*rows.schema.fields, T.StructField("path", T.StringType())])
        arrow = to_arrow_schema(schema)
        ends = rows.where(F.col("n") <= FANOUT ** (SPAN * k))
        reached = ends.join(above.select(F.col("g").alias("tree"), "path"), F.col("g").eqNullSafe(F.col("tree"))).select(*carried, "path")
        if tops is not None:
            below = rows.where(F.col("n") > FANOUT ** (SPAN * k))
            nodes = below.select(*carried, F.lit(None).cast("string").alias("path"), _block(), F.lit(1).alias("kind"))
            blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried if c != "g"]
            parents = tops.select("g", *blank, "path", F.col("i").alias("block"), F.lit(0).alias("kind"))
            both = _in_subtrees(parents.select(*nodes.columns).unionByName(nodes), "kind", "i")
            extract = lambda b, at=SPAN * k, c=carried, a=arrow: _extract(b, at, c, a)
            if k == 0 and finish is not None:
                done = both.mapInArrow(lambda b, x=extract: finish(x(b)), fields)
                return done.unionByName(reached.mapInArrow(finish, fields))
            reached = both.mapInArrow(extract, schema).unionByName(reached)
        tops = reached if k == 0 else staged(reached, "paths")
    return tops if finish is None else tops.mapInArrow(finish, fields)


def fold(leaf: str, path: str, trees: list[tuple[int, int]]) -> str:
    """The root that a leaf and its path give; ``trees`` has the leaf's place and
    the number of leaves of each tree on the way."""
    node, at = leaf, 0
    for i, n in trees:
        while n > 1:
            place = i % FANOUT
            others = min(FANOUT, n - (i - place)) - 1
            some = [path[at + 64 * k : at + 64 * (k + 1)] for k in range(others)]
            node, at = combine([*some[:place], node, *some[place:]]), at + 64 * others
            i, n = i // FANOUT, -(-n // FANOUT)
    return node


def _folded(batches: Batches, schema: pa.Schema) -> Batches:
    for batch in batches:
        rows = batch.to_pydict()
        sides = zip(rows["given"], rows["path"], rows["i"], rows["n"], rows["tree_i"], rows["tree_n"])
        rows["folded_root"] = [fold(leaf, path, [(i, n), (j, m)]) for leaf, path, i, n, j, m in sides]
        rows["proof_sha256"] = [combine([p]) for p in rows["path"]]
        yield pa.RecordBatch.from_pydict({f.name: rows[f.name] for f in schema}, schema=schema)


# --- the manifest of documents -------------------------------------------------------


class Manifest:
    """The manifest of a table with the columns `FIELDS`.

    Leaves ascend by ``doc_id`` (null first, then by leaf) in their ``source``
    (null is a source of its own). Rows that are equal are a leaf each. Other
    columns have no part. ``given`` are the hashes to be held against the
    manifest, by default the leaves themselves."""

    def __init__(self, docs: DataFrame, given: Column | None = None) -> None:
        columns = {f: F.col(f) for f in FIELDS}
        hashes = docs.select("doc_id", F.col("source").alias("g"), leaf_hash(columns).alias("h"), (leaf_hash(columns) if given is None else given).alias("given"))
        self.leaves = in_order(hashes, "g", ["doc_id", "h"])
        self.levels = build(self.leaves)
        subroots = roots(self.levels).select(F.lit(0).alias("all"), F.col("g").alias("source"), "h")
        ranked = in_order(subroots, "all", ["source"])
        self.subroots = staged(ranked.select(F.col("all").alias("g"), "i", "n", "h", "source"), "subroots")
        self.top_levels = build(self.subroots)

    def root(self) -> str | None:
        """The root; none of an empty table."""
        found = roots(self.top_levels).first()
        return None if found is None else found.h

    def _sources(self) -> DataFrame:
        spark = self.subroots.sparkSession
        above = spark.createDataFrame([(0, "")], "g int, path string")
        tops = paths(self.top_levels, self.subroots, above)
        return tops.select(F.col("source").alias("tree"), F.col("i").alias("tree_i"), F.col("n").alias("tree_n"), F.col("h").alias("subroot"), "path")

    def proofs(self) -> DataFrame:
        """``doc_id, source, leaf, subroot, path``: the siblings of each leaf up
        to the root, 64 characters each."""
        sources = staged(self._sources(), "sources")
        found = paths(self.levels, self.leaves, sources.select(F.col("tree").alias("g"), "path"))
        joined = found.join(sources.select("tree", "subroot"), F.col("g").eqNullSafe(F.col("tree")))
        return joined.select("doc_id", F.col("g").alias("source"), F.col("h").alias("leaf"), "subroot", "path")

    def verified(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
        sources = staged(self._sources(), "sources")
        sides = sources.select("tree", "tree_i", "tree_n", "subroot")
        leaves = self.leaves.join(sides, F.col("g").eqNullSafe(F.col("tree"))).drop("tree")
        fields = T.StructType(
            [leaves.schema["doc_id"]]
            + [T.StructField(c, T.StringType()) for c in ("h", "subroot", "proof_sha256", "folded_root")]
        )
        arrow = to_arrow_schema(fields)
        above = sources.select(F.col("tree").alias("g"), "path")
        folded = paths(self.levels, leaves, above, lambda b: _folded(b, arrow), fields)
        root = F.lit(self.root()).cast("string")
        return folded.select(
            "doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
        )


def tampered_leaf() -> Column:
    """The leaf of a document whose line feeds are gone where 2 divides the CRC-32
    of its id; a null id is never tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf_hash({f: F.col(f) for f in FIELDS} | {"text": text})


def digest(docs: DataFrame) -> DataFrame:
    return Manifest(docs, tampered_leaf()).verified()
