"""Removal of long byte strings that repeat, by column-wise insertion.

A string of ``length`` bytes is judged by its anchor: of all its short grams the
one with the smallest hash, the first of equals. Equal strings have equal
anchors at equal places, so texts are cut into stretches whose strings share an
anchor, and stretches whose anchors agree meet. Where all stretches that meet
are equal there is nothing to compare. The others, lined up at their anchors,
are a collection of short texts of bounded length; one symbol of each text is
inserted a round, which updates the collection's transform (the order of the
texts by what was read so far, backward) and the common prefixes of neighbours.
A string repeats if its text agrees with a neighbour over its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import binary_texts, mix, numbered, staged

#: Bytes of a string, and of a gram that may be its anchor.
LENGTH, GRAM = 400, 64
#: Texts that are inserted together in one task.
COLLECTION = 16_384

_RECORD = "m bigint, ctx bigint, rid bigint, pos bigint, low bigint, high bigint"
_SPANS = "array<struct<start:int,stop:int>>"


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every position on."""
    h, width, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * np.uint64(base) + h[width:]
            base, width = base * base & 0xFFFFFFFFFFFFFFFF, width * 2
    return mix(h)


def _window_minimum(values: np.ndarray, window: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``anchor hash, anchor position, first start, last start`` of stretches of
    strings that share an anchor; texts shorter than a string have none."""
    if len(text) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    h = _gram_hashes(np.frombuffer(text, np.uint8), gram)
    place = np.arange(len(h), dtype=np.uint64)
    best = _window_minimum((h & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1) & np.uint64(0xFFFFFFFF)
    best = best.astype(np.int64)
    change = np.flatnonzero(best[1:] != best[:-1])
    low, high = np.concatenate([[0], change + 1]), np.concatenate([change, [len(best) - 1]])
    return h[best[low]].view(np.int64), best[low], low, high


def _records(batches: Iterator[pa.RecordBatch], length: int, gram: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[list] = [[] for _ in schema]
        for rid, text in zip(batch.column("rid").to_pylist(), binary_texts(batch)):
            m, pos, low, high = stretches(text, length, gram)
            ctx = [xxhash.xxh3_64_intdigest(text[a : b + length], seed=p - a) for p, a, b in zip(pos.tolist(), low.tolist(), high.tolist())]
            parts = (m, np.array(ctx, np.uint64).view(np.int64), np.full(len(m), rid), pos, low, high)
            for column, part in zip(made, parts):
                column.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in made], schema=schema)


def _contexts(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in batches:
        m, ctx, before, last, data = [], [], [], [], []
        for text, wanted in zip(binary_texts(batch), batch.column("wanted").to_pylist()):
            for w in wanted:
                m.append(w["m"])
                ctx.append(w["ctx"])
                before.append(w["pos"] - w["low"])
                last.append(w["high"] - w["low"])
                data.append(text[w["low"] : w["high"] + length])
        arrays = [pa.array(v, f.type) for v, f in zip((m, ctx, before, last, data), schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def repeated_starts(texts: list[bytes], before: np.ndarray, last: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For texts whose anchors begin ``before`` bytes in: which of the starts 0
    to ``last`` of each begin a string that another text has, too, at the same
    distance from its anchor. One column of ``out`` per distance."""
    n, reach = len(texts), length - gram
    width = reach + length
    symbols = np.full((width, n), 256, np.uint16)
    for i, (text, b) in enumerate(zip(texts, before.tolist())):
        symbols[reach - b : reach - b + len(text), i] = np.frombuffer(text, np.uint8)
    first, after = reach - before, reach - before + last
    out = np.zeros((n, reach + 1), bool)
    order, since = np.arange(n), np.zeros(n, np.int32)
    for column in range(width):
        row = symbols[column][order]
        move = np.argsort(row, kind="stable")
        # A neighbour's common stretch begins where the last of the texts that
        # stood between the two began to agree.
        same = np.concatenate([[False], row[move[1:]] == row[move[:-1]]]) & (row[move] != 256)
        new = np.full(n, column + 1, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            bounds = np.empty(2 * len(at), np.int64)
            bounds[0::2], bounds[1::2] = move[at - 1] + 1, move[at] + 1
            padded = np.append(since, np.int32(0))
            new[at] = np.maximum.reduceat(padded, bounds)[0::2]
        order, since = order[move], new
        start = column + 1 - length
        if start >= 0:
            agree = np.minimum(since, np.append(since[1:], np.int32(column + 1))) <= start
            hit = order[agree]
            hit = hit[(first[hit] <= start) & (start <= after[hit])]
            out[hit, start] = True
    return out


def _insert(batches: Iterator[pa.RecordBatch], length: int, gram: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts come sorted by anchor; a collection ends between two anchors."""
    held: list[tuple] = []

    def result() -> pa.RecordBatch:
        m, ctx, before, last, data = zip(*held)
        before, last = np.array(before), np.array(last)
        out = repeated_starts(list(data), before, last, length, gram)
        spans = []
        for row, b in zip(out, before.tolist()):
            edge = np.diff(np.concatenate([[0], row.view(np.int8), [0]]))
            shift = length - gram - b
            pairs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
            spans.append([{"start": a - shift, "stop": z - shift} for a, z in pairs])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((m, ctx, spans), schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= COLLECTION and row[0] != held[-1][0]:
                yield result()
                held.clear()
            held.append(row)
    if held:
        yield result()


def _remove(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = {"n_bytes": [], "n_removed": [], "spans": [], "kept_bytes": []}
        for text, found in zip(binary_texts(batch), batch.column("found").to_pylist()):
            runs: list[list[int]] = []
            for a, b in sorted((f["start"], f["stop"] + length - 1) for f in found or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            at, kept = 0, []
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            made["n_bytes"].append(len(text))
            made["n_removed"].append(sum(b - a for a, b in runs))
            made["spans"].append([{"start": a, "stop": b} for a, b in runs])
            made["kept_bytes"].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema
        )


def _window_keys(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A 128-bit key of every string of a stretch with its place in it."""
    for batch in batches:
        for m, ctx, before, last, data in zip(*(c.to_pylist() for c in batch.columns)):
            keys = [xxhash.xxh3_128_digest(data[s : s + length], seed=before - s) for s in range(last + 1)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(([m] * n, [ctx] * n, list(range(n)), keys), schema)], schema=schema
            )


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``rid, doc_id, text, found``: for every row the ranges of starts of
    strings of ``length`` bytes that also start anywhere else, in any order.

    ``rid`` is a number that the row is given once; equal rows repeat each other. Null, empty and shorter texts have no
    string. An empty table has no rows."""
    rows = numbered(docs.select("doc_id", "text"))
    schema = T.StructType.fromDDL(_RECORD)
    slim = rows.select("rid", "text")
    records = staged(slim.mapInArrow(lambda b: _records(b, length, gram, to_arrow_schema(schema)), schema), "anchors")
    shared = staged(records.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"), "shared")
    mine = staged(records.join(shared, "m"), "stretches")
    one = F.min(F.struct("rid", "pos", "low", "high")).alias("one")
    contexts = staged(mine.groupBy("m", "ctx").agg(F.count("*").alias("n"), one), "contexts")
    # Only stretches of one anchor that differ have to be compared.
    mixed = staged(contexts.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    compare = contexts.join(mixed, "m").select("m", "ctx", "kinds", "one.*")
    wanted = compare.groupBy("rid").agg(F.collect_list(F.struct("m", "ctx", "pos", "low", "high")).alias("wanted"))
    data_schema = T.StructType.fromDDL("m bigint, ctx bigint, before int, last int, data binary")
    data = slim.join(wanted, "rid").mapInArrow(lambda b: _contexts(b, length, to_arrow_schema(data_schema)), data_schema)
    data = staged(data, "data")
    # Anchors with more kinds than a collection holds are counted string by
    # string instead, as one task could not hold them.
    crowded = staged(mixed.where(F.col("kinds") > COLLECTION).select("m"), "crowded")
    span_schema = T.StructType.fromDDL(f"m bigint, ctx bigint, spans {_SPANS}")
    usual = data if crowded.isEmpty() else data.join(crowded, "m", "left_anti")
    usual = usual.repartition("m").sortWithinPartitions("m")
    spans = usual.mapInArrow(lambda b: _insert(b, length, gram, to_arrow_schema(span_schema)), span_schema)
    if not crowded.isEmpty():
        key_schema = T.StructType.fromDDL("m bigint, ctx bigint, start int, key binary")
        keyed = data.join(crowded, "m", "left_semi").mapInArrow(
            lambda b: _window_keys(b, length, to_arrow_schema(key_schema)), key_schema
        )
        keyed = staged(keyed, "keys")
        twice = staged(keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1").select("m", "key"), "twice")
        span = F.struct(F.col("start"), (F.col("start") + 1).alias("stop"))
        spans = spans.unionByName(keyed.join(twice, ["m", "key"]).groupBy("m", "ctx").agg(F.collect_list(span).alias("spans")))
    spans = staged(spans.where(F.size("spans") > 0), "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("one.high") - F.col("one.low") + 1).cast("int").alias("stop")))
    judged = contexts.join(spans, ["m", "ctx"], "left").select(
        "m", "ctx", F.when(F.col("n") > 1, whole).otherwise(F.col("spans")).alias("spans")
    )
    judged = staged(judged.where("spans is not null"), "judged")
    shifted = F.transform(
        "spans", lambda s: F.struct((s["start"] + F.col("low")).alias("start"), (s["stop"] + F.col("low")).alias("stop"))
    )
    found = mine.join(judged, ["m", "ctx"]).select("rid", shifted.alias("found"))
    found = staged(found.groupBy("rid").agg(F.flatten(F.collect_list("found")).alias("found")), "found")
    return rows.join(found, "rid", "left").select("rid", "doc_id", "text", "found")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_bytes``: every byte that a
    repeated string covers is removed; spans are maximal runs of bytes. Null
    texts count as empty."""
    found = repeats(docs, length, gram).drop("rid")
    more = "n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept_bytes binary"
    schema = T.StructType([found.schema["doc_id"], *T.StructType.fromDDL(more)])
    return found.mapInArrow(lambda b: _remove(b, length, to_arrow_schema(schema)), schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``."""
    removed = remove_repeats(docs)
    return removed.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
