"""Token counts by way of distinct pre-tokens.

Texts are cut into pre-tokens, and each document keeps only how often it holds
which one. A block (an Arrow batch, or a part of it) names its own pre-tokens
once; the names of all blocks are dealt by hash and sorted, so that equal ones
stream by in a run whose pieces are counted once, and return to their blocks,
where they are joined to the documents' frequencies and summed. No list is made
of the blocks that use a pre-token, nor of token ids.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer, pre_tokenizers

from voltpoint.llm.common import n_bytes, staged, texts_of

# Fixed value of byte-level BPE: how a text falls into pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on whose classes all Unicode versions agree.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ſ]*\Z")
#: A pre-token always begins at a blank before a character that is no space.
_CUT = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?:\s|\Z)")
#: Bytes of text in a block; only a longer text goes beyond.
BLOCK_BYTES = 16 << 20


@lru_cache(maxsize=2)
def _tokenizer(text: str) -> tuple[Tokenizer, list[str], frozenset[str]]:
    """The tokenizer applied to single pre-tokens, its special strings, and the
    pre-tokens that are one piece as they stand (as many as the vocabulary)."""
    spec = json.loads(text)
    pre, special = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("only byte-level vocabularies without a normalizer are counted by pre-token")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
        raise ValueError("special tokens that reach beyond their own characters are not supported")
    whole = Tokenizer.from_str(text)
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    names = [t["content"] for t in special]
    decoded = [whole.decoder.decode([t]) for t in spec["model"]["vocab"] if t not in names]
    likely = [t for t in decoded if t and "�" not in t]
    one = [len(e.ids) == 1 for e in whole.encode_batch(likely, add_special_tokens=False)]
    return whole, sorted(names, key=len, reverse=True), frozenset(itertools.compress(likely, one))


def _pre_tokens(segment: str, official) -> list[str]:
    if _PLAIN.match(segment):
        return PRE_TOKEN.findall(segment)
    return [segment[a:b] for _, (a, b) in official.pre_tokenize_str(segment)]


def _segments(text: str, special) -> tuple[list[str], list[str], int]:
    """Segments that open a stretch, segments after a blank, special tokens."""
    parts = special.split(text) if special else [text]
    opening, after = [], []
    for part in parts:
        first, *rest = _CUT.split(part) if _UNEVEN.search(part) else part.split(" ")
        opening.append(first)
        after += rest
    return opening, after, len(parts) - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of bounded bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // BLOCK_BYTES
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield batch.slice(start, end - start)


def _frequencies(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    _, names, one_piece = _tokenizer(text)
    special = re.compile("|".join(map(re.escape, names))) if names else None
    official = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    pack = zstandard.ZstdCompressor(level=1)
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(_blocks(batches)):
        ids: dict = {}
        which, times, extra = [], [], []
        for value in batch.column("text").to_pylist():
            opening, after, found = _segments(value or "", special)
            held = Counter(after)
            mine = [ids.setdefault(s, len(ids)) for s in held] + [ids.setdefault((s,), len(ids)) for s in opening]
            which.append(np.array(mine, np.int32))
            times.append(np.fromiter(itertools.chain(held.values(), itertools.repeat(1, len(opening))), np.int32, len(mine)))
            extra.append(found)
        names_of: dict[str, int] = {}
        flat, count = [], []
        for segment in ids:
            got = _pre_tokens(segment[0] if type(segment) is tuple else " " + segment, official)
            flat += [names_of.setdefault(t, len(names_of)) for t in got]
            count.append(len(got))
        flat, count = np.array(flat, np.int64), np.array(count, np.int64)
        begin = np.cumsum(count) - count
        single = np.fromiter((t in one_piece for t in names_of), bool, len(names_of))
        rare = np.cumsum(~single) - 1
        known, packed = extra, []
        for row, (mine, often) in enumerate(zip(which, times)):
            # From the document's segments to its pre-tokens, each one once.
            each = count[mine]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[mine], each)
            token, back = np.unique(flat[at], return_inverse=True)
            freq = np.bincount(back, np.repeat(often, each), minlength=len(token)).astype(np.int64)
            one = single[token]
            known[row] += int(freq[one].sum())
            planes = np.concatenate([np.diff(rare[token[~one]], prepend=0), freq[~one]]).astype(np.uint32)
            packed.append(pack.compress(planes.view(np.uint8).reshape(-1, 4).T.tobytes()))
        vocab = [None] * batch.num_rows
        vocab[0] = [t for t, one in zip(names_of, single) if not one]
        made = {
            "block": [(task << 32) + number] * batch.num_rows,
            "known": known,
            "rare": packed,
            "vocab": vocab,
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema],
            schema=schema,
        )


def _pieces(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of pre-tokens that come sorted: of each run once, also where it goes
    on in the next batch."""
    whole, last, of_last = _tokenizer(text)[0], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("token"))
        tokens, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
        goes_on = tokens[0] == last
        pieces = [len(e.ids) for e in whole.encode_batch(tokens[goes_on:], add_special_tokens=False)]
        pieces = [of_last, *pieces] if goes_on else pieces
        last, of_last = tokens[-1], pieces[-1]
        counted = pa.array(np.repeat(pieces, np.diff(ends, prepend=0)), pa.int32())
        made = pa.RecordBatch.from_arrays([counted if f.name == "pieces" else batch.column(f.name) for f in schema], schema=schema)
        yield made.sort_by([("block", "ascending"), ("pos", "ascending")])  # rows that follow each other alike shuffle smaller


def _sum_block(docs: pa.Table, pieces: pa.Table, schema: pa.Schema) -> pa.Table:
    by_place = np.zeros(1 + max(pieces["pos"].to_pylist(), default=0), np.int64)
    by_place[pieces["pos"].to_numpy()] = pieces["pieces"].to_numpy()
    open_ = zstandard.ZstdDecompressor()
    totals = []
    for known, rare in zip(docs["known"].to_pylist(), docs["rare"].to_pylist()):
        planes = np.frombuffer(open_.decompress(rare), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        gaps, freq = np.split(planes.astype(np.int64), 2)
        totals.append(known + int(by_place[np.cumsum(gaps)] @ freq))
    made = {"n_tokens": pa.array(totals, pa.int64())}
    return pa.Table.from_arrays([made.get(f.name, None) if f.name in made else docs[f.name].cast(f.type) for f in schema], schema=schema)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every document.

    As the library counts a whole text, without begin, end or added special
    tokens; a special string inside a text is one token. Null is the empty text
    and has none. Repeated rows give repeated results; an empty table none."""
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()  # one vocabulary file, a megabyte or two
    sent = docs.sparkSession.sparkContext.broadcast(text)
    source = texts_of(docs).withColumn("n_bytes", n_bytes(F.col("text")))
    freq_schema = T.StructType(
        [source.schema["doc_id"], *T.StructType.fromDDL("n_bytes bigint, block bigint, known bigint, rare binary, vocab array<string>")]
    )
    frequencies = staged(
        source.mapInArrow(lambda b: _frequencies(b, sent.value, to_arrow_schema(freq_schema)), freq_schema), "tokens"
    )

    asked = frequencies.where("vocab is not null").select("block", F.posexplode("vocab").alias("pos", "token"))
    in_runs = asked.repartition("token").sortWithinPartitions("token")
    piece_schema = T.StructType.fromDDL("block bigint, pos int, pieces int")
    pieces = in_runs.mapInArrow(lambda b: _pieces(b, sent.value, to_arrow_schema(piece_schema)), piece_schema)
    result = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("n_bytes bigint, n_tokens bigint")])
    return (
        frequencies.drop("vocab")
        .groupBy("block")
        .cogroup(pieces.groupBy("block"))
        .applyInArrow(lambda docs, pieces: _sum_block(docs, pieces, to_arrow_schema(result)), result)
    )


def digest(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """`count_tokens` with ``over_limit``: more than ``limit`` tokens."""
    return count_tokens(docs, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)
