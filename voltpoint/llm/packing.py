"""Packing of documents into sequences of a fixed number of tokens.

Documents become token ids once, cut into full sequences and one rest each, and
the pieces are stored with their place among the pieces of one length. What the
driver sees is the histogram of lengths alone, as many rows as a sequence has
tokens. Shortest-pack-first packs it: lengths are placed longest first, each in
the pack with the most room that takes it, and packs of one content are one
pattern with a count. A piece finds its pattern, hence its sequence and offset,
by its rank among the pieces of its length.

Packs that stay short of a full sequence are laid end to end and cut again at
the sequence ends, so they are filled, too. The tokens left at the very end
become sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer, pre_tokenizers

from voltpoint.llm.common import binary_texts, staged, texts_of

CAPACITY, END_ID = 2048, 1
#: Pieces of text whose ids a worker remembers, the longest of them in bytes, and
#: the bytes of a text that are cut into words at a time.
CACHE_PIECES, CACHE_BYTES, SLICE_BYTES = 1 << 20, 64, 1 << 20

# Fixed value of the vocabulary: how a normalized text falls into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for plain texts: printable ASCII and composed Latin letters, which
#: normalization only puts in lower case, and without a special token.
_LETTERS = "a-zß-öø-ÿĀ-ſ"
_PLAIN = re.compile(r"[\t-\r\x20-\x7EÀ-ſ]*\Z")
_PLAIN_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r\\x20{_LETTERS}0-9]+")


# --- token ids -----------------------------------------------------------------


def check_vocabulary(spec: str) -> np.dtype:
    """The type that ids are stored as; raises where a text's ids are not those
    of its words side by side."""
    found = json.loads(spec)
    splits = found["pre_tokenizer"] or {}
    parts = splits.get("pretokenizers", [splits])
    pattern = parts[0].get("pattern", {}).get("Regex", "") if parts else ""
    drops = parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "\\s" in pattern
    if not drops or any(t["single_word"] for t in found["added_tokens"]) or found["post_processor"]:
        raise ValueError("only vocabularies that drop white space are encoded word by word")
    ids = max(found["model"]["vocab"].values())
    ids = max([ids, *(t["id"] for t in found["added_tokens"])])
    return np.dtype("<u2") if ids < 1 << 16 else np.dtype("<u4")


class _Known(dict):
    """Pre-tokens of plain texts -> their ids, which the model gives by itself."""

    def __init__(self, tokenizer: Tokenizer, kind: np.dtype) -> None:
        self.model, self.kind = tokenizer.model, kind
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
        ids = np.array([t.id for t in self.model.tokenize(letters)], self.kind).tobytes()
        if len(piece) <= CACHE_BYTES:
            self[piece] = ids
        return ids


class _Encoder:
    """The ids of whole texts. White space parts words and has no ids, so a text's
    ids are those of its words side by side. Plain texts are cut into pre-tokens
    here; words of all others go to the library as they are."""

    def __init__(self, spec: str, kind: np.dtype) -> None:
        self.tokenizer, self.kind = Tokenizer.from_str(spec), kind
        found = json.loads(spec)
        pattern = found["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in found["normalizer"]["normalizers"]]
        self.cuts = pattern == PRE_TOKEN and kinds == ["NFC", "Replace", "Lowercase"] and all("<|" in t["content"] for t in found["added_tokens"])
        self.known, self.words = _Known(self.tokenizer, kind), {}

    def _plain(self, text: str) -> bytes:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _PLAIN_TOKEN.findall(text.lower())))

    def _words(self, words: list[bytes]) -> bytes:
        if len(self.words) > CACHE_PIECES // 8:
            self.words.clear()
        new = list({w for w in words if w not in self.words})
        found = self.tokenizer.encode_batch([w.decode("utf-8") for w in new], add_special_tokens=False)
        ids = {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(new, found)}
        joined = b"".join([ids[w] if w in ids else self.words[w] for w in words])
        self.words.update((w, x) for w, x in ids.items() if len(w) <= CACHE_BYTES)
        return joined

    def _slice(self, text: bytes) -> bytes:
        if self.cuts and b"<|" not in text:
            characters = text.decode("utf-8")
            if _PLAIN.match(characters):
                return self._plain(characters)
        return self._words(text.split())

    def text(self, text: bytes) -> bytes:
        if len(text) <= SLICE_BYTES:
            return self._slice(text)
        parts, at = [], 0
        while at < len(text):
            stop = text.find(b" ", at + SLICE_BYTES)
            stop = len(text) if stop < 0 else stop
            parts.append(self._slice(text[at:stop]))
            at = stop
        return b"".join(parts)


@lru_cache(maxsize=1)
def _encoder(spec: str, kind: np.dtype) -> _Encoder:
    """One for all tasks of a worker."""
    return _Encoder(spec, kind)


def _pieces(batches: Iterator[pa.RecordBatch], spec: str, kind: np.dtype, capacity: int, end: int, schema: pa.Schema):
    encoder, part = _encoder(spec, kind), TaskContext.get().partitionId()
    width, last = kind.itemsize, np.array([end], kind).tobytes()
    seen = [0] * (capacity + 1)
    for batch in batches:
        doc, start, length, total, rank, ids = [], [], [], [], [], []
        for row, text in enumerate(binary_texts(batch)):
            found = encoder.text(text) + last
            n = len(found) // width
            for at in range(0, n, capacity):
                size = min(capacity, n - at)
                doc.append(row)
                start.append(at)
                length.append(size)
                total.append(n)
                rank.append(seen[size])
                seen[size] += 1
                ids.append(found[at * width : (at + size) * width])
        columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), [part] * len(doc), start, length, total, rank, ids]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """Written rows ``doc_id, part, start, length, doc_tokens, place, ids``: each
    document's ids and the closing one, cut every ``capacity`` ids. ``place``
    counts the pieces of one length in a task, which ``part`` names."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    kind = check_vocabulary(spec)
    rows = texts_of(docs)
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    return staged(rows.mapInArrow(lambda b: _pieces(b, spec, kind, capacity, end, arrow), schema), "pieces")


# --- patterns ------------------------------------------------------------------


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(length, copies), ...])`` that hold every piece of the
    histogram (length -> pieces) once.

    Shortest-pack-first: lengths from the longest, each into the pack with the
    most room. Equal packs are filled at a time, so the work depends on the
    capacity and not on the number of pieces."""
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    ties = iter(range(1 << 62))

    def put(room: int, count: int, items: list[tuple[int, int]]) -> None:
        if room == 0:
            done.append((count, items))
        else:
            heapq.heappush(open_packs, (-room, next(ties), count, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and -open_packs[0][0] >= length:
            room, _, count, items = heapq.heappop(open_packs)
            taken = min(count, left)
            if taken < count:
                put(-room, count - taken, items)
            head, copies = (items[:-1], items[-1][1]) if items[-1][0] == length else (items, 0)
            put(-room - length, taken, [*head, (length, copies + 1)])
            left -= taken
        # Nothing takes it: new packs, as full of this length as they go.
        fit = capacity // length
        for count, copies in ((left // fit, fit), (1, left % fit)):
            if count and copies:
                put(capacity - copies * length, count, [(length, copies)])
    rest = sorted(open_packs, key=lambda p: p[:2])
    return done + [(count, items) for _, _, count, items in rest]


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each length lie on one line of all sequences: arrays
    sorted by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    stride: np.ndarray
    capacity: int
    #: Inner ends on the line after the last full sequence.
    tail: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Positions on the line of pieces given by length and rank."""
        low, high = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        # The last slot of the length that begins at or before the rank.
        while (low + 1 < high).any():
            middle = (low + high) // 2
            before = self.first[np.minimum(middle, len(self.first) - 1)] <= rank
            inside = low + 1 < high
            low, high = np.where(inside & before, middle, low), np.where(inside & ~before, middle, high)
        nth = rank - self.first[low]
        return self.base[low] + nth // self.copies[low] * self.stride[low] + nth % self.copies[low] * length

    def cuts(self, place: int, length: int) -> list[int]:
        """Ends of sequences inside a piece."""
        stop = place + length
        ends = list(range(-(-(place + 1) // self.capacity) * self.capacity, stop, self.capacity))
        return ends + [int(e) for e in self.tail if place < e < stop]

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of positions that begin a cut piece."""
        sequence, offset = np.divmod(place, self.capacity)
        if len(self.tail):
            behind = np.searchsorted(self.tail, place, "right")
            sequence = sequence + behind
            offset = np.where(behind > 0, place - self.tail[np.maximum(behind - 1, 0)], offset)
        return sequence, offset


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> Slots:
    """Full packs take a sequence each; the others lie end to end behind them."""
    rows, line, used = [], 0, {}
    for full in (True, False):
        for count, items in patterns:
            size = sum(length * copies for length, copies in items)
            if (size == capacity) != full:
                continue
            inside = 0
            for length, copies in items:
                rows.append((length, used.get(length, 0), copies, line + inside, size))
                used[length] = used.get(length, 0) + count * copies
                inside += length * copies
            line += count * size
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5).T
    tail, at, left = [], line - line % capacity, line % capacity
    for bit in reversed(range(capacity.bit_length())):
        if left >> bit & 1:
            at += 1 << bit
            tail.append(at)
    return Slots(*table, capacity, np.array(tail[:-1], np.int64))


# --- pieces in sequences -----------------------------------------------------------


def _place(batches: Iterator[pa.RecordBatch], slots: Slots, kind: np.dtype, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    width = kind.itemsize
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start, length, rank = (batch.column(c).to_numpy() for c in ("start", "length", "rank"))
        places = slots.places(length, rank)
        rows, starts, sizes, at, ids = [], [], [], [], []
        for row, (begin, size, place, binary) in enumerate(zip(start.tolist(), length.tolist(), places.tolist(), batch.column("ids").to_pylist())):
            bounds = [place, *slots.cuts(place, size), place + size]
            for low, high in zip(bounds, bounds[1:]):
                rows.append(row)
                starts.append(begin + low - place)
                sizes.append(high - low)
                at.append(low)
                some = np.frombuffer(binary, kind)[low - place : high - place]
                ids.append(some.astype("<u4").tobytes())
        sequence, offset = slots.sequence(np.array(at, np.int64))
        taken = pa.array(rows, pa.int64())
        columns = [batch.column("doc_id").take(taken), starts, sizes, batch.column("doc_tokens").take(taken), sequence, offset, ids]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, doc_tokens, sequence_id,
    offset, ids`` (little-endian unsigned 32-bit).

    A null or empty text is its closing id alone. Rows that are equal, or share
    an id, are packed each; an empty table gives no rows. Which of several pieces
    of one length takes which place is free."""
    pieces = token_pieces(docs, tokenizer, capacity, end)
    with open(tokenizer, encoding="utf-8") as file:
        kind = check_vocabulary(file.read())
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = staged(counts, "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(pack_histogram(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("place")).alias("rank"), "ids"
    )
    kept = ["doc_id", "start", "length", "doc_tokens"]
    more = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([pieces.schema[c] for c in kept] + more)
    arrow = to_arrow_schema(schema)
    return ranked.mapInArrow(lambda b: _place(b, slots, kind, arrow), schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the ids of each sequence, padded to the
    capacity unless their number is a power of two."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("ids"))))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("p"))
    filler = np.array([pad], "<u4").tobytes().hex()
    power = F.bit_count("n_tokens") == 1
    ids = F.concat(F.array_join("p.ids", ""), F.when(power, "").otherwise(F.repeat(F.lit(filler), (F.lit(capacity) - F.col("n_tokens")).cast("int"))))
    return whole.select("sequence_id", "n_tokens", F.unhex(ids).alias("ids"))


def digest(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    packed = pack(docs, tokenizer, capacity, end)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
