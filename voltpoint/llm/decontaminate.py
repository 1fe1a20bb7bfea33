"""Benchmark decontamination with an FM-index over every shard of documents.

A shard is one Arrow batch of documents. Only stretches of words that all occur
in the benchmark can hold a window, so the shard's text is those stretches as
word numbers, a separator after each. Its suffix array is built by prefix
doubling, its Burrows-Wheeler transform is kept as a wavelet matrix, all windows
are searched backward at once, and occurrences are located by walking to the
next sampled suffix position. Spans of hit words are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import binary_texts, n_bytes, texts_of

# Word bytes: digits, letters (lower case after folding) and all non-ASCII.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit level after the other."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        low = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            is_one = (symbol >> (len(self.levels) - 1 - level)) & 1 == 1
            low_ones, at_ones = ones[low], ones[at]
            low = np.where(is_one, zeros + low_ones, low - low_ones)
            at = np.where(is_one, zeros + at_ones, at - at_ones)
        return at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks by 1, 2, 4, ... symbols until all differ. Every
    separator ranks apart, so no comparison runs past one."""
    n, step = len(symbols), 1
    separator = symbols == 0
    rank = np.where(separator, np.cumsum(separator), symbols + n).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Symbols are 0 (the separator, also the last one) up to ``size`` - 1."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.ranks = WaveletMatrix(self.last, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.n = len(symbols)
        # Also where a separator precedes: no walk has to pass one.
        sampled = (order % self.SAMPLE == 0) | (self.last == 0)
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (one per row)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.before[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            symbol = self.last[rows[walk]]
            rows[walk] = self.before[symbol] + self.ranks.rank(symbol, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.by_size = [
            (size, np.array(list(of), np.int64), [sorted(x) for x in of.values()]) for size, of in sorted(found.items())
        ]
        self.shortest = min(found, default=0)


def _stretches(numbers: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words that can hold a window."""
    edge = np.diff(np.concatenate([[0], (numbers > 0).astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - start >= shortest
    return start[long], stop[long]


def _search_shard(numbers: np.ndarray, owner_end: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Start positions in ``numbers`` of each occurrence, the window's length
    and its items. ``owner_end``: a document's last word breaks a stretch."""
    start, stop = _stretches(numbers, phrases.shortest)
    if not len(start):
        return
    sizes = stop - start + 1
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(start, sizes)
    text = np.where(places < np.repeat(stop, sizes), numbers[np.minimum(places, len(numbers) - 1)], 0)
    index = FMIndex(text, len(phrases.numbers) + 1)
    for size, patterns, items in phrases.by_size:
        low, high = index.search(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            yield places[index.locate(rows)], size, [items[i] for i in which]


def _find(batches: Iterator[pa.RecordBatch], phrases: Phrases, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    number = phrases.numbers.get
    for batch in batches:
        texts, lengths, parts = binary_texts(batch), [], []
        earlier = batch.column("spans").to_pylist()
        seen = batch.column("items").to_pylist()
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        first = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if texts and phrases.numbers:
            for places, size, of in _search_shard(np.concatenate(parts), first, phrases):
                owner = np.searchsorted(first, places, side="right") - 1
                for doc, at, names in zip(owner.tolist(), (places - first[owner]).tolist(), of):
                    spans.setdefault(doc, []).append((at, at + size))
                    items.setdefault(doc, set()).update(names)
        merged, names, hit = [], [], []
        for doc in range(len(texts)):
            runs: list[list[int]] = []
            for a, b in sorted(spans.get(doc, []) + [(x["start"], x["stop"]) for x in earlier[doc]]):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            merged.append([{"start": a, "stop": b} for a, b in runs])
            hit.append(sum(b - a for a, b in runs))
            names.append(sorted((items.get(doc, set()) | set(seen[doc])) - {None}))
        made = {"n_words": lengths, "n_hit": hit, "items": names, "spans": merged}
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema],
            schema=schema,
        )


def _blocks(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most about ``max_bytes`` (a longer item is a block
    of its own), so that what is broadcast has a bound at any benchmark size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(n_bytes(F.col("text")) + 16)).first()[0] or 0
    count = -(-total // max_bytes) or 1
    for block in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else items
        yield [(r.item_id, r.text.encode()) for r in mine.toLocalIterator()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 32 << 20) -> DataFrame:
    """``doc, text, n_words, n_hit, items, spans`` for every document, where
    ``doc`` holds the other input columns and spans are ranges of word numbers.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A
    window is ``window`` consecutive words of an item, or all of a shorter one.
    Null and empty texts have no words; items without text or words have no
    window, those without an id hit like others and are not named; an empty
    benchmark hits nothing. Repeated rows are judged alike."""
    spark = docs.sparkSession
    found = docs.select(
        F.struct(F.lit(True).alias("_"), *[F.col(c) for c in docs.columns if c != "text"]).alias("doc"),
        F.col("text").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )
    for items in _blocks(benchmark, max_bytes):
        sent, schema = spark.sparkContext.broadcast(items), found.schema
        found = found.mapInArrow(
            lambda batches, sent=sent, schema=schema: _find(batches, Phrases(sent.value, window), to_arrow_schema(schema)),
            schema,
        )
    return found


def _cut(text: str | None, starts, stops) -> str | None:
    """The text without the bytes from the first to the last word of each span."""
    if text is None or not len(starts):
        return text
    raw = text.encode()
    kind = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], kind.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for first, after in zip(starts, stops):
        out.append(raw[at : start[first]])
        at = stop[after - 1]
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 32 << 20) -> DataFrame:
    """The documents, all columns kept, with every hit span cut out of the text.

    Documents without a hit are unchanged; a column ``n_chars`` follows the new
    text. A text that was nothing but a benchmark passage becomes empty."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([_cut(*row) for row in zip(text, starts, stops)], dtype=object)

    found = find_benchmark(docs, benchmark, window, max_bytes)
    clean = found.withColumn("clean", cut("text", "spans.start", "spans.stop"))
    hit = F.col("n_hit") > 0
    columns = []
    for field in docs.schema:
        if field.name == "text":
            columns.append(F.when(hit, F.col("clean")).otherwise(F.col("text")).alias("text"))
            continue
        value = F.col("doc").getField(field.name)
        if field.name == "n_chars":
            value = F.when(hit, F.char_length("clean").cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return clean.select(columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated``. Items are sorted as strings by code point."""
    found = find_benchmark(texts_of(docs), benchmark)
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
