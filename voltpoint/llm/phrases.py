"""Collocations: phrases that occur more often than their parts let expect.

Two passes over the texts. The first finds what may be frequent: every phrase of
up to three words is a 64-bit hash, hashes are dealt to hash partitions, and each
partition merges the counts of all tasks into one Misra-Gries summary. A summary
of more than (occurrences in the partition) / (least frequency) counters loses
less than the least frequency of any count, so every frequent phrase is left in
it; the number of partitions grows with the texts and keeps summaries small.
Counters that could not be frequent with all that was lost go, too. The second
pass counts the survivors exactly, by their words.

Survivors reach the tasks of the second pass as a bit array of fixed size. It may
let other phrases through, which the exact counts then drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpoint.llm.common import binary_texts, mix, staged

#: Words of the longest phrase, least frequency, phrases of each language, and
#: the share in percent from which a longer phrase stands for a shorter one.
ORDER, LEAST, TOP, COVER_PERCENT = 3, 10, 2000, 50
NO_LANG = "und"
#: Occurrences that a hash partition holds about, and how many times as many
#: counters as needed it has: the more, the fewer rare phrases survive.
PARTITION_MASS, SPARE = 1 << 21, 4
#: Hash partitions that a task merges, one after the other.
TASK_PARTITIONS = 4
#: Tokens that a task counts at a time, different words that it remembers, hashes
#: of one row, bytes of a text that are cut into words at a time.
TOKENS, WORDS, ROW_HASHES, SLICE_BYTES = 1 << 20, 1 << 18, 1 << 15, 1 << 20
#: Rows whose texts are held as objects at a time.
SLICE = 256
#: Bytes of a hash that are sent, the leading ones: too few only let phrases that
#: share them be counted as one in the first pass.
HASH_BYTES = 6
#: The bit array of survivors has 2**FILTER_BITS bits.
FILTER_BITS = 28

WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
# Lower case, one kind of break, one kind of space.
_TABLE = bytes(46 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(NO_LANG))


class _Words(dict):
    """Words of one language -> numbers, counted through for all languages."""

    def __init__(self, lang: str, tokens: _Tokens) -> None:
        self[b"."] = 0
        self.lang, self.seed, self.tokens = lang, xxhash.xxh64_intdigest(lang.encode()), tokens

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.tokens.words)
        self.tokens.words.append((self.lang, word))
        self.tokens.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


class _Tokens:
    """Texts as numbers of words, 0 where phrases break off."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.words: list[tuple[str, bytes]] = [("", b".")]
        self.hashes = [0]
        self.langs: dict[str, _Words] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.n = 0
        if len(self.words) > WORDS:
            self._forget()

    def full(self) -> bool:
        return self.n > TOKENS or len(self.words) > WORDS

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.langs:
            self.langs[lang] = _Words(lang, self)
        numbers = self.langs[lang]
        text, at = text.translate(_TABLE), 0
        while at < len(text):
            stop = text.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else -1
            stop = len(text) if stop < 0 else stop
            tokens = text[at:stop].replace(b".", b" . ").split(b" ")
            tokens = list(filter(None, tokens))
            self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
            self.n += len(tokens)
            at = stop
        self.parts.append(np.zeros(1, np.int32))

    def grams(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The numbers, and for each length where the phrases end and their hashes."""
        codes = np.concatenate(self.parts)
        of_word = np.array(self.hashes, np.uint64)[codes]
        ends, found = np.flatnonzero(codes), []
        hashes = mix(of_word[ends])
        found.append((ends, hashes))
        for _ in range(ORDER - 1):
            # The last token is a break, so every end has a token behind it.
            inside = codes[ends + 1] > 0
            ends = ends[inside] + 1
            with np.errstate(over="ignore"):
                hashes = mix(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + of_word[ends])
            found.append((ends, hashes))
        return codes, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tokens]:
    """As many texts at a time as are counted together."""
    tokens = _Tokens()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            for lang, text in zip(some.column("lang").to_pylist(), binary_texts(some)):
                tokens.add(lang, text)
                if tokens.full():
                    yield tokens
                    tokens.clear()
    if tokens.parts:
        yield tokens


def _kinds(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each kind begins in a sorted array, and how many of it there are."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(ordered)))


# --- first pass: Misra-Gries summaries ------------------------------------------------


def partition_of(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of ``capacity`` counters from the counters of
    several, and what each has lost: equal keys are added; where more are left,
    all lose what the first one too many has. Over all merges a count loses less
    than mass / capacity."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first, _ = _kinds(keys)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    lost = 0
    if len(keys) > capacity:
        lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        counts = counts - lost
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts, lost


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpacked(keys: bytes) -> np.ndarray:
    whole = np.zeros((len(keys) // HASH_BYTES, 8), np.uint8)
    whole[:, :HASH_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, HASH_BYTES)
    return whole.view(">u8").ravel().astype(np.uint64)


# A row without keys brings a partition's occurrences of a task, ahead of the others.
SUMMARY = "p bigint, mass bigint, keys binary, counts binary"
_SUMMARY = pa.schema([("p", pa.int64()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summaries(batches: Iterator[pa.RecordBatch], partitions: int) -> Iterator[pa.RecordBatch]:
    masses = np.zeros(partitions, np.int64)
    for tokens in _counted(batches):
        ordered = np.sort(np.concatenate([hashes for _, hashes in tokens.grams()[1]]))
        first, counts = _kinds(ordered)
        keys = ordered[first]
        parts = partition_of(keys, partitions)
        masses += np.bincount(parts, counts, partitions).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts)) + 1
        bounds = np.unique(np.concatenate([[0], cuts, np.arange(0, len(keys), ROW_HASHES), [len(keys)]]))
        rows = [(int(parts[a]), None, _packed(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
        yield from _rows(rows, _SUMMARY)
    yield from _rows([(int(p), int(masses[p]), None, None) for p in np.flatnonzero(masses)], _SUMMARY)


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256]), schema)], schema=schema)


_SURVIVORS = pa.schema([("p", pa.int64()), ("first_byte", pa.int64()), ("bits", pa.binary())])


def _survivors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The partitions of a task, sorted by their number: a bit for each hash whose
    counter, with what the summary may have lost of it, is frequent."""

    def bits(p: int) -> pa.RecordBatch:
        places = keys[counts + lost >= least]
        places = np.unique(places >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        first = int(places[0]) // 8 if len(places) else 0
        array = np.zeros(int(places[-1]) // 8 - first + 1 if len(places) else 0, np.uint8)
        np.bitwise_or.at(array, places // 8 - first, (1 << (places % 8)).astype(np.uint8))
        packed = zstandard.ZstdCompressor(1).compress(array.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([p]), pa.array([first]), pa.array([packed], pa.binary())], schema=_SURVIVORS)

    at, mass, held, lost = None, 0, 0, 0
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        nonlocal keys, counts, waiting, held, lost
        keys = np.concatenate([keys, *[k for k, _ in waiting]])
        counts = np.concatenate([counts, *[c for _, c in waiting]])
        # More counters than occurrences / least.
        keys, counts, more = merge(keys, counts, SPARE * mass // least + 1)
        lost += more
        waiting, held = [], 0

    for batch in batches:
        for p, some_mass, k, c in zip(*[batch.column(n) for n in ("p", "mass", "keys", "counts")]):
            p, some_mass, k, c = p.as_py(), some_mass.as_py(), k.as_py(), c.as_py()
            if p != at:
                if at is not None:
                    settle()
                    yield bits(at)
                at, mass, lost = p, 0, 0
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if k is None:
                mass += some_mass
                continue
            waiting.append((_unpacked(k), np.frombuffer(c, "<u4").astype(np.int64)))
            held += len(waiting[-1][0])
            if held > PARTITION_MASS // 8:
                settle()
    if at is not None:
        settle()
        yield bits(at)


def frequent_filter(texts: DataFrame, mass: int, least: int) -> bytes:
    """The bit array of all phrases that may occur ``least`` times, packed."""
    partitions = max(1, -(-mass // PARTITION_MASS))
    found = texts.mapInArrow(lambda b: _summaries(b, partitions), SUMMARY)
    # The occurrences of a partition come ahead of its counters.
    tasks = -(-partitions // TASK_PARTITIONS)
    task = F.expr(f"p div {TASK_PARTITIONS}").cast("int")
    dealt = found.repartitionById(tasks, task).sortWithinPartitions("p", F.col("mass").asc_nulls_last())
    left = dealt.mapInArrow(lambda b: _survivors(b, least), "p bigint, first_byte bigint, bits binary")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in staged(left, "survivors").collect():
        some = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.bits)), np.uint8)
        bits[row.first_byte : row.first_byte + len(some)] |= some
    return zstandard.ZstdCompressor(1).compress(bits.tobytes())


# --- second pass: exact counts ------------------------------------------------------------

_EXACT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])


def _distinct(codes: np.ndarray, ends: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different phrases that end at ``ends``, a row of word numbers each, and
    how often each occurs."""
    words = [codes[ends - n + 1 + k].astype(np.int64) for k in range(n)]
    if size ** n < 1 << 62:
        keys = words[0]
        for more in words[1:]:
            keys = keys * size + more
        order = np.argsort(keys)
        first, counts = _kinds(keys[order])
        return np.stack([w[order[first]] for w in words], axis=1), counts
    return np.unique(np.stack(words, axis=1), axis=0, return_counts=True)


def _exact(batches: Iterator[pa.RecordBatch], packed: bytes) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    for tokens in _counted(batches):
        codes, found = tokens.grams()
        for n, (ends, hashes) in enumerate(found, 1):
            places = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            kept = ends[(bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)]
            grams, counts = _distinct(codes, kept, n, len(tokens.words))
            for at in range(0, len(grams), 1 << 15):
                some = [[tokens.words[k] for k in row] for row in grams[at : at + (1 << 15)].tolist()]
                columns = [
                    pa.array([row[0][0] for row in some], pa.string()),
                    pa.array([b" ".join([w for _, w in row]) for row in some], pa.binary()).cast(pa.string()),
                    pa.array(np.full(len(some), n, np.int32)),
                    pa.array(counts[at : at + (1 << 15)].astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_EXACT)


def word_totals(docs: DataFrame) -> DataFrame:
    """``lang, n``: the words of each language."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.groupBy(language(F.col("lang")).alias("lang")).agg(F.sum(words).alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, totals: DataFrame | None = None) -> DataFrame:
    """Written rows ``lang, phrase, words, a``: every phrase of one to three words
    that occurs ``least`` times or more in its language, and how often."""
    texts = docs.select(language(F.col("lang")).alias("lang"), "text")
    mass = (word_totals(docs) if totals is None else totals).agg(F.sum("n")).first()[0] or 0
    packed = frequent_filter(texts, ORDER * mass, least)
    sent = texts.sparkSession.sparkContext.broadcast(packed)
    found = texts.mapInArrow(lambda b: _exact(b, sent.value), "lang string, phrase string, words int, a bigint")
    return staged(found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")


def _part(first: Column, last: Column) -> Column:
    """Words of a phrase by number, from 1."""
    head = F.call_function("substring_index", F.col("phrase"), F.lit(" "), last)
    return F.call_function("substring_index", head, F.lit(" "), first - last - F.lit(1))


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of each phrase of two words or more:
    its lowest-scoring cut, the first of several."""
    long = counts.where(F.col("words") > 1)
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words")).alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    sides = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    # The products pass 64 bits; decimals of no fraction keep them whole.
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    square = (wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    score = F.call_function("div", square, (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    best = sides.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """``lang, phrase``: phrases inside a longer one with that share of their
    occurrences."""
    longer = counts.where(F.col("words") > 2)
    starts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("first"))
    ends = starts.select("*", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("words"), F.col("first") + F.col("words") - 2))).alias("last"))
    parts = ends.select("lang", _part(F.col("first"), F.col("last")).alias("phrase"), "a")
    most = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    held = counts.join(most, ["lang", "phrase"])
    return held.where(F.lit(100) * F.col("most") >= F.lit(percent) * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = COVER_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    Null and empty texts have no words; repeated rows count each; a null language
    is ``und``. A language without a frequent phrase has no row, nor has an empty
    table. Ties in score and frequency go by the phrase's bytes."""
    totals = staged(word_totals(docs), "totals")
    counts = phrase_counts(docs, least, totals)
    found = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)
