"""Quality rules: counts of a text, then its perplexity against bands.

The language model is a modified Kneser-Ney model of order four over symbols:
letters in lower case with a mark for capitals, digits as one symbol, a few
marks, and the other letters hashed to a few symbols, 64 in all. Spark counts
its n-grams over every document that passes the base rules and looks like
running text. The highest order is a sorted array of hashed n-grams beside their
probabilities, at most 64**4 for a language; lower orders are full tables.

Each language has a band of perplexity around the median of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import staged, union_all

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The model learns from texts with at most these shares, in percent of the
#: characters of words, of symbols and of capitals.
TRAIN_SYMBOLS, TRAIN_CAPITALS = 1, 30
#: The band, as factors of the median perplexity of the language.
LOWER, UPPER = 1 / 1.5, 3.0
#: Bits of a symbol; bytes of models sent to the executors at a time.
BITS, MODEL_BYTES = 6, 256 << 20
#: Rows whose texts are held as objects at a time.
SLICE = 512
ORDER, MARKS = 4, ".,;:!?'\"()-/"
_BEGIN, _SPACE, _DIGIT, _CAPITAL, _LETTER, _MARK, _ASCII, _OTHER, _HASHED = 0, 1, 2, 3, 4, 30, 42, 43, 44

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    again = np.concatenate([[False, False], count[back] > 1, [False, False]])
    return int((again[2:] | again[1:-1] | again[:-2]).sum())


def base_counts(text: str) -> dict:
    """The counts of one text and whether it fails the base rules."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeat = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "base_failed": len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words),
    }


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each of the first 65,536 code points, and which are capitals."""
    symbol, capital = np.full(1 << 16, _OTHER, np.uint8), np.zeros(1 << 16, bool)
    for point in range(1 << 16):
        char = chr(point)
        low = char.lower()[:1]
        capital[point] = low != char and char.isalpha()
        if char.isspace():
            symbol[point] = _SPACE
        elif char.isdigit():
            symbol[point] = _DIGIT
        elif "a" <= low <= "z":
            symbol[point] = _LETTER + ord(low) - ord("a")
        elif low.isalpha():
            symbol[point] = _HASHED + ord(low) % (64 - _HASHED)
        elif point < 128:
            symbol[point] = _MARK + MARKS.index(char) if char in MARKS else _ASCII
    return symbol, capital


def symbols(text: str) -> tuple[np.ndarray, int]:
    """The symbols of a text, and how many of its characters are capitals."""
    table, capitals = _classes()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = points < 1 << 16
    out = np.where(low, table[points & 0xFFFF], _HASHED + points % (64 - _HASHED)).astype(np.uint8)
    capital = capitals[points & 0xFFFF] & low
    twice = np.repeat(out, 1 + capital)
    ends = np.cumsum(1 + capital.astype(np.int64))
    twice[ends[capital] - 2] = _CAPITAL
    space = twice == _SPACE
    return twice[~(space & np.concatenate([[False], space[:-1]]))], int(capital.sum())


def grams(sequence: np.ndarray) -> np.ndarray:
    """The four-symbol grams that end at each symbol, as numbers."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint32), sequence.astype(np.uint32)])
    code = np.zeros(len(sequence), np.uint32)
    for k in range(ORDER):
        code = code << np.uint32(BITS) | padded[k : k + len(sequence)]
    return code


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces whose texts are few enough to be held as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pending: dict[str, list] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang: str, pending=pending, totals=totals) -> None:
            codes, n = np.unique(np.concatenate(pending.pop(lang)), return_counts=True)
            if lang in totals:
                codes, n = np.concatenate([totals[lang][0], codes]), np.concatenate([totals[lang][1], n])
                codes, back = np.unique(codes, return_inverse=True)
                n = np.bincount(back, n).astype(np.int64)
            totals[lang] = codes, n

        rows = (zip(b.column("text").to_pylist(), b.column("lang").to_pylist()) for b in _slices([batch]))
        for text, lang in chain.from_iterable(rows):
            base = base_counts(text or "")
            if base["base_failed"] or 100 * base["n_symbols"] > TRAIN_SYMBOLS * base["word_chars"]:
                continue
            sequence, capitals = symbols(text)
            if 100 * capitals <= TRAIN_CAPITALS * base["word_chars"]:
                pending.setdefault(lang, []).append(grams(sequence))
                if sum(map(len, pending[lang])) > 1 << 21:
                    merge(lang)
        for lang in list(pending):
            merge(lang)
        for lang, (codes, n) in totals.items():
            made = ([lang] * len(codes), codes.astype(np.int32), n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, schema)], schema=schema)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Chen and Goodman's discounts for counts of 0, 1, 2 and 3 or more."""
    n = [0.0, *(float((counts == k).sum()) for k in (1, 2, 3, 4))]
    if not all(n[1:]):  # too little to estimate from
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3))])


@dataclass
class Model:
    keys: np.ndarray
    logs: np.ndarray
    backoff: np.ndarray
    lower: np.ndarray

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> Model:
        """From the counts of four-symbol grams; ``codes`` sorted."""
        size = 1 << BITS
        table, orders = codes.astype(np.int64), {ORDER: (codes.astype(np.int64), counts.astype(np.int64))}
        for order in range(ORDER - 1, 0, -1):
            # How many different symbols precede each shorter gram.
            table, counts_of = np.unique(table & ((1 << BITS * order) - 1), return_counts=True)
            orders[order] = table, counts_of
        lower = np.full(size, 1.0 / size)
        for order in range(1, ORDER + 1):
            grams_of, n = orders[order]
            cut = _discounts(n)[np.minimum(n, 3)]
            context = grams_of >> BITS
            width = 1 << BITS * (order - 1)
            total = np.bincount(context, n, minlength=width)
            mass = np.bincount(context, cut, minlength=width)
            backoff = np.where(total > 0, mass / np.maximum(total, 1), 1.0)
            # lower: probability of the gram's last symbol after its shorter context.
            shorter = lower[grams_of & ((1 << BITS * max(1, order - 1)) - 1)]
            p = (n - cut) / total[context] + backoff[context] * shorter
            if order == ORDER:
                return cls(grams_of.astype(np.uint32), np.log(p).astype(np.float32), np.log(backoff).astype(np.float32), np.log(lower).astype(np.float32))
            full = np.arange(1 << BITS * order)
            lower = backoff[full >> BITS] * lower[full & ((1 << BITS * max(1, order - 1)) - 1)]
            lower[grams_of] = p
        raise AssertionError

    def log_perplexity(self, sequence: np.ndarray) -> float:
        code = grams(sequence)
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        found = self.keys[at] == code
        missing = code[~found]
        total = float(self.logs[at[found]].sum(dtype=np.float64))
        total += float(self.backoff[missing >> np.uint32(BITS)].sum(dtype=np.float64))
        total += float(self.lower[missing & np.uint32((1 << BITS * (ORDER - 1)) - 1)].sum(dtype=np.float64))
        return -total / len(sequence)


def _score(batches: Iterator[pa.RecordBatch], models: dict[str, Model], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows, scores = [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            base = base_counts(text or "")
            model = models.get(lang)
            rows.append(base)
            scores.append(None if base["base_failed"] or model is None else round(model.log_perplexity(symbols(text)[0]), 6))
        made = {name: [r[name] for r in rows] for name in rows[0]} | {"log_perplexity": scores}
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema
        )


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, code, n`` over all documents that the model learns from."""
    schema = T.StructType.fromDDL("lang string, code int, n bigint")
    counted = docs.select("text", "lang").mapInArrow(lambda b: _count(b, to_arrow_schema(schema)), schema)
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _model_sets(counts: DataFrame) -> Iterator[dict[str, Model]]:
    """The models of all languages, in sets that are small enough to send."""
    sizes = counts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    names: list[str] = []
    room = 0
    groups = []
    for row in sizes.toLocalIterator():
        need = row.n * 8 + (8 << BITS * (ORDER - 1))
        if names and room + need > MODEL_BYTES:
            groups.append(names)
            names, room = [], 0
        names, room = [*names, row.lang], room + need
    for group in [*groups, names] if names else []:
        models = {}
        for lang in group:
            table = counts.where(F.col("lang") == lang).select("code", "n").orderBy("code").toArrow()
            models[lang] = Model.fit(table["code"].to_numpy(), table["n"].to_numpy())
        yield models


def score(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns named by ``carry``, by default all), the base counts,
    ``log_perplexity`` and ``kept``.

    Null and empty texts have no words and fail the base rules. A null language
    is a language of its own. A language that no text could be learned for has
    no band, and its documents that pass the base rules are kept. Repeated rows
    are judged alike; an empty table has no rows."""
    spark: SparkSession = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    carry = docs.columns if carry is None else carry
    others = F.struct(F.lit(True).alias("_"), *[F.col(c) for c in carry if c != "text"])
    source = docs.select(others.alias("others"), "text", lang.alias("lang"))
    counts = staged(count_grams(source), "grams")
    passed = [f for f in source.schema.fields if f.name != "text" or "text" in carry]
    schema = T.StructType([*passed, *T.StructType.fromDDL(COUNTS + ", log_perplexity double")])
    parts, seen = [], []
    for models in _model_sets(counts):
        sent = spark.sparkContext.broadcast(models)
        part = source.where(F.col("lang").isin(list(models)))
        parts.append(part.mapInArrow(lambda b, sent=sent: _score(b, sent.value, to_arrow_schema(schema)), schema))
        seen += list(models)
    rest = source.where(~F.col("lang").isin(seen)) if seen else source
    parts.append(rest.mapInArrow(lambda b: _score(b, {}, to_arrow_schema(schema)), schema))
    # Scoring is the costly part, so it is done once: the medians need it first.
    scored = staged(union_all(parts), "scores")
    bins = scored.where("log_perplexity is not null").groupBy("lang", F.floor(F.col("log_perplexity") * 1000).alias("bin"))
    bins = bins.agg(F.count("*").alias("n"))
    by_bin = Window.partitionBy("lang").orderBy("bin")
    total = F.sum("n").over(Window.partitionBy("lang"))
    median = bins.withColumn("upto", F.sum("n").over(by_bin)).withColumn("half", total / 2).where("upto >= half")
    median = median.groupBy("lang").agg((F.min("bin") / 1000).alias("median"))
    medians = {r["lang"]: r["median"] for r in median.where(F.col("lang").isin(seen)).collect()} if seen else {}
    log = F.col("log_perplexity")
    if medians:
        middle = F.element_at(F.create_map(*[F.lit(v) for pair in medians.items() for v in pair]), F.col("lang"))
        inside = log.between(middle + float(np.log(LOWER)), middle + float(np.log(UPPER)))
    else:
        inside = F.lit(True)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    doc = F.struct(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in carry])
    made = [f.name for f in T.StructType.fromDDL(COUNTS)]
    return scored.select(doc.alias("doc"), *made, "log_perplexity", kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``,
    ``kept`` and ``log_perplexity``."""
    scored = score(docs, carry=["doc_id"])
    return scored.select(F.col("doc.doc_id").alias("doc_id"), *[c for c in scored.columns if c != "doc"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return score(docs).where("kept").select("doc.*")
