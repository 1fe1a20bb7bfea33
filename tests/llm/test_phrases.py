"""Collocations against counts made by hand, and what summaries guarantee."""

import random
import re
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from voltpoint.llm import phrases


def brute_grams(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    pieces = [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]
    return Counter(" ".join(p[i : i + n]) for p in pieces for n in (1, 2, 3) for i in range(len(p) - n + 1))


def brute(rows, least, top):
    counts, found = {}, []
    for lang, text in rows:
        counts.setdefault(lang or "und", Counter()).update(brute_grams(text))
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if " " not in p)
        best = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) < 2 or a < least:
                continue
            longer = [b for q, b in f.items() if b >= least and f" {p} " in f" {q} " and q != p]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])], score))
        for rank, (*_, p, a, l, r, score) in enumerate(sorted(best)[:top], 1):
            found.append((lang, rank, p, a, l, r, n, score))
    return sorted(found)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(30)]
    draw = lambda: " ".join(rng.choice(words[: rng.choice((4, 30))]) + rng.choice(("", "", ".", ",\n", "\t")) for _ in range(60))
    return [(rng.choice(("en", "de", None)), rng.choice((draw(), draw(), "", None, " . "))) for _ in range(n)]


def test_collocations(spark):
    rows = texts(3, 120)
    docs = corpus.awkward(spark, [(i, t, g, "s") for i, (g, t) in enumerate(rows)])
    for least, top in ((10, 2000), (3, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect())
        assert got == brute(rows, least, top) and len(got) > 5


def test_awkward_rows(spark, tmp_path):
    docs = corpus.stored(corpus.awkward(spark), tmp_path / "d")
    got = sorted(tuple(r) for r in phrases.collocations(docs, 2, 50).collect())
    assert got == brute([(r.lang, r.text) for r in docs.collect()], 2, 50)
    assert phrases.digest(corpus.empty(spark)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = [("x", "a b", 2, big - 1), ("x", "a", 1, big), ("x", "b", 1, big + 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, a bigint")
    found = phrases.scored(counts).first()
    assert found.score == 10**6 * (big - 1) ** 2 // (big * (big + 7))


def batches(rows):
    yield pa.RecordBatch.from_pydict({"lang": [g or "und" for g, _ in rows], "text": [t for _, t in rows]}, pa.schema([("lang", pa.string()), ("text", pa.string())]))


def test_every_frequent_phrase_survives(monkeypatch):
    rows = texts(5, 300)
    monkeypatch.setattr(phrases, "TOKENS", 500)
    monkeypatch.setattr(phrases, "ROW_HASHES", 64)
    monkeypatch.setattr(phrases, "PARTITION_MASS", 400)
    monkeypatch.setattr(phrases, "SPARE", 1)
    made = [r for half in (rows[:150], rows[150:]) for b in phrases._summaries(batches(half), 5) for r in b.to_pylist()]
    made.sort(key=lambda r: (r["p"], r["mass"] is None))
    dealt = pa.RecordBatch.from_pylist(made, phrases._SUMMARY)
    least = 25
    bits = np.zeros(1 << (phrases.FILTER_BITS - 3), np.uint8)
    for b in phrases._survivors(iter([dealt]), least):
        for r in b.to_pylist():
            some = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
            bits[r["first_byte"] : r["first_byte"] + len(some)] |= some
    seen = Counter()
    for b in phrases._exact(batches(rows), zstandard.ZstdCompressor().compress(bits.tobytes())):
        for r in b.to_pylist():
            seen[r["lang"], r["phrase"]] += r["a"]
    want = Counter()
    for g, t in rows:
        for p, a in brute_grams(t).items():
            want[g or "und", p] += a
    left = len(seen)
    assert {k: a for k, a in seen.items() if a >= least} == {k: a for k, a in want.items() if a >= least}
    # The summaries do drop: most phrases are rare.
    assert left < len(want) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=6), st.integers(1, 12))
def test_merged_summaries_lose_less_than_their_share(parts, capacity):
    keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for part in parts:
        some = Counter(part)
        keys = np.concatenate([keys, np.array(list(some), np.uint64)])
        counts = np.concatenate([counts, np.array(list(some.values()), np.int64)])
        keys, counts, more = phrases.merge(keys, counts, capacity)
        lost += more
        assert len(keys) <= capacity
    true, kept = Counter(x for part in parts for x in part), dict(zip(keys.tolist(), counts.tolist()))
    for key, count in true.items():
        assert 0 <= count - kept.get(key, 0) <= lost <= sum(true.values()) / (capacity + 1)


def test_slices_of_a_text_make_no_difference(monkeypatch):
    text = "Aa bb\tcc. dd ee " * 400
    whole = phrases._Tokens()
    whole.add("x", text.encode())
    monkeypatch.setattr(phrases, "SLICE_BYTES", 7)
    sliced = phrases._Tokens()
    sliced.add("x", text.encode())
    assert np.array_equal(np.concatenate(whole.parts), np.concatenate(sliced.parts))
