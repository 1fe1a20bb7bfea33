"""Packing: every id once, no overlaps, little padding."""

import collections
import random
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltpoint.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 1], "<u4") for e in found]


def check(packed, rows, capacity):
    """``rows``: (doc_id, text). Returns the padding."""
    ids = collections.defaultdict(list)
    for (doc, _), found in zip(rows, library_ids([t for _, t in rows])):
        ids[doc].append(found.tobytes())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    # Rows of one id cannot be told apart; their ids are held against each other as a whole.
    for doc, want in ids.items():
        mine = sorted(pieces[doc], key=lambda r: (r.start, r.doc_tokens))
        assert sum(len(w) for w in want) == sum(4 * r.length for r in mine)
        if len(want) == 1:
            assert b"".join(bytes(r.ids) for r in mine) == want[0]
            assert [r.start for r in mine] == [sum(p.length for p in mine[:k]) for k in range(len(mine))]
            assert {4 * r.doc_tokens for r in mine} == {len(want[0])}
    padding = 0
    for mine in sequences.values():
        mine.sort(key=lambda r: r.offset)
        size = sum(r.length for r in mine)
        assert [r.offset for r in mine] == [sum(p.length for p in mine[:k]) for k in range(len(mine))]
        assert size <= capacity
        padding += 0 if size & (size - 1) == 0 else capacity - size
    return padding


@pytest.mark.parametrize("capacity", [2048, 64])
def test_awkward_rows(spark, tmp_path, capacity):
    docs = corpus.stored(corpus.awkward(spark), tmp_path / "d")
    packed = packing.pack(docs, PATH, capacity).collect()
    assert check(packed, [(r.doc_id, r.text) for r in docs.collect()], capacity) == 0
    empty = [r for r in packed if r.doc_id == 5]
    assert [(r.start, r.length, r.doc_tokens) for r in empty] == [(0, 1, 1)]


def test_empty(spark):
    assert packing.digest(corpus.empty(spark), PATH).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(docs, PATH).collect()
    assert check(packed, [(r.doc_id, r.text) for r in docs.collect()], packing.CAPACITY) == 0
    digest = {(r.doc_id, r.start): r for r in packing.digest(docs, PATH).collect()}
    for doc, start in random.Random(1).sample(sorted(digest), 20):
        whole = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted((p for p in packed if p.doc_id == doc), key=lambda r: r.start)])
        r = digest[doc, start]
        assert r.ids_crc32 == zlib.crc32(whole[start : start + r.length].tobytes())


def test_sequences_are_padded(spark):
    docs = corpus.awkward(spark, [(i, "one two three four five"[: 3 + i], "en", "a") for i in range(17)])
    packed = packing.pack(docs, PATH, 16)
    found = packing.sequences(packed, 16).collect()
    assert sum(r.n_tokens for r in found) == sum(r.length for r in packed.collect())
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens.bit_count() == 1 else 16) for r in found)


@pytest.mark.parametrize("text", ["á <|endoftext|> x<|startoftext|>y", "don't I'LL 'VE", "x y z\x1cq", "Σίσυφος ΣΑΣ\n\nİstanbul 4²", "́ lone \x00 \x85", "word " * 3000, "y" * 5000, "Élan!'s ÀÉŒ×÷ I'llama\x0b12\x7f", "a''ll 'S <| x", "İı ŉ ſ ß"])
def test_words_side_by_side_are_the_text(text):
    with open(PATH, encoding="utf-8") as file:
        spec = file.read()
    encoder = packing._Encoder(spec, packing.check_vocabulary(spec))
    want = library_ids([text])[0][:-1]
    for _ in range(2):
        assert np.frombuffer(encoder.text(text.encode()), "<u2").tolist() == want.tolist()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 2000), max_size=12))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.pack_histogram(histogram, 32)
    held = collections.Counter()
    for count, items in patterns:
        assert count > 0 and sum(length * copies for length, copies in items) <= 32
        for length, copies in items:
            held[length] += count * copies
    assert held == histogram
    slots = packing.slots_of(patterns, 32)
    spans = []
    for length, n in histogram.items():
        places = slots.places(np.full(n, length), np.arange(n))
        spans += [(p, p + length) for p in places.tolist()]
    spans.sort()
    # The line is covered without a gap and without an overlap.
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)


def test_shortest_pack_first():
    assert packing.pack_histogram({20: 1, 16: 2, 12: 2, 4: 1}, 32) == [(1, [(16, 2)]), (1, [(20, 1), (12, 1)]), (1, [(12, 1), (4, 1)])]


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        with pytest.raises(ValueError, match="white space"):
            packing.check_vocabulary(file.read())
