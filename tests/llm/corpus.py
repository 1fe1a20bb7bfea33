"""Small tables with every awkward case, and helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, kept string, rid int, doc string"


def awkward(spark, rows=None):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated
    rows, ids that repeat, and extra columns whose names clash."""
    rng = random.Random(5)
    words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("klmn") + str(i % 7) for i in range(60)]
    prose = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    texts = [
        (1, prose[0], "en", "a"),
        (2, prose[0], "en", "b"),
        (3, prose[0] + " tail", "en", None),
        (None, prose[1], "en", "a"),
        (None, prose[1], "en", "a"),
        (None, None, None, None),
        (5, None, "de", "a"),
        (6, "", "de", ""),
        (6, " \n\t ", None, "a"),
        (7, "né 👍 token = 'abcABC123456789xyz'\n\nLicensed under CC BY-NC 4.0.", "fr", "b"),
        (8, "word", "xx", "c"),
        (8, "other", "xx", "c"),
        (9, " ".join(prose * 40), "de", "a"),
        (10, "aaaa" * 300, None, "a"),
        (11, prose[2] + "\n" + prose[3], "de", "b"),
        (11, prose[2] + "\n" + prose[3], "de", "b"),
    ]
    data = [(i, t, g, s, None if t is None else len(t), "x", "y", 1, "z") for i, t, g, s in (rows or texts)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return awkward(spark).where("false")


def stored(frame, path):
    """As files, where rows keep their places."""
    frame.write.parquet(str(path))
    return frame.sparkSession.read.parquet(str(path))
