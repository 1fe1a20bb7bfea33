"""The manifest against a tree made by hand."""

import hashlib
import zlib

import corpus
import pytest

from voltpoint.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """All levels, and the siblings of each leaf as one text."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 3])) for k in range(0, len(below), 3)])
    proofs = []
    for i in range(len(leaves)):
        path, at = "", i
        for level in levels[:-1]:
            low = at - at % 3
            path += "".join(h for k, h in enumerate(level[low : low + 3], low) if k != at)
            at //= 3
        proofs.append(path)
    return levels, proofs


def brute(rows):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = [(r, brute_leaf(r, r.text)) for r in rows if r.source == s]
        mine.sort(key=lambda m: (m[0].doc_id is not None, m[0].doc_id or 0, m[1]))
        trees[s] = (mine, *brute_tree([h for _, h in mine]))
    top, top_proofs = brute_tree([trees[s][1][-1][0] for s in sources])
    found = []
    for s, above in zip(sources, top_proofs):
        mine, levels, proofs = trees[s]
        for (r, leaf), path in zip(mine, proofs):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            whole = brute_leaf(r, text) == leaf
            found.append((r.doc_id, leaf, levels[-1][0], top[-1][0], sha(path + above), whole))
    return sorted(found, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified")


def check(docs):
    rows = docs.collect()
    got = manifest.digest(docs).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got)
    return got


def test_awkward_rows(spark, tmp_path):
    got = check(corpus.stored(corpus.awkward(spark), tmp_path / "d"))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 82, 260])
def test_trees_of_several_written_levels(spark, n):
    rows = [(i * 7 % n, f"line {i}\nend", "en", "hot" if i % 3 else None) for i in range(n)]
    check(corpus.awkward(spark, rows))


def test_many_sources(spark):
    check(corpus.awkward(spark, [(i, "x\ny", "en", f"s{i}é") for i in range(100)]))


def test_empty(spark):
    empty = corpus.empty(spark)
    assert manifest.digest(empty).count() == 0
    assert manifest.Manifest(empty).root() is None


def test_proofs_fold_to_the_root(spark):
    docs = corpus.awkward(spark, [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(60)])
    made = manifest.Manifest(docs)
    proofs = {r.doc_id: r for r in made.proofs().collect()}
    root = made.root()
    for i in (0, 1, 31, 59):
        trees = [(i // 2, 30), (i % 2, 2)]
        assert manifest.fold(proofs[i].leaf, proofs[i].path, trees) == root
        assert manifest.fold(sha("other"), proofs[i].path, trees) != root


def test_only_every_fourth_level_is_written(spark):
    docs = corpus.awkward(spark, [(i, "t", "en", "a") for i in range(250)])
    made = manifest.Manifest(docs)
    assert [level.count() for level in made.levels] == [250, 4, 1]


def test_rows_are_numbered_through(spark):
    rows = spark.createDataFrame([(i % 5 // 2, i % 7) for i in range(200)] + [(None, None)] * 9, "g int, v int").repartition(6)
    got = manifest.in_order(rows, "g", ["v"]).collect()
    for g in {r.g for r in got}:
        mine = sorted((r.i, r.v is not None, r.v or 0, r.n) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:3] for m in mine] == sorted(m[1:3] for m in mine)
        assert {m[3] for m in mine} == {len(mine)}
