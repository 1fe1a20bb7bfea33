"""Inheritance of licences in the registered query, and notices of any wording."""

import collections
import re

import __spark_entry__
from pyspark.sql import functions as F
from voltpoint.llm import licenses


def test_the_query_inherits_from_several_levels(spark):
    rows = __spark_entry__.queries()["op1_licenses"](spark, "/root/testdata/sf0.01").collect()
    files: dict[str, list] = {}
    for r in rows:
        if r.via == "notice":
            files.setdefault(r.path.rpartition("/")[0], []).append((r.path, r.license))
    assert len({d.count("/") for d in files}) > 1
    levels = set()
    for r in rows:
        own = r.path.rpartition("/")[0]
        above = [d for d in files if own == d or own.startswith(d + "/")]
        if r.via != "notice":
            nearest = max(above, key=len, default=None)
            assert (r.via, r.from_directory) == (nearest and "inherited", nearest)
            assert r.license == (min(files[nearest])[1] if nearest else None)
            levels |= {own.count("/") - nearest.count("/")} if nearest else set()
    assert {0, 1} <= levels


def test_a_notice_needs_no_cue_word(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    forms = ["CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0"]
    more = [(-1 - k, f"plain prose\nReleased under {form}.", "x") for k, form in enumerate(forms)]
    docs = table.union(spark.createDataFrame(more, table.schema))
    rows = docs.collect()
    held = collections.Counter(t for r in rows for t in set(licenses.terms(r.text)))
    vocabulary = {t for ns in licenses.TEMPLATES.values() for n in ns for t in licenses.terms(n)}
    every = licenses.Notices(licenses.TEMPLATES, {t: held[t] for t in vocabulary}, len(rows))
    found = {r.doc_id: r for r in licenses.digest(docs).collect()}
    for r in rows:
        paragraphs = [p for p in re.split(r"\n[^\S\n]*\n", r.text) if p.strip()]
        units = [r.text, *paragraphs, *r.text.split("\n")]
        best = max(every.best(words)[0] for words in map(licenses.terms, units) if words)
        assert (found[r.doc_id].via == "notice") == (best >= licenses.LEAST)
        if best >= licenses.LEAST:
            assert found[r.doc_id].score == best
    assert [found[-1 - k].license for k in range(3)] == ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""


def test_notices_of_one_family_are_told_apart(spark):
    rows = [(name, notice) for name, notices in licenses.TEMPLATES.items() for notice in notices]
    rows += [
        ("LGPL-2.1", f"prose\n\n{LGPL}\n\nprose"),
        ("LGPL-3.0", LGPL.replace("software;", "software:").replace("Foundation;", "Foundation,").replace("2.1", "3")),
        ("GPL-2.0", LGPL.replace("library", "program").replace("Lesser ", "").replace("2.1", "2")),
        ("AGPL-3.0", LGPL.replace("library", "program").replace("Lesser", "Affero").replace("2.1", "3")),
    ]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    found = licenses.scan_licenses(docs, F.lit(None).cast("string")).where("via = 'notice'").collect()
    assert {r.doc_id: r.license for r in found} == {i: name for i, (name, _) in enumerate(rows)}
