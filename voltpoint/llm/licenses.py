"""Licence scans: notices by TF-IDF cosine, then inheritance by directory.

Every line, paragraph and whole text is a sparse TF-IDF vector, compared to the
notices of known licences unless the weight it shares with them cannot reach the
least cosine; document frequencies come from the whole corpus. A file without a notice of its own inherits from the
nearest directory above it that has a licence file. The ancestors of the
distinct directories are joined to the licensed ones, and the files to their
directory, so a directory with many files costs one row until the last join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltpoint.llm.common import staged

# Short public notices by SPDX id.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
}
#: Least cosine of a notice to its template.
LEAST = 0.7
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Notices:
    """The templates as unit vectors, given how many documents hold a term. A
    term outside all templates weighs as one that every document holds."""

    def __init__(self, templates: dict[str, tuple[str, ...]], holding: dict[str, int], documents: int):
        self.idf = {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in holding.items()}
        self.vectors, self.postings = [], {}
        for name, notices in sorted(templates.items()):
            for notice in notices:
                vector = self.vector(terms(notice))
                for term, weight in vector.items():
                    self.postings.setdefault(term, []).append((len(self.vectors), weight))
                self.vectors.append(name)
        #: The most that a term weighs in any notice.
        self.most = {t: max(w for _, w in of) for t, of in self.postings.items()}

    def reaches(self, counts: Counter, least: float) -> bool:
        """Whether the cosine to a notice can be ``least``: no notice gives a
        term more than its greatest weight, and a notice has length one."""
        shared = counts.keys() & self.most.keys()
        if not shared:
            return False
        squares, inside, reach = sum(n * n for n in counts.values()), 0.0, 0.0
        for term in shared:
            n, weight = counts[term], counts[term] * self.idf[term]
            squares += weight * weight - n * n
            inside += weight * weight
            reach += weight * self.most[term]
        # Cosines are rounded to six digits.
        return min(reach, math.sqrt(inside)) >= (least - 1e-6) * math.sqrt(squares)

    def vector(self, words: list[str]) -> dict[str, float]:
        weights = {t: n * self.idf.get(t, 1.0) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    def best(self, words: list[str]) -> tuple[float, str]:
        """The highest cosine and its licence, the first by name of equals."""
        total: dict[int, float] = {}
        for term, weight in self.vector(words).items():
            for number, other in self.postings.get(term, ()):
                total[number] = total.get(number, 0.0) + weight * other
        best = min(((-round(c, 6), self.vectors[k]) for k, c in total.items()), default=(0.0, ""))
        return -best[0], best[1]

    def read(self, text: str, least: float) -> tuple[str | None, float | None, bool, int]:
        """The licence of a text, its cosine, whether the text opens with it, and
        how many lines or paragraphs are notices."""
        found, opens, count = [], False, 0
        paragraphs = [p for p in re.split(r"\n[^\S\n]*\n", text) if p.strip()]
        units = [u for p in paragraphs for u in ((p, *p.split("\n")) if "\n" in p else (p,))]
        for unit in units + ([text] if len(paragraphs) > 1 else []):
            words = terms(unit)
            if self.reaches(Counter(words), least):
                score, name = self.best(words)
                if score >= least:
                    found.append((-score, name))
                    count += 1
                    opens |= text.lstrip().startswith(unit.strip())
        if not found:
            return None, None, False, 0
        score, name = min(found)
        return name, -score, opens, count


def _holding(batches: Iterator[pa.RecordBatch], vocabulary: frozenset, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: Counter = Counter()
        for text in batch.column("text").to_pylist():
            count.update(vocabulary.intersection(terms(text or "")))
        count[""] = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], schema=schema)


def _read(batches: Iterator[pa.RecordBatch], notices: Notices, least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [notices.read(text or "", least) for text in batch.column("text").to_pylist()]
        made = {name: [r[k] for r in rows] for k, name in enumerate(("license", "score", "opens", "notices"))}
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema
        )


def scan_licenses(
    docs: DataFrame,
    path: Column,
    is_license_file: Column | None = None,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """``doc_id, path, license, score, notices, via, from_directory`` for every
    document.

    ``via`` is ``notice`` for a licence found in the text, ``inherited`` for the
    one of the nearest directory at or above the file's, and null for none. A
    directory's licence is that of its licence file, the first by path of
    several; ``is_license_file`` may use the columns ``path, opens, license`` and
    is by default a file name. Null and empty texts have no notice; a null path
    lies in no directory. Repeated rows give repeated results, and an empty table
    none."""
    spark = docs.sparkSession
    vocabulary = frozenset(t for notices in templates.values() for n in notices for t in terms(n))
    counted = T.StructType.fromDDL("term string, n bigint")
    held = docs.select("text").mapInArrow(lambda b: _holding(b, vocabulary, to_arrow_schema(counted)), counted)
    # One row for each term of the templates.
    holding = {r.term: r.n for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    notices = Notices(templates, {t: holding.get(t, 0) for t in vocabulary}, holding.get("", 0))
    sent = spark.sparkContext.broadcast(notices)
    source = docs.select("doc_id", "text", path.alias("path"))
    schema = T.StructType(
        [*source.schema.fields[::2], *T.StructType.fromDDL("license string, score double, opens boolean, notices bigint")]
    )
    read = source.mapInArrow(lambda b: _read(b, sent.value, least, to_arrow_schema(schema)), schema)
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    read = staged(read.withColumn("directory", directory), "notices")
    if is_license_file is None:
        is_license_file = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)
    licensed = read.where(F.col("license").isNotNull() & F.col("path").isNotNull() & is_license_file)
    licensed = licensed.groupBy("directory").agg(F.min(F.struct("path", "license", "score")).alias("file"))
    licensed = staged(licensed.select(F.col("directory").alias("above"), "file.license", "file.score"), "licensed")
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    below = read.where("path is not null and license is null").select("directory").distinct()
    below = below.select("directory", F.inline(ancestors)).join(licensed, "above")
    nearest = below.groupBy("directory").agg(F.max_by(F.struct("above", "license", "score"), "depth").alias("given"))
    nearest = staged(nearest, "inherited")
    joined = read.join(nearest, "directory", "left")
    own = F.col("license").isNotNull()
    given = F.col("given.license").isNotNull() & F.col("path").isNotNull() & ~own
    return joined.select(
        "doc_id",
        "path",
        F.when(own, F.col("license")).when(given, F.col("given.license")).alias("license"),
        F.when(own, F.col("score")).when(given, F.col("given.score")).alias("score"),
        "notices",
        F.when(own, "notice").when(given, "inherited").alias("via"),
        F.when(given, F.col("given.above")).alias("from_directory"),
    )


def _tree(doc_id: Column, source: Column) -> Column:
    """A path for documents that have none: the source, a folder for each digit
    of the id but the last two, and the id. One file in ten, by a hash of the id,
    lies a folder higher, one in a hundred two, and so on, so that folders of
    every level hold files of their own, few at any size of the table."""
    name = doc_id.cast("string")
    lift = F.length(F.regexp_extract(F.pmod(F.xxhash64(name), F.lit(10**9)).cast("string"), "0*$", 0))
    digits = F.substring(name, F.lit(1), F.greatest(F.lit(0), F.length(name) - 2 - lift))
    folders = F.regexp_replace(digits, "(.)", "$1/")
    return F.concat(F.coalesce(source.cast("string"), F.lit("_")), F.lit("/"), F.coalesce(folders, F.lit("")), F.coalesce(name, F.lit("_")))


def digest(docs: DataFrame) -> DataFrame:
    """`scan_licenses` over documents, whose paths are those of `_tree`. A
    document with a notice anywhere is a licence file of its folder; the first
    by path counts for the folders below."""
    return scan_licenses(docs, _tree(F.col("doc_id"), F.col("source")), is_license_file=F.lit(True))
