"""Licence notices in texts, found by MinHash bands over overlapping windows.

Templates and texts are sets of word shingles (`SHINGLE` words; a shorter template is one shingle
of its own length). Templates are classed by shingle length and, in powers of two, by their number
of shingles. For each class a text is covered by windows of two strides, a stride being at least a
template's length, so a template that occurs lies whole in some window. Shingles that no template
has are left out of a window before it is signed: they cannot count for containment, and most
windows are empty then.

A signature is `BANDS` minima of one row each. A window that holds SIMILAR = 0.8 of a template has
a Jaccard similarity of at least 0.8 / (2 * 4 - 0.8 + 1) to it even when all its other shingles
come from other templates, so it shares a band with probability 1 - (1 - s)^64 or more: over
0.997 in that worst case, and practically 1 for a plain occurrence. Templates of a shared band are
looked up by band value, so the cost does not follow their number, and verified exactly: a match has
at least SIMILAR of the template's shingles inside the window, and where the template would stand
there are its numbers and variant words, no others (a template of more than SHORT words: those in
this order). So one version or variant is never taken for another.

Templates are configuration; their table is collected and broadcast, an error beyond `MOST`
characters. Null and empty texts match nothing; very long texts are scanned whole; repeated rows and
null ids are rows like any other. Extra columns stay; result columns replace input columns of their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlight.llm.decontaminate import tokens, word_hashes, words_of

SHINGLE = 5
BANDS = 64
SIMILAR = 0.8
#: Characters of all templates, which every task holds.
MOST = 10_000_000

# Notices of widespread licences, with the class of use that they allow.
TEMPLATES = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    (
        "MIT",
        "permissive",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "permissive",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at",
    ),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "ISC",
        "permissive",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "permissive", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "restricted", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "restricted", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "restricted", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "restricted", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "restricted", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "restricted", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("EPL-2.0", "copyleft", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    (
        "GPL",
        "copyleft",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "restricted", "All rights reserved."),
)


# Words that tell variants of a licence apart, besides numbers.
VARIANTS = frozenset(
    b"affero lesser library sharealike noncommercial noderivatives sa nc nd cc0 mozilla eclipse boost apache mit isc bsd".split()
)
#: Templates up to this many words must have exactly the same numbers and variant words; in longer ones other numbers may stand between.
SHORT = 24


def marks(words: list[bytes]) -> list[bytes]:
    """Numbers and variant words, in order."""
    return [w for w in words if w.isdigit() or w in VARIANTS]


def same_variant(found: list[bytes], wanted: list[bytes], short: bool) -> bool:
    """Whether a place has a template's version and variant; a long template's may have other marks between."""
    if short:
        return found == wanted
    rest = iter(found)
    return all(w in rest for w in wanted)


def template_table(spark: SparkSession) -> DataFrame:
    """name, use, text of the templates above."""
    return spark.createDataFrame(list(TEMPLATES), "name string, use string, text string")


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the BANDS hash functions, by a multiplicative rule."""
    x = (np.arange(1, 2 * BANDS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x[:BANDS] | np.uint64(1), x[BANDS:]


_A, _B = _seeds()


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum per band."""
    h = shingles[:, None] * _A + _B
    return (h ^ (h >> np.uint64(32))).min(axis=0)


class Templates:
    """Templates by class: (shingle length, stride)."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        if sum(len(r[2]) for r in rows) > MOST:
            raise ValueError(f"templates of more than {MOST} characters")
        self.rows = rows
        self.words = [words_of(text) for _, _, text in rows]
        self.marks = list(map(marks, self.words))
        self.bands: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}
        self.classes: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for number, (_, _, text) in enumerate(rows):
            words = words_of(text)
            if not words:
                continue
            k = min(SHINGLE, len(words))
            own = np.unique(tokens(word_hashes(words), k))
            stride = 1 << int(len(words) - k + 1).bit_length()
            self.classes.setdefault((k, stride), []).append((number, own, tokens(word_hashes(words), k)))
            index = self.bands.setdefault((k, stride), {})
            for cell in enumerate(signature(own).tolist()):
                index.setdefault(cell, []).append(number)
        self.own = {number: (own, every) for ts in self.classes.values() for number, own, every in ts}
        self.known = {k: np.unique(np.concatenate([own for (size, _), ts in self.classes.items() if size == k for _, own, _ in ts])) for k in {k for k, _ in self.classes}}

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of every match, overlapping windows merged."""
        words = words_of(text)
        hashes = word_hashes(words)
        found: list[tuple[int, int, int, float]] = []
        for k, known in self.known.items():
            ids = tokens(hashes, k)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids)
            if len(at):
                for size, stride in self.classes:
                    if size == k:
                        found += self._windows(words, at, ids[at], k, stride)
        return merged(found)

    def _variant(self, words: list[bytes], number: int, places: np.ndarray, held: np.ndarray, k: int) -> bool:
        """Whether the words that stand where the template would are of its version and variant.

        The first and the last found shingle say where the template begins and ends there.
        """
        every = self.own[number][1]
        first, last = int(np.flatnonzero(every == held[0])[0]), int(np.flatnonzero(every == held[-1])[-1])
        begin, end = max(0, int(places[0]) - first), int(places[-1]) + len(every) - last + k - 1
        return same_variant(marks(words[begin:end]), self.marks[number], len(self.words[number]) <= SHORT)

    def _windows(self, words: list[bytes], at: np.ndarray, ids: np.ndarray, k: int, stride: int) -> Iterator[tuple[int, int, int, float]]:
        block, index = at // stride, self.bands[k, stride]
        for j in np.unique(np.concatenate((block, np.maximum(block - 1, 0)))).tolist():
            lo, hi = np.searchsorted(block, j), np.searchsorted(block, j + 1, side="right")
            places, held = at[lo:hi], ids[lo:hi]
            if not len(held):
                continue
            # templates that share a band, by one look-up for each band, however many templates there are
            retrieved = {n for cell in enumerate(signature(np.unique(held)).tolist()) for n in index.get(cell, ())}
            for number in sorted(retrieved):
                shingles = self.own[number][0]
                inside = np.isin(held, shingles)
                share = len(np.unique(held[inside])) / len(shingles)
                if share >= SIMILAR and self._variant(words, number, places[inside], held[inside], k):
                    yield number, int(places[inside][0]), int(places[inside][-1]) + k, share


def merged(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Overlapping matches of one template become one, with the best containment."""
    out: list[tuple[int, int, int, float]] = []
    for number, a, b, share in sorted(found):
        if out and out[-1][0] == number and a < out[-1][2]:
            _, a0, b0, share0 = out[-1]
            out[-1] = (number, a0, max(b, b0), max(share, share0))
        else:
            out.append((number, a, b, share))
    return out


def scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Add licenses (sorted names), license_use and license_spans (name, start and end word, containment).

    The use is the strictest found: restricted, copyleft, permissive, none.
    """
    spark = docs.sparkSession
    rows = [tuple(r) for r in (templates if templates is not None else template_table(spark)).select("name", "use", "text").orderBy("name", "text").collect()]
    held = spark.sparkContext.broadcast(Templates(rows))
    names = ["licenses", "license_use", "license_spans"]
    kept = docs.drop(*names)
    where = kept.columns.index(text)
    span = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("containment", T.DoubleType())])
    schema = T.StructType([*kept.schema.fields, T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("license_use", T.StringType()), T.StructField("license_spans", T.ArrayType(span))])
    span_kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            every = [own.matches(t.as_py()) for t in batch.column(where)]
            uses = [{own.rows[m[0]][1] for m in one} for one in every]
            cols = [
                pa.array([sorted({own.rows[m[0]][0] for m in one}) for one in every], pa.list_(pa.string())),
                pa.array([next((u for u in ("restricted", "copyleft", "permissive") if u in got), "none") for got in uses], pa.string()),
                pa.array([[{"name": own.rows[n][0], "start": a, "end": b, "containment": s} for n, a, b, s in one] for one in every], span_kind),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
