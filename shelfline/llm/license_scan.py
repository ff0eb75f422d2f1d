"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies.

A template is its distinct shingles of five words. Templates are put in classes by how many
shingles they have, c / 2 < s <= c for c a power of two. For each class a text's shingles
are cut into windows of 1.5 c that start every c / 2, so that any c in a row lie whole in one
window. A window that holds CONTAINED of a template's shingles has a Jaccard similarity of at
least CONTAINED * s / (1.5 c + (1 - CONTAINED) s) with it, a quarter at worst; BANDS bands of
one MinHash each miss such a window with probability (3 / 4) ** BANDS, under 1e-4. Whatever
a band retrieves is verified by counting the template's shingles in the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import words_of

SHINGLE, CONTAINED, BANDS = 5, 0.8, 32
#: Shingles whose hashes are held at once.
CHUNK = 1 << 15

#: Notices by which works state their licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's shingles of words in order."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)) for ws in words_of(text)]
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - SHINGLE + 1 + i]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


_MULTIPLY = np.random.default_rng(7).integers(1, 1 << 62, BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_BAND = (np.arange(BANDS, dtype=np.uint32) << np.uint32(16))[:, None]


def minhash_values(shingles: np.ndarray) -> np.ndarray:
    """[band, shingle]: values whose least one over a window is its MinHash."""
    return ((shingles[None, :] * _MULTIPLY[:, None]) >> np.uint64(32)).astype(np.uint32)


def _steps(c: int) -> tuple[int, int]:
    """How far apart windows of a class start, and how many such steps one spans."""
    return max(1, c // 2), 1 if c == 1 else 3


class Templates:
    """Templates by class: their shingles, and in each band the MinHash that retrieves them."""

    def __init__(self, notices: dict[str, list[str]]):
        self.sets: list[tuple[str, np.ndarray]] = []
        self.classes: dict[int, list[int]] = {}
        for name, texts in sorted(notices.items()):
            for text in texts:
                s = np.unique(shingle_hashes(text))
                if len(s):
                    c = 1 << int(len(s) - 1).bit_length()
                    self.classes.setdefault(c, []).append(len(self.sets))
                    self.sets.append((name, s))
        self.bands = {c: [self._band(b, members) for b in range(BANDS)] for c, members in self.classes.items()}
        #: By class: may a value (by its low 16 bits) be one that retrieves, in each band? Spares most look-ups.
        self.may = {c: np.zeros((BANDS, 1 << 16), bool) for c in self.classes}
        for c, bands in self.bands.items():
            for b, (keys, _) in enumerate(bands):
                self.may[c][b, keys & np.uint32(0xFFFF)] = True

    def _band(self, b: int, members: list[int]) -> tuple[np.ndarray, list[list[int]]]:
        found: dict[int, list[int]] = {}
        for t in members:
            found.setdefault(int(minhash_values(self.sets[t][1])[b].min()), []).append(t)
        keys = sorted(found)
        return np.array(keys, np.uint32), [found[k] for k in keys]

    def scan(self, shingles: np.ndarray, verify_all: bool = False) -> list[tuple[int, int, int]]:
        """(template, start, end) of windows of shingles that contain a template; with verify_all without retrieval, for tests."""
        out: list[tuple[int, int, int]] = []
        n, order = len(shingles), sorted(self.classes)
        if verify_all:
            for c in order:
                step, span = _steps(c)
                out += [x for w in range(-(-n // step)) for x in self._verify(shingles, w * step, min(n, (w + span) * step), self.classes[c])]
            return out
        longest = max(1, order[-1] // 2) if order else 1
        size = -(-CHUNK // longest) * longest
        for lo in range(0, n, size):
            # Values once for all classes; minima over a class's steps come from those of the class below.
            least, at_step = minhash_values(shingles[lo : lo + size + 2 * longest]), 1
            for c in order:
                step, span = _steps(c)
                while at_step < step:
                    if least.shape[1] % 2:
                        least = np.concatenate([least, np.full((BANDS, 1), 0xFFFFFFFF, np.uint32)], axis=1)
                    least, at_step = np.minimum(least[:, ::2], least[:, 1::2]), at_step * 2
                wide = least.copy() if span > 1 else least
                for k in range(1, span):
                    wide[:, :-k] = np.minimum(wide[:, :-k], least[:, k:])
                wide = wide[:, : -(-min(size, n - lo) // step)]
                hits: set[tuple[int, int]] = set()
                maybe = np.flatnonzero(self.may[c].ravel()[(wide & np.uint32(0xFFFF)) | _BAND])
                for b, w in zip(*(x.tolist() for x in np.divmod(maybe, wide.shape[1]))):
                    keys, of = self.bands[c][b]
                    k = int(np.searchsorted(keys, wide[b, w]))
                    if k < len(keys) and keys[k] == wide[b, w]:
                        hits.update((w, t) for t in of[k])
                for w, t in sorted(hits):
                    start = lo + w * step
                    out += self._verify(shingles, start, min(n, start + span * step), [t])
        return out

    def _verify(self, shingles: np.ndarray, start: int, end: int, members: list[int]) -> list[tuple[int, int, int]]:
        window, out = shingles[start:end], []
        for t in members:
            mine = self.sets[t][1]
            at = np.flatnonzero(np.isin(window, mine))
            if len(at) and len(np.unique(window[at])) >= CONTAINED * len(mine):
                out.append((t, start + int(at[0]), start + int(at[-1]) + SHINGLE))
        return out


SCHEMA = "doc_id long, n_words long, n_matches long, licenses array<string>, spans array<struct<license:string,start:long,end:long>>"


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_matches, licenses, spans``.

    ``spans`` are the word positions [start, end) of each license's notices, merged where they
    overlap, and ``licenses`` the sorted names. Null and empty texts, and texts of fewer than five
    words, have none. Rows repeat as they come, with null ids too; an empty table gives none.
    Columns besides doc_id and text are ignored. Templates are a fixed, small set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(notices or TEMPLATES))

    def one(i, text) -> dict:
        t = shared.value
        s = shingle_hashes(text)
        by_name: dict[str, list] = {}
        for k, a, b in t.scan(s) if len(s) else ():
            by_name.setdefault(t.sets[k][0], []).append((a, b))
        spans = []
        for name, found in sorted(by_name.items()):
            merged: list = []
            for a, b in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            spans += [{"license": name, "start": a, "end": b} for a, b in merged]
        n = len(s) + SHINGLE - 1 if len(s) else sum(map(len, words_of(text)))
        return {"doc_id": i, "n_words": n, "n_matches": len(spans), "licenses": sorted(by_name), "spans": spans}

    kind = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(i, t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1))], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
