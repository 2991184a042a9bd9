"""License scans by conditional compression.

Stretches of a text around its cues (words of which every template holds one) are candidates: blocks that reach as many
words both ways as the longest template's places can have, over line breaks and the signs of comments. In a block a template's places are found by wording: as many words as can agree in the
template's order do so, and what the longer side has beside them are differences, of which a place has at most
``DIFFERENCES`` times the template's words. The words of each place are compressed alone and with the template's as a
raw zstandard dictionary; the bytes that a template saves rank the places, whatever stands around them. In that order
places are reported, unless a better one has already taken the words.

Null texts and texts without a cue give no rows. Repeated rows are scanned one by one. An empty table gives an empty
result. Other columns than doc_id and text are left out.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of which each template holds one.
CUE = r"(?i)licen[sc]e|permission|redistribution|public\W+domain"
#: The most differences for each template word.
DIFFERENCES = 0.1
LEVEL = 3

# License notices. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}

_WORD = re.compile(r"\w+(?:[.\-]+\w+)*")


def wording(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words with where they begin and end."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def blocks_of(text: str, begins: list[int], reach: int) -> list[tuple[int, int]]:
    """(first word, end) of each block: ``reach`` words both ways of a cue's word, joined where they meet."""
    blocks: list[tuple[int, int]] = []
    for m in re.finditer(CUE, text):
        at = bisect.bisect_right(begins, m.start()) - 1
        low, high = max(0, at - reach), min(len(begins), at + reach + 1)
        if blocks and low <= blocks[-1][1]:
            low, _ = blocks.pop()
        blocks.append((low, high))
    return blocks


def places_of(words: list[str], own: list[str]) -> list[tuple[int, int, int]]:
    """(first word, end, differences) of each place of a template's words among a block's; places do not overlap."""
    n, most = len(words), int(DIFFERENCES * len(words))
    width = n + most  # no place is longer
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    block = np.array([number.get(w, -1) for w in own] + [-1] * width)
    # at most so many of the template's words are left out, before the first that agrees or in all
    held = np.concatenate([[0], np.cumsum(block >= 0)])
    starts = np.flatnonzero(np.isin(block[: len(own)], [number[w] for w in words[: most + 1]]))
    starts = starts[held[starts + width] - held[starts] >= n - most]
    if not len(starts):
        return []
    window = block[starts[:, None] + np.arange(width)]
    agree = np.zeros((len(starts), width + 1), dtype=np.int64)
    for w in words:
        agree[:, 1:] = np.maximum(agree[:, 1:], agree[:, :-1] + (window == number[w]))
        agree = np.maximum.accumulate(agree, axis=1)
    differences = np.maximum(n, np.arange(width + 1)) - agree
    best = differences.argmin(axis=1)
    found = sorted((int(d[b]), int(b), int(s)) for d, b, s in zip(differences, best, starts) if d[b] <= most)
    places: list[tuple[int, int, int]] = []
    for d, size, low in found:
        if all(low + size <= a or low >= b for a, b, _ in places):
            places.append((low, low + size, d))
    return places


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = []
        for name, text in templates.items():
            words = wording(text)[0]
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw), words))
        self.reach = max((len(words) + int(DIFFERENCES * len(words)) for _, _, words in self.templates), default=0)

    def scan(self, text: str) -> Iterator[tuple[str, int, int, float, int, int]]:
        """(license, begin, end, share saved, template words, differences) of each notice, in characters of the text."""
        all_words, begins, ends = wording(text)
        for first, end in blocks_of(text, begins, self.reach):
            own = all_words[first:end]
            ranked = []
            for name, c, words in self.templates:
                for low, high, differences in places_of(words, own):
                    raw = " ".join(own[low:high]).encode()
                    alone = len(self.plain.compress(raw))
                    saved = alone - len(c.compress(raw))
                    ranked.append((-saved, differences, name, low, high, saved / alone, len(words)))
            taken = [False] * len(own)
            for _, differences, name, low, high, share, n in sorted(ranked):
                if not any(taken[low:high]):
                    taken[low:high] = [True] * (high - low)
                    yield name, begins[first + low], ends[first + high - 1], round(share, 6), n, differences


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per notice: doc_id, license, begin, end (characters), saved, template_words, differences."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in scanner.scan(text)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "license", "begin", "end", "saved", "template_words", "differences"]
            )

    return docs.where(F.col("text").rlike(CUE)).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license string, begin long, end long, saved double, template_words long, differences long"
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
