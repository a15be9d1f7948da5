"""License scans: which known notices a document holds, and where.

Texts and templates become word shingles.  For a template of m shingles, a document is cut
into windows of 1.5 m shingles, one every m / 2, so that an occurrence lies whole in some
window.  Windows that share a MinHash band with the template are retrieved: with ``BANDS``
bands of ``ROWS`` values, a window that holds four fifths of the template (a Jaccard
similarity of 0.47 or more) is found with a probability of 0.997, an exact copy (0.66) with more
than 0.9999.  Retrieved windows are verified by the exact share of the template's shingles
that they hold.

A band can only collide if the window and the template have a shingle in common, so windows
without one are passed over before any hash is computed; no match is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.memory import lean
from notarium.llm.shards import cut_batch
from notarium.llm.words import U64, Texts, find_words, hash_spans, mix, rolling, texts_of

SHINGLE = 3
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8

# Short forms of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_PLAIN = np.full(256, 0x20, np.uint8)
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    _PLAIN[_low:_high + 1] = np.arange(_low, _high + 1)
_PLAIN[65:91] = np.arange(97, 123)


def word_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash at each word (0 where none fits) and the first word of each text.

    A word is a run of letters and digits; ASCII capitals are lowered, punctuation separates.
    """
    plain = Texts(_PLAIN[texts.data], texts.offsets)
    words = find_words(plain)
    hashes = rolling(hash_spans(plain.data, words.starts, words.ends), SHINGLE) | U64(1)
    return np.where(words.after() >= SHINGLE, hashes, U64(0)), words.firsts


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` least values of a set of shingles under different mixings."""
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    return mix(shingles[:, None] ^ salts[None, :]).min(axis=0)


class Template:
    """A notice with its shingles and bands."""

    def __init__(self, name: str, text: str):
        found, _ = word_shingles(texts_of(pa.array([text])))
        self.name, self.shingles = name, np.unique(found[found > 0])
        if not len(self.shingles):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.bands = min_hashes(self.shingles).reshape(BANDS, ROWS)
        self.length = int((found > 0).sum())
        self.width, self.step = -(-3 * self.length // 2), max(1, self.length // 2)


def find_notices(shingles: np.ndarray, template: Template, containment: float) -> list[tuple[int, int, float]]:
    """(first word, word after the last, share of the template) of its occurrences in one text."""
    hit = np.isin(shingles, template.shingles)
    if not hit.any():
        return []
    at = np.flatnonzero(hit)
    # Windows i * step .. i * step + width that hold a hit.
    low = np.maximum(0, (at - template.width) // template.step + 1)
    numbers = np.unique(np.concatenate([low + k for k in range(template.width // template.step + 1)]))
    spans: list[tuple[int, int, float]] = []
    for start in (numbers[numbers <= at[-1] // template.step] * template.step).tolist():
        window = shingles[start:start + template.width]
        own = hit[start:start + template.width]
        if not own.any():
            continue
        bands = min_hashes(window[window > 0]).reshape(BANDS, ROWS)
        if not (bands == template.bands).all(axis=1).any():
            continue
        share = len(np.unique(window[own])) / len(template.shingles)
        if share < containment:
            continue
        places = np.flatnonzero(own)
        first, last = start + int(places[0]), start + int(places[-1]) + SHINGLE
        if spans and first < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]), max(share, spans[-1][2]))
        else:
            spans.append((first, last, share))
    return spans


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template, first_word, end_word, containment): the notices of every text.

    ``containment`` is the share of a template's distinct shingles inside one window; spans of one
    template that overlap are one row.  ``template`` numbers the templates from 0.

    A null text, or one of fewer than ``SHINGLE`` words, holds nothing and gives no row.
    Repeated rows and null ids are scanned as documents of their own.  No rows give no rows.
    Other columns aren't read.
    """
    known = [Template(name, text) for name, text in templates]
    anywhere = np.unique(np.concatenate([t.shingles for t in known]))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
                        ("end_word", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batch(whole):
                shingles, firsts = word_shingles(texts_of(batch["text"]))
                slot = np.minimum(np.searchsorted(anywhere, shingles), len(anywhere) - 1)
                some = np.flatnonzero(np.diff(np.r_[0, np.cumsum(anywhere[slot] == shingles)][firsts]))
                rows = []
                for i in some.tolist():
                    doc_id = batch["doc_id"][i].as_py()
                    for number, template in enumerate(known):
                        for first, end, share in find_notices(shingles[firsts[i]:firsts[i + 1]], template, containment):
                            rows.append((doc_id, template.name, number, first, end, share))
                columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, license string, template int, first_word long, end_word long, containment double")
