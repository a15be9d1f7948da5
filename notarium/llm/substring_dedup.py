"""Substring dedup: remove every word covered by a window of words that also occurs elsewhere.

Difference-cover anchors: modulo ``PERIOD`` every difference of two positions is a difference
of two members of ``COVER``.  So of two equal windows of ``WINDOW`` words, some anchor of
``WINDOW - PERIOD + 1`` words begins at a cover position of its own document in both.  Only
anchors at cover positions are hashed and compared over the corpus; windows that hold an
anchor found twice are then extended to full windows and compared in a second round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm import shards
from notarium.llm.words import find_words, hash_spans, ragged, rolling, texts_of

WINDOW = 35
PERIOD = 21
# A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ANCHORS, _WINDOWS = 1, 2
OUT = "doc_id long, n_words long, n_removed long, kept string"


class _Chunk:
    """Words of a chunk's documents, its anchors, and what is known of them."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window, self.anchor = window, window - PERIOD + 1
        self.texts = texts_of(batch["text"])
        self.words = find_words(self.texts)
        self.hashes = hash_spans(self.texts.data, self.words.starts, self.words.ends)
        self.after = self.words.after()
        self.at = np.flatnonzero(_IN_COVER[self.words.place() % PERIOD] & (self.after >= self.anchor))
        self.anchors, self.anchor_no, self.anchor_n = np.unique(
            rolling(self.hashes, self.anchor)[self.at], return_inverse=True, return_counts=True)

    def candidates(self, known: dict, buckets: int) -> np.ndarray:
        """Windows with an anchor that occurs twice; no other window can occur twice."""
        hit = shards.answered(self.anchors, buckets, known, _ANCHORS) | (self.anchor_n > 1)
        marked = np.zeros(len(self.hashes) + PERIOD, np.int32)
        marked[self.at[hit[self.anchor_no]]] = 1
        seen = np.r_[0, np.cumsum(marked)]
        n = len(self.hashes)
        return np.flatnonzero((seen[PERIOD:PERIOD + n] > seen[:n]) & (self.after >= self.window))

    def repeats(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(rolling(self.hashes, self.window)[at], return_inverse=True, return_counts=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without words of repeated windows.

    A window is ``window`` consecutive words of one document; it is repeated if its word
    sequence starts at any other place, of the same document too.  ``kept`` is the remaining
    words joined by one space.  Words and windows are told apart by 64-bit hashes.

    A null text has no words and gives zeros and an empty ``kept``.  A text shorter than a
    window stays whole.  Rows with the same or a null id are documents of their own.  No rows
    give no rows.  Other columns aren't read.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs at least {PERIOD} words")
    table = shards.store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "words")
    buckets = shards.bucket_count(table)

    def ask_anchors(shard: int, chunk: int, batch: pa.RecordBatch, _: dict) -> Iterator[dict]:
        c = _Chunk(batch, window)
        low = c.anchors.astype("<u4")
        yield shards.questions(shard, chunk, _ANCHORS, c.anchors, buckets, lambda b, e: low[b:e].tobytes())

    def ask_windows(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        c = _Chunk(batch, window)
        hashes, _, _ = c.repeats(c.candidates(known, buckets))
        yield shards.questions(shard, chunk, _WINDOWS, hashes, buckets, lambda b, e: hashes[b:e].tobytes())

    def cut(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        c = _Chunk(batch, window)
        at = c.candidates(known, buckets)
        hashes, number, count = c.repeats(at)
        hit = (shards.answered(hashes, buckets, known, _WINDOWS) | (count > 1))[number]
        change = np.zeros(len(c.hashes) + window + 1, np.int32)
        np.add.at(change, at[hit], 1)
        np.add.at(change, at[hit] + window, -1)
        removed = np.cumsum(change)[:len(c.hashes)] > 0
        gone = np.r_[0, np.cumsum(removed)][c.words.firsts]
        yield {"doc_id": batch["doc_id"], "n_words": c.words.counts(), "n_removed": np.diff(gone),
               "kept": _joined(c, ~removed)}

    asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask_anchors)
    first = shards.kept(shards.answer(asked, shards.repeated("<u4")), "answers")
    asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask_windows, first)
    second = shards.answer(asked, shards.repeated("<u8"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return shards.visit(table, schema, OUT, cut, shards.union_answers(first, second))


def _joined(c: _Chunk, keep: np.ndarray) -> list[str]:
    """Kept words of each document, joined by one space."""
    starts = c.words.starts[keep]
    sizes = c.words.ends[keep] - starts + 1
    out = np.append(c.texts.data, np.uint8(0))[ragged(starts, sizes)]
    ends = np.cumsum(sizes)
    out[ends - 1] = 0x20
    edges = np.r_[0, ends][np.r_[0, np.cumsum(keep)][c.words.firsts]]
    whole = out.tobytes()
    return [whole[a:max(a, b - 1)].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
