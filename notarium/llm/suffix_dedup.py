"""Suffix-array dedup: remove every byte of a string that also starts in an earlier document.

Suffixes are only ever compared where a repeat is possible.  Each window of ``LENGTH`` bytes
is tied to its anchor, the ``ANCHOR``-byte string with the least hash in it (the leftmost of
equals), so equal windows have equal anchors at the same place.  A first round finds the
anchors that occur more than once in the corpus; windows that hold any other anchor are
unique.  For the rest, each chunk of documents sends the stretch of text around an anchor to
a bucket of the anchor's hash.

In a bucket the chunks' stretches are merged as Burrows-Wheeler transforms are: the interleave
starts as one chunk after the other, and is refined by one stable counting pass for each
further byte to the left, so that after the pass for a column the rows are in the order of
their suffixes from that column on.  No suffix is sorted anew.  Neighbours of that order that
agree over ``LENGTH`` bytes form a repeated interval; all its rows but those of its smallest
document id are repeats.  As all rows of a bucket are aligned at their anchor, a column of
rows plays the part of the whole transform, and only aligned suffixes need an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from notarium.llm import shards
from notarium.llm.words import U64, Texts, byte_values, mix, powers, ragged, rolling, texts_of

LENGTH = 50
ANCHOR = 24
SPAN = LENGTH - ANCHOR + 1
ROW = LENGTH + SPAN - 1
OUTSIDE = 0xFF  # never a byte of UTF-8
BLOCK = 1 << 18
NO_ID = np.iinfo(np.int64).max

_ANCHORS, _ROWS = 1, 2


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values; the result is shorter by ``width - 1``."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def whole_windows(texts: Texts) -> np.ndarray:
    """True where a window of ``LENGTH`` bytes fits into the document."""
    fits = np.ones(len(texts.data), bool)
    ends = texts.offsets[1:]
    size = np.minimum(np.diff(texts.offsets), LENGTH - 1)
    fits[ragged(ends - size, size)] = False
    return fits


def find_anchors(texts: Texts, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows, in order."""
    places, hashes = [], []
    n = len(texts.data)
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK + LENGTH - 1)
        if end - begin < LENGTH:
            break
        h = rolling(byte_values(texts.data[begin:end]), ANCHOR)[:end - begin - ANCHOR + 1]
        top = (h >> U64(32)).astype(np.uint32)
        least = _sliding(top, SPAN, np.minimum)
        least[~fits[begin:begin + len(least)]] = 0
        pad = np.zeros(SPAN - 1, np.uint32)
        over = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
        some = _sliding(np.concatenate([pad, fits[begin:begin + len(least)], pad]), SPAN, np.maximum)
        at = np.flatnonzero((over == top) & some.astype(bool))
        places.append(at + begin)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


class _Chunk:
    """Anchors of a chunk's documents and the stretches around those that occur twice."""

    def __init__(self, batch: pa.RecordBatch):
        self.texts = texts_of(batch["text"])
        self.ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.fits = whole_windows(self.texts)
        self.at, self.hash = find_anchors(self.texts, self.fits)
        # An anchor has the least hash of its windows, so these hashes crowd at the low end; buckets go by them spread out again.
        self.anchors, self.number, self.count = np.unique(mix(self.hash), return_inverse=True, return_counts=True)

    def stretch(self, known: dict, buckets: int) -> None:
        """Rows of bytes around the anchors of all windows that may be repeated.

        Sets ``anchor`` (place), ``low`` and ``high`` (first and last window of the row),
        ``rows``, and the grouping of equal rows: ``order``, ``group``, ``first``.
        """
        data, n = self.texts.data, len(self.texts.data)
        hit = (shards.answered(self.anchors, buckets, known, _ANCHORS) | (self.count > 1))[self.number]
        marked = np.zeros(n + SPAN, np.int32)
        marked[self.at[hit]] = 1
        seen = np.r_[0, np.cumsum(marked, dtype=np.int32)]
        windows = np.flatnonzero(self.fits & (seen[SPAN:SPAN + n] > seen[:n]))
        best = np.searchsorted(self.at, windows)
        top = np.append((self.hash >> U64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
        place = np.append(self.at, np.iinfo(np.int64).max)
        nxt, live = best + 1, np.arange(len(windows))
        while len(live):
            live = live[place[np.minimum(nxt[live], len(self.at))] <= windows[live] + SPAN - 1]
            better = live[top[nxt[live]] < top[best[live]]]
            best[better] = nxt[better]
            nxt[live] += 1
        tied = hit[best] if len(best) else np.zeros(0, bool)
        windows, best = windows[tied], best[tied]
        edge = np.flatnonzero(np.r_[True, np.diff(best) > 0]) if len(best) else np.zeros(0, np.int64)
        self.anchor = self.at[best[edge]]
        self.low = windows[edge]
        self.high = windows[np.r_[edge[1:], len(windows)] - 1] if len(edge) else self.low
        hashes = mix(self.hash[best[edge]])
        self.doc = np.searchsorted(self.texts.offsets, self.low, side="right") - 1
        self.rows = np.full((len(edge), ROW), OUTSIDE, np.uint8)
        if len(edge):
            for b in range(0, len(edge), 1 << 12):
                cells = self.anchor[b:b + (1 << 12), None] - (SPAN - 1) + np.arange(ROW)
                inside = (cells >= self.low[b:b + (1 << 12), None]) & (cells < self.high[b:b + (1 << 12), None] + LENGTH)
                self.rows[b:b + (1 << 12)][inside] = data[cells[inside]]
        key = _row_hash(self.rows)
        ids = self.ids[self.doc] if len(edge) else np.zeros(0, np.int64)
        self.order = np.lexsort((ids, key, hashes))
        key, hashes = key[self.order], hashes[self.order]
        new = np.r_[True, (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])] if len(edge) else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.hashes = hashes[self.first]
        self.owner = ids[self.order][self.first]
        self.later = ids[self.order] > self.owner[self.group]

    def blob(self, b: int, e: int) -> bytes:
        pick = self.order[self.first[b:e]]
        return zstandard.compress(self.owner[b:e].astype("<i8").tobytes() + self.rows[pick].tobytes(), 3)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    factor, out = powers(ROW), np.zeros(len(rows), U64)
    for b in range(0, len(rows), 1 << 12):
        out[b:b + (1 << 12)] = (byte_values(rows[b:b + (1 << 12)]) * factor).sum(axis=1, dtype=np.uint64)
    return mix(out)


def merge_rows(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each row, the bits of those columns whose window also occurs in a row of a smaller owner."""
    bits = np.zeros(len(rows), np.uint32)
    order = np.arange(len(rows))
    columns = np.ascontiguousarray(rows.T)
    for c in range(ROW - 1, -1, -1):
        order = order[np.argsort(columns[c][order], kind="stable")]
        if c >= SPAN:
            continue
        live = order[(columns[c][order] != OUTSIDE) & (columns[c + LENGTH - 1][order] != OUTSIDE)]
        if len(live) < 2:
            continue
        equal = np.ones(len(live) - 1, bool)
        for k in range(c, c + LENGTH):  # most neighbours differ soon, so few stay
            at = np.flatnonzero(equal)
            if not len(at):
                break
            equal[at] = columns[k][live[at]] == columns[k][live[at + 1]]
        starts = np.flatnonzero(np.r_[True, ~equal])
        least = np.repeat(np.minimum.reduceat(owner[live], starts), np.diff(np.r_[starts, len(live)]))
        bits[live[owner[live] > least]] |= np.uint32(1 << c)
    return bits


def _merged(blobs: list[bytes]) -> list[bytes | None]:
    parts = [zstandard.decompress(b) for b in blobs]
    sizes = [len(p) // (8 + ROW) for p in parts]
    owner = np.concatenate([np.frombuffer(p, "<i8", n) for p, n in zip(parts, sizes, strict=True)])
    rows = np.concatenate([np.frombuffer(p, np.uint8, offset=8 * n).reshape(n, ROW) for p, n in zip(parts, sizes, strict=True)])
    del parts
    bits = merge_rows(rows, owner)
    edges = np.cumsum([0, *sizes])
    return [zstandard.compress(bits[a:b].tobytes(), 3) if bits[a:b].any() else None
            for a, b in zip(edges[:-1], edges[1:], strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept[, carried, text]): documents without repeated strings.

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a
    smaller id; strings are judged on the input.  ``kept`` is the remaining bytes; a cut may
    run through a character.  ``n_spans`` counts maximal removed runs.  ``carry`` names
    columns to be handed through in the struct ``carried``, and adds ``text``: the text, after
    a removal ``kept`` without the bytes of characters that a cut runs through.  Anchors are told apart by 64-bit
    hashes only to find candidates; windows are compared by their bytes.

    A null text is empty: zeros and empty ``kept``.  A text shorter than ``LENGTH`` stays
    whole.  Rows with equal ids don't remove each other's bytes; a null id counts as larger
    than all.  No rows give no rows.
    """
    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if carry:
        chosen.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    docs = docs.select(*chosen)
    table = shards.store(docs, "bytes")
    buckets = shards.bucket_count(table)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept", pa.binary())]
    out = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    if carry:
        out = out.add("carried", docs.schema["carried"].dataType)
        out = out.add("text", "string")
        fields.append(("carried", to_arrow_type(docs.schema["carried"].dataType)))
        fields.append(("text", pa.string()))
    schema = pa.schema(fields)

    def ask_anchors(shard: int, chunk: int, batch: pa.RecordBatch, _: dict) -> Iterator[dict]:
        c = _Chunk(batch)
        low = c.anchors.astype("<u4")
        yield shards.questions(shard, chunk, _ANCHORS, c.anchors, buckets, lambda b, e: low[b:e].tobytes())

    def ask_rows(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        c = _Chunk(batch)
        c.stretch(known, buckets)
        yield shards.questions(shard, chunk, _ROWS, c.hashes, buckets, c.blob)

    def cut(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        c = _Chunk(batch)
        c.stretch(known, buckets)
        bits = np.zeros(len(c.hashes), np.uint32)
        for bucket, b, e in shards.bucket_runs(c.hashes, buckets):
            if (blob := known.get((_ROWS, bucket))) is not None:
                bits[b:e] = np.frombuffer(zstandard.decompress(blob), "<u4")
        mine = bits[c.group] if len(c.group) else bits
        mine = np.where(c.later, np.uint32(0xFFFFFFFF), mine)
        anchor, low, high = (x[c.order] for x in (c.anchor, c.low, c.high))
        n = len(c.texts.data)
        change = np.zeros(n + 1, np.int32)
        for column in range(SPAN):
            at = anchor - (SPAN - 1) + column
            at = at[((mine >> np.uint32(column)) & np.uint32(1)).astype(bool) & (at >= low) & (at <= high)]
            change[at] += 1
            change[at + LENGTH] -= 1
        gone = np.cumsum(change[:n]) > 0
        edge = np.zeros(n + 1, bool)
        edge[c.texts.offsets] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:n]
        kept = c.texts.data[~gone].tobytes()
        to = np.r_[0, np.cumsum(~gone)][c.texts.offsets]
        row = {"doc_id": batch["doc_id"], "n_bytes": np.diff(c.texts.offsets),
               "n_removed": np.diff(np.r_[0, np.cumsum(gone)][c.texts.offsets]),
               "n_spans": np.diff(np.r_[0, np.cumsum(begins)][c.texts.offsets]),
               "kept": [kept[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]}
        if carry:
            row["carried"] = batch["carried"]
            # A text that stays whole is handed on as it was, null or not.
            row["text"] = [b.decode("utf-8", "ignore") if n else t
                           for b, n, t in zip(row["kept"], row["n_removed"].tolist(), batch["text"].to_pylist(), strict=True)]
        yield row

    asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask_anchors)
    first = shards.kept(shards.answer(asked, shards.repeated("<u4")), "answers")
    asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask_rows, first)
    second = shards.answer(asked, _merged)
    return shards.visit(table, schema, out, cut, shards.union_answers(first, second))
