"""Packing documents into token sequences of at most ``SEQUENCE`` tokens.

Bounded-space online packing: each partition holds ``OPEN`` open windows.  A document gives
full windows while it is long enough; its rest goes into the open window that it fills best.
When it fits into none, the fullest window is emitted and a new one opened.  What is open at
the end of a partition is merged with that of other partitions, ``MERGE`` partitions to a
group: the leftover pieces are laid end to end and cut at full sequences, so that each group
pads one sequence at most.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.bpe import Encoder
from notarium.llm.memory import lean
from notarium.llm.shards import cut_batch
from notarium.llm.words import texts_of
from notarium.session import materialise

SEQUENCE = 4096
OPEN = 64
MERGE = 8
END_ID = 2

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.binary()),
           ("part", pa.int32())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "tokens binary, part int")


class _Pieces:
    """Rows of output by column."""

    def __init__(self, part: int):
        self.part, self.columns = part, [[] for _ in _FIELDS]

    def add(self, doc_id, start: int, tokens: bytes, doc_tokens: int, sequence: int | None, offset: int) -> None:
        row = (doc_id, start, len(tokens) // 4, zlib.crc32(tokens), doc_tokens, sequence, offset, tokens, self.part)
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.columns, _FIELDS, strict=True)], schema=_SCHEMA)
        self.columns = [[] for _ in _FIELDS]
        return out


class Packer:
    """The open windows of one partition.  ``emit(sequence, pieces)`` gets each closed window."""

    def __init__(self, out: _Pieces, first_sequence: int, size: int = SEQUENCE, windows: int = OPEN):
        self.out, self.next, self.size, self.windows = out, first_sequence, size, windows
        self.gaps: list[tuple[int, int]] = []  # (free tokens, window), in order
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.size * 4
        full = len(ids) // step * step
        for at in range(0, full, step):
            self.out.add(doc_id, at // 4, ids[at:at + step], total, self._sequence(), 0)
        if full < len(ids):
            self._place((doc_id, full // 4, ids[full:], total))

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, piece: tuple) -> None:
        need = len(piece[2]) // 4
        at = bisect.bisect_left(self.gaps, (need, -1))
        if at == len(self.gaps):
            if len(self.gaps) >= self.windows:
                self._emit(self.gaps.pop(0)[1])
            self.opened += 1
            window, gap = self.opened, self.size
            self.held[window] = []
        else:
            gap, window = self.gaps.pop(at)
        self.held[window].append(piece)
        if gap == need:
            self._emit(window)
        else:
            bisect.insort(self.gaps, (gap - need, window))

    def _emit(self, window: int) -> None:
        sequence, offset = self._sequence(), 0
        for doc_id, start, tokens, total in self.held.pop(window):
            self.out.add(doc_id, start, tokens, total, sequence, offset)
            offset += len(tokens) // 4

    def leave(self) -> None:
        """Hand out what is still open, without a sequence."""
        for _, window in self.gaps:
            for doc_id, start, tokens, total in self.held.pop(window):
                self.out.add(doc_id, start, tokens, total, None, 0)
        self.gaps = []


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
         windows: int = OPEN, merge: int = MERGE) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tokens, part).

    A document's tokens are those of its text for the vocabulary at ``path``, then ``END_ID``;
    ``tokens`` holds a piece's as little-endian 32-bit numbers.  Every token lies in one piece.
    A sequence holds at most ``size`` tokens, its pieces without gaps from offset 0.

    A null or empty text gives the end token alone.  Repeated rows and null ids are packed as
    documents of their own; a document longer than a sequence is cut.  No rows give no rows.
    Other columns aren't read.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, out = Encoder(path), _Pieces(part)
        packer = Packer(out, part << 33, size, windows)
        for batch in batches:
            for chunk in cut_batch(batch):
                ids, offsets = encoder.encode(texts_of(chunk["text"]))
                ids = np.insert(ids, offsets[1:], END_ID).astype("<u4").tobytes()
                edges = ((offsets + np.arange(len(offsets))) * 4).tolist()
                for doc_id, a, b in zip(chunk["doc_id"].to_pylist(), edges[:-1], edges[1:], strict=True):
                    packer.add(doc_id, ids[a:b])
                yield out.batch()
        packer.leave()
        yield out.batch()

    def merged(table: pa.Table) -> pa.Table:
        rows = table.select(["part", "doc_id", "start", "tokens", "doc_tokens"]).to_pylist()
        rows.sort(key=lambda r: (r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["tokens"]))
        group = rows[0]["part"] // merge
        out, sequence, offset = _Pieces(group), (1 << 62) + (group << 33), 0
        for r in rows:
            tokens, start = r["tokens"], r["start"]
            while tokens:
                take = min(len(tokens), (size - offset) * 4)
                out.add(r["doc_id"], start, tokens[:take], r["doc_tokens"], sequence, offset)
                offset, start, tokens = offset + take // 4, start + take // 4, tokens[take:]
                if offset == size:
                    sequence, offset = sequence + 1, 0
        return pa.Table.from_batches([out.batch()])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialise(rows.mapInArrow(lean(place), _DDL), "packed")
    left = placed.filter("sequence_id IS NULL").withColumn("group", F.expr(f"part div {merge}"))
    tail = left.groupBy("group").applyInArrow(lambda t: merged(t.drop_columns(["group"])), _DDL)
    return placed.filter("sequence_id IS NOT NULL").unionByName(tail)
