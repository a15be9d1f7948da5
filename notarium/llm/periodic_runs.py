"""Runs of words that repeat with a period, found from maximal pairs.

A run is a longest stretch of a document's words in which words ``period`` apart are equal, at
least twice as long as its smallest period and at least ``LEAST`` words long.

* **Suffixes.** The words of a chunk's documents are numbered and their suffixes are sorted by
  doubling: after k rounds suffixes are told apart by their first 2^k words.  What two neighbours
  of the order have in common follows from the rounds they stayed together in.
* **Maximal pairs.** The order is read once with a stack of open LCP intervals, deepest closed
  first.  Each interval keeps the places of its suffixes in order, every place with the class of
  the word on its left, and the shorter list is always merged into the longer one.  Two places
  that meet in an interval of depth d come from different children, so they agree on d words and
  on no more; if their left words differ as well, the pair is maximal.
* **Runs.** A maximal pair at distance p <= d is the stretch of p + d words from the first place:
  nothing is to be extended.  In a run of smallest period p, no place between the first two
  copies has the same d words (the run would have a smaller period), hence only neighbours in the
  merged list are looked at.  Pairs at multiples of the period give the same stretch, of which the
  smallest distance counts.

A run of ``LEAST`` words needs a pair that agrees on half of them, so documents in which no
stretch of LEAST / 2 words comes twice are passed over, and so are shallower intervals.

Runs never cross documents and depend on nothing but the document, so no row is shuffled and a
lost task is run again by itself; memory is bound by a chunk of texts of a megabyte, or by one
document where that is longer.  Null and empty texts have no words and no runs.  Repeated rows
and ids get the same answer each; further columns are kept, those named n_words, runs and
collapsed are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from notarium.llm.memory import lean
from notarium.llm.shards import cut_batch
from notarium.llm.words import Texts, Words, find_words, hash_spans, mix, ragged, rolling, texts_of

LEAST = 12
RUNS = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))
Run = tuple[int, int, int]


def numbered(texts: Texts, words: Words, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some documents, one for each different word, and each document's first."""
    counts = words.counts()[docs]
    at = ragged(words.firsts[docs], counts)
    sizes = words.ends[at] - words.starts[at]
    spelled = np.ascontiguousarray(texts.data[ragged(words.starts[at], sizes)])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def with_repeats(texts: Texts, words: Words, width: int) -> np.ndarray:
    """Documents in which a stretch of ``width`` words comes twice (by hashes: now and then one more)."""
    hashes = rolling(hash_spans(texts.data, words.starts, words.ends), width)
    doc = np.repeat(np.arange(len(texts)), words.counts())
    whole = words.after() >= width
    doc, hashes = doc[whole], hashes[whole]
    ordered = np.sort(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    again = np.zeros(len(texts), bool)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        mine = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
        at = np.minimum(np.searchsorted(twice, mine), len(twice) - 1)
        again[doc[twice[at] == mine]] = True
    return np.flatnonzero(again)


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first symbol with another one, in order, and what each shares with the one before.

    Every document ends with a symbol of its own, so no two suffixes are equal and none agrees
    beyond an end.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    # A suffix's rank is the place where its group begins; groups only ever split.
    rank[order] = _begins(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rounds, width = [rank.copy()], 1
    mates = np.flatnonzero(_shared(rank[order]))
    slots = mates
    while len(slots):
        suffixes = order[slots]
        head, tail = rank[suffixes], rank[np.minimum(suffixes + width, n)]
        by = np.lexsort((tail, head))
        suffixes, head, tail = suffixes[by], head[by], tail[by]
        order[slots] = suffixes
        new_group = np.concatenate([[True], head[1:] != head[:-1]])
        split = new_group | np.concatenate([[True], tail[1:] != tail[:-1]])
        at = np.arange(len(slots))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_split = np.maximum.accumulate(np.where(split, at, 0))
        rank[suffixes] = head + first_of_split - first_of_group
        width *= 2
        rounds.append(rank.copy())
        slots = slots[_shared(rank[suffixes])]
    sa = order[mates]
    shared = np.zeros(len(sa), np.int64)
    if len(sa):
        left, right = sa[:-1], sa[1:]
        both = np.zeros(len(sa) - 1, np.int64)
        for k in range(len(rounds) - 1, -1, -1):
            known = rounds[k]
            same = known[np.minimum(left + both, n)] == known[np.minimum(right + both, n)]
            both += np.where(same, 1 << k, 0)
        shared[1:] = both
    return sa, shared


def _begins(starts: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    out = np.zeros(len(sorted_ranks), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _merge(one: list[int], other: list[int], depth: int, left: list[int], runs: dict, least: int) -> list[int]:
    """The places of two children together; maximal pairs among them that are runs go to ``runs``."""
    many, few = (one, other) if len(one) >= len(other) else (other, one)
    for place in few:
        at = bisect_left(many, place)
        for first, second in (((many[at - 1], place),) if at else ()) + (((place, many[at]),) if at < len(many) else ()):
            period = second - first
            if period <= depth and period + depth >= least and left[first] != left[second]:
                stretch = (first, period + depth)
                if runs.get(stretch, period) >= period:
                    runs[stretch] = period
    if len(few) * 8 < len(many):
        for place in few:
            many.insert(bisect_left(many, place), place)
    else:
        many.extend(few)
        many.sort()
    return many


def runs_of_intervals(suffixes: list[int], shared: list[int], left: list[int], least: int, shallow: int, runs: dict) -> None:
    """Bottom-up over the LCP intervals of suffixes that all share at least ``shallow`` symbols."""
    open_: list[list] = []  # depth and places, deepest last
    for k, place in enumerate(suffixes, 1):
        depth = shared[k] if k < len(suffixes) else shallow - 1
        places = [place]
        while open_ and open_[-1][0] > depth:
            closed, mates = open_.pop()
            places = _merge(mates, places, closed, left, runs, least)
        if open_ and open_[-1][0] == depth:
            open_[-1][1] = _merge(open_[-1][1], places, depth, left, runs, least)
        else:
            open_.append([depth, places])


def runs_of_documents(symbols: np.ndarray, firsts: np.ndarray, least: int = LEAST) -> list[list[Run]]:
    """(start, length, period) of the runs of each document, by start, then period.

    ``symbols`` are word numbers of all documents, ``firsts`` where each document begins.
    """
    counts = np.diff(firsts)
    if not len(counts):
        return []
    shallow = -(-least // 2)
    # Each document has word numbers of its own and an end of its own.
    doc = np.repeat(np.arange(len(counts)), counts)
    stride = int(symbols.max(initial=0)) + 2
    text = np.empty(len(symbols) + len(counts), np.int64)
    places = np.arange(len(symbols)) + doc
    begins = firsts[:-1] + np.arange(len(counts))
    text[places] = doc * stride + symbols + 1
    text[begins + counts] = np.arange(len(counts)) * stride
    suffixes, shared = suffix_order(text)
    left = np.concatenate([text[-1:], text[:-1]]).tolist()
    # Stretches of the order in which neighbours share enough for a run.
    deep = np.concatenate([shared[1:] >= shallow, [False]]) if len(shared) else np.zeros(0, bool)
    edges = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
    runs: dict[tuple[int, int], int] = {}
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        runs_of_intervals(suffixes[a:b + 1].tolist(), shared[a:b + 1].tolist(), left, least, shallow, runs)
    out: list[list[Run]] = [[] for _ in counts]
    owner = np.searchsorted(begins, np.array([s for s, _ in runs], np.int64), side="right") - 1
    for d, ((start, length), period) in zip(owner.tolist(), runs.items(), strict=True):
        out[d].append((start - int(begins[d]), length, period))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Words behind the first period of any run."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def joined(texts: Texts, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, one space between them."""
    at = np.flatnonzero(kept)
    sizes = words.ends[at] - words.starts[at] + 1
    data = texts.data[np.minimum(ragged(words.starts[at], sizes), max(len(texts.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes)
    if len(at):
        data[ends - 1] = 32
    # Each document's last space is left out.
    per_doc = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.firsts])
    last = np.cumsum(per_doc)[per_doc > 0] - 1
    solid = np.ones(len(data), bool)
    solid[ends[last] - 1] = False
    totals = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_doc)])]
    offsets = totals - np.concatenate([[0], np.cumsum(per_doc > 0)])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[solid]))])


def _answers(column: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    texts = texts_of(column)
    words = find_words(texts)
    docs = with_repeats(texts, words, -(-least // 2))
    symbols, firsts = numbered(texts, words, docs)
    runs: list[list[Run]] = [[] for _ in range(len(texts))]
    kept = np.ones(len(words.starts), bool)
    for d, found in zip(docs.tolist(), runs_of_documents(symbols, firsts, least), strict=True):
        runs[d] = found
        a, b = int(words.firsts[d]), int(words.firsts[d + 1])
        kept[a:b] = ~dropped(found, b - a)
    flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
    ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
    return pa.array(words.counts().astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), items), joined(texts, words, kept)


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text with each run cut down to its first period, words joined by a space.
    """
    new = {"n_words": LongType(), "runs": RUNS, "collapsed": StringType()}
    schema = StructType([f for f in docs.schema.fields if f.name not in new])
    carried = list(schema.names)
    for name, kind in new.items():
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch):
                counts, runs, collapsed = _answers(part.column(part.schema.get_field_index(text)), least)
                columns = [part.column(part.schema.get_field_index(c)) for c in carried] + [counts, runs, collapsed]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(lean(answers), schema)
