"""BPE encoding and decoding of whole columns, after a public vocabulary file.

Forced-boundary splitting: two neighbouring bytes that no token of the vocabulary holds side
by side can never end up in one token.  Every word is cut there, the fragments are merged on
their own, and their tokens are put together again; the result is that of the whole word.

Words repeat, so a batch looks at each different word once.  All its fragments are merged at
the same time as arrays: in each round every fragment merges its leftmost pair of least rank.
Fragments of many symbols use a heap instead, so that a text without blanks stays cheap.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.memory import lean
from notarium.llm.shards import cut_batch
from notarium.llm.words import Texts, find_words, hash_spans, lists, ragged, texts_of

NONE = np.int64(1) << 40
LONG = 256
CACHED_WORDS = 300_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file with word ends, as arrays; also decodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.base = len(ids) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = made
        self.together = np.zeros((256, 256), bool)
        for token in ids:
            raw = [byte_of[c] for c in token.removesuffix(end) if c in byte_of]
            self.together[raw[:-1], raw[1:]] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        parts = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.token_size = np.array([len(p) for p in parts])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_of = byte_of

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; ``NONE`` if it has none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Token texts joined by a space, as a vocabulary without a decoder reads."""
        sizes = self.token_size[ids]
        whole = self.token_bytes[ragged(self.token_start[ids], sizes)].tobytes()
        edges = np.r_[0, np.cumsum(sizes)][offsets].tolist()
        return [whole[a:max(a, b - 1)].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """One fragment of many symbols: pairs wait in a heap by rank, then place."""
    ids = list(symbols)
    nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    ranks = v.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def push(i: int) -> None:
        j = nxt[i]
        if j < len(ids):
            pair = ids[i], ids[j]
            if pair not in known:
                known[pair] = int(v.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = int(v.made[r]), -1
        nxt[i] = nxt[j]
        if nxt[i] < len(ids):
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [x for x in ids if x >= 0]


def _merge(v: Vocabulary, symbols: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all fragments; returns their tokens and, for each token, its fragment, in order."""
    out_ids, out_of = [], []
    sizes = np.bincount(fragment) if len(fragment) else np.zeros(0, np.int64)
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        starts = np.cumsum(sizes) - sizes
        for f in long.tolist():
            ids = _merge_long(v, symbols[starts[f]:starts[f] + sizes[f]].tolist())
            out_ids.append(np.array(ids, np.int64))
            out_of.append(np.full(len(ids), f))
        rest = sizes[fragment] <= LONG
        symbols, fragment = symbols[rest], fragment[rest]
    symbols = symbols.copy()
    rank = np.full(len(symbols), NONE)
    if len(symbols) > 1:
        inside = fragment[1:] == fragment[:-1]
        at = np.flatnonzero(inside)
        rank[at] = v.rank(symbols[at], symbols[at + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        best = np.minimum.reduceat((rank << 22) | np.arange(len(symbols)) if len(symbols) < 1 << 22
                                   else _wide(rank), starts)
        least = best >> 22
        over = least >= NONE
        if over.any():
            gone = np.repeat(over, np.diff(np.r_[starts, len(symbols)]))
            out_ids.append(symbols[gone])
            out_of.append(fragment[gone])
            if over.all():
                break
        at = (best & ((1 << 22) - 1))[~over]
        symbols[at] = v.made[least[~over]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        if over.any():
            keep &= ~gone
        moved = np.cumsum(keep)[at] - 1
        symbols, fragment, rank = symbols[keep], fragment[keep], rank[keep]
        for i in (moved, moved[moved > 0] - 1):
            j = np.minimum(i + 1, len(symbols) - 1)
            joined = (j > i) & (fragment[i] == fragment[j])
            rank[i] = np.where(joined, v.rank(symbols[i], symbols[j]), NONE)
    if not out_ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, of = np.concatenate(out_ids), np.concatenate(out_of)
    order = np.argsort(of, kind="stable")
    return ids[order], of[order]


def _wide(rank: np.ndarray) -> np.ndarray:
    raise ValueError("too many symbols in one batch")


def merge_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words given as byte spans that follow each other, and tokens per word."""
    ids, counts, at = [], [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 21), side="right")))
        a, b = starts[at], ends[to - 1]
        part = data[a:b]
        cut = np.zeros(len(part), bool)
        cut[1:] = ~v.together[part[:-1], part[1:]]
        cut[starts[at:to] - a] = True
        symbols = v.inner[part]
        symbols[ends[at:to] - a - 1] = v.final[part[ends[at:to] - a - 1]]
        fragment = np.cumsum(cut) - 1
        if len(symbols) >= 1 << 22:  # a single word this long has few fragments; each goes alone
            got = [np.array(_merge_long(v, s.tolist()), np.int64) for s in np.split(symbols, np.flatnonzero(cut)[1:])]
            ids.append(np.concatenate(got))
            counts.append(np.array([len(ids[-1])]))
        else:
            tokens, of = _merge(v, symbols, fragment)
            word = np.cumsum(np.bincount(starts[at:to] - a, minlength=len(part)))[np.flatnonzero(cut)] - 1
            ids.append(tokens)
            counts.append(np.bincount(word[of], minlength=to - at))
        at = to
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(counts)


class Encoder:
    """Encodes batches of texts; keeps the tokens of at most ``CACHED_WORDS`` different words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and the offset of each text's first."""
        words = find_words(texts)
        hashes = hash_spans(texts.data, words.starts, words.ends)
        unique, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(unique) > CACHED_WORDS:
            self._forget()
        keys = unique.tolist()
        slot = np.array([self.slots.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            starts, ends = words.starts[first[new]], words.ends[first[new]]
            ids, counts = self._chunks(texts.data, starts, ends)
            slot[new] = len(self.start) + np.arange(len(new))
            self.slots.update(zip((keys[i] for i in new.tolist()), slot[new].tolist(), strict=True))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(counts) - counts]
            self.size = np.r_[self.size, counts]
            self.flat = np.r_[self.flat, ids.astype(np.int32)]
        slot = slot[number]
        sizes = self.size[slot]
        return self.flat[ragged(self.start[slot], sizes)], np.r_[0, np.cumsum(sizes)][words.firsts]

    def _chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of runs without blanks, and tokens per run."""
        sizes = ends - starts
        part = data[ragged(starts, sizes)].copy()
        begins = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(sizes)), sizes)
        before = np.r_[np.uint8(0), part[:-1]]
        before[begins] = 0
        # Plain runs: visible ASCII without apostrophes, and the composed letters of Latin-1.
        accent = (before == 0xC3) & (part >= 0x80) & (part != 0x97) & (part != 0xB7)
        lead = part == 0xC3
        plain = ((part > 0x20) & (part < 0x7F) & (part != 0x27)) | accent | lead
        plain &= ~((part == 0x7C) & (before == 0x3C))
        odd = np.zeros(len(sizes), bool)
        odd[run[~plain]] = True
        broken = lead & np.r_[part[1:] < 0x80, True]
        odd[run[broken]] = True
        after = np.r_[accent[1:], False]
        odd[run[lead & ~after]] = True
        capital = ((part >= 0x41) & (part <= 0x5A)) | (accent & (part <= 0x9E))
        part[capital] += 0x20
        letter = ((part >= 0x61) & (part <= 0x7A)) | accent | lead
        digit = (part >= 0x30) & (part <= 0x39)
        kind = np.where(letter, 1, np.where(digit, 2, 3)).astype(np.uint8)
        opens = np.r_[True, kind[1:] != kind[:-1]] | digit
        opens[begins] = True
        easy = ~odd[run]
        body = part[easy]
        word_starts = np.flatnonzero(opens[easy])
        word_ends = np.r_[word_starts[1:], len(body)]
        owner = run[easy][word_starts]
        ids, counts = merge_words(self.vocabulary, body, word_starts, word_ends)
        per_run = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
        if not odd.any():
            return ids, per_run
        hard = np.flatnonzero(odd)
        hard_ids, hard_counts = self._hard([data[starts[i]:ends[i]].tobytes().decode() for i in hard.tolist()])
        per_run[hard] = hard_counts
        out = np.empty(int(per_run.sum()), np.int64)
        at = np.cumsum(per_run) - per_run
        soft = np.flatnonzero(~odd)
        out[ragged(at[soft], per_run[soft])] = ids
        out[ragged(at[hard], per_run[hard])] = hard_ids
        return out, per_run

    def _hard(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any other run: the library normalises it and cuts it into words, and control strings are tokens."""
        import re

        special = self.vocabulary.special
        cutter = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        byte_of = self.vocabulary.byte_of
        words, pieces = [], []
        for text in runs:
            mine: list[int | None] = []
            for piece in cutter.split(text):
                if piece in special:
                    mine.append(special[piece])
                elif piece:
                    normal = self.library.normalizer.normalize_str(piece)
                    for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                        words.append(bytes(byte_of[c] for c in word))
                        mine.append(None)
            pieces.append(mine)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, counts = merge_words(self.vocabulary, data, ends - sizes, ends)
        tokens = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        out, per_run = [], []
        for mine in pieces:
            got = [np.array([m], np.int64) if m is not None else next(tokens) for m in mine]
            out += got
            per_run.append(sum(map(len, got)))
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(per_run, np.int64)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the tokens of each whole text, as the tokenizers library gives them for the
    file at ``path`` without added control tokens.

    Rows stay where they are.  A null text is an empty one and has no tokens; a text without
    words too.  Control strings inside a text become their tokens.  Repeated rows and null
    ids are kept.  Other columns aren't read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in cut_batch(batch):
                ids, offsets = encoder.encode(texts_of(part["text"]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists(ids.astype(np.int32), offsets)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the text that the library decodes the tokens to.

    A null or empty list decodes to an empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            ids = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.r_[0, np.cumsum(_sizes(ids))]
            step = max(1, batch.num_rows * (1 << 19) // max(1, len(flat)))
            for b in range(0, batch.num_rows, step):
                e = min(batch.num_rows, b + step)
                texts = vocabulary.decode(flat[sizes[b]:sizes[e]], sizes[b:e + 1] - sizes[b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(b, e - b), ids.slice(b, e - b), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def _sizes(ids: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
