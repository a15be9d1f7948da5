"""N-gram Jaccard join by PartEnum signatures, and the classes of documents that it links.

Two sets of sizes x and y with a Jaccard similarity of at least s differ in at most
(1 - s) / (1 + s) * (x + y) elements.  Sizes fall into bands, each wider by 1/s, so similar
sets lie in the same band or in neighbours; every pair meets on the *level* of its lower band,
where at most ``k`` elements differ.  On a level the feature domain is cut into more than
``k`` partitions: at most ``k`` of them can differ.  Small sets enumerate all subsets that leave
``k`` partitions out, larger ones the single partitions of ``k`` and a reserve; similar sets
share a signature, the hash of what they hold in one such subset.

Partitions that hold nothing say nothing.  If a set has more than ``k`` partitions with
elements, one of those must agree, and only they are used; a set with fewer is partitioned
anew by another function.  In the same way, signatures shared by many sets (a passage in many
documents) are only needed for sets that have at most ``k`` others (see ``_dense_links``).

Candidates are verified by exact intersection.  Sets that are equal are one class from the
start.  In a large group of near copies, each set is verified with its likeliest partners and
with a few hubs near what the group has in common.  Other pairs are verified where their ends
aren't in one component yet: those that infrequent signatures show one by one, those that
only frequent ones can show in blocks.  Before that, sets are asked which of their elements
another component holds too (see ``_linkable``): a set with too few of them can't be linked
any further and goes, so documents that merely share a passage never meet, and of a
component's sets that share the same elements with others only the smallest stays.  So no link
between components is lost, and the blocks hold only sets of which 80 % lie in other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from notarium.llm import shards
from notarium.llm.components import components
from notarium.llm.memory import lean, one_group, two_groups
from notarium.llm.words import U64, find_words, hash_spans, mix, ragged, rolling, texts_of
from notarium.session import materialise

WORDS = 5
SIMILARITY = Fraction(80, 100)
MANY = 3  # a signature of more sets links them in a line and a star, not in pairs
LIKELIEST = 3
HUBS = 8
BLOCK = 128
SUBSETS_UP_TO = 6
_CHOSEN = np.array([2, 3, 4, 3, 3, 3, 3])  # partitions in a signature, by k; as many as k allows at a fair number of subsets
FUNCTIONS = 5

_SIGNATURES, _WANTED, _HELD = 1, 2, 3
_SEVERAL = -1  # an element that several components of one chunk hold
_BOTH_LOWER, _ROLE_0, _ROLE_1, _ADJACENT = 0, 1, 2, 3
_SALT = [U64(x) for x in (0, 0x8F1BBCDC2A5D1C93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25)]


class Levels:
    """Bands of sizes and the number of differing elements on each level."""

    def __init__(self, similarity: Fraction = SIMILARITY, longest: int = 1 << 34):
        self.low, edge = [], Fraction(1)
        while edge <= longest:
            self.low.append(-(-edge.numerator // edge.denominator))
            edge /= similarity
        self.low = np.array(self.low)
        share = (1 - similarity) / (1 + similarity)
        self.k = []
        for level in range(len(self.low)):
            x = int(self.low[level]) - 1  # largest size of the lower band
            self.k.append(int(share * (x + int(x / similarity))))
        self.k = np.array(self.k)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def shingle_sets(batch: pa.RecordBatch, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and the offset of each set."""
    texts = texts_of(batch["text"]).lower()
    found = find_words(texts)
    hashes = hash_spans(texts.data, found.starts, found.ends)
    counts, after = found.counts(), found.after()
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = after >= words
    values, of = rolling(hashes, words)[whole], doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        alone = np.array([rolling(hashes[found.firsts[i]:found.firsts[i + 1]], int(counts[i]))[0] ^ U64(counts[i]) for i in short.tolist()], U64)
        values, of = np.concatenate([values, alone]), np.concatenate([of, short])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.searchsorted(of[new], np.arange(len(counts) + 1))


def set_digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 63-bit number for each set; 0 for an empty one."""
    total = np.r_[U64(0), np.cumsum(mix(values))][offsets]
    sizes = np.diff(offsets)
    digest = mix((total[1:] - total[:-1]) + sizes.astype(U64)) >> U64(1)
    return np.where(sizes > 0, np.maximum(digest, U64(1)), U64(0)).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, role) of all sets; role 0 on the level above the set's band, 1 on its own.

    Signatures of the second and later partition functions have a role larger by 2, 4, ...
    """
    sizes = np.diff(offsets)
    band = levels.band(np.maximum(sizes, 1))
    out: list[tuple] = []
    for role in (0, 1):
        level = band + 1 - role
        k = levels.k[level]
        todo = np.flatnonzero(sizes > 0)
        for turn in range(FUNCTIONS + 1):
            if not len(todo):
                break
            last = turn == FUNCTIONS
            small = todo[k[todo] <= SUBSETS_UP_TO]
            large = todo[k[todo] > SUBSETS_UP_TO]
            left = []
            for part, method in ((small, _subsets), (large, _singles)):
                if len(part):
                    sig, of, poor = method(values, offsets, part, level, k, _SALT[turn], last)
                    out.append((sig, of, np.full(len(sig), role + 2 * turn)))
                    left.append(poor)
            todo = np.concatenate(left) if left else todo[:0]
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _elements(values, offsets, sets, salt):
    """The elements of the chosen sets, salted, and which set each is of."""
    sizes = np.diff(offsets)[sets]
    if len(sets) == len(offsets) - 1:
        flat, of = values, np.repeat(sets, sizes)
    else:
        flat, of = values[ragged(offsets[sets], sizes)], np.repeat(sets, sizes)
    return (mix(flat ^ salt) if salt else flat), of


def _part(flat: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ((flat >> U64(32)) * parts.astype(U64) >> U64(32)).astype(np.int64)


def _singles(values, offsets, sets, level, k, salt, last):
    """Signatures of single partitions; the sets with too few filled partitions are handed back."""
    flat, of = _elements(values, offsets, sets, salt)
    parts = k + 4 + k // 5
    part = _part(flat, parts[of])
    if salt:
        order = np.lexsort((part, of))
        flat, of, part = flat[order], of[order], part[order]
    new = np.ones(len(flat), bool)
    new[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    total = np.add.reduceat(mix(flat), starts)
    own, part = of[starts], part[starts]
    filled = np.bincount(own, minlength=len(k))
    poor = sets[filled[sets] <= k[sets]]
    sig = mix(total + (level[own].astype(U64) << U64(40)) + part.astype(U64) + salt)
    if last:
        extra, of_extra = _empties(poor, parts, own, part, level, salt)
        return np.concatenate([sig, extra]), np.concatenate([own, of_extra]), poor[:0]
    return sig, own, poor


def _empties(poor, parts, own, part, level, salt):
    """After the last function: the empty partitions of the sets that are still poor."""
    sigs, ofs = [], []
    for s in poor.tolist():
        free = np.setdiff1d(np.arange(parts[s]), part[own == s])
        sigs.append(mix(free.astype(U64) + (level[s].astype(U64) << U64(40)) + salt))
        ofs.append(np.full(len(free), s))
    return (np.concatenate(sigs), np.concatenate(ofs)) if sigs else (np.zeros(0, U64), np.zeros(0, np.int64))


def _subsets(values, offsets, sets, level, k, salt, last):
    """Signatures of all choices of partitions that leave ``k`` out."""
    flat, of = _elements(values, offsets, sets, salt)
    row = np.zeros(len(k), np.int64)
    row[sets] = np.arange(len(sets))
    parts = k + _CHOSEN[np.minimum(k, SUBSETS_UP_TO)]
    part = _part(flat, parts[of])
    width = SUBSETS_UP_TO + int(_CHOSEN[SUBSETS_UP_TO])
    cell = row[of] * width + part
    total = np.zeros(len(sets) * width, U64)
    np.add.at(total, cell, mix(flat))
    total = mix(total.reshape(-1, width) + np.arange(1, width + 1, dtype=np.uint64)[None, :])
    filled = np.bincount(cell, minlength=len(sets) * width).reshape(-1, width) > 0
    poor = filled.sum(axis=1) <= k[sets]
    sigs, ofs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for need in np.unique(k[sets]).tolist():
        at = np.flatnonzero(k[sets] == need)
        for chosen in combinations(range(need + int(_CHOSEN[need])), int(_CHOSEN[need])):
            use = at[filled[at][:, chosen].any(axis=1) | (poor[at] & last)]
            both = total[use][:, chosen].sum(axis=1, dtype=np.uint64) + U64(sum(1 << c for c in chosen))
            sigs.append(mix(mix(both) + (level[sets[use]].astype(U64) << U64(40)) + salt))
            ofs.append(sets[use])
    return np.concatenate(sigs), np.concatenate(ofs), (sets[poor] if not last else sets[:0])


def _node(shard: int, chunk: int) -> int:
    return shard << 36 | chunk << 16


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document with the least id reachable by links.

    Two documents are linked if the Jaccard similarity of their sets of distinct word
    shingles is at least ``similarity``; A-Z are lowered.  A text of fewer than ``words``
    words is one shingle.  Shingles and sets are told apart by 64-bit hashes.

    A null text, or one without words, has size 0 and stays alone.  Rows with equal ids count
    as one document in ``component_id``, but each gives a row.  A null id gives a row whose
    component is the least id that its row is linked with, or null.  No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _classes(shards.store(rows, "sets"), words, similarity).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component.

    First is the least id, a null id last; of rows with the same id, one stays.  Rows without
    words all stay.  The chosen rows are read from where they are stored; no text is joined.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("carried"))
    table = shards.store(rows, "sets")
    last = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max))
    chosen = _classes(table, words, similarity).groupBy(F.coalesce("class", "node").alias("class")).agg(
        F.min(F.struct(last.alias("id"), "node")).alias("first")).select("first.node")
    kind = rows.schema["carried"].dataType
    schema = pa.schema([("carried", to_arrow_type(kind)), ("text", pa.string())])

    def pick(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        picked = _picked(known)
        if picked:
            yield {c: batch[c].take(pa.array(picked)) for c in ("carried", "text")}

    kept = shards.visit(table, schema, T.StructType().add("carried", kind).add("text", "string"), pick, _wanted(chosen))
    return kept.select(*((F.col("text") if c == text_col else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def _wanted(nodes: DataFrame, with_column: str | None = None) -> DataFrame:
    """Node numbers as answers for the shards that hold them; a chunk has at most 2^15 nodes."""
    number = F.expr("cast(node & 65535 as string)")
    lists = nodes.groupBy(F.shiftright("node", 36).alias("shard"), F.expr("cast(shiftright(node, 16) & 1048575 as int)").alias("chunk")).agg(
        F.array_join(F.collect_list(F.concat_ws(":", number, with_column) if with_column else number), ",").cast("binary").alias("blob"))
    return lists.select("shard", F.lit(0).alias("bucket"), "chunk", F.lit(_WANTED).alias("kind"), "blob")


def _picked(known: dict) -> list[int]:
    blob = known.get((_WANTED, 0))
    return sorted(map(int, blob.decode().split(","))) if blob else []


def _classes(table: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(node, doc_id, n, class, least) of all stored rows: class and least id of each component."""
    levels = Levels(similarity)
    buckets = shards.bucket_count(table)

    info_schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()),
                             ("need0", pa.int64()), ("need1", pa.int64())])

    def describe(shard: int, chunk: int, batch: pa.RecordBatch, _: dict) -> Iterator[dict]:
        values, offsets = shingle_sets(batch, words)
        sizes = np.diff(offsets)
        _, of, role = signatures(values, offsets, levels)
        # How many of a set's signatures may be passed over: all but k + 1 of those of a level.
        # Small sets, and sets that needed a second function, can't spare any.
        reserve = []
        for r in (0, 1):
            k = levels.k[levels.band(np.maximum(sizes, 1)) + 1 - r]
            k = np.where(k <= SUBSETS_UP_TO, NEVER, k)
            k[of[role >= 2]] = NEVER
            reserve.append(np.bincount(of[role == r], minlength=len(sizes)) - k)
        yield {"node": _node(shard, chunk) + np.arange(len(sizes)), "doc_id": batch["doc_id"],
               "digest": set_digests(values, offsets), "n": sizes, "need0": reserve[0], "need1": reserve[1]}

    def ask(shard: int, chunk: int, batch: pa.RecordBatch, _: dict) -> Iterator[dict]:
        values, offsets = shingle_sets(batch, words)
        sig, of, role = signatures(values, offsets, levels)
        # Of equal sets in the chunk, the first speaks for all.
        digests = set_digests(values, offsets)
        speaks = np.zeros(len(digests), bool)
        speaks[np.unique(digests, return_index=True)[1]] = True
        use = speaks[of]
        sig, of, role = sig[use], of[use], role[use] & 1
        order = np.argsort(sig)
        sig, tag = sig[order], (of | role << 15).astype("<u2")[order]
        low, head = sig.astype("<u4"), np.array([_node(shard, chunk)], "<i8").tobytes()
        yield shards.questions(shard, chunk, _SIGNATURES, sig, buckets,
                               lambda b, e: head + low[b:e].tobytes() + tag[b:e].tobytes())

    info = shards.kept(shards.visit(table, info_schema, "node long, doc_id long, digest long, n long, need0 long, need1 long", describe), "sets_info")
    asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask)
    met = materialise(asked.groupBy("bucket").applyInArrow(one_group(_meet), "kind int, a long, b long, c long"), "candidates")

    # How many of a set's signatures are shared by many, on each of its two levels.
    frequent = met.filter(f"kind IN ({_ROLE_0}, {_ROLE_1})").groupBy(F.col("b").alias("node")).agg(
        F.count_if(F.col("kind") == _ROLE_0).alias("many0"), F.count_if(F.col("kind") == _ROLE_1).alias("many1"))
    same = info.filter("n > 0").groupBy("digest").agg(F.min("node").alias("rep"))
    info = materialise(info.join(same, "digest", "left").join(frequent, "node", "left").fillna(0, ["many0", "many1"]), "sets_info")
    few = materialise(met.filter(f"kind IN ({_BOTH_LOWER}, {_ADJACENT})").groupBy("kind", "a", "b").agg(F.sum("c").alias("c")), "counted")
    held = materialise(met.filter(f"kind IN ({_ROLE_0}, {_ROLE_1})").groupBy(F.col("b").alias("node"), F.col("kind").alias("role")).agg(
        F.collect_list("a").alias("sigs")), "frequent")
    best = Window.partitionBy("b").orderBy(F.desc("c"), "a")
    pairs = materialise(_possible(few, info, held, similarity).withColumn("place", F.row_number().over(best)), "pairs")

    # First each set's likeliest partners and the hubs of its frequent signatures; what they
    # don't join is looked at in full.
    hubs = materialise(_hubs(met, info), "hubs")
    near = pairs.filter(F.col("place") <= LIKELIEST).select("a", "b").union(
        _possible(_counted(hubs), info, held, similarity).select("a", "b"))
    near = materialise(near.distinct(), "pairs")
    links = materialise(_verified(table, near, words, similarity), "links")
    joined = components(links)
    rest = materialise(_apart(pairs.filter(F.col("place") > LIKELIEST), joined), "pairs")
    more = materialise(_dense_links(table, met, info, hubs, joined, words, similarity), "links")
    found = links.union(more)
    if not rest.isEmpty():
        found = found.union(materialise(_verified(table, rest, words, similarity), "links"))
    joined = components(found)

    # Components of representatives to least document ids; then every row takes its class's.
    placed = info.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "class", F.coalesce("component", "rep"))
    least = placed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "class", "left").select("node", "doc_id", "n", "class", "least")


NEVER = 1 << 40  # small sets keep all their signatures


def _meet(table: pa.Table) -> pa.Table:
    """Sets of one bucket that share a signature.

    Pairs (a, b) with the number ``c`` of infrequent signatures that they share here: ``_BOTH_LOWER`` for sets
    of one band, ``_ADJACENT`` for a in the band below b's.  Two sets in the upper band of a
    level aren't paired there; they meet on the next level.  Signatures of more than ``MANY``
    sets give a line and a star of pairs, and rows (signature, set) named by the set's role.
    """
    sigs, nodes, roles = [], [], []
    for blob in table["blob"].to_pylist():
        n = (len(blob) - 8) // 6
        tag = np.frombuffer(blob, "<u2", n, 8 + 4 * n).astype(np.int64)
        sigs.append(np.frombuffer(blob, "<u4", n, 8))
        nodes.append(int.from_bytes(blob[:8], "little") + (tag & 0x7FFF))
        roles.append(tag >> 15)
    sig, node, role = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(roles)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    twin = np.zeros(len(sig), bool)
    twin[1:] = sig[1:] == sig[:-1]
    live = twin.copy()
    live[:-1] |= twin[1:]
    sig, node, role = sig[live], node[order][live], role[order][live]
    order = np.lexsort((node, sig))
    sig, node, role = sig[order], node[order], role[order]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(sig)])
    of = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(sig)) - np.repeat(starts, size)
    big = np.repeat(size > MANY, size)
    left, right = [], []
    for step in range(1, MANY):
        at = np.flatnonzero(~big & (place >= step))
        left.append(at - step)
        right.append(at)
    at = np.flatnonzero(big & (place >= 1))
    i = np.concatenate([*left, at - 1, starts[of[at]]])
    j = np.concatenate([*right, at, at])
    use = ((role[i] == 0) | (role[j] == 0)) & (node[i] != node[j])
    i, j = i[use], j[use]
    turn = (role[i] == 1) | ((role[j] == 0) & (node[i] > node[j]))  # the lower band first, else the lesser node
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    kind = np.where(role[j] == 1, _ADJACENT, _BOTH_LOWER)
    if len(i):
        pair, number = np.unique(np.stack([kind, node[i], node[j]], 1), axis=0, return_inverse=True)
        count = np.bincount(number.ravel(), weights=~big[i], minlength=len(pair)).astype(np.int64)
    else:
        pair, count = np.zeros((0, 3), np.int64), i
    key = (int(table["bucket"][0].as_py()) << 32) + sig[big].astype(np.int64)
    columns = {"kind": [pair[:, 0], np.where(role[big] == 0, _ROLE_0, _ROLE_1)], "a": [pair[:, 1], key], "b": [pair[:, 2], node[big]],
               "c": [count, np.ones(len(key), np.int64)]}
    kinds = {"kind": pa.int32()}
    return pa.table({n: pa.array(np.concatenate(v), kinds.get(n, pa.int64())) for n, v in columns.items()})


def _possible(counted: DataFrame, info: DataFrame, held: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b, c) of class representatives that may be linked, from pairs (kind, a, b, c) of sets.

    Their sizes must allow a link, and as at most ``k`` partitions differ, they must share all
    but ``k`` of either's signatures of their level: ``c`` infrequent ones, and those that stand
    in both lists of frequent ones.  A list is as long as a set has signatures at most.
    """
    info = info.filter("n > 0")
    a = info.select(F.col("node").alias("a"), F.col("rep").alias("x"), F.col("n").alias("n_x"),
                    F.col("need0").alias("need_a"), F.col("many0").alias("many_a"))
    b = info.select(F.col("node").alias("b"), F.col("rep").alias("y"), F.col("n").alias("n_y"), "need0", "need1", "many0", "many1")
    upper = F.col("kind") == _ADJACENT
    joined = counted.join(a, "a").join(b, "b").withColumn(
        "need", F.greatest("need_a", F.when(upper, F.col("need1")).otherwise(F.col("need0")))).withColumn(
        "many_b", F.when(upper, F.col("many1")).otherwise(F.col("many0")))
    p, q = similarity.numerator, similarity.denominator
    near = joined.filter("x <> y").filter(F.least("n_x", "n_y") * q >= F.greatest("n_x", "n_y") * p).filter(
        F.col("c") + F.least("many_a", "many_b") >= F.col("need")).select("a", "b", "x", "y", "c", "need", F.when(upper, _ROLE_1).otherwise(_ROLE_0).alias("role"))
    lower = held.filter(f"role = {_ROLE_0}").select(F.col("node").alias("a"), F.col("sigs").alias("sigs_a"))
    other = held.select(F.col("node").alias("b"), "role", F.col("sigs").alias("sigs_b"))
    listed = near.join(lower, "a", "left").join(other, ["b", "role"], "left")
    shared = F.col("c") + F.coalesce(F.size(F.array_intersect("sigs_a", "sigs_b")), F.lit(0))
    return (listed.withColumn("shared", shared).filter("shared >= need")
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("shared").alias("c")))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    a = joined.select(F.col("node").alias("a"), F.col("component").alias("p"))
    b = joined.select(F.col("node").alias("b"), F.col("component").alias("q"))
    placed = pairs.join(a, "a", "left").join(b, "b", "left")
    return placed.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b").distinct()


def _dense_links(table: DataFrame, met: DataFrame, info: DataFrame, hubs: DataFrame, joined: DataFrame, words: int,
                 similarity: Fraction) -> DataFrame:
    """Links (a, b) between components that may show only in frequent signatures.

    A set with more than ``k`` infrequent signatures on a level shares one of those with every
    similar set of the level, so its frequent ones add nothing; only sets without such a
    reserve are looked at, and of those only the ones that ``_linkable`` leaves.  They are
    grouped by their first hub.  Groups that meet in a signature are compared in blocks of
    about ``BLOCK`` sets: the sets outside their group's largest component, in blocks of
    their own, with all of the other group, or all with all where the largest components differ.
    """
    frequent = met.filter(f"kind IN ({_ROLE_0}, {_ROLE_1})").select("kind", F.col("a").alias("sig"), F.col("b").alias("node"))
    needy = info.select("node", "rep", F.explode(F.array(
        F.struct(F.lit(_ROLE_0).alias("kind"), (F.col("many0") >= F.col("need0")).alias("open"), F.col("many0").alias("many")),
        F.struct(F.lit(_ROLE_1).alias("kind"), (F.col("many1") >= F.col("need1")).alias("open"), F.col("many1").alias("many")))).alias("r")).filter(
        "r.open AND r.many > 0").select("node", "rep", "r.kind")
    first_hub = hubs.groupBy(F.col("x").alias("node")).agg(F.max_by("y", F.struct("c", "y")).alias("group"))
    placed = needy.join(first_hub, "node", "left").withColumn("group", F.coalesce("group", "node")).join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    met_sets = frequent.join(placed, ["node", "kind"])
    # Only signatures that several components share can show a link between components.
    several = met_sets.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("sig")
    met_sets = materialise(met_sets.join(several, "sig").select("sig", "rep", "group", "component").distinct(), "needy")
    able = _linkable(table, met_sets.select("rep", "component").distinct(), words, similarity)
    if able.isEmpty():
        return able.select(F.col("rep").alias("a"), F.col("component").alias("b"))
    met_sets = met_sets.join(able.select("rep"), "rep")
    met_groups = met_sets.select("sig", "group").distinct()
    placed = met_sets.select("rep", "group").distinct()
    members = placed.groupBy("rep").agg(F.min("group").alias("group"))
    # A class stands in one group; signatures of its other sets count for that group.
    moved = placed.select("rep", F.col("group").alias("old")).join(members, "rep").select("old", "group").distinct()
    met_groups = met_groups.join(moved.withColumnRenamed("group", "new"), met_groups["group"] == F.col("old")).select("sig", F.col("new").alias("group")).distinct()
    members = members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    shares = members.groupBy("group", "component").agg(F.count("*").alias("n"))
    groups = shares.groupBy("group").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("major"),
                                         F.count("*").alias("parts"), F.max("n").alias("most")).withColumn(
        "blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")).withColumn("few_blocks", F.expr(f"(n - most + {BLOCK - 1}) div {BLOCK}"))
    groups = materialise(groups, "groups")
    members = materialise(members.join(groups, "group").select(
        "rep", "group", "component", "major", F.expr("pmod(xxhash64(rep), blocks)").alias("block"),
        F.expr("IF(component <> major, pmod(xxhash64(rep), few_blocks), NULL)").alias("few_block")), "members")

    left = groups.select(F.col("group").alias("g"), F.col("major").alias("major_g"), F.col("parts").alias("parts_g"), F.col("blocks").alias("blocks_g"),
                         F.col("few_blocks").alias("few_g"))
    right = groups.select(F.col("group").alias("h"), F.col("major").alias("major_h"), F.col("blocks").alias("blocks_h"))
    ends = met_groups.withColumnRenamed("group", "g").join(met_groups.withColumnRenamed("group", "h"), "sig").select("g", "h").distinct()
    # (g, h) and (h, g) both stand in the list; where all meet all, one of them is enough.
    same = F.col("major_g") == F.col("major_h")
    tasks = ends.join(left, "g").join(right, "h").filter(
        F.when(same, F.col("parts_g") > 1).otherwise(F.col("g") < F.col("h"))).select(
        "g", "h", same.alias("minor"), "blocks_h",
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(same, F.col("few_g")).otherwise(F.col("blocks_g")) - 1)).alias("p")).select(
        "g", "h", "minor", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_h") - 1)).alias("q"))
    tasks = materialise(tasks, "tasks")
    cell = ["g", "h", "p", "q"]
    few, every = (members.select(F.col("group").alias("g"), F.col(c).alias("p"), "rep", "component") for c in ("few_block", "block"))
    one = tasks.filter("minor").join(few.filter("p IS NOT NULL"), ["g", "p"]).select(*cell, "rep", "component").union(
        tasks.filter("NOT minor").join(every, ["g", "p"]).select(*cell, "rep", "component"))
    two = tasks.join(members.select(F.col("group").alias("h"), F.col("block").alias("q"), "rep", "component"), ["h", "q"]).select(*cell, "rep", "component")
    # Blocks without a set on the left send nothing.
    two = two.join(one.select(*cell).distinct(), cell, "left_semi")
    sets = materialise(_sets(table, members.select("rep").distinct().withColumnRenamed("rep", "node"), words).withColumnRenamed("node", "rep"), "elements")
    p, q = similarity.numerator, similarity.denominator

    def compare(left_sets: pa.Table, right_sets: pa.Table) -> pa.Table:
        a, b = _block_links(left_sets, right_sets.rename_columns(left_sets.column_names), p, q)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    ones = one.join(sets, "rep").select(*cell, "rep", "component", "elements")
    twos = two.join(sets, "rep").select(*(F.col(c).alias(f"{c}_2") for c in ones.columns))
    return ones.groupBy(*cell).cogroup(twos.groupBy(*(f"{c}_2" for c in cell))).applyInArrow(two_groups(compare), "a long, b long")


def _linkable(table: DataFrame, members: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(rep, component): the members that may be linked with a member of another component.

    A member can only have in common with one of another component what it shares with any:
    unless that is ``similarity`` of its set, it goes.  Of a component's members that share the
    same elements the smallest stays, for whatever is linked with another of them is linked
    with it.  What goes shares nothing any more, so the question is put again until it takes
    away less than a tenth.  Every chunk sends an element once, whichever sets hold it.
    """
    buckets = shards.bucket_count(table)
    p, q = similarity.numerator, similarity.denominator

    def chosen(batch: pa.RecordBatch, known: dict) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Members of the chunk, their components, elements and offsets."""
        pairs = sorted(tuple(map(int, x.split(":"))) for x in known[_WANTED, 0].decode().split(","))
        picked = [i for i, _ in pairs]
        return picked, np.array([c for _, c in pairs], np.int64), *shingle_sets(batch.take(pa.array(picked)), words)

    def ask(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        if (_WANTED, 0) not in known:
            return
        _, component, values, offsets = chosen(batch, known)
        held, owner = _owners(values, np.repeat(component, np.diff(offsets)))
        yield shards.questions(shard, chunk, _HELD, held, buckets, lambda b, e: held[b:e].tobytes() + owner[b:e].tobytes())

    def decide(blobs: list[bytes]) -> list[bytes | None]:
        sizes = [len(x) // 16 for x in blobs]
        values = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(blobs, sizes, strict=True)])
        component = np.concatenate([np.frombuffer(x, "<i8", n, 8 * n) for x, n in zip(blobs, sizes, strict=True)])
        held, owner = _owners(values, component)
        hit = owner[np.searchsorted(held, values)] == _SEVERAL
        edges = np.cumsum([0, *sizes])
        return [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def describe(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        if (_WANTED, 0) not in known:
            return
        picked, component, values, offsets = chosen(batch, known)
        held = np.unique(values)
        shared = shards.answered(held, buckets, known, _HELD)[np.searchsorted(held, values)]
        ends = np.r_[0, np.cumsum(shared)][offsets]
        sizes = np.diff(offsets)
        use = q * np.diff(ends) >= p * sizes
        yield {"rep": (_node(shard, chunk) + np.array(picked))[use], "component": component[use], "n": sizes[use],
               "digest": set_digests(values[shared], ends)[use]}

    schema = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("digest", pa.int64())])
    now, count = materialise(members.select("rep", "component"), "linkable"), members.count()
    while count:
        wanted = shards.kept(_wanted(now.withColumnRenamed("rep", "node"), "component"), "wanted")
        asked = shards.visit(table, shards.QUESTIONS, shards.ANSWERS, ask, wanted)
        answers = shards.union_answers(wanted, shards.answer(asked, decide))
        found = shards.visit(table, schema, "rep long, component long, n long, digest long", describe, answers)
        now = materialise(found.groupBy("component", "digest").agg(F.min_by("rep", F.struct("n", "rep")).alias("rep")).select(
            "rep", "component"), "linkable")
        before, count = count, now.count()
        if 10 * count > 9 * before:
            break
    return now


def _owners(values: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements, each with the component that holds it or ``_SEVERAL``."""
    if not len(values):
        return values, component
    order = np.argsort(values, kind="stable")
    values, component = values[order], component[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    low, high = np.minimum.reduceat(component, starts), np.maximum.reduceat(component, starts)
    return values[starts], np.where(low == high, low, _SEVERAL)


def _block_links(left: pa.Table, right: pa.Table, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of sets, one for each left set and right component."""
    if not left.num_rows or not right.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def unfolded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, "<u8") for x in t["elements"].to_pylist()]
        sizes = np.array([len(x) for x in parts])
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), sizes

    values, of, sizes_l = unfolded(left)
    other, other_of, sizes_r = unfolded(right)
    order = np.argsort(other, kind="stable")
    other, other_of = other[order], other_of[order]
    begin, end = np.searchsorted(other, values, "left"), np.searchsorted(other, values, "right")
    both = np.zeros(len(sizes_l) * len(sizes_r), np.int64)
    hits = np.cumsum(end - begin)
    at = 0
    while at < len(values):  # a bounded number of meetings at a time
        to = max(at + 1, int(np.searchsorted(hits, (hits[at - 1] if at else 0) + (1 << 20), "right")))
        n = end[at:to] - begin[at:to]
        cells = np.repeat(of[at:to], n) * len(sizes_r) + other_of[ragged(begin[at:to], n)]
        both += np.bincount(cells, minlength=len(both))
        at = to
    both = both.reshape(len(sizes_l), len(sizes_r))
    comp_l, comp_r = left["component"].to_numpy(), right["component"].to_numpy()
    linked = (q * both >= p * (sizes_l[:, None] + sizes_r[None, :] - both)) & (comp_l[:, None] != comp_r[None, :])
    i, j = np.nonzero(linked)
    if len(i):
        _, first = np.unique(np.stack([i, comp_r[j]], 1), axis=0, return_index=True)
        i, j = i[first], j[first]
    return left["rep"].to_numpy()[i], right["rep"].to_numpy()[j]


def _counted(pairs: DataFrame) -> DataFrame:
    """Rows (x, role_x, y, role_y) to pairs (kind, a, b, c), with no infrequent signature counted."""
    upper_x, upper_y = F.col("role_x") == _ROLE_1, F.col("role_y") == _ROLE_1
    turn = upper_x | (~upper_y & (F.col("x") > F.col("y")))
    return pairs.groupBy(
        F.when(upper_x | upper_y, _ADJACENT).otherwise(_BOTH_LOWER).alias("kind"),
        F.when(turn, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("b")).agg(F.lit(0).cast("long").alias("c"))


def _hubs(met: DataFrame, info: DataFrame) -> DataFrame:
    """(x, role_x, y, role_y, c): sets without a reserve of infrequent signatures, with hubs of
    their frequent ones, ``HUBS`` at most for each set.

    In a group of near copies, the sets with the most frequent signatures are nearest to what
    the group has in common, and similar to most of it.  One such set of each of ``HUBS`` parts
    of a signature's members stands for it; each set keeps those that it meets most often.
    """
    rows = met.filter(f"kind IN ({_ROLE_0}, {_ROLE_1})").select(F.col("kind").alias("role"), F.col("a").alias("sig"), F.col("b").alias("node"))
    lower = rows.filter(f"role = {_ROLE_0}").join(info.select("node", "many0"), "node")
    hubs = lower.groupBy("sig", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("part")).agg(
        F.max_by("node", F.struct("many0", "node")).alias("y"))
    met_hubs = rows.join(hubs, "sig").filter("node <> y").select(F.col("node").alias("x"), F.col("role").alias("role_x"), "y", F.lit(_ROLE_0).alias("role_y"))
    poor = info.select(F.col("node").alias("x"), F.explode(F.array(
        F.struct(F.lit(_ROLE_0).alias("role_x"), (F.col("many0") >= F.col("need0")).alias("open")),
        F.struct(F.lit(_ROLE_1).alias("role_x"), (F.col("many1") >= F.col("need1")).alias("open")))).alias("r")).filter("r.open").select("x", "r.role_x")
    counted = met_hubs.join(poor, ["x", "role_x"]).groupBy("x", "role_x", "y", "role_y").agg(F.count("*").alias("c"))
    best = Window.partitionBy("x").orderBy(F.desc("c"), "y")
    return counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HUBS).drop("place")


def _sets(table: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, elements) of the named sets, read from their shards."""
    def sets(shard: int, chunk: int, batch: pa.RecordBatch, known: dict) -> Iterator[dict]:
        picked = _picked(known)
        if not picked:
            return
        values, offsets = shingle_sets(batch.take(pa.array(picked)), words)
        yield {"node": [_node(shard, chunk) + i for i in picked],
               "elements": [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]}

    schema = pa.schema([("node", pa.int64()), ("elements", pa.binary())])
    return shards.visit(table, schema, "node long, elements binary", sets, _wanted(nodes))


def _verified(table: DataFrame, pairs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The pairs of nodes whose sets are similar enough, by exact intersection.

    Only the sets of candidates leave their shard; each is sent to its pairs.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = _sets(table, wanted, words)
    p, q = similarity.numerator, similarity.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                left, right = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                both = len(left) + len(right) - len(np.union1d(left, right))
                keep.append(q * both >= p * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(found.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
    whole = right.join(found.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
    return whole.select("a", "b", "left", "right").mapInArrow(lean(compare), "a long, b long")
