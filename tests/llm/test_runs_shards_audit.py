"""Runs of words, shards by rendezvous and the audit of filters, against plain versions."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from brute import plain_audit, plain_runs, words

from notarium.llm import filter_audit, periodic_runs, sharding
from pyspark.sql import functions as F

ODD = [None, "", " \n\t ", "one", "a b " * 30, "x " * 4000, "é🙂 " * 50, "the cat sat\n" * 12, "no repeats at all here"]
KIND = "doc_id long, text string, source string, n_words int, runs int, collapsed string, `a b` int"


def random_documents(rng, n):
    docs = []
    for _ in range(n):
        size = rng.choice([1, 2, 3, 5, 40])
        w = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(60))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        docs.append(" ".join(w * rng.choice([1, 1, 2, 4])))
    return docs


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_documents(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = [d.split() for d in random_documents(rng, rng.randrange(4))]
        numbers = {w: i for i, w in enumerate({w for d in docs for w in d})}
        symbols = np.array([numbers[w] for d in docs for w in d], np.int64)
        got = periodic_runs.runs_of_documents(symbols, np.cumsum([0, *map(len, docs)]), least)
        assert got == [plain_runs(d, least) for d in docs]


def test_suffixes_and_common_words():
    rng = random.Random(5)
    for _ in range(60):
        body = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        text = np.array([*body, 0], np.int64)
        order, shared = periodic_runs.suffix_order(text)
        listed = text.tolist()
        repeated = [i for i in range(len(listed)) if listed.count(listed[i]) > 1]
        assert sorted(order.tolist()) == repeated
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist()):
            common = next(k for k, (x, y) in enumerate(itertools.zip_longest(listed[a:], listed[b:])) if x != y)
            assert common == n and listed[a:] < listed[b:] or listed[a] != listed[b]


def test_find_runs(spark):
    """Whole rows: spans, collapsed texts, carried columns, columns of the same names."""
    texts = ODD + random_documents(random.Random(3), 40) + ["a b " * 30]
    rows = [(i if i % 7 else None, t, "s", 1, 2, "old", i) for i, t in enumerate(texts)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows + rows[4:6], KIND).repartition(3)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        w = words(texts[r["a b"]])
        want = plain_runs(w)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(spark.createDataFrame([], KIND)).count() == 0


def test_looped_texts_and_digests(spark):
    """The query's own columns on ids of which some loop their text."""
    from notarium.llm.queries import looped

    rng = random.Random(11)
    texts = [" ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(90))) for _ in range(120)]
    rows = [*enumerate(texts), (None, "a b"), (120, None), (121, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("t")).collect():
        w = words(dict(rows)[r.doc_id])
        h = 1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert words(r.t) == w


def test_shards(spark):
    rows = [(i, f"text {i % 50}") for i in range(4000)] + [(None, None)] * 900 + [(7, "seven")] * 700 + [(7, f"{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(docs, shards=6).collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 6)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) == set(range(6))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(h) == 1 for h in homes.values())
    moved = sum(r.grown_shard == 6 for r in got if r.doc_id is not None and r.doc_id != 7) / 4000
    assert 0.08 < moved < 0.21
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r.doc_id, r.size, r.text_crc32, r.slot, r.shard) for r in got} == {
        (r.doc_id, r.size, r.text_crc32, r.slot, r.shard) for r in sharding.shard_documents(docs.repartition(2), shards=6).collect()}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_many_equal_rows_are_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 16)
    docs = spark.createDataFrame([(1, "same")] * 500 + [(2, "other")] * 3, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=1)
    assert sorted(r.slot for r in got.collect()) == list(range(503))


def test_weights(spark):
    """Shards get keys by weight; a changed weight moves keys only to or from its shard."""
    keys = spark.range(20_000)
    weights = {0: 1.0, 1: 2.0, 5: 1.0}
    both = sharding.assign(sharding.assign(keys, F.col("id"), weights), F.col("id"), weights | {1: 3.0}, "later").collect()
    share = collections.Counter(r.shard for r in both)
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    assert all(r.later == r.shard or r.later == 1 for r in both)
    for bad in ({}, {0: 0.0}):
        with pytest.raises(ValueError, match="weights"):
            sharding.choose(F.col("id"), bad)


LABELS = "doc_id long, quality int, toxic int"


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int, part string").repartition(3)
    return filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))


def test_audit(spark):
    rng = random.Random(8)
    parts = ["s1", "s2", "", None]

    def text():
        w = [f"w{rng.randrange(rng.choice([5, 400]))}" for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))]
        if rng.random() < 0.3:
            w += ["ABC"] * rng.randrange(30)
        if rng.random() < 0.3:
            w.append(rng.choice("#$%&*|"))
        return rng.choice([" ", "\n", " \t"]).join(w)

    texts = [text() for _ in range(60)] + [None, "", " \n", "É" * 40, "Z" * 3 + "z" * 57, "Z" * 3 + "z" * 58]
    rows = [(rng.choice([None, i, i, i, 5]), rng.choice(texts), rng.choice(parts), 1, "clash") for i in range(400)]
    rows += [(5, texts[0], "s1", 1, "clash")] * 20 + [(900 + i, "copied " * 60, "hot", 1, "c") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audited(spark, rows, labels).collect()}
    assert got == plain_audit([r[:3] for r in rows], labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []).count() == 0
    got = audited(spark, [(1, None, None, 0, "x")], []).collect()
    assert len(got) == 600 and sum(r.shapley for r in got if r.filter_order == "ABCDE") == 120


def test_shapley_shares_add_up(spark):
    """Efficiency and symmetry, with other filters and counts."""
    counts = spark.createDataFrame([("p", m, bool(m & 1), bool(m & 2), (m * 7) % 11) for m in range(8)],
                                   "part string, mask int, good boolean, toxic boolean, n long")
    out = filter_audit.steps(filter_audit.games(counts, "xyz"), "xyz").collect()
    assert len(out) == 18 and out[0].kept + out[0].removed == sum((m * 7) % 11 for m in range(8))
    share = {r.filter_order[r.step - 1]: r.shapley for r in out}
    summed = collections.Counter()
    for r in out:
        summed[r.filter_order[r.step - 1]] += r.removed
    assert share == dict(summed) and sum(share.values()) == 6 * sum((m * 7) % 11 for m in range(1, 8))
