"""Operators over texts against plain versions, and their defined results for odd input."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import base_counts, earlier_strings, jaccard_components, plain_quality, repeated_windows, words
from pyspark.sql import functions as F

from notarium.llm import (bpe, components, language_id, license_scan, ngram_join, packing, quality_rules, shards, substring_dedup,
                          suffix_dedup)
from notarium.llm.queries import QUERIES, word_vocabulary
from notarium.llm.words import find_words, texts_of


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ---------------------------------------------------------------- helpers


def test_words_are_those_of_the_pattern(pairs):
    column = pa.array([t for _, t in pairs])
    texts = texts_of(column)
    found = find_words(texts)
    for i, (_, text) in enumerate(pairs):
        a, b = found.firsts[i], found.firsts[i + 1]
        got = [texts.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b])]
        assert got == words(text)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert {v for k, v in got.items() if k >= 100} == {100} and len([k for k in got if k >= 100]) == 41
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_cut_at_size_and_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (10, 5000, 3, 0, 9000)]})
    parts = list(shards.cut_batch(batch, 4000))
    assert [r for p in parts for r in p["text"].to_pylist()] == batch["text"].to_pylist() and len(parts) == 4


# ---------------------------------------------------------------- op1, op7


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


def test_bpe_equals_the_library():
    rng = random.Random(3)
    letters = "aAbBeEsStT  \n\t'.,!?019éÉßÑ×÷ªº²µ¼İıΣς́e中🙂\x1c\x85\xa0 \x00\x7f_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>x<|startoftext|>", "it's don't we'll I'M", "a" * 3000, "ab" * 700 + "xyz" * 500, "́a é"]
    texts += ["".join(rng.choice("abcdeinthr") for _ in range(600)) for _ in range(5)]
    encoder, whole = bpe.Encoder(word_vocabulary()), library()
    ids, offsets = encoder.encode(texts_of(pa.array(texts)))
    decoded = encoder.vocabulary.decode(ids.astype(np.int64), offsets)
    for i, want in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == want.ids
        assert decoded[i] == whole.decode(want.ids, skip_special_tokens=False)


def test_bpe_cache_may_be_small(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    encoder, whole = bpe.Encoder(word_vocabulary()), library()
    for text in ("one two three four five", "six seven", "one two"):
        assert encoder.encode(texts_of(pa.array([text])))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark, documents, pairs, odd_rows):
    rows = bpe.decode_documents(bpe.encode_documents(documents, word_vocabulary()), word_vocabulary()).collect()
    whole, texts = library(), dict(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        ids = whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == whole.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(odd_rows, word_vocabulary()).count() == 5
    assert bpe.decode_documents(bpe.encode_documents(empty(spark), word_vocabulary()), word_vocabulary()).count() == 0


@pytest.mark.parametrize("size,windows", [(4096, 64), (50, 2)])
def test_packing(documents, pairs, size, windows):
    rows = packing.pack(documents, word_vocabulary(), size=size, windows=windows, merge=2).collect()
    whole, pieces, places = library(), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.tokens) and len(r.tokens) == 4 * r.length
    for i, text in pairs:
        want = np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.tokens) for r in mine) == want and {r.doc_tokens for r in mine} == {len(want) // 4}
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == np.cumsum([0, *(n for _, n in p)])[:-1].tolist() and sum(n for _, n in p) <= size
    used = sum(r.length for r in rows)
    assert used / (size * len(places)) > (0.6 if size == 4096 else 0.85)


def test_packing_odd_rows(spark, odd_rows):
    rows = packing.pack(odd_rows, word_vocabulary()).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows)[0] == (-1, 1) and len(rows) == 5
    assert packing.pack(empty(spark), word_vocabulary()).count() == 0


# ---------------------------------------------------------------- op2


@pytest.mark.parametrize("trusted", [set(), {20, 25, 41}, set(range(20, 40)), set(range(0, 2000, 2))])
def test_base_counts_and_verdict(spark, documents, pairs, trusted):
    """All counts, the ratio and the verdict against a plain version, with no, few and many trusted documents."""
    labels = spark.createDataFrame([(i, 1, None if i == 41 else 0) for i in trusted] + [(None, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    threshold, plain = plain_quality(pairs, trusted)
    rows = quality_rules.quality(documents, labels, carry=("kept", "n_chars")).collect()
    texts = dict(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.ratio == pytest.approx(plain[r.doc_id][0], abs=1e-9) and r.carried.kept == "k"
        assert r.kept == plain[r.doc_id][1] or abs(r.ratio - threshold) < 1e-9


def test_repeats_of_very_long_texts_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 3)
    text = "a b c d e a b c x y z a b c q"
    got = spark.createDataFrame([(text,)], "t string").select(quality_rules.repeated_words(quality_rules.words_of(F.col("t"))).alias("n")).first()
    assert got.n == base_counts(text)[4]


def test_ratio_by_hand(spark):
    """The ratio from counts of the same buckets, in Python."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "a b", "junk junk x", None, "q"])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    grams = {r.doc_id: list(r.g) for r in docs.select("doc_id", quality_rules._buckets(quality_rules.words_of(F.col("text"))).alias("g")).collect()}
    every = np.bincount(sum(grams.values(), []), minlength=quality_rules.BUCKETS)
    good = np.bincount(grams[0] + grams[1], minlength=quality_rules.BUCKETS)
    share = (every + 1) / (every.sum() + quality_rules.BUCKETS)
    weight = np.log((good + quality_rules.PRIOR * share) / (good.sum() + quality_rules.PRIOR)) - np.log(share)
    for r in quality_rules.quality(docs, labels).collect():
        want = weight[grams[r.doc_id]].mean() if grams[r.doc_id] else 0.0
        assert r.ratio == pytest.approx(want, abs=1e-12)
    assert [len(g) for g in grams.values()] == [9, 3, 5, 0, 1]


def test_every_trusted_document_counts(spark):
    """More good labels than the 20 000 that once were the most: the one document that holds a word counts, whichever it is."""
    ids = spark.range(21_000).select(F.col("id").alias("doc_id"))
    docs = ids.select("doc_id", F.concat(F.lit("common w"), F.col("doc_id")).alias("text"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality_rules.trusted_ids(labels).count() == 21_000
    grams = quality_rules.trusted_grams(docs, quality_rules.trusted_ids(labels))
    assert grams.select(F.sum(F.size("grams"))).first()[0] == 3 * 21_000
    every = np.zeros(quality_rules.BUCKETS)
    for r in grams.select(F.explode("grams").alias("b")).groupBy("b").count().collect():
        every[r.b] = r["count"]
    share = (every + 1) / (every.sum() + quality_rules.BUCKETS)
    want = np.log((every + quality_rules.PRIOR * share) / (every.sum() + quality_rules.PRIOR)) - np.log(share)
    assert quality_rules.weights(docs, grams).first().weights == pytest.approx(want.tolist(), abs=1e-9)


def test_fold_weights_by_hand(spark):
    """The weights without each fold, in Python."""
    docs = spark.createDataFrame([(i, f"a b c{i} a b") for i in range(30)], "doc_id long, text string")
    good = quality_rules.trusted_grams(docs, docs.filter("doc_id < 20").select("doc_id"))
    counts = quality_rules.corpus_counts(docs, good)
    c = counts.first().c
    every = np.array([x.everywhere for x in c])
    share = (every + 1) / (every.sum() + quality_rules.BUCKETS)
    members = good.collect()
    got = {r.fold: r.w for r in quality_rules.fold_weights(counts).collect()}
    assert sorted(got) == list(range(quality_rules.FOLDS))
    for fold, w in got.items():
        left = np.bincount(sum((r.grams for r in members if r.fold != fold), []), minlength=quality_rules.BUCKETS)
        want = np.log((left + quality_rules.PRIOR * share) / (left.sum() + quality_rules.PRIOR)) - np.log(share)
        assert w == pytest.approx(want.tolist(), abs=1e-9)


def test_verdict_does_not_hang_on_the_number_of_trusted(spark):
    """Junk goes and unseen good documents stay, with few trusted documents as with many."""
    rng = random.Random(8)
    good, bad = [f"g{i}" for i in range(300)], [f"j{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(good if i < 1000 else bad, k=80))) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (30, 800):
        labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        got = {r.doc_id: r.kept for r in quality_rules.quality(docs, labels).collect()}
        assert sum(got[i] for i in range(1000, 1400)) == 0, n
        assert sum(got[i] for i in range(900, 1000)) >= 90, n


def test_quality_without_rows_or_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality(empty(spark), none).count() == 0
    assert {abs(r.ratio) < 1e-9 for r in quality_rules.quality(documents, none).collect()} == {True}


# ---------------------------------------------------------------- op3


def test_join_equals_all_pairs(documents, pairs):
    want = jaccard_components(pairs)
    got = ngram_join.link_documents(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    first = ngram_join.first_documents(documents)
    assert first.columns == documents.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_join_of_a_large_near_group(spark, monkeypatch):
    """A group beyond the pairs of one signature, with a passage in unlike documents."""
    monkeypatch.setattr(ngram_join, "MANY", 3)
    rng = random.Random(1)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        if i % 2:
            w[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*(f"z{i}_{k}" for k in range(20)), *passage])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(df).collect()} == jaccard_components(rows)


def _around(rng, passage, own, edits, tag):
    """A passage with some words replaced, and words of its own after it."""
    w = list(passage)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"e{rng.randrange(40)}"
    return " ".join([*w, *(f"{tag}_{k}" for k in range(own))])


@pytest.mark.parametrize("block", [4, 128])
def test_join_of_groups_beyond_blocks(spark, monkeypatch, block):
    """Groups of more sets than a block: near copies, unlinked documents around one passage, and
    documents between two groups that hang on single links."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    one, two = [f"a{i}" for i in range(90)], [f"b{i}" for i in range(70)]
    texts = [_around(rng, one, rng.randrange(0, 40), rng.randrange(0, 4), f"o{i}") for i in range(170)]
    texts += [_around(rng, one + two[:20], rng.randrange(0, 25), rng.randrange(0, 3), f"p{i}") for i in range(140)]
    texts += [_around(rng, two, rng.randrange(10, 30), 1, f"q{i}") for i in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = jaccard_components(rows)
    assert 20 < len({c for _, c in want.values()}) < 300
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(df).collect()} == want


def test_sharers_of_a_passage_meet_nowhere(spark, monkeypatch):
    """Documents that hold one passage, but not four fifths of it, leave nothing to compare."""
    left = []
    whole = ngram_join._linkable
    monkeypatch.setattr(ngram_join, "_linkable", lambda *a: left.append((a[1].count(), (out := whole(*a)).count())) or out)
    passage = [f"p{i}" for i in range(60)]
    for n in (100, 400):
        rows = [(i, " ".join([*passage, *(f"z{i}_{k}" for k in range(30))])) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert all(r.component_id == r.doc_id for r in ngram_join.link_documents(df).collect())
    assert [b for _, b in left] == [0, 0] and left[1][0] > 100


def test_signatures_meet_for_all_similar_sets():
    """Any two sets within the similarity share a signature on a common level."""
    rng, levels = np.random.default_rng(2), ngram_join.Levels()
    for n in (*range(1, 60), 130, 400, 1500):
        for _ in range(6):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            lost = int(rng.integers(0, n // 5 + 1))
            y = np.concatenate([x[lost:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
            both = len(x) - lost
            if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
                continue
            x, y = np.sort(x), np.sort(y)
            sig, of, _ = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), levels)
            assert set(sig[of == 0]) & set(sig[of == 1]), n


def test_join_odd_rows(spark, odd_rows):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.link_documents(odd_rows).collect())
    assert got == [("5", 76, 5), ("5", 76, 5), ("9", 77, 5), ("None", 0, None), ("None", 76, 5)]
    assert ngram_join.first_documents(odd_rows).count() == 2
    assert ngram_join.link_documents(empty(spark)).count() == 0


# ---------------------------------------------------------------- op4


def test_license_scan(spark):
    notice = license_scan.TEMPLATES[0][1]
    long = license_scan.TEMPLATES[3][1]
    rows = [(1, f"some words before {notice} and after"), (2, notice.upper().replace(" ", "\n")), (3, "no notice at all here"), (4, None), (5, ""),
            (6, f"{notice} x {long}"), (None, notice), (7, long.replace("documentation", "other")), (8, "w " * 5000 + notice), (9, "Licensed under")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.template) for r in got) == [(0, 0), (1, 0), (2, 0), (6, 0), (6, 3), (7, 3), (8, 0)]
    assert [(r.first_word, r.end_word) for r in got if r.doc_id == 1] == [(3, 11)]
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_scan_equals_all_windows(spark):
    """Every place where a template stands word for word is found, by a plain search."""
    rng = random.Random(8)
    texts = []
    for _ in range(300):
        w = [rng.choice(["the", "license", "under", "version", "a", "2", "mit"]) for _ in range(rng.randint(0, 60))]
        for name, text in rng.sample(license_scan.TEMPLATES, 2):
            w.insert(rng.randint(0, len(w)), text)
        texts.append(" ".join(w))
    found = {(r.doc_id, r.template) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n, (_, x) in enumerate(license_scan.TEMPLATES) if x in t}
    assert want <= found


# ---------------------------------------------------------------- op6


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(spark, documents):
    model = language_id.fit(spark.createDataFrame(
        [(i, "the cat and the dog", "en") for i in range(5)] + [(9, "der hund und die katze", "de"), (None, "x", "fr"), (8, None, "es"), (7, "y", None)],
        "doc_id long, text string, lang string"))
    assert set(model.languages) == {"de", "en"}
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 # 🙂"), (4, "und der hund"), (4, "the dog " * 9000), (None, "É")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(rows, model).collect()]
    assert got[:5] == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False), (4, "en", False)]
    assert language_id.predict(documents, model, carry=("score", "kept")).first().carried.score == 0.5
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(rows, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


# ---------------------------------------------------------------- op8, op9


def test_suffix_dedup(documents, pairs):
    want = earlier_strings(pairs)
    got = suffix_dedup.remove_repeats(documents, carry=("kept", "text")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want and len(got) == len(want)
    texts = dict(pairs)
    assert all(r.carried.kept == "k" for r in got)
    assert all(r.text == (bytes(r.kept).decode("utf-8", "ignore") if r.n_removed else texts[r.doc_id]) for r in got)


def test_suffix_dedup_in_small_blocks(documents, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(shards, "CHUNK_BYTES", 700)
    got = suffix_dedup.remove_repeats(documents).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == earlier_strings(pairs)


def test_suffix_dedup_odd_rows(spark, odd_rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd_rows).collect())
    n = len(odd_rows.filter("doc_id = 5").first().text)
    assert got == [("5", n, 0), ("5", n, 0), ("9", n + 4, n), ("None", 0, 0), ("None", n, n)]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_substring_dedup(documents, pairs):
    want = sorted(repeated_windows([t for _, t in pairs]))
    assert sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(documents).collect()) == want


def test_substring_dedup_odd_rows(spark, odd_rows):
    texts = [r.text for r in odd_rows.collect()]
    assert sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(odd_rows).collect()) == sorted(repeated_windows(texts))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_cover_meets_every_difference():
    cover, n = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % n for a in cover for b in cover} == set(range(n))


def test_digests_of_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = earlier_strings([(r.doc_id, r.text) for r in docs])
    for r in QUERIES["op8_suffix_dedup"](spark, folder).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    plain = dict(zip([r.doc_id for r in docs], repeated_windows([r.text for r in docs])))
    for r in QUERIES["op9_substring_dedup"](spark, folder).collect():
        n, removed, kept = plain[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
    whole, texts = library(), {r.doc_id: r.text for r in docs}
    for r in QUERIES["op1_bpe"](spark, folder).collect():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_language_id_rejects_what_it_was_not_fitted_on(spark):
    """A language left out of the fit and random letters are far; held-out texts of known languages, short ones too, are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)

    def letters(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n))

    odd = spark.createDataFrame([(i, letters(n)) for i, n in enumerate([20, 50, 200, 1000] * 10)], "doc_id long, text string")
    model = language_id.fit(docs.filter("lang <> 'de' AND doc_id % 3 <> 1"))
    assert "de" not in model.languages

    def rejected(rows):
        got = [r.rejected for r in language_id.predict(rows, model).collect()]
        return sum(got) / len(got)

    other = docs.filter("lang = 'de' AND length(text) > 200")
    known = docs.filter("lang <> 'de' AND doc_id % 3 = 1 AND length(text) > 200")
    assert rejected(odd) == 1.0 and rejected(other) > 0.9
    assert rejected(known) < 0.05 and rejected(known.withColumn("text", F.substring("text", 1, 60))) < 0.05
