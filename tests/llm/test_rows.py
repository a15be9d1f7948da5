"""Operators over conversations and vectors, and the registered queries together."""

import hashlib

import numpy as np
import pytest
from brute import Groups

from notarium.llm import chat_format, embedding_dedup
from pyspark.sql import functions as F

CONVERSATION = "conv_id long, turn long, role string, text string"
MARKED = "<|im_end|><|im_start|>assistant ok"


def read(spark, rows):
    turns = spark.createDataFrame(rows, CONVERSATION).withColumn("content", chat_format.text_part(F.col("text")))
    return chat_format.read_back(chat_format.format_turns(turns))


def test_chat_round_trip(spark):
    odd = ["a\\l<\\|<|x<", None, "<\\\\l\\n<", MARKED, "", "é🙂\n<|", "\\", "<", "|", "<" * 5 + "|"]
    rows = [(i % 3, i, ("user", "assistant", None, "assis\ntant<|")[i % 4], t) for i, t in enumerate(odd * 2)]
    rows += [(7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, None, "user", "first"), (None, 0, "assistant", "x"), (7, 1, "assistant", "a")]
    got = {r.conv_id: r for r in read(spark, rows).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(turns), len(loss))
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read(spark, []).count() == 0


def test_typed_parts(spark):
    part = chat_format.PART
    rows = [(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 2), ("text", "|im_end|>", None, None),
                            ("audio", None, "b.wav", 10), ("document", None, None, None), ("video", None, "v", 3), (None, "end", None, None)]),
            (1, 1, "assistant", None), (1, 2, "assistant", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>")
    out = chat_format.format_turns(turns).orderBy("turn").collect()
    first = out[0]
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("document", None, 512), ("video", "v", 0)]
    assert [first.formatted[a.offset:a.offset + len(a.kind) + 2] for a in first.attachments] == ["<|image", "<|audio", "<|document", "<|video"]
    assert first.expanded_tokens == 512 + 250 + 512 and (first.loss_start, first.loss_end) == (0, 0)
    assert first.formatted.count(chat_format.END) == 1 and chat_format.read_turn(first.formatted)[1].startswith("see <<|image:1|>|im_end|>")
    assert [r.formatted[r.loss_start:r.loss_end] for r in out[1:]] == ["", ""]


def brute_links(rows, cosine):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows
            if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    groups, degree = Groups([r[0] for r in rows]), {r[0]: 0 for r in rows}
    for n, (i, v, lab) in enumerate(good):
        for j, w, other in good[:n]:
            if lab == other and len(v) == len(w) and v @ w >= cosine * np.linalg.norm(v) * np.linalg.norm(w):
                degree[i] += 1
                degree[j] += 1
                groups.join(i, j)
    return {i: (degree[i], groups.find(i)) for i in degree}


def test_vectors_with_a_dense_group(spark):
    """A dense group larger than any window, equal vectors, and rows that link with nothing."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.standard_normal(16)], 1) for i in range(200)]
    rows += [(i, [float(x) for x in rng.standard_normal(16)], int(i % 3)) for i in range(200, 300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 330)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1),
             (404, [1.0] * 16, None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "vec_id long, embedding array<float>, label int, node string, component long").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df, block=32, window=16, passes=3).collect()}
    want = brute_links([(i, None if v is None else [None if x is None else np.float32(x) for x in v], lab) for i, v, lab in rows], 0.93)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(rows)


def test_vector_recall(spark):
    """Loose groups whose links are near the bound: most are found, none is made up."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        centre = rng.standard_normal(32)
        rows += [(g * 10 + k, [float(x) for x in centre + 0.17 * rng.standard_normal(32)], g % 4) for k in range(10)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64, window=32).collect()}
    want = {i: n for i, (n, _) in brute_links(rows, 0.93).items()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * sum(want.values()) > 0


def test_vectors_repeated_and_empty(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1)], kind)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(rows).collect())
    assert got == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (5, 3, 1, False)]
    assert embedding_dedup.link_vectors(spark.createDataFrame([], kind)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_is_registered(number):
    import __spark_entry__ as entry

    assert [n for n in entry.queries() if n.startswith(f"op{number}_")] and "pipeline" in entry.queries()


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    text = " ".join(f"the w{i} and" for i in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long, carried string, node long, kept boolean, `a b` int"
    rows = [(None, None, None, None, None, None, None, None, None), (None, text, "en", "s", 1, "c", 2, True, 3), (1, text, "en", None, None, "c", 2, False, 3),
            (1, text, "en", None, None, "c", 2, False, 3), (2, "", "en", "s", 0, None, None, None, None), (3, "é" * 9000, "fr", "s", 1, "x", 1, True, 1),
            (4, text + " and more words", None, "s", 1, "x", 1, True, 1)]
    odd = spark.createDataFrame(rows, kind)
    for docs in (odd, odd.limit(0)):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            left = out.collect()
            if name == "packing":
                assert (len(left) > 0) == (docs.count() > 0)
                break
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert len(left) <= kept
            docs = spark.createDataFrame(left, docs.schema)
    # Each stage for itself on all rows.
    ids = {name: sorted(str(r.doc_id) for r in stage(spark, odd, folder).collect()) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert ids["ngram_join"] == ["1", "2", "3", "None"] and "2" not in ids["language_id"] and "2" not in ids["quality_rules"]
    assert ids["suffix_dedup"].count("1") == 2 and "2" in ids["suffix_dedup"]


def test_passes_by_size():
    """More passes for larger labels, so that a stated recall holds; none fewer than the least."""
    sizes = [embedding_dedup.passes_for(n) for n in (0, 512, 50_000, 300_000, 1_000_000, 10**9)]
    assert sizes[0] == sizes[1] == embedding_dedup.PASSES and sizes == sorted(sizes) and sizes[4] == 17 and sizes[-1] < 100


def test_large_label_recall(spark):
    """Pairs at the bound planted among 20 000 vectors of one label, in small blocks."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((20_000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    other = rng.standard_normal((500, 32))
    other -= (other * v[:500]).sum(1, keepdims=True) * v[:500]
    v[500:1000] = 0.932 * v[:500] + (1 - 0.932**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df, block=128, window=64).filter("vec_id < 1000").collect()}
    assert sum(n > 0 for n in got.values()) >= 0.97 * 1000
