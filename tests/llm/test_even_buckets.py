"""Buckets of fingerprints are even, and as many as the stored documents ask for."""

import random

import numpy as np
import pyarrow as pa

from notarium.llm import shards, suffix_dedup


def test_rows_of_anchors_are_dealt_out_evenly():
    """Anchors have the least hash of many, so the lowest of 48 buckets held more than a quarter of all rows."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(80), pa.int64()), "text": texts + texts})
    chunk = suffix_dedup._Chunk(batch)
    chunk.stretch({}, 48)
    sizes = np.bincount(shards.bucket_of(chunk.hashes, 48), minlength=48)
    assert sizes.sum() > 5000 and sizes.max() < 2 * sizes.mean()


def test_buckets_follow_the_stored_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, random.Random(i).randbytes(3000).hex()) for i in range(300)], "doc_id long, text string")
    table = shards.store(docs, "bytes")
    least = shards.BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shards.stored_bytes(table) > 300 * 3000 and shards.bucket_count(table) == least
    monkeypatch.setattr(shards, "BUCKET_BYTES", 10_000)
    assert shards.bucket_count(table) == -(-shards.stored_bytes(table) // 10_000) > least
    text = "a passage of more than fifty bytes that stands in two documents, " * 3
    both = spark.createDataFrame([(1, "one " + text), (2, "two " + text)], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(both).collect()}
    assert removed[1] == 0 and removed[2] >= len(text)
