"""Documents stored once in shards, and rounds of questions that shards send to hash buckets.

Operators that look for repeats over a whole corpus must know, for each fingerprint of a
document, whether it occurs elsewhere.  Shuffling the texts for each such question would
move the corpus again and again.  Here the documents are written once, compressed, with the
number of the writing task as *shard*; the table is bucketed by shard, so later visits read
it in place.  A visit sends small blobs of fingerprints to buckets of the hash range, a
bucket answers each blob, and the next visit reads shards and answers side by side.

* Each chunk of about a megabyte sends a fingerprint once, however often it holds it; one
  that a third of all documents share costs an entry for each chunk, not for each document.
* Buckets are at least ``BUCKETS_PER_PARTITION`` times the shuffle partitions, and one for each
  ``BUCKET_BYTES`` of the stored table, so what one worker holds does not grow with the data.
* The table lies in the folder that spark.checkpoint.dir names; nothing is kept in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.memory import lean, one_group, two_groups
from notarium.session import materialise, scratch_path

CHUNK_BYTES = 1 << 20
BUCKETS_PER_PARTITION = 2
BUCKET_BYTES = 32 << 20
TABLE_BUCKETS_PER_PARTITION = 4
ANSWERS = "shard long, bucket int, chunk int, kind int, blob binary"
_ANSWERS = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("chunk", pa.int32()),
                      ("kind", pa.int32()), ("blob", pa.binary())])

Visit = Callable[[pa.RecordBatch, dict[tuple[int, int], bytes]], Iterator[dict]]


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def cut_batch(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes each; a larger row is a slice of its own."""
    begin = 0
    row = max(1, batch.nbytes // max(1, batch.num_rows))
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    total = np.full(batch.num_rows, 64, np.int64)
    for c in texts:
        total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not texts:
        total += row
    ends = np.cumsum(total)
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def store(docs: DataFrame, label: str) -> DataFrame:
    """Write all rows and columns of ``docs`` as chunks: (shard, chunk, payload)."""
    spark = docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in cut_batch(batch):
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard], pa.int64()), "chunk": pa.array([n], pa.int32()), "payload": [_pack(part)]},
                    schema=pa.schema([("shard", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())]))
                n += 1

    table = f"{label}_{uuid.uuid4().hex}"
    buckets = TABLE_BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.mapInArrow(lean(chunks), "shard long, chunk int, payload binary")
     .write.format("parquet").option("compression", "uncompressed").option("path", scratch_path(spark, label))
     .bucketBy(buckets, "shard").saveAsTable(table))
    return spark.table(table)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of a table written by ``store``."""
    spark, files = table.sparkSession, table.inputFiles()
    if not files:
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def bucket_count(table: DataFrame) -> int:
    least = BUCKETS_PER_PARTITION * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-stored_bytes(table) // BUCKET_BYTES))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; rises with the hash, so sorted hashes lie in runs of one bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_runs(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of each run of equal bucket in sorted hashes."""
    if not len(sorted_hashes):
        return
    numbers = bucket_of(sorted_hashes, buckets)
    edges = np.flatnonzero(np.diff(numbers)) + 1
    begins, ends = np.r_[0, edges], np.r_[edges, len(numbers)]
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        yield int(numbers[b]), b, e


def visit(table: DataFrame, schema: str | pa.Schema, ddl: str, work: Callable, answers: DataFrame | None = None) -> DataFrame:
    """Run ``work(shard, chunk, batch, answers of the shard)`` on every chunk; it yields dicts of columns.

    ``answers`` is a dict (kind, bucket) -> blob of the whole shard.
    """
    def frames(shard: int, rows, known: dict) -> Iterator[pa.RecordBatch]:
        for chunk, payload in rows:
            for out in work(shard, chunk, unpack(payload), known.get(chunk, {})):
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    if answers is None:
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, chunk, payload in zip(*(batch[c].to_pylist() for c in ("shard", "chunk", "payload")), strict=True):
                    yield from frames(shard, [(chunk, payload)], {})

        return table.mapInArrow(lean(alone), ddl)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict = {}
        for chunk, kind, bucket, blob in zip(*(right[c].to_pylist() for c in ("chunk", "kind", "bucket", "blob")), strict=True):
            known.setdefault(chunk, {})[kind, bucket] = blob
        rows = ((c.as_py(), p.as_py()) for c, p in zip(left["chunk"], left["payload"], strict=True))
        shard = left["shard"][0].as_py() if left.num_rows else -1
        return pa.Table.from_batches(list(frames(shard, rows, known)), schema)

    return table.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(two_groups(together), ddl)


def questions(shard: int, chunk: int, kind: int, hashes: np.ndarray, buckets: int, blob_of: Callable) -> dict:
    """Question rows for sorted distinct hashes; ``blob_of(begin, end)`` makes a run's blob."""
    runs = list(bucket_runs(hashes, buckets))
    return {"shard": [shard] * len(runs), "bucket": [r[0] for r in runs], "chunk": [chunk] * len(runs),
            "kind": [kind] * len(runs), "blob": [blob_of(b, e) for _, b, e in runs]}


QUESTIONS = _ANSWERS


def answer(asked: DataFrame, decide: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Let ``decide`` see all blobs of a bucket together and answer each one; None: no answer needed."""
    def whole(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        replies = decide(blobs)
        keep = [i for i, r in enumerate(replies) if r is not None]
        kept = table.take(pa.array(keep, pa.int64()))
        return kept.set_column(kept.schema.get_field_index("blob"), "blob",
                               pa.array([replies[i] for i in keep], pa.binary()))

    return asked.groupBy("bucket").applyInArrow(one_group(whole), ANSWERS)


def repeated(dtype: str) -> Callable[[list[bytes]], list[bytes | None]]:
    """Answer each blob of fingerprints with bits: does another chunk hold the fingerprint too?"""
    def decide(blobs: list[bytes]) -> list[bytes | None]:
        values = np.frombuffer(b"".join(blobs), dtype)
        ordered = np.sort(values)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        hit = np.zeros(len(values), bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
            hit = twice[at] == values
        edges = np.cumsum([0, *(len(b) // values.itemsize for b in blobs)])
        return [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None
                for a, b in zip(edges[:-1], edges[1:], strict=True)]

    return decide


def answered(hashes: np.ndarray, buckets: int, known: dict, kind: int) -> np.ndarray:
    """The bits that came back for sorted distinct hashes; False where no answer came."""
    hit = np.zeros(len(hashes), bool)
    for bucket, b, e in bucket_runs(hashes, buckets):
        blob = known.get((kind, bucket))
        if blob is not None:
            hit[b:e] = np.unpackbits(np.frombuffer(blob, np.uint8), count=e - b).astype(bool)
    return hit


def union_answers(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*(F.col(c) for c in ("shard", "bucket", "chunk", "kind", "blob")))


def kept(answers: DataFrame, label: str) -> DataFrame:
    """Answers written to the shared folder, for those that are read more than once."""
    return materialise(answers, label)
