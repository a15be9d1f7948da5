"""Files of a folder as a table, listed by tasks instead of the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED_SCHEMA = "path string, modificationTime timestamp, length bigint"
_ENTRY_SCHEMA = f"{LISTED_SCHEMA}, is_folder boolean"
BATCH = 10_000


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or an address."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.removeprefix("file:"))


def _entries(folder: str, below: bool) -> Iterator[pa.RecordBatch]:
    """What lies in a folder; with ``below`` its sub-folders are gone through one after the other instead of shown."""
    files, top = file_system(folder)
    address = folder[:-len(top)] if "://" in folder and folder.endswith(top) else ""
    waiting = [top]
    while waiting:
        found = [f for f in files.get_file_info(fs.FileSelector(waiting.pop())) if not f.base_name.startswith(("_", "."))]
        folders = [f.type == fs.FileType.Directory for f in found]
        if below:
            waiting += [f.path for f, inner in zip(found, folders) if inner]
            found, folders = [f for f, inner in zip(found, folders) if not inner], [False] * (len(found) - sum(folders))
        for at in range(0, len(found), BATCH):
            part = found[at:at + BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array([address + f.path for f in part], pa.string()),
                 pa.array([(f.mtime_ns or 0) // 1000 for f in part], pa.timestamp("us", "UTC")),
                 pa.array([f.size for f in part], pa.int64()), pa.array(folders[at:at + BATCH], pa.bool_())],
                ["path", "modificationTime", "length", "is_folder"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length`` of every file in a folder and below it; hidden names are left out.

    One task lists the folder itself, and its sub-folders are dealt out to tasks.  The driver is
    told nothing of single files, so their number costs it no memory; a task holds the names of one
    folder, hence very many files belong in sub-folders (``named_text.write_named`` with ``per_folder``).
    """
    def entries(below: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    yield from _entries(path, below)

        return run

    top = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path")).mapInArrow(entries(False), _ENTRY_SCHEMA)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    inner = top.filter("is_folder").select("path").repartition(tasks).mapInArrow(entries(True), _ENTRY_SCHEMA)
    return top.filter("NOT is_folder").unionByName(inner).drop("is_folder")


def write_listing(spark: SparkSession, folder: str, listing: str) -> None:
    """Add the files now in a folder to a listing, in lists of ``BATCH`` files at most.

    Files listed before are listed again; ``streaming.live.first_arrivals`` takes each once.
    """
    list_files(spark, folder).write.mode("append").option("maxRecordsPerFile", BATCH).parquet(listing)


def stream_listing(spark: SparkSession, listing: str, lists_per_batch: int = 100) -> DataFrame:
    """Every file of a listing as a stream; the driver keeps account of lists, not of files."""
    return spark.readStream.schema(LISTED_SCHEMA).option("maxFilesPerTrigger", lists_per_batch).parquet(listing)


def list_count(spark: SparkSession, listing: str) -> int:
    return len(spark.read.schema(LISTED_SCHEMA).parquet(listing).inputFiles())
