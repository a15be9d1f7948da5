"""Label text, note tables and arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from notarium.functions.paths import base_name
from notarium.operators.labels import format_label
from notarium.operators.routing import label_target
from notarium.sources.named_text import write_named

LABEL_SCHEMA = "class_id int, norm_x double, norm_y double, norm_w double, norm_h double"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label text files, typed, with the name of their file."""
    return spark.read.csv(folder, sep=" ", schema=LABEL_SCHEMA, pathGlobFilter="*.txt", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), "*"
    )


def write_labels(labels: DataFrame, folder: str) -> None:
    """Label lines in document order, one folder per page; pages without labels get none.

    For exports of so few pages that a folder each is fine; see ``write_label_lines``.

    One page is one document, so hashing on the page keeps tasks even; pages are sorted
    inside their task, and one file per page is open at a time.
    """
    lines = format_label(labels).repartition("file").sortWithinPartitions("file", "ord")
    lines.select("file", "line").write.partitionBy("file").text(folder)


def write_label_files(labels: DataFrame, folder: str, per_folder: int = 0) -> None:
    """One label file a page under its own name (see ``label_target``), lines in document order,
    no newline at the end; a page without labels gets none.  ``per_folder`` as in ``write_named``."""
    named = label_target(format_label(labels)).select(base_name("label_file").alias("name"), "ord", "line")
    write_named(named, folder, per_folder)


def write_label_lines(labels: DataFrame, folder: str, buckets: int = 64) -> None:
    """Label lines of all pages in ``buckets`` folders: name of the label file, place, line.

    For corpora whose pages are too many for a folder each; the name is that of
    ``label_target``.  Lines stay where they are, nothing is shuffled.
    """
    named = label_target(format_label(labels)).select("label_file", "ord", "line")
    named.withColumn("page_bucket", F.pmod(F.xxhash64("label_file"), F.lit(buckets)).cast("int")).write.partitionBy(
        "page_bucket").parquet(folder)


def read_label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_label_lines`` wrote, typed."""
    fields = F.split("line", " ")
    numbers = [fields[i + 1].cast("double").alias(n) for i, n in enumerate(("norm_x", "norm_y", "norm_w", "norm_h"))]
    return spark.read.parquet(folder).select("label_file", "ord", fields[0].cast("int").alias("class_id"), *numbers)


def write_note_events(notes: DataFrame, folder: str, buckets: int = 64, song_key: str = "song_id") -> None:
    """Timed notes as parquet, folders by a bounded hash of the song."""
    notes.withColumn("song_bucket", F.pmod(F.xxhash64(song_key), F.lit(buckets)).cast("int")).write.partitionBy(
        "song_bucket").parquet(folder)


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Every newly arriving input file, without its bytes."""
    return (
        spark.readStream.schema(FILE_SCHEMA).format("binaryFile")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select("path", "modificationTime", "length")
    )


def sink_sound_events(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A stream of sound events to parquet; restarts continue from the checkpoint."""
    return (
        events.writeStream.format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
