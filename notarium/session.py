"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import notarium
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job here wants; all can be set on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts of large plans are kept for every query of a session; their beginnings do.
    "spark.sql.maxPlanStringLength": "2000",
    # Keyed stream state beyond memory, and the only store for processors with state.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes what it changed, not the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Send the package's functions along with each job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(notarium)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "notarium") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else a temporary one.

    The fallback is only for single-machine runs, where no cluster names a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folders[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows out to all cores before they grow.

    For tables of few slices whose rows turn into large documents or many rows, such as the
    stand-in tables.  It always shuffles, so readers of real documents don't use it.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write an expensive intermediate once and read it back with lineage cut.

    Used where two branches of a plan read the same decoded documents, so that the
    decoder runs once and a lost executor re-reads files instead of decoding again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
