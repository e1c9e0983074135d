"""Session settings, the shared folder, and tables kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder (no master)."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, the same for every executor.

    The cluster names it in ``spark.checkpoint.dir``; where that is not set, it lies
    beside the tables, in the warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again; runs at once.

    For a table that several others are made of: it is computed once, and lost
    executors cost none of it.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts lineage, freezes values."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _files(spark: SparkSession, name: str):
    """A Hadoop path and its file system, whatever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders or files that nothing reads any more."""
    for folder in folders:
        path, files = _files(spark, folder)
        files.delete(path, True)


def touch(spark: SparkSession, name: str) -> None:
    """Write an empty file."""
    path, files = _files(spark, name)
    files.create(path, True).close()


def listed(spark: SparkSession, pattern: str, levels: int = 1) -> list[str]:
    """The last ``levels`` parts of the paths that match a pattern."""
    path, files = _files(spark, pattern)
    found = files.globStatus(path) or []
    return ["/".join(str(f.getPath().toString()).split("/")[-levels:]) for f in found]
