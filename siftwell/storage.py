"""Where plans are cut: the folder shared by all executors, never a machine-local one on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a notebook in local mode) a temporary folder is used;
    outside local mode a missing setting is an error, since executors could not see each other's files.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return named
    own = getattr(spark.sparkContext, "_siftwell_shared", None)
    if own is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
        spark.sparkContext._siftwell_shared = own
    return own


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    Results are lazy, so a table must outlive the call that wrote it. It is deleted by ``cleanup``, or when the
    driver's JVM ends in order; a driver that is killed leaves its tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _path(spark, path)
    written[0].deleteOnExit(written[1])
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _written(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_siftwell_written"):
        context._siftwell_written = []
    return context._siftwell_written


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this session; call it when the results have been used. Returns how many."""
    gone = 0
    while _written(spark):
        files, place = _path(spark, _written(spark).pop())
        gone += bool(files.delete(place, True))
    return gone


def busy_partitions(spark: SparkSession) -> int:
    """Partitions for costly work per row: some for each core, and no fewer than the session's shuffles have."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """A scan ``df`` in enough partitions to keep all cores busy with costly work per row.

    Large inputs are in far more partitions than there are cores and stay where they are; only a small or
    unsplittable input is dealt out evenly (round robin over sorted rows, the same for a recomputed task).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(3 * cores)
