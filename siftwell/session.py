"""A session with the settings the plans are written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(name: str = "siftwell", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """``master`` and ``partitions`` are for local runs; on a cluster its own settings hold.

    Adaptive execution coalesces small shuffle partitions and splits skewed ones; shuffle partitions should
    be about the shuffled bytes over 128 MB there. ``spark.checkpoint.dir`` names the folder shared by executors.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", "4g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run and whatever their working folder is; once per context."""
    context = spark.sparkContext
    if getattr(context, "_siftwell_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftwell-")) / "siftwell.zip"  # read on the driver only, served to executors by Spark
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for file in sorted(root.rglob("*.py")):
            bundle.write(file, str(Path("siftwell") / file.relative_to(root)))
    context.addPyFile(str(archive))
    context._siftwell_shipped = True
