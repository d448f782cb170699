"""Session helpers: a builder with the settings the plans rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "counterlake", **conf: str) -> SparkSession:
    """Create a session. On a cluster leave ``master`` unset and size shuffles there."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # call sites in error messages cost several round trips per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this application for intermediate tables, deleted when the application ends.

    It lies in the shared folder that the session names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="counterlake-")
        _FOLDERS[app] = f"{base}/counterlake-{app}-{uuid.uuid4().hex[:8]}"
        _delete_at_end(spark, _FOLDERS[app])
    return _FOLDERS[app]


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """The folder goes when the driver's file systems are closed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the work folder and read it back.

    Several plans can then share the result, their lineage starts at the table, and a lost
    executor costs nothing but a re-read.
    """
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, paths: str | Sequence[str], each: int) -> int:
    """So many partitions that ``each`` bytes of the files or folders make one; at least those of a shuffle."""
    size = 0
    for path in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // each)
