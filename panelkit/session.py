"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "panelkit", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made only for
    local masters, where driver and executors share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="panelkit-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/panelkit/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    The written files outlive lost executors, so later stages never recompute what came before, values that
    depend on row order are fixed once, and later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Scratch folders this process has written through ``cut_lineage``.
_WRITTEN: list[str] = []


def drop_frames(*frames: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for these frames, once nothing still to be computed reads them: rounds that
    replace a table would else keep every state of it. Frames that ``cut_lineage`` did not return are left alone."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True))


def drop_scratch(spark: SparkSession) -> int:
    """Delete what ``cut_lineage`` wrote, once no result that reads it is needed; returns how many folders."""
    dropped = 0
    while _WRITTEN:
        dropped += _delete(spark, _WRITTEN.pop())
    return dropped
