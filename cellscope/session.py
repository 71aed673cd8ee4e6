"""A session with the settings that the engine's plans expect, and tables that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "cellscope", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; further settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    In a local session without that setting, as in tests, a temporary folder takes its place; on a cluster,
    where it would be another folder on every machine, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellscope-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellscope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remember(spark: SparkSession, path: str) -> None:
    """Have ``path``, written below the shared folder, deleted with the tables of this session."""
    _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove((spark, path))


def discard(df: DataFrame) -> None:
    """Delete the table behind what ``durable`` returned, once nothing reads it any more."""
    _delete(df.sparkSession, df.stored_at)


def forget_stored(spark: SparkSession) -> None:
    """Delete the tables that ``durable`` has written in this session; results read from them are gone too."""
    for own, path in list(_written):
        if own is spark:
            _delete(own, path)


@atexit.register
def _leave_nothing() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            forget_stored(spark)
        except Exception:  # noqa: BLE001, S110 - the session may have ended, and its folder with it
            pass
