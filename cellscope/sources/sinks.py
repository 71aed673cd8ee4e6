"""Sinks: score shards with a manifest, feature collections, JSON lines and CSV, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe
from ..session import discard, durable


def write_shards(scores: DataFrame, path: str, region: str, prefix_len: int = 4) -> None:
    """Scores by region and code prefix; afterwards the region holds exactly these rows, other regions what they held.

    The region's partitions are replaced one by one when the write commits; prefixes that it had before and
    has no longer are deleted after that, from a listing of the region's own folder.
    """
    spark = scores.sparkSession
    out = durable(scores.withColumns({"region": F.lit(region), "prefix": F.left("k", F.lit(prefix_len))}))
    out.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region", "prefix").parquet(path)
    kept = {f"prefix={r[0] or '__HIVE_DEFAULT_PARTITION__'}" for r in out.select("prefix").distinct().toLocalIterator()}
    own = _hadoop_path(spark, f"{path}/region={region}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(own) if files.exists(own) else []:
        if f.getPath().getName().startswith("prefix=") and f.getPath().getName() not in kept:
            files.delete(f.getPath(), True)
    discard(out)


def upsert_manifest(spark: SparkSession, path: str, entry: DataFrame, key: str = "name") -> DataFrame:
    """The manifest with the entry's rows in place of those of the same name: a new version in a folder beside the old.

    ``path`` holds folders ``v00000001``, ``v00000002``, ...; a version counts once its _SUCCESS file is there, so
    a failure while one is written leaves the version before it in force. Older versions stay.
    """
    hadoop = _hadoop_path(spark, path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(f.getPath().getName()) for f in files.listStatus(hadoop) if files.exists(_hadoop_path(spark, f"{path}/{f.getPath().getName()}/_SUCCESS"))] if files.exists(hadoop) else []
    last = max(done, default=None)
    old = spark.read.schema(entry.schema).json(f"{path}/{last}") if last else entry.limit(0)
    rows = old.join(entry.select(key), key, "left_anti").unionByName(entry)
    version = f"{path}/v{int(last[1:]) + 1 if last else 1:08d}"
    rows.coalesce(1).write.mode("overwrite").json(version)
    return spark.read.schema(entry.schema).json(version)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def write_feature_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, from ``feature`` strings: line-delimited, so it is written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Lists become one cell joined by "; "; cells that a spreadsheet would run are quoted."""
    out = rows
    for name, kind in rows.dtypes:
        if kind.startswith("array<"):
            out = out.withColumn(name, F.array_join(F.transform(name, lambda v: v.cast("string")), "; "))
        elif kind == "string":
            out = out.withColumn(name, csv_safe(F.col(name)))
    out.write.mode("append").option("header", True).csv(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """The current state of a feed, replacing the last one; each record carries the time of writing."""
    rows.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)
