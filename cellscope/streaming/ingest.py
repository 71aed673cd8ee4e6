"""Structured Streaming: event and feed streams, windows with watermarks, de-duplicated ingest, snapshots."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..session import remember, shared_dir

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


# Keyed state lives on disk. A run that ends needs no store afterwards, so each is closed, and its working
# folder given up, when its task has committed; checkpoints get a batch's changes instead of the whole store.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with ``ts`` as an instant."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """``start, event_type, n``; with ``late`` set, state beyond the watermark is dropped and late rows with it."""
    s = stream.withWatermark("ts", late) if late else stream
    return s.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, width: str, every: str, late: str) -> DataFrame:
    s = stream.withWatermark("ts", late)
    return s.groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    s = stream.withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Rows whose key was not seen before. Without ``late`` the state holds all keys ever seen."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else stream.dropDuplicates(keys)


def ingest(feed: DataFrame, keys: list[str], history: str, latest: str, checkpoint: str, extra: Callable[[DataFrame, int], None] | None = None):
    """Run a feed to its end: new rows are appended to ``history``, the last batch's whole content replaces ``latest``.

    The history is keyed: a batch that is run again after a failure adds nothing twice, as rows already
    in the history are taken out by an anti-join on their keys.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if _exists(spark, history):
            rows = rows.join(spark.read.parquet(history).select(*keys).distinct(), keys, "left_anti")
        rows.write.mode("append").parquet(history)
        batch.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(latest)
        if extra is not None:
            extra(rows, epoch)

    query = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


BUCKETS = 1024  # a checkpoint holds for this number


def _plain(v: object) -> object:
    """A key's value as Spark's grouping sees it, fit for a dictionary: not-a-number equals itself."""
    if isinstance(v, list | tuple | dict):
        return tuple(map(_plain, v.values() if isinstance(v, dict) else v))
    return v if v == v else "NaN"


class FirstSight(StatefulProcessor):
    """Passes a key's first row on; the key is forgotten when the watermark is ``keep_ms`` past its last row.

    State goes by buckets of keys, as every call to the store costs far more than a key does: a bucket's keys with the instants of
    their last rows are one value, and one timer per bucket is set to the first that ends. A bucket's rows are read one by one, and
    one row of each new key is held, so a hot key needs no more memory than others.
    """

    def __init__(self, keys: list[str], columns: list[str], order: list[str], keep_ms: int):
        self.keys, self.columns, self.order, self.keep_ms = keys, columns, order, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen binary, due long")

    def _read(self, mark: int) -> tuple[dict, int | None]:
        """The keys whose time isn't over, and when the bucket's timer is due."""
        found = self.seen.get()
        if found is None:
            return {}, None
        return {k: ms for k, ms in pickle.loads(found[0]).items() if ms + self.keep_ms > mark}, found[1]  # noqa: S301 - written below

    def _write(self, seen: dict, due: int | None) -> None:
        """``due`` is the time of a timer that is still set."""
        soon = min(seen.values()) + self.keep_ms if seen else None
        if soon != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if soon is not None:
                self.handle.registerTimer(soon)
        if soon is None:
            self.seen.clear()
        else:
            self.seen.update((pickle.dumps(seen, 5), soon))

    def handleInputRows(self, key, rows, timerValues):
        # Timers fire after a batch's rows, so keys whose time is over are left out here too.
        old, due = self._read(timerValues.getCurrentWatermarkInMs())
        seen, first, at = dict(old), {}, None
        for row in rows:
            if at is None:
                names = row.__fields__
                at, by, when = [names.index(c) for c in self.keys], [names.index(c) for c in self.order], names.index("__ms")
            own, ms = tuple([_plain(row[i]) for i in at]), row[when]
            if own not in old:
                rank = (ms, *((row[i] is not None, row[i]) for i in by))
                if own not in first or rank < first[own][0]:
                    first[own] = rank, row
            seen[own] = max(seen.get(own, ms), ms)
        self._write(seen, due)
        for _, row in first.values():
            yield T.Row(**{c: row[c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, _ = self._read(timerValues.getCurrentWatermarkInMs())
        self._write(seen, None)  # the timer that fired is no longer set
        return iter(())

    def close(self) -> None:
        pass


def first_sights(feed: DataFrame, keys: list[str], when: str, keep_ms: int, late: str, order: list[str]) -> DataFrame:
    """The rows of a stream whose key is new, or was last seen ``keep_ms`` or more before the watermark.

    Of a batch's rows of a new key the earliest counts, ties by ``order``. Null keys are keys like others.
    Rows without an instant, or from before the watermark (the latest instant less ``late``), take no part:
    a forgotten key's old rows can't come back as new. Repeated rows pass once.
    """
    timed = feed.filter(F.col(when).isNotNull()).withColumn("__ms", F.unix_millis(when)).withWatermark(when, late)
    dealt = timed.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("__bucket").transformWithState(FirstSight(keys, feed.columns, order, keep_ms), feed.schema, "Append", "EventTime")


def ingest_keyed(feed: DataFrame, keys: list[str], when: str, keep_ms: int, late: str, order: list[str], history: str, checkpoint: str):
    """Run a feed to its end: ``first_sights`` are appended to ``history``, which is never read.

    Keys are state of the stream and leave it by their timers, so a run's work grows with the new rows and
    the keys of the last ``keep_ms``, not with the history. The file sink keeps a log of its batches, so one that
    is run again after a failure adds nothing. The settings of ``STATE`` hold for this query alone.
    """
    spark = feed.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        rows = first_sights(feed, keys, when, keep_ms, late, order)
        query = rows.writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return query


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Results of a bounded stream as a table in the shared folder: in append mode all rows, in complete mode the last batch's.

    Each batch is a folder of its own, written by the executors; the driver only learns its number.
    """
    spark = stream.sparkSession
    path, batches = f"{shared_dir(spark)}/cellscope/stream-{name}-{uuid.uuid4().hex}", []
    remember(spark, path)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{epoch:08d}")
        batches.append(epoch)

    stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    kept = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{epoch:08d}" for epoch in kept])
