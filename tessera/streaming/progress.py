"""Progress of runs and the active dataset of each user, in batch and as streams.

The streaming forms keep one row a key in RocksDB state, which is also the table that readers
query. Rows of a busy key are combined before the shuffle. An entry goes by an event-time timer
once the watermark, one time to live behind the newest event, has passed it; rows that come in
later than that would be expired already and are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.config import ACTIVE_DATASET_TTL, PROGRESS_TTL

LAST_STEP = 6
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on local disk instead of the heap; it is backed up per micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# ---------------------------------------------------------------- batch forms

def latest(df: DataFrame, key: str, values: list[str], ttl: int, now: Column | None = None
           ) -> DataFrame:
    """Last values per key that are not older than ``ttl`` seconds at ``now``.

    A grouped maximum: it combines before the shuffle, so a busy key costs no more than others.
    """
    last = df.groupBy(key).agg(F.max_by(F.struct(*values, "ts"), "ts").alias("s")).select(
        key, "s.*")
    if now is None:
        return last
    return last.where(F.col("ts") > now - F.make_interval(secs=F.lit(ttl)))


def latest_progress(df: DataFrame, now: Column | None = None) -> DataFrame:
    return latest(df, "training_id", ["step", "step_index", "model_name"], PROGRESS_TTL, now)


def active_datasets(df: DataFrame, now: Column | None = None) -> DataFrame:
    return latest(df, "user_id", ["files_key", "filename"], ACTIVE_DATASET_TTL, now)


def feed(df: DataFrame) -> DataFrame:
    """Events of each run up to and including its first final step."""
    return _until(df, _ends(df))


def _ends(df: DataFrame) -> DataFrame:
    return df.where(F.col("step_index") == LAST_STEP).groupBy("training_id").agg(
        F.min("ts").alias("end"))


def _until(df: DataFrame, ends: DataFrame) -> DataFrame:
    return (df.join(ends, "training_id", "left")
            .where(F.col("end").isNull() | (F.col("ts") <= F.col("end"))).drop("end"))


# ---------------------------------------------------------------- streaming forms

def _millis(ts: pd.Timestamp) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class Latest(StatefulProcessor):
    """Keeps the newest row of a key until the watermark has passed it, and tells of each change."""

    def __init__(self, key: str, schema: T.StructType):
        self.key, self.columns = key, [f.name for f in schema if f.name != key]
        self.kept = T.StructType([f for f in schema if f.name != key])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, new = (self.state.get() if self.state.exists() else None), None
        for pdf in rows:
            row = pdf.loc[pdf["ts"].idxmax()]
            if new is None or row["ts"] > new["ts"]:
                new = row
        at = self.columns.index("ts")
        if new is None or old is not None and pd.Timestamp(old[at]) > new["ts"]:
            return
        if old is not None:
            self.handle.deleteTimer(_millis(old[at]) + 1)
        values = [None if pd.isna(v) else v.item() if hasattr(v, "item") else v
                  for v in (new[c] for c in self.columns)]
        values[at] = new["ts"].to_pydatetime()
        self.state.update(tuple(values))
        self.handle.registerTimer(_millis(new["ts"]) + 1)
        yield pd.DataFrame({self.key: [key[0]], **{c: [new[c]] for c in self.columns}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class Feed(StatefulProcessor):
    """Lets the rows of a run pass up to its first final step, which it remembers for a while."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))[self.columns]
        old = pd.Timestamp(self.end.get()[0]) if self.end.exists() else None
        last = pdf.loc[pdf["step_index"] == LAST_STEP, "ts"]
        end = min([*([old] if old is not None else []), *([last.min()] if len(last) else [])],
                  default=None)
        if end is not None and end != old:
            if old is not None:
                self.handle.deleteTimer(_millis(old) + 1)
            self.end.update((end.to_pydatetime(),))
            self.handle.registerTimer(_millis(end) + 1)
        yield pdf if end is None else pdf[pdf["ts"] <= end]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.end.clear()
        yield from ()

    def close(self) -> None:
        pass


def _stream_latest(stream: DataFrame, key: str, values: list[str], ttl: int) -> DataFrame:
    """Update stream of the newest values per key; the state named "latest" is the table itself."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select(key, *values, "ts")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])

    def newest(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[pdf.groupby(key, sort=False)["ts"].idxmax()]

    return (rows.mapInPandas(newest, rows.schema).withWatermark("ts", f"{ttl} seconds").groupBy(key)
            .transformWithStateInPandas(Latest(key, schema), schema, "Update", "EventTime"))


def stream_latest_progress(stream: DataFrame) -> DataFrame:
    return _stream_latest(stream, "training_id", ["step", "step_index", "model_name"],
                          PROGRESS_TTL)


def stream_active_datasets(stream: DataFrame) -> DataFrame:
    return _stream_latest(stream, "user_id", ["files_key", "filename"], ACTIVE_DATASET_TTL)


def run_available(stream: DataFrame, checkpoint: str, once: bool = True):
    """Keep the table of an update stream up to date in the state at ``checkpoint``.

    With ``once`` the rows that are there are processed and the query ends; otherwise the running
    query is returned.
    """
    return _start(stream.writeStream.format("noop").outputMode("update"), checkpoint, once)


def stream_feed(stream: DataFrame) -> DataFrame:
    """Progress events, ending each run's events at its first final step.

    The end of a run is kept in its state, and goes with a timer as the progress itself does.
    """
    use_rocksdb(stream.sparkSession)
    columns = stream.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    return (stream.withWatermark("ts", f"{PROGRESS_TTL} seconds").groupBy("training_id")
            .transformWithStateInPandas(Feed(columns), schema, "Append", "EventTime"))


def run_feed(stream: DataFrame, sink: str, checkpoint: str, once: bool = True):
    """Write the feed to ``sink`` as it grows."""
    return _start(stream_feed(stream).writeStream.outputMode("append").format("parquet")
                  .option("path", sink), checkpoint, once)


def _start(writer, checkpoint: str, once: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Newest row per key that hasn't expired: the state of an update stream, one row a key."""
    rows = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return rows.select("key.*", "value.*")
