"""Streams: topic weight per time bin, and the last points of each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import instant

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---------------------------------------------------------------- topic weight per bin
def stream_topic_weights(messages: DataFrame, weights: DataFrame, k: int, width: str, watermark: str,
                         ts: str = "ts", doc: str = "doc_id", message: str = "message_id") -> DataFrame:
    """``(bin_start, bin_end, weights, count)``: sums of the ``k`` topic weights of the messages in each bin.

    ``messages`` (a stream or a table) name a document each; ``weights`` (a table) holds the
    documents' weight arrays. A message counts once, however often it arrives.

    On a stream the watermark runs over the ends of bins: a message is late if its bin has been
    closed. Late messages are left out row by row, before anything is summed, so the engine's
    count of them (:func:`late_rows`) is the number of messages.
    """
    at = F.window(instant(messages, ts), width)
    keyed = messages.withColumns({"bin_start": at["start"], "bin_end": at["end"]}).select(message, doc, "bin_start", "bin_end")
    if messages.isStreaming:
        once = keyed.withWatermark("bin_end", watermark).dropDuplicatesWithinWatermark([message])
    else:
        once = keyed.dropDuplicates([message])
    met = once.join(weights.select(doc, "weights"), doc)
    sums = [F.sum(F.get("weights", F.lit(i))).alias(f"__w{i}") for i in range(k)]
    binned = met.groupBy("bin_end", "bin_start").agg(*sums, F.count(F.lit(1)).alias("count"))
    return binned.select("bin_start", "bin_end", F.array(*[F.col(f"__w{i}") for i in range(k)]).alias("weights"), "count")


def late_rows(query: StreamingQuery) -> DataFrame:
    """``(batch, watermark, rows, late)``: for each batch that the query still reports how many rows came, and how many too late."""
    told = [
        (p.batchId, p.eventTime.get("watermark"), p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators))
        for p in query.recentProgress
    ]
    return SparkSession.active().createDataFrame(told, "batch long, watermark string, rows long, late long")


def record_late_rows(query: StreamingQuery, path: str) -> None:
    """Keep :func:`late_rows` in a table beside the result, a folder for each batch; a batch that is told again replaces its row."""
    spark = SparkSession.active()
    told = late_rows(query)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        told.write.mode("overwrite").partitionBy("batch").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def latest_bins(table: DataFrame, part: list[str], version: str) -> DataFrame:
    """The newest row of each key of a table that update-mode batches were appended to."""
    newest = table.groupBy(*part).agg(F.max(version).alias("__newest")).select(*[F.col(p).alias(f"__{p}") for p in part], "__newest")
    same = (F.col(version) == F.col("__newest"))
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    return table.join(newest, same, "left_semi")


# ---------------------------------------------------------------- last points
def _last(rows: pd.DataFrame, part: list[str], order: list[str], n: int) -> pd.DataFrame:
    ordered = rows.sort_values(order, kind="stable", na_position="first")
    return ordered.groupby(part, sort=False, dropna=False).tail(n)


def _cut(part: list[str], order: list[str], n: int):
    """The last rows of each series within a task, so that a hot series sends few rows through the shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in frames:
            held = _last(rows if held is None else pd.concat([held, rows]), part, order, n)
        if held is not None:
            yield held

    return run


def _plain(value, field: T.StructField):
    """A pandas cell as the state store takes it: no NaN or NaT for a null, no float for a whole number."""
    if value is None or (isinstance(value, (float, type(pd.NaT))) and value != value):
        return None
    return int(value) if isinstance(field.dataType, T.IntegralType) else value


class _LastRows(StatefulProcessor):
    """List state of at most ``n`` rows for a series; a timer drops a series without news."""

    def __init__(self, schema: T.StructType, order: list[str], n: int, ts: str | None):
        self.schema, self.order, self.n, self.ts = schema, order, n, ts

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        new = pd.concat([r[names] for r in rows]).astype(object)
        held = pd.DataFrame(list(self.rows.get()), columns=names, dtype=object) if self.rows.exists() else None
        both = new if held is None else pd.concat([held, new])
        kept = both.sort_values(self.order, kind="stable", na_position="first").tail(self.n)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.rows.put([tuple(map(_plain, r, self.schema.fields)) for r in kept.itertuples(index=False, name=None)])
        self.version.update((version,))
        if self.ts is not None:  # the watermark gets there when the series has been idle for the delay
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            newest = pd.to_datetime(kept[self.ts]).max()
            if newest is not pd.NaT:
                self.handle.registerTimer(int(newest.timestamp() * 1000) + 1)
        yield kept.assign(version=version, pos=range(len(kept)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.version.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_tail(points: DataFrame, part: list[str], order: list[str], n: int, idle: tuple[str, str] | None = None) -> DataFrame:
    """The last ``n`` points of each series of a stream, along ``order``; a missing order value comes first.

    A series that got points in a batch gives all its last points with their ``pos``, from 0, and a
    ``version`` that grows with each such batch; :func:`latest_bins` takes the newest of each series.
    Points are kept in the engine's state store, which must be the one of :data:`STORE`. With
    ``idle``, a timestamp column and a delay, a series whose points are all older than the newest
    point of the stream by more than the delay is forgotten, and points that old are too late.
    """
    out = T.StructType([*points.schema.fields, T.StructField("version", T.LongType()), T.StructField("pos", T.LongType())])
    cut = points.mapInPandas(_cut(part, order, n), points.schema)
    if idle:
        cut = cut.withWatermark(*idle)
    keep = _LastRows(points.schema, order, n, idle[0] if idle else None)
    return cut.groupBy(*part).transformWithStateInPandas(
        statefulProcessor=keep, outputStructType=out, outputMode="Update", timeMode="EventTime" if idle else "None"
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what a stream's source holds now; each batch is a folder ``batch=..`` below ``path``, and a batch that runs again replaces it."""
    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
