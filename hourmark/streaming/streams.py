"""Structured Streaming forms of the batch rules. Extensions: the batch side has no streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that the keys of ``keep_last_stream`` are dealt to; part of its state, so it stays as it is.
BUCKETS = 256


def read_parquet_stream(spark: SparkSession, folder: str, like: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over ``folder`` restricted to ``pattern``; schema taken from one file's footer."""
    schema = spark.read.parquet(like).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def hourly_stream(readings: DataFrame, keys: list[str], ts: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Hourly mean and count per key; an hour is emitted once the watermark passes its end."""
    windowed = readings.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 hour").alias("_w"))
    out = windowed.agg(F.avg(value).alias("power_mean_w"), F.count(value).alias("intervals"))
    return out.select(*keys, F.col("_w.start").alias("valid_time_utc"), F.col("_w.end").alias("available_at_utc"), "power_mean_w", "intervals")


def deduplicated_stream(records: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First record per key within the watermark (the batch rule keeps the last)."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def keep_last_stream(records: DataFrame, keys: list[str], ts: str, delay: str = "1 hour", hold_seconds: int = 3600) -> DataFrame:
    """Last record per key, the batch rule on a stream: emitted once no newer one can come.

    State holds one record per open key, the newest by ``ts`` (ties: by the other
    columns in order, nulls first). It is handed on and forgotten when the watermark is
    ``hold_seconds`` past it; a key seen again after that is a new one. Records
    behind the watermark are dropped before they get here, those without ``ts`` too.

    Keys are dealt to ``BUCKETS`` groups by hash, and a group's open records are one
    Arrow table: a call and a state entry per group, not per key.
    """
    rest = [c for c in records.columns if c not in (*keys, ts)]
    shown = [*keys, ts, *rest]
    kinds = {c: records.schema[c].dataType for c in shown}
    stamps = [c for c in shown if isinstance(kinds[c], T.TimestampType)]  # travel as microseconds, so no time zone touches them
    schema = T.StructType([T.StructField(c, T.LongType() if c in stamps else kinds[c]) for c in shown])
    arrow = to_arrow_schema(schema)
    hold = hold_seconds * 1000

    def newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tables = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        if not state.hasTimedOut:
            tables += [pa.Table.from_pandas(part[shown], schema=arrow, preserve_index=False) for part in parts]
        table = _last_of_key(pa.concat_tables(tables), keys, [ts, *rest])
        due = np.floor_divide(table.column(ts).to_numpy(), 1000) + hold
        closed = due < state.getCurrentWatermarkMs()
        out, open_ = table.filter(pa.array(closed)), table.filter(pa.array(~closed))
        if open_.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, arrow, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(open_)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(due[~closed].min()), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000).to_pandas(integer_object_nulls=True)

    dealt = records.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"), F.col(ts).alias("_at"), *[F.unix_micros(c).alias(c) if c in stamps else F.col(c) for c in shown]
    )
    last = dealt.groupBy("_bucket").applyInPandasWithState(newest, schema, "open binary", "append", GroupStateTimeout.EventTimeTimeout)
    return last.select(*[F.timestamp_micros(c).alias(c) if c in stamps else F.col(c) for c in records.columns])


def _last_of_key(table: pa.Table, keys: list[str], order: list[str]) -> pa.Table:
    """The last row of each key in ascending ``order``; nulls come first, and null keys are equal."""
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (*keys, *order)], null_placement="at_start")).combine_chunks()
    n = table.num_rows
    last = np.ones(n, bool)
    if n > 1:
        last[:-1] = False
        for c in keys:
            here, after = table.column(c).slice(0, n - 1), table.column(c).slice(1)
            other = pc.coalesce(pc.not_equal(here, after), pc.xor(pc.is_null(here), pc.is_null(after)))
            last[:-1] |= other.to_numpy()
    return table.filter(pa.array(last))


def joined_error_stream(
    actuals: DataFrame, forecasts: DataFrame, keys: list[str], actual_ts: str, forecast_ts: str, actual: str, forecast: str,
    apart: str = "1 hour", window: str = "1 day", delay: str = "1 hour",
) -> DataFrame:
    """Absolute forecast error per window from two streams: rows and mean.

    Both sides have a watermark and stamps may lie ``apart`` at most, so either
    side keeps only what a partner may still come for.
    """
    span = F.expr(f"INTERVAL {apart}")
    left = actuals.withWatermark(actual_ts, delay).select(*keys, F.col(actual_ts).alias("_t"), F.col(actual).alias("_a"))
    right = forecasts.withWatermark(forecast_ts, delay).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(forecast_ts).alias("_u"), F.col(forecast).alias("_f"))
    same = (F.col("_u") >= F.col("_t") - span) & (F.col("_u") <= F.col("_t") + span)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    scored = left.join(right, same)
    out = scored.groupBy(F.window("_t", window).alias("_w")).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("_a") - F.col("_f"))).alias("mae"))
    return out.select(F.col("_w.start").alias("window_start"), "rows", "mae")


def error_stream(actuals: DataFrame, predictions: DataFrame, join: list[str], ts: str, actual: str, prediction: str,
                 window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Stream-static join of actuals to predictions, absolute error averaged per window."""
    scored = actuals.withWatermark(ts, delay).join(predictions, join)
    out = scored.groupBy(F.window(ts, window).alias("_w")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col(actual) - F.col(prediction))).alias("mae")
    )
    return out.select(F.col("_w.start").alias("window_start"), "rows", "mae")


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Drain what is available into a Parquet sink (exactly once) and stop."""
    running = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return running
