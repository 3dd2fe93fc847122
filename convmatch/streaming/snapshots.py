"""Streams of conversation snapshots: change detection, debounce and live similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def content_hash(messages: str) -> Column:
    return F.xxhash64(F.to_json(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))))


def changed(df: DataFrame, key: str, order: list[str], value: str, ts: str | None = None, silence: float | None = None) -> DataFrame:
    """Batch twin: rows whose value differs from the previous one of their key; with ``silence`` also
    those that come more than so many seconds after it, by ``ts``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))
    df = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    if silence is None:
        return df.where(new).drop("_p", "_n")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_g", at - F.lag(at).over(w)).where(new | (F.col("_g") > silence * 1e6)).drop("_p", "_n", "_g")


def settled(df: DataFrame, key: str, ts: str, order: list[str], seconds: float = 1.0) -> DataFrame:
    """Batch twin of the debounce: rows that no row of the key follows within ``seconds``."""
    w = Window.partitionBy(key).orderBy(*order)
    nxt = F.unix_micros(F.lead(F.col(ts).cast("timestamp")).over(w)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_g", nxt).where(F.col("_g").isNull() | (F.col("_g") > seconds * 1e6)).drop("_g")


def settled_or_first(df: DataFrame, key: str, ts: str, order: list[str], seconds: float = 1.0) -> DataFrame:
    """The first snapshot of a key is not held back."""
    w = Window.partitionBy(key).orderBy(*order)
    nxt = F.unix_micros(F.lead(F.col(ts).cast("timestamp")).over(w)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_g", nxt).withColumn("_n", F.row_number().over(w)).where("_n = 1 or _g is null or _g > %f" % (seconds * 1e6)).drop("_g", "_n")


def changed_stream(stream: DataFrame, key: str, value: str, ts: str, late: str = "10 seconds", silence: int = 86_400) -> DataFrame:
    """Stream of (key, value, ts) without repeats of the last value.

    State: the last value and time of a key, until ``silence`` seconds pass without a row of it; it
    goes when the watermark has passed that time.  A value that comes again after such a
    silence is new, whether its state is gone by then or not.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values([ts, value], kind="stable")
        keep = []
        for v, t in zip(rows[value], rows[ts].astype("datetime64[us]").astype("int64")):
            keep.append(at is None or v != last or t - at > silence * 1_000_000)
            last, at = v, int(t)
        state.update((last, at))
        state.setTimeoutTimestamp(max(at // 1000 + silence * 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.loc[keep, [key, value, ts]]

    out = f"{key} {kinds[key]}, {value} {kinds[value]}, {ts} timestamp"
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stream.select(key, value, ts).groupBy(key).applyInPandasWithState(run, out, f"last {kinds[value]}, at long", "append", GroupStateTimeout.EventTimeTimeout)


def debounced_stream(stream: DataFrame, key: str, value: str, ts: str, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """The last snapshot of every burst: session windows with a gap of ``seconds``."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = s.groupBy(key, F.session_window(ts, f"{seconds} seconds").alias("w")).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
    return g.select(key, value, ts)


def ready(messages: str, title: str) -> Column:
    """Title, two messages or more, and a last one by the assistant of over one character."""
    last = F.try_element_at(F.col(messages), F.lit(-1))
    return F.coalesce(F.col(title).isNotNull() & (F.size(messages) >= 2) & (last["role"] == "assistant") & (F.length(last["content"]) > 1), F.lit(False))


def should_process(snapshots: DataFrame, states: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Add ``go``: unknown yes, in process no, failed or done with the same hash no, else yes."""
    s = states.select(key, F.col("status").alias("_st"), F.col("content_hash").alias("_h"))
    same = F.col("content_hash").eqNullSafe(F.col("_h"))
    go = F.when(F.col("_st").isNull(), True).when(F.col("_st") == "processing", False).when(F.col("_st").isin("error", "completed") & same, False).otherwise(True)
    return snapshots.join(s, key, "left").withColumn("go", go).drop("_st", "_h")


def run_live(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, key: str = "conversation_id", ts: str = "ts"):
    """``foreachBatch``: the latest snapshot of every conversation goes to ``handle``, which
    reuses or makes vectors, upserts them and searches; once over what is there."""

    def batch(df: DataFrame, epoch: int) -> None:
        latest = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), ts).alias("r")).select(key, "r.*")
        handle(latest, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
