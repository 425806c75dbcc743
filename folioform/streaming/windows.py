"""Windowed and stateful operators on event streams; each also runs on a batch table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.schema import TRANSCRIPT
from folioform.session import shared_dir


def read_transcripts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Transcript events, one JSON object per line, as a table or (new files of a folder) as a stream."""
    return (spark.readStream if stream else spark.read).schema(TRANSCRIPT).json(path)


def write_transcripts(df: DataFrame, path: str) -> None:
    """Transcript events as JSON lines, members without a value left out; files are appended, so a run's events can come in parts."""
    df.select(*[F.col(c.split()[0]) for c in _members(TRANSCRIPT)]).write.mode("append").json(path)


def _members(schema: str) -> list[str]:
    """The members of a schema string; those of nested types stay together."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return out


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet events of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, a file or a folder of files, as a stream of its rows, under the schema it has."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only from a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all that is there now has been read: batches are written to the shared folder, in mode ``complete`` the last one holds."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    at = f"{shared_dir(spark)}/stream-{name}"

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    try:
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    except AnalysisException:  # nothing was read, so nothing was written
        return spark.createDataFrame([], df.schema)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_ts", late) if df.isStreaming else timed


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` per window and key; with ``slide`` the windows slide. Later events than the watermark are dropped from a stream only."""
    w = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    out = _timed(df, ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("win_start"), F.col("w.end").cast("timestamp_ntz").alias("win_end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts per key and session: events less than ``gap`` apart are one session."""
    out = _timed(df, ts, late).groupBy(F.session_window("_ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("win_start"), F.col("w.end").cast("timestamp_ntz").alias("win_end"), *keys, "n")


def dedup_stream(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key; a stream keeps keys as long as the watermark says."""
    timed = _timed(df, ts, late)
    return (timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)).drop("_ts")


def allow(times: list[float], capacity: float, per_second: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """Token bucket: which of the (ascending) times are let through, and the state after."""
    out = []
    for t in times:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, t - last) * per_second)
        last = t
        ok = tokens >= 1
        tokens -= ok
        out.append(bool(ok))
    return out, tokens, last


def token_bucket(df: DataFrame, key: str, ts: str, capacity: float = 10.0, per_second: float = 1.0, idle: str | None = "5 minutes") -> DataFrame:
    """(key, ts, allowed) of a stream: keyed state that refills; a key idle for ``idle`` is forgotten (None: never, for streams that end)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    forget = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("_ts", kind="stable")
        tokens, last = state.get if state.exists else (capacity, None)
        ok, tokens, last = allow([t.timestamp() for t in rows["_ts"]], capacity, per_second, tokens, last)
        state.update((float(tokens), float(last)))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"key": [str(k[0])] * len(rows), "ts": rows["_ts"], "allowed": ok})

    timed = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("_ts"))
    return timed.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def job_states(df: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The latest status of each job; on a stream use output mode ``update`` or ``complete``."""
    return df.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))
