"""Streams of events and files: windows over late data, states per item, files that came to rest."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.session import checkpoint_dir


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """window start, event_type, n, total of a stream (or table) with ``ts``; later events than ``late`` are let go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def failure_counts(events: DataFrame) -> DataFrame:
    """user_id, failures, status: failures since the last success of each item, two or more make it failed."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, newest = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for number, kind in zip(rows.event_id, rows.event_type):
            if number <= newest:
                continue
            failures = 0 if kind == "purchase" else failures + (kind == "error")
            newest = number
        state.update((int(failures), int(newest)))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [int(failures)], "status": ["failed" if failures >= 2 else "queued"]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, failures int, status string", "failures int, newest bigint", "update", GroupStateTimeout.NoTimeout
    )


def files_at_rest(listings: DataFrame, quiet: float = 10.0) -> DataFrame:
    """path, size, modified, at of files whose size and time stayed equal for ``quiet`` seconds of observations (path, size, modified, at).

    A clock that goes back begins the wait anew; each state of a file is reported once.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, modified, since, told = state.get if state.exists else (-1, 0.0, 0.0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            if (r.size_, r.modified) != (size, modified) or r.at < since:
                size, modified, since, told = int(r.size_), float(r.modified), float(r.at), False
            elif not told and r.at - since >= quiet:
                told = True
                out.append((key[0], size, modified, float(r.at)))
        state.update((size, modified, since, told))
        yield pd.DataFrame(out, columns=["path", "size", "modified", "at"])

    named = listings.select("path", F.col("size").alias("size_"), "modified", "at")
    return named.groupBy("path").applyInPandasWithState(
        step, "path string, size bigint, modified double, at double", "size bigint, modified double, since double, told boolean", "append", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all input that is there now, written by the executors to the shared folder.

    ``complete`` keeps the last batch; ``update`` the newest row of each of ``keys``; ``append`` all rows.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}_{uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.select("*", F.lit(0).cast("bigint").alias("batch")).schema).parquet(f"{base}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        value = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("newest")).select(*keys, "newest.*")
    return rows.select(*stream.columns)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
