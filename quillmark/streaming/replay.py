"""Structured Streaming forms (section Q): windowed counts, exact sliding limits, progress and append sinks.

The streams replay the events table as a file source with ``availableNow``, so that each runs to its end;
with another source the same functions run without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.sources.tables import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; event time is a timestamp with zone, as watermarks require."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # a file source watches folders
        s = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        s = reader.parquet(f"{sf_dir}/events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and read its output; checkpoint and output lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again overwrites its own folder, so each result stands once
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def hourly_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and sum per hour and event type, late events up to ``late``."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def q2_hourly(spark, sf_dir):
    """Q.1, Q.2: hourly counts as a stream in complete mode."""
    return run_to_table(hourly_counts(event_stream(spark, sf_dir)), "complete", "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


SECONDS, MOST = 3600, 3


def admit(times: list[float], kept: list[float], seconds: int = SECONDS, most: int = MOST) -> tuple[list[bool], list[float]]:
    """Which arrivals are let in when rejected ones do not count, and the arrivals still in the window."""
    out = []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        ok = len(kept) < most
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def q3_admitted(spark, sf_dir):
    """Q.3: exact limit per client as a batch: clients share partitions, rows come sorted, and the state of the
    current client is carried from one Arrow batch to the next, so a client of any size needs ``MOST`` numbers."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, []
        for part in parts:
            ok = []
            for c, us in zip(part.user_id, part.us):
                if c != client:
                    client, kept = c, []
                one, kept = admit([us / 1e6], kept)
                ok += one
            yield pd.DataFrame({"event_id": part.event_id, "admitted": ok})

    return e.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "event_id long, admitted boolean")


def limited_stream(stream: DataFrame) -> DataFrame:
    """Q.3, Q.4: the same limit over a stream; the state of a client is at most ``MOST`` numbers."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        ok, kept = admit((rows.us / 1e6).tolist(), kept)
        state.update((kept,))
        yield pd.DataFrame({"event_id": rows.event_id, "admitted": ok})

    s = stream.select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return s.groupBy("user_id").applyInPandasWithState(step, "event_id long, admitted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def q3_admitted_stream(spark, sf_dir):
    return run_to_table(limited_stream(event_stream(spark, sf_dir)), "append", "limited")


def q8_feedback(spark, sf_dir):
    """Q.8, A.17: feedback rows appended by a stream, then read back."""
    s = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("verdict"))
    return run_to_table(s, "append", "feedback")


QUERIES = {f.__name__: f for f in (q2_hourly, q3_admitted, q3_admitted_stream, q8_feedback)}
ORACLE = {
    "q2_hourly": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "q8_feedback": "SELECT event_id, user_id, CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS INT) AS verdict FROM events WHERE event_type = 'purchase'",
}
