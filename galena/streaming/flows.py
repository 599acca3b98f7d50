"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform):
    """Files that come into source are transformed once each and appended to sink; a restarted query goes on where the checkpoint ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def latest_operation(stream: DataFrame, key: str, operation: str, value: str) -> DataFrame:
    """Per key the value of its latest operation; late answers to earlier operations change nothing."""
    return stream.groupBy(key).agg(F.max(operation).alias(operation), F.max_by(value, operation).alias(value))


def windowed_counts(stream: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str, event: str, order: str) -> DataFrame:
    """key, turns, status of each batch of a session's events ('open' or a text): turns are taken one after the other in order; a second open is a conflict, a turn before
    it is unknown, and neither changes the state."""

    def step(k, batches, state):
        turns, conflicts, unknown = state.get if state.exists else (-1, 0, 0)
        for pdf in batches:
            for e in pdf.sort_values(order)[event]:
                if e == "open":
                    turns, conflicts = (0, conflicts) if turns < 0 else (turns, conflicts + 1)
                elif turns < 0:
                    unknown += 1
                else:
                    turns += 1
        state.update((turns, conflicts, unknown))
        yield pd.DataFrame({key: [k[0]], "turns": [turns], "conflicts": [conflicts], "unknown": [unknown]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, turns long, conflicts long, unknown long", "turns long, conflicts long, unknown long", "update", "NoTimeout")
