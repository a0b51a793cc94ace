"""Event-time aggregates and per-document state, for batches and for streams.

An extension: the fact engine's documents arrive one by one, so its state lives from
a document's first fact to its barrier, and is then dropped but for permanent facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, size: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def stream_of(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def consume_documents(facts: DataFrame, doc: str) -> DataFrame:
    """Batch form of the barrier: every document's facts are consumed once."""
    return facts.groupBy(doc).agg(F.count("*").alias("consumed"))


def barrier_stream(facts: DataFrame, doc: str = "docid", cmd: str = "cmd") -> DataFrame:
    """Stream form: facts of a document count up until its ``done`` line, which emits and clears its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n = held.get[0] if held.exists else 0
        done = False
        for pdf in batches:
            n += int((pdf[cmd] != "done").sum())
            done |= bool((pdf[cmd] == "done").any())
        if done:
            if held.exists:
                held.remove()
            yield pd.DataFrame({doc: [key[0]], "consumed": [n]})
        else:
            held.update((n,))

    kind = dict(facts.dtypes)[doc]
    return facts.groupBy(doc).applyInPandasWithState(step, f"{doc} {kind}, consumed long", "n long", "append", GroupStateTimeout.NoTimeout)


def reset(state: DataFrame, schema_mark: str = "is_schema") -> DataFrame:
    """State with everything but the permanent facts dropped."""
    return state.where(F.col(schema_mark))


def listen(stream: DataFrame, consumer, checkpoint: str):
    """Calls ``consumer(facts, epoch)`` for every micro-batch."""
    return stream.writeStream.foreachBatch(consumer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
