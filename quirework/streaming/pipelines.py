"""Streaming forms of ingest and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirework import schemas
from quirework.operators import chunks as C
from quirework.operators import index as I


def ingest(spark: SparkSession, source: str, index: str, checkpoint: str, archive: str | None = None, embedder=None):
    """Chunk files that arrive in a folder go into a versioned index (operators/index.py): of each chunk the newest file's
    text counts, it replaces all rows of the chunk, and only the buckets concerned are written. Gives the query.

    A batch's tag is its checkpoint and number, so a batch that is run again writes its version again, and a new
    checkpoint goes on from the versions there are.
    """
    r = spark.readStream.schema(schemas.CHUNK).option("pathGlobFilter", "*__chunks.json").option("multiLine", True)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    arrived = r.json(source).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        order = F.struct("_at", "_file", F.monotonically_increasing_id())
        new = I.latest(df.withColumn("_order", order), "chunk_id", "_order").drop("_at", "_file", "_order")
        I.upsert_version(df.sparkSession, index, C.index_rows(new), f"{checkpoint}#{epoch}", embedder)

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(messages: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Messages and sessions of each window of sent_at; messages later than `late` behind the newest are left out."""
    return (
        messages.withColumn("sent_at", F.col("sent_at").cast("timestamp"))
        .withWatermark("sent_at", late)
        .groupBy(F.window("sent_at", window), "role")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("session_id").alias("sessions"))
        .select(F.col("window.start").alias("start"), "role", "n", "sessions")
    )


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, n: int) -> Iterator[pd.DataFrame]:
    turns = {int(t): m for t, m in zip(*state.get)} if state.exists else {}
    for d in batches:
        for t, role, m in zip(d["turn_no"], d["role"], d["message"]):
            turns[int(t)] = f"{role or ''}: {m or ''}"
    last = sorted(turns)[-n:]
    state.update((last, [turns[t] for t in last]))
    yield pd.DataFrame({"session_id": [key[0]], "turns": [len(last)], "history": ["\n".join(turns[t] for t in last)]})


def histories(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each session after each batch that touches it; the state holds n turns for a session. A turn
    received again replaces the first. Ends with updates: session_id, turns, history."""
    return messages.groupBy("session_id").applyInPandasWithState(
        lambda k, it, s: _keep(k, it, s, n), "session_id string, turns int, history string", "turns array<int>, said array<string>", "update", GroupStateTimeout.NoTimeout
    )
