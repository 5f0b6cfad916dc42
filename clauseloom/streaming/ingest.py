"""Continuous forms of the two incremental steps: new files, and session history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from clauseloom.functions.text import preprocess_text, sha256, token_count
from clauseloom.operators.search import HISTORY_LENGTH


def stream_chunks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Chunk files as they arrive; the checkpoint remembers which ones were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepare_stream(chunks: DataFrame) -> DataFrame:
    """Stateless preparation of arriving chunks."""
    prepared = chunks.withColumn("preprocessed_final_content", preprocess_text(F.col("content")))
    return prepared.withColumn("preprocessed_token_count", token_count(F.col("preprocessed_final_content"))).withColumn(
        "preprocessed_sha256", sha256(F.col("preprocessed_final_content"))
    )


def ingest(chunks: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Prepare everything a chunk stream has not delivered before, then stop."""
    return (
        prepare_stream(chunks)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


HISTORY_SCHEMA = "session_id string, seq long, role string, content string"
SNAPSHOT_SCHEMA = f"{HISTORY_SCHEMA}, round long"
CLEAR = "clear"  # the role of a message that clears its session up to its own number
_KEPT_SCHEMA = "seq long, role string, content string"
_PLACE_SCHEMA = "round long, listed long, cleared long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionHistory(StatefulProcessor):
    """The last ``keep`` messages of a session as a list that grows by appends.

    Only new messages are written; the list is cut back to ``keep`` when it holds twice as
    many, so a message is rewritten at most about once however long the session runs.
    """

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _KEPT_SCHEMA, self.idle_ms)
        self.place = handle.getValueState("place", _PLACE_SCHEMA, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        round_, listed, before = self.place.get() if self.place.exists() else (0, 0, None)
        cleared, new = before, []
        for frame in rows:
            clears = frame.loc[(frame["role"] == CLEAR) & frame["seq"].notna(), "seq"]
            if len(clears):
                cleared = max(int(clears.max()), cleared if cleared is not None else int(clears.max()))
            told = frame[(frame["role"] != CLEAR) & frame["seq"].notna()]
            new.extend(zip(told["seq"].astype(int), *(told[name].where(told[name].notna(), None) for name in ("role", "content"))))
            new = self._last(new, cleared)
        held = [tuple(row) for row in self.kept.get()] if listed else []
        last = self._last(held + new, cleared)
        if cleared != before or listed + len(new) > 2 * self.keep:
            if last:
                self.kept.put(last)
            elif listed:
                self.kept.clear()
            listed = len(last)
        elif new:
            self.kept.appendList(new)
            listed += len(new)
        self.place.update((round_ + 1, listed, cleared))
        # A cleared session shows as one row without a message.
        shown = pd.DataFrame(last or [(None, None, None)], columns=["seq", "role", "content"]).astype({"seq": "Int64"})
        yield shown.assign(session_id=key[0], round=round_ + 1)[["session_id", "seq", "role", "content", "round"]]

    def _last(self, rows: list[tuple], cleared: int | None) -> list[tuple]:
        """The last messages after the cleared number; of equal numbers those that came last."""
        open_ = rows if cleared is None else [row for row in rows if row[0] > cleared]
        return sorted(open_, key=lambda row: row[0])[-self.keep :]

    def close(self) -> None:
        pass


def session_histories(messages: DataFrame, keep: int = HISTORY_LENGTH, idle_ms: int | None = None) -> DataFrame:
    """The last ``keep`` messages of every session touched by a micro-batch, with the session's ``round``.

    Messages of role ``clear`` remove all messages of their session up to their own number,
    also those that arrive later; a session left without messages gives one row whose ``seq``
    is null.  Messages without a number are left out.  With ``idle_ms`` messages expire that
    long after they were written, and a session that is gone starts at round one again.

    A round is never changed afterwards, so the stream is written in append mode, to files as well.
    State lies in RocksDB, which ``stateful_session`` sets for a session.
    """
    mode = "none" if idle_ms is None else "processingTime"
    return messages.groupBy("session_id").transformWithStateInPandas(
        SessionHistory(keep, idle_ms), SNAPSHOT_SCHEMA, "Append", mode
    )


def stateful_session(spark: SparkSession, stores: int | None = None) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB.

    Expired messages are never read, so no batches without data are run to remove them; with
    such batches a stream that has expiry would not end by itself.  ``stores`` is the number of
    stores that sessions are dealt to, fixed for the life of a stream's checkpoint; by default
    that of shuffle partitions.  Stores upload changes instead of whole files, and reserve no
    disk space ahead, which small ones would never fill.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    if stores is not None:
        own.conf.set("spark.sql.shuffle.partitions", str(stores))
    return own


def latest_histories(snapshots: DataFrame) -> DataFrame:
    """Each session's messages in its latest round; cleared sessions have none."""
    rounds = snapshots.groupBy("session_id").agg(F.max("round").alias("round"))
    return snapshots.join(rounds, ["session_id", "round"]).where(F.col("seq").isNotNull()).drop("round")


def keep_histories(snapshots: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream of snapshots has not delivered before as Parquet, then stop."""
    return (
        snapshots.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
