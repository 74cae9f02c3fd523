"""Streams that go on where they stopped: state by key instead of a look at what was written.

A key that has been done is remembered in the state store (RocksDB, on the checkpoint's folder), so a micro-batch reads its own rows and the
state of their keys, however much the target holds. Rows reach the target with the batch's commit, all or none. The first failure, a
repeated key where that is an error included, stops the stream; a new run with the same checkpoint does that batch again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.staging import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Once(StatefulProcessor):
    """Lets each key's only row through; another row of the key, in whatever batch, is an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "at boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for row in rows:
            if self.done.exists():
                raise ValueError(f"repeated id: {key[0]}")
            self.done.update((True,))
            yield row

    def close(self) -> None:
        pass


def once(stream: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The rows of a stream whose key is new to it. ``strict`` makes a repeated key an error; without, its later rows are left out. A null key is a key."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if not strict:
        return stream.dropDuplicates([key])
    ship(stream.sparkSession)
    return stream.groupBy(key).transformWithState(Once(), stream.schema, "Append", "None")


def resumed(stream: DataFrame, target: str, checkpoint: str, key: str, strict: bool = True, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends each new row to the Parquet table ``target`` after ``work`` on it, until what is there has been read, and stops; a second run goes on
    after the last batch that was written."""
    rows = once(stream, key, strict)
    rows = rows if work is None else work(rows)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
