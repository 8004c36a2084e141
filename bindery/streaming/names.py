"""Names that a stream has given away, kept as its state, so that a run costs what is new in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from bindery.session import settings

# state on the executors' disks, not in their memory, without reserving megabytes for each part of it; what changed is
# written, not all; Arrow batches of few texts; a new file costs neither a task to look at nor 4 MB of a task to read
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.files.openCostInBytes": "65536",
}
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings while a stream that keeps names runs."""
    with settings(spark, {**_SETTINGS, _LISTING: str(4 * spark.sparkContext.defaultParallelism)}):
        yield


def run_once(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Give ``write`` everything new in micro-batches, and stop."""
    started = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    started.trigger(availableNow=True).start().awaitTermination()


def _least(frame: pd.DataFrame, order: list[str]) -> int:
    rows = list(zip(*(frame[c].to_list() for c in order), strict=True))
    return rows.index(min(rows))


def first_comers(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of the rows of one ``name`` the least by ``order`` (no nulls) in the first batch that has any; later ones are dropped."""

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if not state.exists:
                both = frame if best is None else pd.concat([best, frame])
                at = _least(both, order) if len(both) > 1 else 0
                best = both.iloc[at : at + 1]
        if best is not None:
            state.update((True,))
            yield best

    return _kept(rows, name, first, rows.schema, "taken boolean")


def least_owners(rows: DataFrame, name: str, rank: str, key: str, blank: str) -> DataFrame:
    """Each row with ``lost``, whether a row of less ``rank`` has its ``name`` by now, and ``instead``.

    ``instead`` is the ``key`` of an earlier batch's owner that this row takes the name from. A row that lost has no
    ``blank``. The state is one rank and key a name. A name's rows in a batch are held together: they are few, one
    for each suffix.
    """

    def settle(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(frames)
        both = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        at, was = _least(both, [rank, key]), tuple(state.get) if state.exists else None
        least = (both[rank].iat[at], both[key].iat[at])
        wins = was is None or least < was
        lost = [not wins or i != at for i in range(len(both))]
        both[blank] = [None if x else v for x, v in zip(lost, both[blank], strict=True)]
        both["lost"] = lost
        both["instead"] = pd.Series([was[1] if was and not x else None for x in lost], index=both.index, dtype=object)
        if wins:
            state.update(least)
        yield both

    schema = StructType([*rows.schema, StructField("lost", BooleanType()), StructField("instead", StringType())])
    return _kept(rows, name, settle, schema, "rank string, key string")


def _kept(rows: DataFrame, name: str, fn: Callable, schema: StructType, state: str) -> DataFrame:
    return rows.groupBy(name).applyInPandasWithState(fn, schema, state, "append", GroupStateTimeout.NoTimeout)
