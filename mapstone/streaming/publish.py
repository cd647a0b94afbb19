"""Publishing: events about new versions of stored graphs, as a stream that any number of readers follow.

Every saved graph leaves a row in its store's table of versions. The table is read as a stream; the state of each graph holds the newest
version that nobody was told of. Versions that come close together are one event (the newest, with how many it stands for), told
once nothing has come for DEBOUNCE; a graph about which nothing is new for HEARTBEAT sends a sign of life. Events of a graph come in
the order of its versions, and a version that arrives late, or twice after a restart, isn't told again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds. Fixed values.
DEBOUNCE, HEARTBEAT = 100, 25_000
VERSION = "graph string, version long, at timestamp"
EVENT = "graph string, event string, version long, merged int"
UPDATED, ALIVE = "graph-updated", "heartbeat"


def versions(spark: SparkSession, store_at: str) -> DataFrame:
    """A stream of the versions that a store leaves."""
    return spark.readStream.schema(VERSION).json(f"{store_at.rstrip('/')}/versions")


def events(found: DataFrame, debounce: int = DEBOUNCE, heartbeat: int = HEARTBEAT) -> DataFrame:
    """graph, event, version, merged of a stream of versions."""

    def tell(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, newest, merged = state.get if state.exists else (-1, -1, 0)
        if state.hasTimedOut:
            if merged:
                yield pd.DataFrame({"graph": [key[0]], "event": [UPDATED], "version": [newest], "merged": [merged]})
                told, merged = newest, 0
            else:
                yield pd.DataFrame({"graph": [key[0]], "event": [ALIVE], "version": [told], "merged": [0]})
            state.update((told, newest, merged))
            state.setTimeoutDuration(heartbeat)
            return
        fresh = {int(v) for b in batches for v in b["version"].dropna() if v > max(told, newest if merged else told)}
        if fresh:
            newest, merged = max(fresh), merged + len(fresh)
        state.update((told, newest, merged))
        state.setTimeoutDuration(debounce if merged else heartbeat)

    return found.where(F.col("graph").isNotNull()).groupBy("graph").applyInPandasWithState(tell, EVENT, "told long, newest long, merged int", "append", GroupStateTimeout.ProcessingTimeTimeout)
