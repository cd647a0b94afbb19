"""Events about new versions: ordered, coalesced, and told once."""

import time

from mapstone.schema import EDGE, NODE, Graph
from mapstone.sources.store import Store
from mapstone.streaming import publish


def until(told, n, seconds=60):
    end = time.time() + seconds
    while len(told) < n and time.time() < end:
        time.sleep(0.2)


def test_events_are_ordered_and_coalesced(spark, tmp_path):
    store, told = Store(spark, str(tmp_path / "store")), []
    empty = Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    put = lambda *rows: spark.createDataFrame(rows, "graph string, version long").coalesce(1).write.mode("append").json(f"{store.at}/versions")
    put(("g", 3), ("g", 1), ("g", 2), ("g", 3), ("h", 7), (None, 9))

    def start():
        q = publish.events(publish.versions(spark, store.at), heartbeat=3_600_000).writeStream.outputMode("append").foreachBatch(lambda df, _: told.extend(tuple(r) for r in df.collect()))
        return q.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()

    q = start()
    until(told, 2)
    put(("g", 2), ("g", 5), ("g", 4))
    until(told, 3)
    q.stop()
    assert sorted(told[:2]) == [("g", "graph-updated", 3, 3), ("h", "graph-updated", 7, 1)] and told[2:] == [("g", "graph-updated", 5, 2)]
    q = start()  # goes on where it was
    store.save_graph(empty)
    until(told, 4)
    q.stop()
    assert [x[:2] + x[3:] for x in told[3:]] == [(store.at, "graph-updated", 1)]


def test_a_quiet_graph_sends_signs_of_life(spark, tmp_path):
    told = []
    spark.createDataFrame([("g", 1)], "graph string, version long").write.json(str(tmp_path / "versions"))
    q = publish.events(publish.versions(spark, str(tmp_path)), heartbeat=400).writeStream.outputMode("append").foreachBatch(lambda df, _: told.extend(tuple(r) for r in df.collect()))
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    until(told, 3)
    q.stop()
    assert told[:3] == [("g", "graph-updated", 1, 1), ("g", "heartbeat", 1, 0), ("g", "heartbeat", 1, 0)]
