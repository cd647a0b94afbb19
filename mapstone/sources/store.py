"""Graphs at rest: Parquet, one folder for each snapshot, written once; JSON for exchange."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, NODE, Graph, validate


class Store:
    """Snapshots below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at.rstrip("/")

    def _path(self, part: str, snapshot: str) -> str:
        return f"{self.at}/{part}/snapshot_id={snapshot}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save_graph(self, graph: Graph) -> None:
        """The current graph, replaced as a whole; leaves a row in the table of versions, for those who follow it."""
        for part, df in (("nodes", graph.nodes), ("edges", graph.edges)):
            df.write.mode("overwrite").parquet(self._path(part, "current"))
        row = self.spark.range(1).select(F.lit(self.at).alias("graph"), F.lit(time.time_ns() // 1_000_000).alias("version"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").json(f"{self.at}/versions")

    def load_graph(self, snapshot: str = "current") -> Graph:
        """Fails loudly if the graph is missing or not valid."""
        if not self._exists(self._path("nodes", snapshot)):
            raise FileNotFoundError(f"no graph {snapshot}; analyze first")
        g = Graph(self.spark.read.schema(NODE).parquet(self._path("nodes", snapshot)), self.spark.read.schema(EDGE).parquet(self._path("edges", snapshot)))
        validate(g)
        return g

    def has_snapshot(self, sha: str) -> bool:
        return self._exists(self._path("nodes", sha) + "/_SUCCESS") and self._exists(self._path("edges", sha) + "/_SUCCESS")

    def save_snapshot(self, graph: Graph, git: dict | None) -> bool:
        """Keep a graph under its commit. Refused without a repository and for a tree with changes; kept ones stay."""
        if not git or git.get("dirty"):
            return False
        if not self.has_snapshot(git["sha"]):
            for part, df in (("nodes", graph.nodes), ("edges", graph.edges)):
                df.write.mode("overwrite").parquet(self._path(part, git["sha"]))
        return True

    def load_snapshot(self, sha: str) -> Graph | None:
        """None if it isn't there or can't be read; it can be built again."""
        try:
            return self.load_graph(sha) if self.has_snapshot(sha) else None
        except Exception:  # noqa: BLE001  a stale snapshot is a miss, whatever is wrong with it
            return None

    def load_snapshots(self, shas: list[str]) -> Graph:
        """The kept graphs of commits in one: nodes and edges with a column snapshot. Only the folders of these commits are read."""

        def part(name: str, ddl: str) -> DataFrame:
            rows = self.spark.read.schema(f"{ddl}, snapshot_id string").parquet(f"{self.at}/{name}")
            return rows.where(F.col("snapshot_id").isin(*shas)).withColumnRenamed("snapshot_id", "snapshot")

        return Graph(part("nodes", NODE), part("edges", EDGE))

    def compact_facts(self, used: DataFrame | None = None, per_file: int = 50_000) -> int:
        """Write the kept facts, appended run by run, anew: each key once, with `used` (key) only those, in files of about `per_file` rows sorted
        by key, so that a look-up skips what can't hold its keys. Returns how many stay. The old files go when the new ones are whole."""
        at = f"{self.at}/facts"
        if not self._exists(at):
            return 0
        kept = self.spark.read.parquet(at).dropDuplicates(["key"])
        kept = kept if used is None else kept.join(used.select("key").distinct(), "key", "left_semi")
        n = self.spark.read.parquet(at).select("key").distinct().count()
        fresh, old = f"{self.at}/facts-new", f"{self.at}/facts-old"
        kept.repartitionByRange(max(1, -(-n // per_file)), "key").sortWithinPartitions("key").write.mode("overwrite").parquet(fresh)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(old), True)
        fs.rename(path(at), path(old))
        fs.rename(path(fresh), path(at))
        fs.delete(path(old), True)
        return self.spark.read.parquet(at).count()

    def list_snapshots(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.at}/nodes")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName().removeprefix("snapshot_id=") for s in fs.listStatus(p)]
        return sorted(n for n in names if n != "current" and self.has_snapshot(n))


def export_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, absent parts left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def import_json(df: DataFrame, ddl: str, column: str = "json") -> DataFrame:
    """Rows of a schema from JSON texts; a text that isn't JSON raises."""
    return df.select(F.from_json(column, ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*")
