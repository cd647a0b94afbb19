"""Watching a repository: a file stream whose micro-batches re-analyze, never two at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import SKIPPED_DIRS

#: How long changes are gathered, and the dot files that matter.
DEBOUNCE = "300 milliseconds"
CONFIG_FILES = (".gitignore", ".npmrc", ".env", ".babelrc", ".eslintrc", ".prettierrc")
WATCHED = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|md)$"


def is_ignored(path: Column) -> Column:
    """Below a skipped directory, or a dot file that isn't a configuration."""
    dirs = "|".join(SKIPPED_DIRS)
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike(rf"(^|/)({dirs}|\.git)/") | (name.startswith(".") & ~name.isin(*CONFIG_FILES))


def is_relevant(path: Column) -> Column:
    return path.rlike(WATCHED) | F.element_at(F.split(path, "/"), -1).isin("package.json", "tsconfig.json", "pyproject.toml", *CONFIG_FILES)


def changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of path, modified of files that appear or change below a folder, those that matter."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    own = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"))
    return own.where(is_relevant(F.col("path")) & ~is_ignored(F.col("path")))


def watch(spark: SparkSession, root: str, rebuild: Callable[[list[str]], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call rebuild with the changed paths of each batch, the first being all of them. Triggers that come close are one."""

    def batch(df: DataFrame, _: int) -> None:
        paths = [r[0] for r in df.select("path").distinct().orderBy("path").collect()]
        if paths:
            rebuild(paths)

    q = changes(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime=DEBOUNCE)).start()


class GraphSource:
    """The current graph of a store, read again only when it has been written since."""

    def __init__(self, store, root: str | None = None) -> None:
        self.store, self.root, self._at, self._graph = store, root, None, None

    def load(self):
        from ..sources import git

        jvm, spark = self.store.spark.sparkContext._jvm, self.store.spark
        p = jvm.org.apache.hadoop.fs.Path(self.store._path("nodes", "current"))
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            raise FileNotFoundError("no graph; analyze first")
        at = fs.getFileStatus(p).getModificationTime()
        if at != self._at:
            self._graph, self._at = self.store.load_graph(), at
        return self._graph, (git.info(self.root) if self.root else None)
