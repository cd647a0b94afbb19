"""A graph that follows its tree: after each change only what the change touches is read, parsed and resolved."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import extract_files
from ..operators.algo import checkpointed
from ..operators.maintain import Maintained, Resolution
from ..operators.resolve import infer_modules
from ..schema import Graph
from ..sources import config, git, scan
from ..sources.store import Store
from ..streaming.watch import watch
from .analyze import build_graph, facts_of, python_roots

#: Files that say how imports are resolved: when one of them changes, everything is resolved anew.
DECISIVE = (config.CONFIG_NAME, ".gitignore", "package.json", "tsconfig.json", "tsconfig.base.json", "pnpm-workspace.yaml", "lerna.json", "pyproject.toml")


class LiveGraph:
    """The graph of a local tree. apply() takes changed paths; graph is always whole."""

    def __init__(self, spark: SparkSession, root: str, store: Store | None = None) -> None:
        self.spark, self.root, self.store = spark, str(Path(root).resolve()), store
        self.rebuild()

    def rebuild(self) -> None:
        """Everything from the tree."""
        root = self.root
        self.config, self.paths = config.load_config(root), scan.list_paths(root)
        self.members = config.workspaces(root)
        self.how = Resolution(config.path_aliases(root, self.paths), self.members, python_roots(self.paths, self.config.python_roots), config.workspace_entries(root, self.members))
        self.files = checkpointed(scan.local_tree(self.spark, root, config.gitignore(root), self.config.exclude))
        self.facts = facts_of(self.files, self.store)
        self.kept = Maintained.start(self.how, self._located(self.facts), self._imports(self.facts))
        self._build()

    def _located(self, facts: DataFrame) -> DataFrame:
        return infer_modules(facts.select("path"), self.config.modules, self.members, Path(self.root).name).select("path", "module")

    @staticmethod
    def _imports(facts: DataFrame) -> DataFrame:
        return facts.select("path", F.explode("imports").alias("i")).select("path", "i.specifier", "i.symbols")

    def _build(self) -> None:
        how = self.how
        self.graph: Graph = build_graph(self.files, self.facts, self.config, Path(self.root).name, self.members, how.aliases, how.roots, how.entries, self.kept)
        if self.store is not None:
            self.store.save_graph(self.graph)
            self.store.save_snapshot(self.graph, git.info(self.root))

    def apply(self, paths: list[str]) -> Graph:
        """The graph after these paths, absolute or relative to the root, were written or deleted."""
        names = sorted({p.removeprefix(self.root + "/") for p in paths})
        if any(n.rpartition("/")[2] in DECISIVE for n in names):
            self.rebuild()
            return self.graph
        asked = self.spark.createDataFrame([(n,) for n in names], "path string")
        there = [n for n in names if Path(self.root, n).is_file()]
        now = checkpointed(scan.local_tree(self.spark, self.root, config.gitignore(self.root), self.config.exclude, only=there))
        self.files = checkpointed(self.files.join(asked, "path", "left_anti").unionByName(now))
        fresh = checkpointed(extract_files(now.where(scan.is_source(F.col("path")))))
        removed = asked.join(now.select("path"), "path", "left_anti")
        self.facts = checkpointed(self.facts.join(asked, "path", "left_anti").unionByName(fresh))
        self.kept = self.kept.update(self._located(fresh), self._imports(fresh), removed.join(self.kept.files.select("path"), "path", "left_semi"))
        self._build()
        return self.graph

    def follow(self, checkpoint: str, once: bool = False):
        """Apply the changes that a file stream brings, batch by batch."""
        return watch(self.spark, self.root, self.apply, checkpoint, once)
