"""What a command line would do, as functions: init, analyze, diff, database introspection and drift."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.types import SPARK_FAMILY
from .operators import diff as diffs
from .operators import drift
from .plans import analyze as plans
from .plans import render
from .schema import Graph
from .sources import config, database, git, scan
from .sources.store import Store


def init(spark: SparkSession, root: str) -> dict:
    """Detect languages, Prisma files and layers; write a configuration unless there is one."""
    paths = spark.createDataFrame([(p,) for p in scan.list_paths(root)], "path string")
    stack = config.detect_stack(paths)
    return stack | {"written": config.write_config(root, stack), "workspaces": config.workspaces(root)}


def analyze(spark: SparkSession, root: str, store: Store, full: bool = False) -> Graph:
    """Analyze and save; a snapshot is kept if the tree is clean. full: extract everything again."""
    return plans.analyze(spark, root, store, full=full)


def diff(spark: SparkSession, root: str, base: str, head: str, store: Store, as_json: bool = False) -> str:
    """Differences of two refs. The text leaves the database out, the JSON has everything."""
    changes = plans.compare(spark, root, base, head, store)
    if as_json:
        return json.dumps({k: [r.asDict() for r in df.collect()] for k, df in changes.items()}, sort_keys=True)
    return render.diff({k: changes[k] for k in ("modules", "dependencies", "files")})


def _live(spark: SparkSession, root: str, source: str | None) -> drift.Live:
    found = config.pick_source(config.load_config(root).sources, source)
    url = os.environ.get(found.get("urlEnv", ""))
    if not url:
        raise ValueError(f"the environment variable {found.get('urlEnv')} is not set")
    return database.introspect(spark, url, found.get("schemas"))


def db_introspect(spark: SparkSession, root: str, store: Store, source: str | None = None, live: drift.Live | None = None) -> dict:
    """Lay a live schema over the saved graph; counts of tables on both sides, live only, declared only."""
    g = drift.merge_live(store.load_graph(), live or _live(spark, root, source), SPARK_FAMILY)
    g = Graph(plans.checkpointed(g.nodes), plans.checkpointed(g.edges))
    store.save_graph(g)
    counts = {r.origin: r.n for r in g.nodes.where("kind = 'table'").groupBy("origin").agg(F.count("*").alias("n")).collect()}
    return {k: counts.get(k, 0) for k in ("both", "live", "declared")}


def db_drift(spark: SparkSession, root: str, store: Store, source: str | None = None, live: drift.Live | None = None) -> dict:
    """Findings, and exit 1 if there are any; migration heads are told but don't count."""
    declared = drift.declared_columns(store.load_graph())
    found = drift.compute_drift(declared, live or _live(spark, root, source), SPARK_FAMILY)
    at = config.versions_dir(root, scan.list_paths(root))
    heads = config.migration_heads(scan.local_tree(spark, root).where(F.col("path").startswith(f"{at}/") & F.col("path").rlike(r"/(?!__)[^/]+[.]py$"))) if at else spark.createDataFrame([], "revision string")
    return drift.drift_summary(declared, found) | {"findings": [r.asDict() for r in found.orderBy("schema", "table", "kind", "detail").collect()], "heads": [r.revision for r in heads.collect()]}


def status(root: str, graph_sha: str | None) -> list[str]:
    """What to tell about a graph that may be behind its tree."""
    now = git.info(root)
    return render.staleness(graph_sha, now["sha"] if now else None, bool(now and now["dirty"]))


def count_changes(base: Graph, head: Graph) -> int:
    return diffs.change_count(base, head)
