"""From a repository to its graph: scan, extract what the cache lacks, resolve, build, measure."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import FACTS, extract_files
from ..functions.ids import node_id_col
from ..functions.text import cut_document, titles, truncated_document
from ..functions.text import headings as doc_headings
from ..operators import build, diff
from ..operators.algo import checkpointed
from ..operators.ancestry import History, neighbours
from ..operators.maintain import Maintained
from ..operators.resolve import infer_modules, resolve_imports
from ..schema import Graph, edges_of, nodes_of
from ..sources import cache, config, git, scan
from ..sources.store import Store


def facts_of(files: DataFrame, store: Store | None = None, full: bool = False) -> DataFrame:
    """Facts of source files; with a store, kept facts are reused and new ones are added to it."""
    spark = files.sparkSession
    sources = files.where(scan.is_source(F.col("path")))
    if store is None:
        return checkpointed(extract_files(sources))
    at = f"{store.at}/facts"
    keyed = sources.withColumn("key", cache.facts_key("path", "content"))
    kept = spark.read.schema("key string, " + FACTS).parquet(at) if store._exists(at) and not full else None
    fresh = keyed if kept is None else keyed.join(kept.select("key"), "key", "left_anti")
    made = checkpointed(extract_files(fresh).join(fresh.select("path", "key"), "path"))
    if not made.isEmpty():
        made.select("key", *[c for c in made.columns if c != "key"]).write.mode("overwrite" if full else "append").parquet(at)
    facts = made.drop("key")
    if kept is not None:
        facts = facts.unionByName(kept.join(keyed.select("key"), "key", "left_semi").dropDuplicates(["key"]).drop("key"))
    return checkpointed(facts)


def build_graph(files: DataFrame, facts: DataFrame, cfg: config.Config, root_name: str, workspaces: list, aliases: dict[str, dict] | list, roots: list[str], entries: dict[str, list[str]] | None = None, kept: Maintained | None = None) -> Graph:
    """The whole graph of files (path, content) and their facts. kept: imports that are maintained already, used as they are."""
    spark = files.sparkSession
    located = checkpointed(infer_modules(facts.select("path", "lang", "loc", "doc"), cfg.modules, workspaces, root_name))
    nodes = build.module_nodes(located).unionByName(build.file_nodes(located))
    symbols = facts.select("path", "lang", F.posexplode("symbols").alias("pos", "s")).select("path", "lang", "pos", "s.*")
    nodes = nodes.unionByName(build.symbol_nodes(symbols))

    imports = facts.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    raw = kept.edges if kept else checkpointed(resolve_imports(imports, facts.select("path"), aliases, workspaces, roots, entries))
    merged = build.merge_edges(raw.select("kind", "src", "dst", "symbols")).withColumns({"source": F.lit("static"), "confidence": F.lit("certain")})
    edges = edges_of(merged)
    packages = raw.where("kind = 'imports_pkg'").groupBy("dst").agg(F.min_by("registry", "src").alias("registry"))
    nodes = nodes.unionByName(nodes_of(packages.select(F.col("dst").alias("id"), F.lit("extpkg").alias("kind"), F.expr("substring(dst, 5)").alias("name"), "registry")))

    ents = facts.select("path", F.explode("entities").alias("e")).select("path", "e.*").withColumn("id", node_id_col("entity", "path", "name"))
    ents = checkpointed(ents)
    own = nodes_of(
        ents.select("id", F.lit("entity").alias("kind"), "name", node_id_col("file", "path").alias("parent"), "path", "orm", F.concat_ws(".", F.coalesce("table_schema", F.lit("public")), "table_name").alias("declared_table"),
            F.expr("transform(fields, f -> named_struct('name', f.name, 'type', f.type, 'column', nullif(f.column, f.name), 'nullable', f.nullable, 'is_pk', f.is_pk, 'is_fk', f.is_fk))").alias("fields"),
        )
    )
    tables, links = build.link_declared_schema(ents)
    nodes = nodes.unionByName(own).unionByName(tables)
    edges = edges.unionByName(links)

    md = files.where(scan.is_doc(F.col("path"), cfg.docs_include, cfg.docs_exclude))
    md = checkpointed(md.select("path", cut_document(F.col("content")).alias("content"), truncated_document(F.col("content")).alias("truncated")))
    heads = doc_headings(md).groupBy("path").agg(F.expr("transform(array_sort(collect_list(struct(line_no, depth, text))), x -> struct(x.depth, x.text))").alias("headings"))
    docs = md.join(titles(md), "path").join(heads, "path", "left")
    nodes = nodes.unionByName(nodes_of(docs.select(node_id_col("doc", "path").alias("id"), F.lit("doc").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "title", "content", "truncated", "headings")))
    readmes = md.where(F.lower(F.element_at(F.split("path", "/"), -1)) == "readme.md").select("path")
    placed = infer_modules(readmes, cfg.modules, workspaces, root_name).join(located.select("module").distinct(), "module", "left_semi")
    folder = lambda c: F.regexp_extract(c, "^(.*/)?[^/]*$", 1)
    beside = located.select(folder("path").alias("dir"), "module").distinct().withColumn("beside", F.lit(True))
    doc_edges = placed.withColumn("dir", folder("path")).join(beside, ["dir", "module"], "left").select(
        F.lit("documents").alias("kind"), node_id_col("doc", "path").alias("src"), node_id_col("module", "module").alias("dst"), F.lit("static").alias("source"), F.when(F.col("beside"), "certain").otherwise("inferred").alias("confidence")
    )
    edges = edges.unionByName(edges_of(doc_edges))
    if cfg.edges:
        edges = build.manual_edges(edges, spark.createDataFrame([(e["kind"], e["src"], e["dst"], e.get("reason")) for e in cfg.edges], "kind string, src string, dst string, reason string"))
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    derived, fans = (kept.dependencies(), kept.fans_with(edges)) if kept and not cfg.edges else (None, None)
    g = build.with_metrics(Graph(nodes, build.with_dependencies(nodes, edges, derived)), fans=fans)
    return Graph(checkpointed(g.nodes), g.edges)


def python_roots(paths: list[str], configured: list[str]) -> list[str]:
    """Where absolute imports start: as configured, else src (if there) and the root."""
    if configured:
        return [r.strip("/").removeprefix("./") if r not in (".", "./") else "" for r in configured]
    return (["src"] if any(p.startswith("src/") and p.endswith(".py") for p in paths) else []) + [""]


def analyze(spark: SparkSession, root: str, store: Store | None = None, root_name: str | None = None, full: bool = False) -> Graph:
    """Analyze a local repository; with a store, save the graph, and a snapshot if the tree is clean."""
    cfg = config.load_config(root)
    files = checkpointed(scan.local_tree(spark, root, config.gitignore(root), cfg.exclude))
    facts = facts_of(files, store, full)
    paths = scan.list_paths(root)
    roots, members = python_roots(paths, cfg.python_roots), config.workspaces(root)
    g = build_graph(files, facts, cfg, root_name or Path(root).resolve().name, members, config.path_aliases(root, paths), roots, config.workspace_entries(root, members))
    if store is not None:
        store.save_graph(g)
        store.save_snapshot(g, git.info(root))
    return g


def ensure_snapshot(spark: SparkSession, root: str, ref: str, store: Store) -> tuple[str, Graph]:
    """The graph of a commit: from the store, else analyzed in a worktree of its own and kept."""
    sha = git.resolve_ref(root, ref)
    if (kept := store.load_snapshot(sha)) is not None:
        return sha, kept
    at = tempfile.mkdtemp(prefix="mapstone-tree-")
    git.checkout(root, sha, at)
    try:
        g = analyze(spark, at, root_name=Path(root).resolve().name)
        store.save_snapshot(g, {"sha": sha, "dirty": False})
    finally:
        git.drop_checkout(root, at)
    return sha, store.load_graph(sha)


def compare(spark: SparkSession, root: str, base: str, head: str, store: Store) -> dict[str, DataFrame]:
    """All differences between two commits, aware of git's renames."""
    (a, b), (c, d) = ensure_snapshot(spark, root, base, store), ensure_snapshot(spark, root, head, store)
    return diff.all_differences(b, d, git.renames(spark, root, a, c))


def history(spark: SparkSession, root: str, base: str, store: Store, head: str = "HEAD", most: int = 5) -> dict[str, DataFrame]:
    """points (nth, sha, label, date) from base over sampled tagged commits to head; intervals between neighbours; and every kind of
    difference, one table for all intervals (column interval), made in one plan from the kept graphs."""
    a, b = git.resolve_ref(root, base), git.resolve_ref(root, head)
    asked = spark.createDataFrame([("range", a, b, base, head)], "key string, base string, head string, base_label string, head_label string")
    points = checkpointed(History(git.commits(spark, root, a, b)).waypoints(asked, most))
    intervals = checkpointed(neighbours(points).drop("key"))
    shas = sorted({r["sha"] for r in points.select("sha").collect()})  # at most `most`
    for sha in shas:
        ensure_snapshot(spark, root, sha, store)
    moved = [(r["interval"], *x) for r in intervals.select("interval", "base", "head").collect() for x in git.renamed(root, r["base"], r["head"])]
    renames = spark.createDataFrame(moved, "interval string, old string, new string")
    kept = store.load_snapshots(shas)
    sides = diff.interval_graphs(kept.nodes, kept.edges, intervals)
    return {"points": points.drop("key"), "intervals": intervals, **diff.all_differences(*sides, renames, ("interval",))}
