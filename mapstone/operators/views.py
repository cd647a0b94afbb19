"""Questions about a graph, each a DataFrame; parameters are plain Python values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import rest_col
from ..schema import Graph
from .algo import impact_depths

#: Most results of a search, and of suggestions.
MAX_RESULTS, SUGGESTIONS = 100, 3


def _names(g: Graph, prefix: str, *columns: str) -> DataFrame:
    return g.nodes.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("id", *columns)])


def module_summaries(g: Graph) -> DataFrame:
    """id, name, layer, files, loc, rank, fan_in, fan_out, out_deps, in_deps, instability (null if isolated)."""
    deps = g.edges.where("kind = 'depends_on'")
    ends = deps.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(deps.select("dst", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("o").alias("out_deps"), F.sum("i").alias("in_deps"))
    files = g.nodes.where("kind = 'file'").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("files"))
    own = g.nodes.where("kind = 'module'").select("id", "name", "layer", "loc", "rank", "fan_in", "fan_out")
    own = own.join(files, "id", "left").join(n, "id", "left").na.fill({"files": 0, "out_deps": 0, "in_deps": 0})
    total = F.col("out_deps") + F.col("in_deps")
    return own.withColumn("instability", F.when(total > 0, F.round(F.col("out_deps") / total, 3)))


def overview_modules(g: Graph) -> DataFrame:
    return module_summaries(g).orderBy(F.desc("rank"), F.collate("id", "UNICODE"))


def overview_dependencies(g: Graph) -> DataFrame:
    """src, dst, weight, heaviest first."""
    deps = g.edges.where("kind = 'depends_on'").select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))
    return deps.orderBy(F.desc("weight"), F.collate(F.concat("src", "dst"), "UNICODE"))


def overview_packages(g: Graph) -> DataFrame:
    return g.nodes.where("kind = 'extpkg'").select("id", "name", "registry", "fan_in").orderBy(F.desc("fan_in"), F.collate("id", "UNICODE"))


def total_imports(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'imports'").agg(F.count("*").alias("imports"))


def resolve_ref(g: Graph, ref: str) -> DataFrame:
    """The node that a reference names: an identity, else a module, file, package or document of that name."""
    tries = g.spark.createDataFrame([(ref if not p else f"{p}:{ref}", k) for k, p in enumerate(["", "mod", "file", "pkg", "doc"])], "id string, __k int")
    hit = g.nodes.join(F.broadcast(tries), "id")  # five rows
    return hit.orderBy("__k").limit(1).drop("__k")


def resolve_db_ref(g: Graph, ref: str, prefer: str = "entity") -> DataFrame:
    """An entity or table by identity, by schema.table, or by a name (the preferred kind first) that only one node has."""
    own = g.nodes.where("kind IN ('entity', 'table')")
    kinds = ["entity", "table"] if prefer == "entity" else ["table", "entity"]
    named = F.lower("name") == ref.lower()
    step = F.when(F.col("id") == ref, 0).when((F.col("id") == f"tbl:{ref}") & F.lit("." in ref), 1)
    for k, kind in enumerate(kinds):
        if kind == "table":
            step = step.when(F.col("id") == f"tbl:public.{ref}", 2 + 2 * k)
        step = step.when((F.col("kind") == kind) & named, 3 + 2 * k)
    hits = own.withColumn("__step", step).where("__step IS NOT NULL")
    first = hits.withColumns({"__best": F.min("__step").over(Window.partitionBy(F.lit(1))), "__n": F.count("*").over(Window.partitionBy("__step"))})
    return first.where("__step = __best AND __n = 1").drop("__step", "__best", "__n")


def module_files(g: Graph, module: str) -> DataFrame:
    """Files of a module by rank, each with the names it exports."""
    files = g.nodes.where((F.col("kind") == "file") & (F.col("parent") == module)).select("id", "path", "lang", "loc", "rank", "doc")
    names = g.nodes.where("kind = 'symbol' AND exported").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("exports"))
    return files.join(names, "id", "left").orderBy(F.desc("rank"), F.collate("id", "UNICODE"))


def internal_imports(g: Graph, module: str) -> DataFrame:
    """src, dst, symbols of imports between two files of a module."""
    own = g.nodes.where((F.col("kind") == "file") & (F.col("parent") == module)).select("id")
    e = g.edges.where("kind = 'imports'").select("src", "dst", "symbols")
    return e.join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi")


def module_packages(g: Graph, module: str) -> DataFrame:
    """Packages that a module's files import, by the number of files that do."""
    own = g.nodes.where((F.col("kind") == "file") & (F.col("parent") == module)).select(F.col("id").alias("src"))
    used = g.edges.where("kind = 'imports_pkg'").join(own, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("files"))
    return used.join(g.nodes.select("id", "name", "registry"), "id", "left").select("id", F.coalesce("name", "id").alias("name"), "registry", "files")


def module_deps(g: Graph, module: str, out: bool = True) -> DataFrame:
    """id, weight of the modules that a module depends on, or that depend on it."""
    a, b = ("src", "dst") if out else ("dst", "src")
    return g.edges.where((F.col("kind") == "depends_on") & (F.col(a) == module)).select(F.col(b).alias("id"), F.coalesce("weight", F.lit(1)).alias("weight"))


def module_readmes(g: Graph) -> DataFrame:
    """module, doc, path, certain: the best document of each module; certain links first, then by path."""
    e = g.edges.where("kind = 'documents'").select(F.col("dst").alias("module"), F.col("src").alias("id"), (F.col("confidence") == "certain").alias("certain"))
    own = e.join(g.nodes.where("kind = 'doc'").select("id", "path", "title"), "id")
    rn = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("certain"), F.collate("path", "UNICODE")))
    return own.withColumn("rn", rn).where("rn = 1").select("module", F.col("id").alias("doc"), "path", "title", "certain")


def dependencies_of(g: Graph, node: str) -> DataFrame:
    """direction, edge_kind, other_id, other_name, other_kind, symbols, source, confidence of all edges at a node."""
    e = g.edges.where((F.col("src") == node) | (F.col("dst") == node))
    sides = e.select(
        F.explode(F.filter(F.array(F.struct(F.lit("out").alias("d"), F.col("src").alias("own"), F.col("dst").alias("other")), F.struct(F.lit("in").alias("d"), F.col("dst").alias("own"), F.col("src").alias("other"))), lambda s: s["own"] == node)).alias("s"),
        F.col("kind").alias("edge_kind"), "symbols", "source", "confidence",
    )
    named = sides.join(_names(g, "other_", "name", "kind"), F.col("s.other") == F.col("other_id"), "left")
    return named.select(
        F.col("s.d").alias("direction"), "edge_kind", F.col("s.other").alias("other_id"), F.coalesce("other_name", F.col("s.other")).alias("other_name"), F.coalesce("other_kind", F.lit("file")).alias("other_kind"), "symbols", "source", "confidence"
    )


def impact_summary(g: Graph, start: str) -> DataFrame:
    """One row: total_files, max_depth, visited, truncated."""
    d = impact_depths(g.nodes, g.edges, start).join(g.nodes.select("id", "kind"), "id", "left")
    return d.agg(
        F.sum((F.col("kind") == "file").cast("long")).alias("total_files"), F.max("depth").alias("max_depth"), F.count("*").alias("visited"), F.max("truncated").alias("truncated")
    ).na.fill({"total_files": 0, "max_depth": 0, "truncated": False})


def impact_by_module(g: Graph, start: str) -> DataFrame:
    """module, files, min_depth of the files that a change reaches."""
    d = impact_depths(g.nodes, g.edges, start).join(g.nodes.where("kind = 'file' AND parent IS NOT NULL").select("id", "parent"), "id")
    return d.groupBy(F.col("parent").alias("module")).agg(F.count("*").alias("files"), F.min("depth").alias("min_depth")).orderBy(F.desc("files"), F.collate("module", "UNICODE"))


def impact_tables(g: Graph, start: str) -> DataFrame:
    """Tables that a change reaches: those visited, and those that entities in the visited files (or the start) map to."""
    seen = impact_depths(g.nodes, g.edges, start).select("id").union(g.spark.createDataFrame([(start,)], "id string"))
    files = seen.join(g.nodes.where("kind = 'file'").select("id"), "id", "left_semi")
    ents = g.nodes.where("kind = 'entity'").select(F.col("id").alias("src"), F.col("parent").alias("id")).join(files, "id", "left_semi")
    mapped = g.edges.where("kind = 'maps_to'").join(ents.select("src"), "src", "left_semi").select(F.col("dst").alias("id"))
    visited = seen.where(F.col("id") != start)
    return g.nodes.where("kind = 'table'").select("id", "name").join(visited.union(mapped).distinct(), "id", "left_semi")


def direct_dependents(g: Graph, node: str) -> DataFrame:
    e = g.edges.where(F.col("kind").isin("imports", "depends_on", "maps_to") & (F.col("dst") == node))
    if not node.startswith("mod:"):  # derived dependencies lie between modules: they needn't be counted to find none
        e = e.where("NOT (kind <=> 'depends_on' AND source <=> 'static')")
    e = e.select(F.col("src").alias("id"), "symbols")
    return e.join(g.nodes.select("id", "name", "kind"), "id").orderBy(F.collate("id", "UNICODE"))


def containing_modules(g: Graph) -> DataFrame:
    """id, module_id of every node below a module: the tree is at most two levels deep, so two look-ups do."""
    up = g.nodes.select(F.col("id").alias("p_id"), F.col("kind").alias("p_kind"), F.col("parent").alias("p_parent"))
    own = g.nodes.select("id", "kind", "parent").join(up, F.col("parent") == F.col("p_id"), "left")
    two = F.when(F.col("kind") == "module", F.col("id")).when(F.col("p_kind") == "module", F.col("p_id")).when(F.col("p_kind") == "file", F.col("p_parent"))
    return own.select("id", two.alias("module_id"))


def search_score(query: str) -> Column:
    q, name = query.lower(), F.lower("name")
    return F.when(name == q, 3.0).when(name.startswith(q), 2.0).when(name.contains(q), 1.0).when(F.lower("id").contains(q), 0.5)


def search(g: Graph, query: str, kinds: list[str] | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """id, kind, name, module_id, rank, score, total: the best matches; total counts all of them."""
    own = g.nodes if not kinds else g.nodes.where(F.col("kind").isin(*kinds))
    hits = own.select("id", "kind", "name", "rank", search_score(query).alias("score")).where("score IS NOT NULL")
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(F.desc("score"), F.desc("rank"), F.collate("id", "UNICODE")).limit(limit)
    return top.join(containing_modules(g), "id", "left").join(F.broadcast(total))  # total is one row


def suggestions(g: Graph, ref: str) -> DataFrame:
    """For a reference that names nothing: the best matches of its last part."""
    return search(g, ref.split("/")[-1].split("#")[-1], limit=SUGGESTIONS)


def split_table_ref(ref) -> tuple[Column, Column]:
    """Schema and name of a table reference, split at the first dot; public without one."""
    at = F.instr(ref, ".")
    return F.when(at > 0, F.substring(ref, F.lit(1), at - 1)).otherwise("public"), F.when(at > 0, F.substring(ref, at + 1, F.length(ref))).otherwise(F.col(ref))


def mapped_entities(g: Graph) -> DataFrame:
    """table_id, entity_id, entity_name, orm, confidence."""
    e = g.edges.where("kind = 'maps_to'").select(F.col("dst").alias("table_id"), F.col("src").alias("entity_id"), "confidence")
    return e.join(g.nodes.where("kind = 'entity'").select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "orm"), "entity_id")


def table_summaries(g: Graph) -> DataFrame:
    """id, schema, name, origin, n_columns, pk, entities, n_drift of every table."""
    ents = mapped_entities(g).groupBy("table_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    t = g.nodes.where("kind = 'table'").withColumn("ref", rest_col("id"))
    schema, name = split_table_ref("ref")
    t = t.select(
        "id", schema.alias("schema"), name.alias("name"), "origin", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"),
        F.transform(F.filter("columns", lambda c: c["is_pk"]), lambda c: c["name"]).alias("pk"), F.coalesce(F.size("drift"), F.lit(0)).alias("n_drift"),
    )
    return t.join(ents, t["id"] == ents["table_id"], "left").drop("table_id")


def foreign_keys(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'fk'").select("src", "dst", "fk_columns", "source", "confidence")


def erd_columns(g: Graph) -> DataFrame:
    """table_id, pos and the parts of each column."""
    return g.nodes.where("kind = 'table'").select(F.col("id").alias("table_id"), F.posexplode("columns").alias("pos", "c")).select("table_id", "pos", "c.*")


def related_tables(g: Graph, table: str) -> DataFrame:
    """direction, table_id, table_name, fk_columns, source, confidence of the foreign keys at a table, in before out."""
    e = g.edges.where("kind = 'fk'")
    both = e.where(F.col("src") == table).select(F.lit("out").alias("direction"), F.col("dst").alias("table_id"), "fk_columns", "source", "confidence").unionByName(
        e.where(F.col("dst") == table).select(F.lit("in").alias("direction"), F.col("src").alias("table_id"), "fk_columns", "source", "confidence")
    )
    named = both.join(g.nodes.select(F.col("id").alias("table_id"), "name"), "table_id", "left")
    return named.select("direction", "table_id", F.coalesce("name", "table_id").alias("table_name"), "fk_columns", "source", "confidence").orderBy("direction", F.collate("table_id", "UNICODE"))


def entity_table(g: Graph, node: str) -> DataFrame:
    """table_id of an entity (its first mapping) or of a table (itself)."""
    own = g.nodes.where((F.col("id") == node) & (F.col("kind") == "table")).select(F.col("id").alias("table_id"))
    via = g.edges.where((F.col("kind") == "maps_to") & (F.col("src") == node)).orderBy(F.collate("id", "UNICODE")).limit(1).select(F.col("dst").alias("table_id"))
    return own.union(via)


def drifted_tables(g: Graph) -> DataFrame:
    """table_id, kind, column, detail of every drift entry stored on a table."""
    return g.nodes.where("kind = 'table' AND size(drift) > 0").select(F.col("id").alias("table_id"), F.explode("drift").alias("d")).select("table_id", "d.*")


def file_exports(g: Graph, file: str) -> DataFrame:
    return g.nodes.where((F.col("kind") == "symbol") & (F.col("parent") == file)).select("id", "name", "symbol_kind", "start_line", "end_line", "doc").orderBy("start_line", F.collate("name", "UNICODE"))


def file_imports(g: Graph, file: str, incoming: bool = False) -> DataFrame:
    """kind, id, symbols of the edges by which a file imports (or is imported)."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return g.edges.where(F.col("kind").isin("imports", "imports_pkg") & (F.col(a) == file)).select("kind", F.col(b).alias("id"), "symbols").orderBy(F.collate("id", "UNICODE"))


def doc_modules(g: Graph) -> DataFrame:
    """doc, module: the first documents edge of each document whose module exists."""
    e = g.edges.where("kind = 'documents'").join(g.nodes.where("kind = 'module'").select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.groupBy(F.col("src").alias("doc")).agg(F.min("dst").alias("module"))


def docs_list(g: Graph) -> DataFrame:
    """id, path, title, truncated, module of every document, by path."""
    d = g.nodes.where("kind = 'doc'").select("id", "path", "title", "truncated")
    return d.join(doc_modules(g), d["id"] == F.col("doc"), "left").drop("doc").orderBy(F.collate("path", "UNICODE"))


# --- transforms for drawing ---------------------------------------------------------------------------------------


def edge_width(weight) -> Column:
    return F.least(F.lit(1) + F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double")), F.lit(5.0))


def overview_flow(g: Graph) -> DataFrame:
    """src, dst, weight, width of the lines between modules."""
    return overview_dependencies(g).withColumn("width", F.round(edge_width("weight"), 6))


def module_neighbours(g: Graph, module: str) -> DataFrame:
    """id, role of the modules beside a module: it depends on them, they on it, or both."""
    e = g.edges.where("kind = 'depends_on'")
    sides = e.where(F.col("src") == module).select(F.col("dst").alias("id"), F.lit("out").alias("r")).union(e.where(F.col("dst") == module).select("src", F.lit("in")))
    return sides.where(F.col("id") != module).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("r")), "+").alias("role"))


def focus(g: Graph, node: str) -> DataFrame:
    """The nodes within one edge of a node, itself, and the parents of all of them."""
    e = g.edges.where((F.col("src") == node) | (F.col("dst") == node))
    near = e.select(F.explode(F.array("src", "dst")).alias("id")).union(g.spark.createDataFrame([(node,)], "id string")).distinct()
    up = g.nodes.where("parent IS NOT NULL").join(near, "id", "left_semi").select(F.col("parent").alias("id"))
    return near.union(up).distinct().join(g.nodes.select("id"), "id", "left_semi")


def layers(g: Graph) -> DataFrame:
    """layer ('' for none), modules: names by layer, for a side list."""
    return g.nodes.where("kind = 'module'").groupBy(F.coalesce("layer", F.lit("")).alias("layer")).agg(F.sort_array(F.collect_list("name")).alias("modules")).orderBy("layer")


def project_docs(g: Graph) -> DataFrame:
    """Documents that document no module."""
    return g.nodes.where("kind = 'doc'").join(g.edges.where("kind = 'documents'").select(F.col("src").alias("id")), "id", "left_anti").select("id", "path", "title")


def lines_with(docs: DataFrame, query: str, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_no (from 1) of the lines that hold a query, in any case; none for an empty query."""
    q = query.strip().lower()
    lines = docs.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    return lines.where(F.lit(bool(q)) & F.lower("line").contains(q)).select(key, (F.col("pos") + 1).alias("line_no"))


def source_lines(docs: DataFrame, first: int, last: int, key: str = "path", content: str = "content", most: int = 5_000) -> DataFrame:
    """key, line_no, line of a range of lines, from 1, at most `most`."""
    lines = docs.select(key, F.posexplode(F.split(content, "\r?\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    return lines.where(F.col("line_no").between(first, min(last, first + most - 1))).select(key, "line_no", "line")


def unified_diff(patches: DataFrame, key: str = "key", patch: str = "patch") -> DataFrame:
    """key, pos, kind, text, old_no, new_no of each line of unified diffs; numbers run within a hunk, by windows."""
    meta = "^(diff --git|index |--- |\\+\\+\\+ |new file|deleted file|old mode|new mode|similarity|rename |copy |Binary files|\\\\)"
    hunk = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    body = patches.where(F.trim(patch) != "").select(key, F.posexplode(F.split(F.regexp_replace(patch, "\n$", ""), "\n")).alias("pos", "raw"))
    kind = (
        F.when(F.col("raw").rlike(hunk), "hunk").when(F.col("raw").rlike(meta), "meta").when(F.col("raw").startswith("+"), "add").when(F.col("raw").startswith("-"), "del").otherwise("ctx")
    )
    rows = body.withColumn("kind", kind)
    rows = rows.withColumn("part", F.sum((F.col("kind") == "hunk").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    start = F.struct(F.regexp_extract("raw", hunk, 1).cast("int").alias("o"), F.regexp_extract("raw", hunk, 2).cast("int").alias("n"))
    w = Window.partitionBy(key, "part").orderBy("pos")
    rows = rows.withColumn("start", F.first(F.when(F.col("kind") == "hunk", start), ignorenulls=True).over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ran = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    rows = rows.withColumns({"o": F.coalesce("start.o", F.lit(0)) + ran(("del", "ctx")), "n": F.coalesce("start.n", F.lit(0)) + ran(("add", "ctx"))})
    text = F.when(F.col("kind").isin("hunk", "meta"), F.col("raw")).when(F.col("kind").isin("add", "del") | F.col("raw").startswith(" "), F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    return rows.select(
        key, "pos", "kind", text.alias("text"), F.when(F.col("kind").isin("del", "ctx"), F.col("o")).alias("old_no"), F.when(F.col("kind").isin("add", "ctx"), F.col("n")).alias("new_no")
    )
