"""Differences between two graphs: set operations and full outer joins over identities, aware of renamed files.

With keys, each side is many graphs in one: their nodes, edges and renames carry the key columns, and one plan
compares the graphs of every key (see interval_graphs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id_col, rest_col
from ..schema import Graph

#: A module counts as renamed if more than this share of the larger side's files is shared. Fixed value.
OVERLAP = 0.5
Keys = tuple[str, ...]


def interval_graphs(nodes: DataFrame, edges: DataFrame, intervals: DataFrame) -> tuple[Graph, Graph]:
    """The bases and the heads of intervals (interval, base, head), with a column interval; nodes and edges: of snapshots (snapshot)."""
    sides = [intervals.select("interval", F.col(c).alias("snapshot")) for c in ("base", "head")]
    base, head = (Graph(nodes.join(s, "snapshot").drop("snapshot"), edges.join(s, "snapshot").drop("snapshot")) for s in sides)
    return base, head


def remap(base: DataFrame, renames: DataFrame | None, column: str = "id", keys: Keys = ()) -> DataFrame:
    """column_new: identities of files and symbols of the base with their paths after the renames (old, new)."""
    if renames is None:
        return base.withColumn(f"{column}_new", F.col(column))
    path = F.substring_index(rest_col(column), "#", 1)
    own = base.withColumn("__path", F.when(F.col(column).rlike("^(file|sym):"), path))
    got = own.join(renames.select(*keys, F.col("old").alias("__path"), F.col("new").alias("__to")), [*keys, "__path"], "left")
    moved = F.when(F.col(column).startswith("file:"), node_id_col("file", "__to")).otherwise(F.concat(F.lit("sym:"), "__to", F.expr(f"substring({column}, length(__path) + 5)")))
    return got.withColumn(f"{column}_new", F.when(F.col("__to").isNotNull(), moved).otherwise(F.col(column))).drop("__path", "__to")


def diff_files(base: Graph, head: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """change (added, removed, moved), id, previous_id. A file that only changed inside is not listed."""
    b = remap(base.nodes.where("kind = 'file'").select(*keys, "id"), renames, keys=keys).select(*keys, F.col("id").alias("old"), F.col("id_new").alias("id"))
    h = head.nodes.where("kind = 'file'").select(*keys, "id", F.lit(True).alias("in_head"))
    both = b.join(h, [*keys, "id"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(F.col("old") != F.col("id"), "moved")
    out = both.withColumn("change", change).where("change IS NOT NULL")
    return out.select(*keys, "change", F.when(F.col("change") == "removed", F.col("old")).otherwise(F.col("id")).alias("id"), F.when(F.col("change") == "moved", F.col("old")).alias("previous_id"))


def module_file_sets(g: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """module, file of a graph, files by their new identities."""
    f = remap(g.nodes.where("kind = 'file' AND parent IS NOT NULL").select(*keys, "id", "parent"), renames, keys=keys)
    return f.select(*keys, F.col("parent").alias("module"), F.col("id_new").alias("file"))


def _one_sided(base: Graph, head: Graph, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    b, h = (g.nodes.where("kind = 'module'").select(*keys, F.col("id").alias("module")) for g in (base, head))
    return b.join(h, [*keys, "module"], "left_anti"), h.join(b, [*keys, "module"], "left_anti")


def module_renames(base: Graph, head: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """old, new, overlap of modules that vanished and appeared with mostly the same files.

    As the overlap is above half of the larger side, a module has one partner at most; the row number only settles
    rename maps that send two files to one.
    """
    gone, fresh = _one_sided(base, head, keys)
    b = module_file_sets(base, renames, keys).join(gone, [*keys, "module"], "left_semi").toDF(*keys, "old", "file").distinct()
    h = module_file_sets(head, keys=keys).join(fresh, [*keys, "module"], "left_semi").toDF(*keys, "new", "file").distinct()
    nb, nh = b.groupBy(*keys, "old").agg(F.count("*").alias("nb")), h.groupBy(*keys, "new").agg(F.count("*").alias("nh"))
    shared = b.join(h, [*keys, "file"]).groupBy(*keys, "old", "new").agg(F.count("*").alias("shared")).join(nb, [*keys, "old"]).join(nh, [*keys, "new"])
    pairs = shared.withColumn("overlap", F.col("shared") / F.greatest("nb", "nh", F.lit(1))).where(F.col("overlap") > OVERLAP)
    first = pairs.withColumn("a", F.row_number().over(Window.partitionBy(*keys, "old").orderBy(F.desc("overlap"), "new"))).withColumn("b", F.row_number().over(Window.partitionBy(*keys, "new").orderBy(F.desc("overlap"), "old")))
    return first.where("a = 1 AND b = 1").select(*keys, "old", "new", F.round("overlap", 6).alias("overlap"))


def diff_modules(base: Graph, head: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """change (added, removed, renamed), module, previous."""
    gone, fresh = _one_sided(base, head, keys)
    pairs = module_renames(base, head, renames, keys)
    none = F.lit(None).cast("string")
    out = fresh.join(pairs.select(*keys, F.col("new").alias("module")), [*keys, "module"], "left_anti").select(*keys, F.lit("added").alias("change"), "module", none.alias("previous"))
    out = out.union(gone.join(pairs.select(*keys, F.col("old").alias("module")), [*keys, "module"], "left_anti").select(*keys, F.lit("removed"), "module", none))
    return out.union(pairs.select(*keys, F.lit("renamed"), F.col("new"), F.col("old")))


def diff_dependencies(base: Graph, head: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """change (added, removed, weight), src, dst, before, after of module dependencies; renamed modules are one."""
    pairs = module_renames(base, head, renames, keys)

    def deps(g: Graph, name: str, mapped: bool) -> DataFrame:
        d = g.edges.where("kind = 'depends_on'").select(*keys, "src", "dst", F.coalesce("weight", F.lit(1)).alias(name))
        for c in ("src", "dst") if mapped else ():
            d = d.join(pairs.select(*keys, F.col("old").alias(c), F.col("new").alias("__to")), [*keys, c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        return d.groupBy(*keys, "src", "dst").agg(F.max(name).alias(name))

    both = deps(base, "before", True).join(deps(head, "after", False), [*keys, "src", "dst"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "weight")
    return both.select(*keys, change.alias("change"), "src", "dst", "before", "after").where("change IS NOT NULL")


def column_signature(c: Column) -> Column:
    """Type, ? if nullable, pk: what a change of a column is judged by. Foreign keys are not part of it."""
    return F.concat(c["sql_type"], F.when(c["nullable"], "?").otherwise(""), F.when(c["is_pk"], " pk").otherwise(""))


def diff_columns(base: Graph, head: Graph, keys: Keys = ()) -> DataFrame:
    """table_id, column, before, after (∅ for absent) of tables in both graphs."""

    def cols(g: Graph, name: str) -> DataFrame:
        c = g.nodes.where("kind = 'table'").select(*keys, F.col("id").alias("table_id"), F.explode("columns").alias("c"))
        return c.select(*keys, "table_id", F.col("c.name").alias("column"), column_signature(F.col("c")).alias(name))

    common = base.nodes.where("kind = 'table'").select(*keys, F.col("id").alias("table_id")).join(head.nodes.where("kind = 'table'").select(*keys, F.col("id").alias("table_id")), [*keys, "table_id"], "left_semi")
    both = cols(base, "before").join(cols(head, "after"), [*keys, "table_id", "column"], "full").join(common, [*keys, "table_id"], "left_semi")
    return both.na.fill("∅", ["before", "after"]).where("before <> after")


def diff_tables(base: Graph, head: Graph, keys: Keys = ()) -> DataFrame:
    """change (added, removed, changed), table_id."""
    b, h = (g.nodes.where("kind = 'table'").select(*keys, F.col("id").alias("table_id")) for g in (base, head))
    out = h.join(b, [*keys, "table_id"], "left_anti").select(*keys, F.lit("added").alias("change"), "table_id")
    out = out.union(b.join(h, [*keys, "table_id"], "left_anti").select(*keys, F.lit("removed"), "table_id"))
    return out.union(diff_columns(base, head, keys).select(*keys, F.lit("changed"), "table_id").distinct())


def diff_foreign_keys(base: Graph, head: Graph, keys: Keys = ()) -> DataFrame:
    """change (added, removed), src, dst; which columns a key has doesn't matter."""
    b, h = (g.edges.where("kind = 'fk'").select(*keys, "src", "dst").distinct() for g in (base, head))
    on = [*keys, "src", "dst"]
    return h.join(b, on, "left_anti").select(*keys, F.lit("added").alias("change"), "src", "dst").union(b.join(h, on, "left_anti").select(*keys, F.lit("removed"), "src", "dst"))


def diff_drift(base: Graph, head: Graph, keys: Keys = ()) -> DataFrame:
    """table_id, kind, detail, column of drift entries that only the head has."""
    b, h = (g.nodes.where("kind = 'table'").select(*keys, F.col("id").alias("table_id"), F.explode("drift").alias("d")).select(*keys, "table_id", "d.kind", "d.detail", "d.column") for g in (base, head))
    on = [*keys, "table_id", "kind", "detail"]
    return h.join(b.select(*on).distinct(), on, "left_anti").select(*on, "column")


def all_differences(base: Graph, head: Graph, renames: DataFrame | None = None, keys: Keys = ()) -> dict[str, DataFrame]:
    """Every kind of difference by its name."""
    return {
        "files": diff_files(base, head, renames, keys), "modules": diff_modules(base, head, renames, keys), "dependencies": diff_dependencies(base, head, renames, keys),
        "tables": diff_tables(base, head, keys), "columns": diff_columns(base, head, keys), "foreign_keys": diff_foreign_keys(base, head, keys), "drift": diff_drift(base, head, keys),
    }


def change_count(base: Graph, head: Graph, renames: DataFrame | None = None) -> int:
    """Changes of all kinds, those of the database included."""
    parts = [diff_files(base, head, renames), diff_modules(base, head, renames), diff_dependencies(base, head, renames), diff_tables(base, head), diff_foreign_keys(base, head), diff_drift(base, head)]
    return sum(p.count() for p in parts)
