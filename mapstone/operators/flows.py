"""Node and line tables for drawing: overview with opened modules, tables, and differences with their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import rest_col
from ..schema import Graph
from .diff import diff_dependencies, diff_modules
from .views import edge_width, module_summaries, overview_dependencies

#: Modules on the start page and in a timeline's bars, and how long "just now" lasts there.
HOME_MODULES, TIMELINE_MODULES, FRESH_SECONDS = 9, 10, 60


def overview_nodes(g: Graph, opened: list[str] | None = None) -> DataFrame:
    """id, type, parent, name, loc, files: modules (groups where opened) and the files of opened ones."""
    opened = opened or []
    m = module_summaries(g).select(
        "id", F.when(F.col("id").isin(*opened) if opened else F.lit(False), "moduleGroup").otherwise("module").alias("type"), F.lit(None).cast("string").alias("parent"), "name", "loc", "files"
    )
    f = g.nodes.where((F.col("kind") == "file") & (F.col("parent").isin(*opened) if opened else F.lit(False)))
    return m.unionByName(f.select("id", F.lit("file").alias("type"), "parent", "name", "loc", F.lit(0).cast("long").alias("files")))


def overview_lines(g: Graph, opened: list[str] | None = None) -> DataFrame:
    """id, src, dst, width, label: dependencies (labelled above weight 1), and imports inside opened modules."""
    d = overview_dependencies(g).select(
        F.concat(F.lit("dep:"), "src", F.lit("→"), "dst").alias("id"), "src", "dst", edge_width("weight").alias("width"), F.when(F.col("weight") > 1, F.col("weight").cast("string")).alias("label")
    )
    if not opened:
        return d
    own = g.nodes.where((F.col("kind") == "file") & F.col("parent").isin(*opened)).select("id", "parent")
    e = g.edges.where("kind = 'imports'").join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a = b")
    return d.unionByName(e.select(F.concat(F.lit("imp:"), "src", F.lit("→"), "dst").alias("id"), "src", "dst", F.lit(None).cast("double").alias("width"), F.lit(None).cast("string").alias("label")))


def table_boxes(g: Graph, head: int = 36, row: int = 22) -> DataFrame:
    """id, name, n_columns, height of tables."""
    n = F.coalesce(F.size("columns"), F.lit(0))
    return g.nodes.where("kind = 'table'").select("id", "name", n.alias("n_columns"), (F.lit(head) + n * row).alias("height"))


def diff_nodes(base: Graph, head: Graph, renames: DataFrame | None = None) -> DataFrame:
    """id, name, status (added, changed for renamed, removed, or null), detail: the head's modules and ghosts of lost ones.

    A removed dependency whose end isn't in the head makes that end a ghost too.
    """
    changes = diff_modules(base, head, renames)
    new = changes.where("change <> 'removed'").select(F.col("module").alias("id"), "change", "previous")
    now = head.nodes.where("kind = 'module'").select("id", "name")
    status = F.when(F.col("change") == "added", "added").when(F.col("change") == "renamed", "changed")
    shown = now.join(new, "id", "left").select("id", "name", status.alias("status"), F.when(F.col("change") == "renamed", F.concat(F.lit("renamed from "), rest_col("previous"))).alias("detail"))
    lost = changes.where("change = 'removed'").select(F.col("module").alias("id"))
    gone = diff_dependencies(base, head, renames).where("change = 'removed'").select(F.explode(F.array("src", "dst")).alias("id"))
    ghosts = lost.union(gone).distinct().join(now.select("id"), "id", "left_anti")
    return shown.union(ghosts.select("id", rest_col("id"), F.lit("removed"), F.lit(None).cast("string")))


def diff_lines(base: Graph, head: Graph, renames: DataFrame | None = None) -> DataFrame:
    """id, src, dst, class, label: the head's dependencies by what became of them, and the removed ones."""
    changes = diff_dependencies(base, head, renames)
    marks = changes.where("change <> 'removed'").select("src", "dst", "change", "before", "after")
    kind = F.when(F.col("change") == "added", "edge-added").when(F.col("change") == "weight", "edge-changed")
    label = F.when(F.col("change") == "weight", F.concat(F.col("before").cast("string"), F.lit(" → "), F.col("after").cast("string")))
    shown = overview_dependencies(head).join(marks, ["src", "dst"], "left")
    shown = shown.select(F.concat(F.lit("dep:"), "src", F.lit("→"), "dst").alias("id"), "src", "dst", kind.alias("class"), label.alias("label"))
    gone = changes.where("change = 'removed'")
    return shown.union(gone.select(F.concat(F.lit("dep-removed:"), "src", F.lit("→"), "dst"), "src", "dst", F.lit("edge-removed"), F.lit(None).cast("string")))


def home_modules(g: Graph, most: int = HOME_MODULES) -> DataFrame:
    """The modules of the start page, by rank."""
    return module_summaries(g).orderBy(F.desc("rank"), F.collate("id", "UNICODE")).limit(most)


def relative_time(at, now) -> Column:
    """just now, minutes, hours or days between two timestamps."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < FRESH_SECONDS, "just now").when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).otherwise(ago(86_400, "d"))


#: Colours of layers. Fixed values.
LAYER_COLORS = ("#2563eb", "#7c3aed", "#0891b2", "#16a34a", "#d97706", "#dc2626", "#db2777", "#65a30d")


def layer_color(layer: Column) -> Column:
    """A layer's colour by a rolling hash of its characters (times 31, in 32 bits with overflow); of a character beyond 16 bits its first half counts."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    point = lambda c: F.ascii(c).cast("long")
    unit = lambda c: F.when(point(c) > 0xFFFF, F.lit(0xD800) + F.shiftright(point(c) - 0x10000, 10)).otherwise(point(c))
    hashed = F.aggregate(F.filter(F.split(layer, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + unit(c)))
    return F.when(layer.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in LAYER_COLORS]), (F.abs(hashed) % len(LAYER_COLORS)).cast("int") + 1))
