"""From facts to a graph: edges merged, module dependencies derived, metrics attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id_col
from ..schema import NODE_KINDS, Graph, edges_of, nodes_of
from .algo import checkpointed, pagerank, stored

#: What counts as fan: both ends of these kinds, and only the target of package imports. Fixed values.
FAN_BOTH = ("imports", "depends_on", "maps_to", "fk")
FAN_TARGET = ("imports_pkg",)
#: Mappers whose relations name tables and columns; the others name entities and fields.
BY_TABLE = ("sqlalchemy",)


def merge_edges(edges: DataFrame, keys: tuple[str, ...] = ("kind", "src", "dst")) -> DataFrame:
    """One edge for each (kind, src, dst), or what else names it: symbols are the sorted distinct union of all its occurrences."""
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("symbols", F.array().cast("array<string>"))))))
    return edges.groupBy(*keys).agg(union.alias("symbols"))


def module_nodes(files: DataFrame) -> DataFrame:
    """Modules of files (path, module, layer, module_source)."""
    first = files.groupBy("module").agg(F.min_by("layer", "path").alias("layer"), F.min_by("module_source", "path").alias("module_source"))
    return nodes_of(first.select(node_id_col("module", "module").alias("id"), F.lit("module").alias("kind"), F.col("module").alias("name"), "layer", "module_source"))


def file_nodes(files: DataFrame) -> DataFrame:
    """File nodes below their modules; files: path, module, lang, loc, doc."""
    return nodes_of(
        files.select(
            node_id_col("file", "path").alias("id"),
            F.lit("file").alias("kind"),
            F.element_at(F.split("path", "/"), -1).alias("name"),
            node_id_col("module", "module").alias("parent"),
            "lang",
            "loc",
            "path",
            "doc",
            F.lit(1).alias("start_line"),
            F.greatest("loc", F.lit(1)).alias("end_line"),
        )
    )


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Exported symbols below their files; of symbols that repeat a name in a file the last one stays."""
    own = symbols.where("exported").withColumn("rn", F.row_number().over(Window.partitionBy("path", "name").orderBy(F.desc("pos")))).where("rn = 1")
    return nodes_of(
        own.select(
            node_id_col("symbol", "path", "name").alias("id"),
            F.lit("symbol").alias("kind"),
            "name",
            node_id_col("file", "path").alias("parent"),
            "lang",
            "path",
            "start_line",
            "end_line",
            "symbol_kind",
            "exported",
            "doc",
        )
    )


def depends_on(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted module dependencies: the number of file imports between files of different modules."""
    parent = nodes.where("kind = 'file'").select("id", "parent")
    pairs = (
        edges.where("kind = 'imports'")
        .join(parent.toDF("src", "from_module"), "src")
        .join(parent.toDF("dst", "to_module"), "dst")
        .where("from_module <> to_module")
        .groupBy("from_module", "to_module")
        .agg(F.count("*").alias("weight"))
    )
    return edges_of(
        pairs.select(
            F.lit("depends_on").alias("kind"), F.col("from_module").alias("src"), F.col("to_module").alias("dst"), "weight", F.lit("static").alias("source"), F.lit("certain").alias("confidence")
        )
    )


def first_wins(edges: list[DataFrame]) -> DataFrame:
    """Union of edge tables, each without repeats; of edges with one identity that of the earliest table stays."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e.join(out.select("id"), "id", "left_anti").select(*out.columns))
    return out


def manual_edges(edges: DataFrame, manual: DataFrame) -> DataFrame:
    """Edges of the configuration (kind, src, dst, reason): they replace extracted ones of the same identity."""
    own = edges_of(manual.select("kind", "src", "dst", "reason", F.lit("manual").alias("source"), F.lit("certain").alias("confidence")))
    return first_wins([own.dropDuplicates(["id"]), edges])


def with_dependencies(nodes: DataFrame, edges: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Adds derived module dependencies (made here unless they are given); a derived one replaces a manual one of the same identity.
    Other kinds pass through."""
    derived = depends_on(nodes, edges) if derived is None else derived
    return edges.where("kind <> 'depends_on'").unionByName(first_wins([derived, edges.where("kind = 'depends_on'")]))


def fan_metrics(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out over the kinds that count; one pass, both ends stacked before the count."""
    ends = edges.where(F.col("kind").isin(*FAN_BOTH, *FAN_TARGET)).select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.when(F.col("kind").isin(*FAN_BOTH), F.col("src")).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    )
    return ends.where("e.id IS NOT NULL").groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def rollup(nodes: DataFrame) -> DataFrame:
    """id, loc, rank, files of modules: sums over their files."""
    return (
        nodes.where("kind = 'file'")
        .groupBy(F.col("parent").alias("id"))
        .agg(F.sum("loc").alias("loc"), F.round(F.sum("rank"), 6).alias("rank"), F.count("*").alias("files"))
    )


def stored_graph(graph: Graph) -> Graph:
    """The graph, its edges in a table without their identities, which follow from the rest."""
    return Graph(checkpointed(graph.nodes), edges_of(stored(graph.edges.drop("id"))))


def with_metrics(graph: Graph, rank: DataFrame | None = None, fans: DataFrame | None = None) -> Graph:
    """Fan, PageRank of files, and module sums attached to the nodes. Edges are read several times, so they are stored first."""
    graph = stored_graph(graph)
    rank = pagerank(graph.nodes, graph.edges) if rank is None else rank
    base = graph.nodes.drop("fan_in", "fan_out", "rank")
    fans = fan_metrics(graph.edges) if fans is None else fans
    own = base.join(fans, "id", "left").join(rank.select("id", "rank"), "id", "left")
    own = own.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out", "rank")})
    sums = rollup(own).select("id", F.col("loc").alias("m_loc"), F.col("rank").alias("m_rank"))
    own = own.join(sums, "id", "left").withColumns({"loc": F.coalesce("m_loc", "loc"), "rank": F.coalesce("m_rank", "rank")})
    return Graph(nodes_of(own), graph.edges)


def kind_counts(nodes: DataFrame) -> DataFrame:
    """kind, n for every node kind, zero included."""
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    return kinds.join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill({"n": 0})


def in_graph_order(df: DataFrame) -> DataFrame:
    """Rows by identity in the order of the Unicode collation."""
    return df.orderBy(F.collate("id", "UNICODE"))


def link_declared_schema(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table nodes and maps_to / fk edges of declared entities.

    entities: id, path, name, orm, table_schema, table_name, explicit, fields (name, type, column, nullable, is_pk, is_fk),
    relations (from_field, from_col, target, target_col). Entities go by identity: for each table column the first entity
    that declares it wins. Foreign keys of one pair of tables are one edge with all column pairs. A relation that names a
    table keeps it, declared or not; one to an entity that isn't declared is dropped. A field of the target entity stands
    for its column. A mapping is certain if the table's name is explicit.
    """
    e = entities.withColumn("table_id", node_id_col("table", F.coalesce("table_schema", F.lit("public")), "table_name"))
    by_name = e.groupBy(F.col("name").alias("target")).agg(F.min_by("table_id", "id").alias("t1"), F.min("id").alias("to_entity"))
    fields = e.select(F.col("id").alias("to_entity"), F.explode("fields").alias("f")).groupBy("to_entity", F.col("f.name").alias("target_col")).agg(F.min("f.column").alias("to_column"))
    rel = e.select("id", "table_id", "orm", F.explode("relations").alias("r")).select("id", "table_id", "orm", "r.*")
    rel = rel.join(by_name, "target", "left")
    named = F.concat(F.lit("tbl:"), F.when(F.col("target").contains("."), F.col("target")).otherwise(F.concat(F.lit("public."), "target")))
    rel = rel.withColumn("to_table", F.when(F.col("orm").isin(*BY_TABLE), named).otherwise(F.col("t1"))).where("to_table IS NOT NULL")
    rel = rel.join(fields, ["to_entity", "target_col"], "left").withColumn("target_col", F.coalesce("to_column", "target_col")).drop("to_column")
    cols = e.select("id", "table_id", F.posexplode("fields").alias("pos", "f")).where("f.column IS NOT NULL")
    one = cols.withColumn("rn", F.row_number().over(Window.partitionBy("table_id", "f.column").orderBy("id", "pos"))).where("rn = 1")
    fk = rel.withColumn("rn", F.row_number().over(Window.partitionBy("table_id", "from_col").orderBy("id"))).where("rn = 1")
    fk = fk.select("table_id", F.col("from_col").alias("col"), F.expr("substring(to_table, 5)").alias("fk_table"), F.col("target_col").alias("fk_column"))
    one = one.withColumn("col", F.col("f.column")).join(fk, ["table_id", "col"], "left")
    columns = one.groupBy("table_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.collate("col", "UNICODE").alias("by_name"), F.struct(F.col("col").alias("name"), F.col("f.type").alias("sql_type"), F.col("f.nullable").alias("nullable"), F.col("f.is_pk").alias("is_pk"), "fk_table", "fk_column").alias("c")
                )
            )
        ).alias("cs")
    )
    tables = nodes_of(
        e.select("table_id", "table_name").distinct().join(columns, "table_id", "left").select(
            F.col("table_id").alias("id"), F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.lit("declared").alias("origin"), F.expr("transform(cs, x -> x.c)").alias("columns")
        )
    )
    maps = e.select(
        F.lit("maps_to").alias("kind"), F.col("id").alias("src"), F.col("table_id").alias("dst"), F.lit("static").alias("source"), F.when(F.col("explicit"), "certain").otherwise("inferred").alias("confidence")
    )
    fks = rel.groupBy(F.col("table_id").alias("src"), F.col("to_table").alias("dst")).agg(
        F.array_distinct(F.expr("transform(sort_array(collect_list(struct(id, from_col, target_col))), x -> struct(x.from_col as from_col, x.target_col as to_col))")).alias("fk_columns")
    )
    fks = fks.select(F.lit("fk").alias("kind"), "src", "dst", "fk_columns", F.lit("static").alias("source"), F.lit("certain").alias("confidence"))
    return tables, edges_of(maps).unionByName(edges_of(fks))
