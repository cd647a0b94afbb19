"""Declared against live schema, and the overlay of the live schema on a graph.

Both sides are flat: columns (schema, table, column, pos, sql_type, nullable, is_pk, fk_table, fk_column) and, for the
live side, tables (schema, table) and keys (schema, table, from_col, to_schema, to_table, to_col).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_id_col, rest_col
from ..functions.types import sql_family_col
from ..schema import DRIFT, Graph, edges_of, nodes_of
from .build import first_wins
from .views import split_table_ref

DEFAULT_SCHEMA = "public"


@dataclass
class Live:
    """A live database: its tables, columns and foreign keys, and the schema that unqualified names mean."""

    tables: DataFrame
    columns: DataFrame
    keys: DataFrame
    default_schema: str = DEFAULT_SCHEMA


def declared_columns(g: Graph) -> DataFrame:
    """Flat declared columns of a graph's tables; those that only a live database has are left out."""
    t = g.nodes.where("kind = 'table' AND coalesce(origin, 'declared') <> 'live'").withColumn("ref", rest_col("id"))
    schema, name = split_table_ref("ref")
    return t.select(F.col("id").alias("table_id"), schema.alias("schema"), name.alias("table"), F.posexplode_outer("columns").alias("pos", "c")).select(
        "table_id", "schema", "table", F.col("c.name").alias("column"), "pos", "c.sql_type", "c.nullable", "c.is_pk", "c.fk_table", "c.fk_column"
    )


def _mapped(declared: DataFrame, live: Live) -> DataFrame:
    """Declared rows with the schema that the live side calls the default one."""
    return declared.withColumn("schema", F.when(F.col("schema") == DEFAULT_SCHEMA, live.default_schema).otherwise(F.col("schema")))


def compute_drift(declared: DataFrame, live: Live, families: dict[str, str] | None = None) -> DataFrame:
    """schema, table, kind, column, detail of every difference."""
    d = _mapped(declared, live)
    dt, lt = d.select("schema", "table").distinct(), live.tables.select("schema", "table").distinct()
    key = F.concat_ws(".", "schema", "table")
    none = F.lit(None).cast("string").alias("column")
    out = dt.join(lt, ["schema", "table"], "left_anti").select(
        "schema", "table", F.lit("table_missing_in_db").alias("kind"), none, F.concat(F.lit("the database has no table "), key).alias("detail")
    )
    out = out.union(
        lt.join(dt, ["schema", "table"], "left_anti").join(dt.select("schema").distinct(), "schema", "left_semi").select(
            "schema", "table", F.lit("table_missing_in_code"), none, F.concat(F.lit("no entity declares the table "), key)
        )
    )
    common = dt.join(lt, ["schema", "table"], "left_semi")
    a = d.where("column IS NOT NULL").select("schema", "table", "column", F.col("sql_type").alias("d_type"), F.col("nullable").alias("d_null"))
    b = live.columns.select("schema", "table", "column", F.col("sql_type").alias("l_type"), F.col("nullable").alias("l_null"))
    both = a.join(b, ["schema", "table", "column"], "full").join(common, ["schema", "table"], "left_semi")
    df, lf = sql_family_col("d_type", families), sql_family_col("l_type", families)
    word = lambda c: F.when(F.col(c), "nullable").otherwise("not null")
    found = F.array_compact(
        F.array(
            F.when(F.col("l_type").isNull(), F.struct(F.lit("column_missing_in_db").alias("kind"), F.concat(F.lit("the database has no column "), "column", F.lit(" of type "), "d_type").alias("detail"))),
            F.when(F.col("d_type").isNull(), F.struct(F.lit("column_missing_in_code").alias("kind"), F.concat(F.lit("no entity declares the column "), "column", F.lit(" of type "), "l_type").alias("detail"))),
            F.when((df != "unknown") & (df != lf), F.struct(F.lit("type_mismatch").alias("kind"), F.concat("column", F.lit(" should be "), "d_type", F.lit(", a type of "), df, F.lit("; the database has "), "l_type", F.lit(", a type of "), lf).alias("detail"))),
            F.when(F.col("d_null") != F.col("l_null"), F.struct(F.lit("nullability_mismatch").alias("kind"), F.concat("column", F.lit(" should be "), word("d_null"), F.lit("; the database has it "), word("l_null")).alias("detail"))),
        )
    )
    out = out.union(both.select("schema", "table", F.explode(found).alias("f"), "column").select("schema", "table", "f.kind", "column", "f.detail"))
    to = F.concat(F.lit(" → "), "target")
    dk = d.where("fk_table IS NOT NULL").select("schema", "table", "column", F.concat_ws(".", "fk_table", "fk_column").alias("target")).distinct()
    lk = live.keys.select("schema", "table", F.col("from_col").alias("column"), F.concat_ws(".", "to_schema", "to_table", F.coalesce("to_col", F.lit(""))).alias("target")).distinct()
    dk, lk = dk.join(common, ["schema", "table"], "left_semi"), lk.join(common, ["schema", "table"], "left_semi")
    pair = ["schema", "table", "column", "target"]
    out = out.union(dk.join(lk, pair, "left_anti").select("schema", "table", F.lit("fk_missing_in_db"), "column", F.concat(F.lit("the database doesn't enforce the reference "), "column", to)))
    return out.union(lk.join(dk, pair, "left_anti").select("schema", "table", F.lit("fk_missing_in_code"), "column", F.concat(F.lit("no entity declares the reference "), "column", to)))


def drift_summary(declared: DataFrame, drift: DataFrame) -> dict:
    """total, tables_checked and, as a command's exit code would be, whether there is any."""
    total = drift.count()
    return {"total": total, "tables_checked": declared.select("schema", "table").distinct().count(), "exit": int(total > 0)}


def merge_live(g: Graph, live: Live, families: dict[str, str] | None = None) -> Graph:
    """The graph with the live schema over it; merging again gives the same.

    Earlier overlays go first. Declared tables get their drift and origin both or declared; tables that only the live
    side has join if their schema is a declared one; live foreign keys join unless a static edge has their identity.
    """
    nodes = g.nodes.where("NOT (kind = 'table' AND coalesce(origin, 'declared') = 'live')").withColumns(
        {"drift": F.lit(None).cast(DRIFT), "origin": F.when(F.col("kind") == "table", "declared").otherwise(F.col("origin"))}
    )
    edges = g.edges.where("source <> 'live'")
    declared = _mapped(declared_columns(Graph(nodes, edges)), live)
    drift = compute_drift(declared, live, families)
    entries = drift.groupBy("schema", "table").agg(
        F.expr("transform(array_sort(collect_list(struct(kind, detail, column))), x -> x)").cast(DRIFT).alias("found")
    )
    own = declared.select("table_id", "schema", "table").distinct()
    lt = live.tables.select("schema", "table").distinct()
    info = own.join(lt.withColumn("live", F.lit(True)), ["schema", "table"], "left").join(entries, ["schema", "table"], "left")
    info = info.select(F.col("table_id").alias("id"), F.coalesce("live", F.lit(False)).alias("live"), "found")
    kept = nodes.join(info, "id", "left").withColumns(
        {"origin": F.when(F.col("live"), "both").otherwise(F.col("origin")), "drift": F.coalesce("found", "drift")}
    )
    fresh = lt.join(own, ["schema", "table"], "left_anti").join(own.select("schema").distinct(), "schema", "left_semi")
    columns = live.columns.join(live.keys.select("schema", "table", F.col("from_col").alias("column"), F.concat_ws(".", "to_schema", "to_table").alias("fk_table"), F.col("to_col").alias("fk_column")), ["schema", "table", "column"], "left")
    columns = columns.groupBy("schema", "table").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, column, sql_type, nullable, is_pk, fk_table, fk_column))), x -> struct(x.column as name, x.sql_type, x.nullable, x.is_pk, x.fk_table, x.fk_column))").alias("columns")
    )
    added = fresh.join(columns, ["schema", "table"], "left").join(entries, ["schema", "table"], "left").select(
        node_id_col("table", "schema", "table").alias("id"), F.lit("table").alias("kind"), F.col("table").alias("name"), F.lit("live").alias("origin"), "columns", F.col("found").alias("drift"),
        F.lit(0).alias("fan_in"), F.lit(0).alias("fan_out"), F.lit(0.0).alias("rank"),
    )
    at = own.select("schema", "table", F.col("table_id").alias("id")).union(fresh.select("schema", "table", node_id_col("table", "schema", "table")))
    keys = live.keys.join(at.withColumnRenamed("id", "src"), ["schema", "table"]).join(at.toDF("to_schema", "to_table", "dst"), ["to_schema", "to_table"])
    fk = keys.groupBy("src", "dst").agg(F.expr("transform(array_sort(collect_list(struct(from_col, to_col))), x -> x)").alias("fk_columns"))
    fk = fk.select(F.lit("fk").alias("kind"), "src", "dst", "fk_columns", F.lit("live").alias("source"), F.lit("certain").alias("confidence"))
    return Graph(nodes_of(kept).unionByName(nodes_of(added)), first_wins([edges, edges_of(fk)]))


def live_from_spark(spark, tables: dict[str, DataFrame], schema: str = DEFAULT_SCHEMA) -> Live:
    """A live side from Spark's own schemas; names of columns and types only, no data is read."""
    rows = [(schema, t, f.name, k, f.dataType.simpleString(), f.nullable, False) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    return Live(
        spark.createDataFrame([(schema, t) for t in tables], "schema string, table string"),
        spark.createDataFrame(rows, "schema string, table string, column string, pos int, sql_type string, nullable boolean, is_pk boolean"),
        spark.createDataFrame([], "schema string, table string, from_col string, to_schema string, to_table string, to_col string"),
        schema,
    )
