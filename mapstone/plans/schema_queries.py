"""Registered queries of declared schemas made of the tables, through the linking of entities, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build, diff, flows, views
from ..schema import Graph, nodes_of
from . import adapters as A
from .queries import query

# A customer is an entity with a table in its region's schema: a column for each priority of its orders, and a key to the next
# customer of its nation. The key names a field of the target; where the target has no such field the name stays as it is.
DECLARED = """
    c AS (SELECT c_custkey AS k, lower(replace(r_name, ' ', '_')) AS s, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nx FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority[1] AS p FROM orders WHERE o_custkey IN (SELECT k FROM c)),
    t AS (SELECT k, 'tbl:' || s || '.c' || k AS id, s, nx FROM c),
    fk AS (SELECT a.k, a.id AS src, b.id AS dst, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.k = b.k AND p.p = '1') THEN 'p1' ELSE 'f1' END AS col FROM t a JOIN t b ON b.k = a.nx)
"""


def declared(spark, sf) -> Graph:
    """Tables and entities of the customers."""
    nation = A.read(spark, sf, "nation").join(A.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_"))).alias("s"))
    c = A.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("k"), "s", F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("nx"))
    p = A.read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("p")).groupBy("k").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    own = c.join(p, "k", "left")
    field = lambda name, kind, column, nullable, pk, fk: F.struct(name.alias("name"), kind.alias("type"), column.alias("column"), nullable.alias("nullable"), pk.alias("is_pk"), fk.alias("is_fk"))
    false = F.lit(False)
    plain = F.transform(F.coalesce("ps", F.array().cast("array<string>")), lambda x: field(F.concat(F.lit("f"), x), F.lit("text"), F.concat(F.lit("p"), x), x != "1", x == "1", false))
    key = field(F.lit("next"), F.lit("integer"), F.lit("next_key"), F.lit(True), false, F.col("nx").isNotNull())
    relation = F.struct(F.lit("next").alias("from_field"), F.lit("next_key").alias("from_col"), F.concat(F.lit("C"), "nx").alias("target"), F.lit("f1").alias("target_col"))
    path = F.concat(F.lit("models/c"), "k", F.lit(".prisma"))
    ents = own.select(
        F.concat(F.lit("ent:"), path, F.lit("#C"), "k").alias("id"), path.alias("path"), F.concat(F.lit("C"), "k").alias("name"), F.lit("prisma").alias("orm"), F.col("s").alias("table_schema"), F.concat(F.lit("c"), "k").alias("table_name"),
        (F.col("k") % 2 == 0).alias("explicit"), F.concat(plain, F.array(key)).alias("fields"), F.when(F.col("nx").isNotNull(), F.array(relation)).otherwise(F.array().cast("array<struct<from_field:string,from_col:string,target:string,target_col:string>>")).alias("relations"),
    )
    tables, edges = build.link_declared_schema(ents)
    nodes = nodes_of(ents.select("id", F.lit("entity").alias("kind"), "name", F.concat(F.lit("file:"), "path").alias("parent"), "path", "orm"))
    return Graph(nodes.unionByName(tables), edges)


@query(f"WITH {DECLARED} SELECT t.id, s AS schema, 'c' || t.k AS name, count(p) + 1 AS n_columns, coalesce(max(CASE WHEN p = '1' THEN 'p1' END), '') AS pk, 'ent:models/c' || t.k || '.prisma#C' || t.k AS entities FROM t LEFT JOIN p ON p.k = t.k GROUP BY ALL")
def declared_tables(spark, sf):
    t = views.table_summaries(declared(spark, sf))
    return t.select("id", "schema", "name", F.col("n_columns").cast("long").alias("n_columns"), F.array_join("pk", ",").alias("pk"), F.array_join("entities", ",").alias("entities"))


@query(f"""WITH {DECLARED} SELECT t.id AS table_id, 'p' || p AS name, 'text' AS sql_type, p <> '1' AS nullable, p = '1' AS is_pk, CAST(NULL AS VARCHAR) AS fk_table, CAST(NULL AS VARCHAR) AS fk_column FROM t JOIN p USING (k)
    UNION ALL SELECT t.id, 'next_key', 'integer', true, false, substr(fk.dst, 5), col FROM t LEFT JOIN fk USING (k)""")
def declared_columns(spark, sf):
    return views.erd_columns(declared(spark, sf)).drop("pos")


@query(f"WITH {DECLARED} SELECT src, dst, 'next_key=' || col AS columns, 'certain' AS confidence FROM fk")
def declared_keys(spark, sf):
    return views.foreign_keys(declared(spark, sf)).select("src", "dst", F.expr("array_join(transform(fk_columns, x -> concat(x.from_col, '=', x.to_col)), ',')").alias("columns"), "confidence")


@query(f"WITH {DECLARED} SELECT 'ent:models/c' || k || '.prisma#C' || k AS entity_id, id AS table_id, 'C' || k AS entity_name, CASE WHEN k % 2 = 0 THEN 'certain' ELSE 'inferred' END AS confidence FROM t")
def declared_mappings(spark, sf):
    return views.mapped_entities(declared(spark, sf)).select("entity_id", "table_id", "entity_name", "confidence")


@query(f"WITH {DECLARED} SELECT t.id, count(p) + 1 AS n_columns, 36 + 22 * (count(p) + 1) AS height FROM t LEFT JOIN p ON p.k = t.k GROUP BY t.id")
def declared_boxes(spark, sf):
    return flows.table_boxes(declared(spark, sf)).select("id", F.col("n_columns").cast("long").alias("n_columns"), F.col("height").cast("long").alias("height"))


def _changed(spark, sf) -> tuple[Graph, Graph]:
    """The declared schema, and as it is once urgent orders are no key any more and every fourth customer's table is gone."""
    base = declared(spark, sf)
    lost = F.expr("CAST(substring_index(id, '.c', -1) AS long) % 4 = 0")
    keyless = F.expr("transform(columns, c -> named_struct('name', c.name, 'sql_type', c.sql_type, 'nullable', c.nullable, 'is_pk', false, 'fk_table', c.fk_table, 'fk_column', c.fk_column))")
    nodes = base.nodes.where((F.col("kind") != "table") | ~lost).withColumn("columns", F.when(F.col("kind") == "table", keyless))
    gone = lambda end: F.expr(f"CAST(substring_index({end}, '.c', -1) AS long) % 4 = 0")
    return base, Graph(nodes, base.edges.where((F.col("kind") != "fk") | ~(gone("src") | gone("dst"))))


@query(f"WITH {DECLARED} SELECT t.id AS table_id, 'p1' AS \"column\", 'text pk' AS before, 'text' AS after FROM t JOIN p USING (k) WHERE p = '1' AND k % 4 <> 0")
def changed_columns(spark, sf):
    return diff.diff_columns(*_changed(spark, sf))


@query(f"WITH {DECLARED} SELECT 'removed' AS change, id AS table_id FROM t WHERE k % 4 = 0 UNION ALL SELECT 'changed', t.id FROM t JOIN p USING (k) WHERE p = '1' AND k % 4 <> 0")
def changed_tables(spark, sf):
    return diff.diff_tables(*_changed(spark, sf))


@query(f"WITH {DECLARED} SELECT 'removed' AS change, src, dst FROM fk JOIN t ON t.id = fk.dst WHERE fk.k % 4 = 0 OR t.k % 4 = 0")
def changed_keys(spark, sf):
    return diff.diff_foreign_keys(*_changed(spark, sf))
