"""Row types of the graph: nodes, edges, and their parts. Schemas are explicit, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds and enumerations that stored graphs use. Fixed values.
NODE_KINDS = ("module", "file", "symbol", "entity", "table", "extpkg", "doc")
EDGE_KINDS = ("imports", "imports_pkg", "calls", "fk", "maps_to", "depends_on", "documents")
EDGE_SOURCES = ("static", "live", "manual")
CONFIDENCES = ("certain", "inferred")

COLUMNS = "array<struct<name:string,sql_type:string,nullable:boolean,is_pk:boolean,fk_table:string,fk_column:string>>"
FIELDS = "array<struct<name:string,type:string,column:string,nullable:boolean,is_pk:boolean,is_fk:boolean>>"
DRIFT = "array<struct<kind:string,detail:string,column:string>>"
NODE = (
    "id string, kind string, name string, parent string, lang string, loc int, fan_in long, fan_out long, rank double,"
    " path string, start_line int, end_line int, layer string, module_source string, doc string, symbol_kind string, exported boolean,"
    f" orm string, declared_table string, fields {FIELDS}, origin string, columns {COLUMNS}, drift {DRIFT},"
    " registry string, title string, content string, truncated boolean, headings array<struct<depth:int,text:string>>"
)
EDGE = (
    "id string, kind string, src string, dst string, source string, confidence string, symbols array<string>, weight long,"
    " fk_columns array<struct<from_col:string,to_col:string>>, reason string"
)


@dataclass
class Graph:
    """Two DataFrames. Operators take one and give a new one."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of a schema: missing ones null, others dropped, types cast."""
    from pyspark.sql.types import StructType

    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields]
    )


def nodes_of(df: DataFrame) -> DataFrame:
    return conform(df, NODE)


def edges_of(df: DataFrame) -> DataFrame:
    """Adds the identity of an edge, of which there is one for each kind, source and target."""
    return conform(df.withColumn("id", F.concat_ws("|", "kind", "src", "dst")), EDGE)


#: What each kind of edge leads from and to; a document may belong to anything. Fixed values.
ENDS = {
    "imports": ("file", "file"), "imports_pkg": ("file", "extpkg"), "calls": ("symbol", "symbol"), "fk": ("table", "table"), "maps_to": ("entity", "table"), "depends_on": ("module", "module"), "documents": ("doc", None),
}
#: What may hold a node of a kind. Fixed values.
HOLDERS = {"file": "module", "symbol": "file", "entity": "file"}


#: Columns that a check reads.
CHECKED_OF_NODES = ("id", "kind", "parent", "fan_in", "fan_out", "rank", "loc", "columns")
CHECKED_OF_EDGES = ("id", "kind", "src", "dst", "source", "confidence")


def violations(graph: Graph) -> DataFrame:
    """what, id, detail of everything that is wrong with a graph, in one plan: unknown kinds, sources and confidences, negative metrics,
    repeated identities, parents and ends of edges that aren't there or are of the wrong kind, and tables whose foreign keys
    name no table. An empty result is a valid graph."""
    from .operators.algo import stored

    return violations_of(stored(graph.nodes.select(*CHECKED_OF_NODES)), stored(graph.edges.select(*CHECKED_OF_EDGES)))  # both are read many times


def violations_of(n: DataFrame, e: DataFrame) -> DataFrame:
    """The same for nodes and edges (CHECKED_OF_NODES, CHECKED_OF_EDGES) that are stored already. Each of both is looked through once for
    what a row shows alone, and all that names a node is joined with the nodes at once, so that the plan stays small."""
    same = e.groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("m")).where("m > 1").select("h")
    maybe = e.withColumn("h", F.xxhash64("id")).join(same, "h", "left_semi")  # hashes are shorter than identities; few repeat
    allowed = lambda values: ", ".join(f"'{v}'" for v in values)
    other = lambda column, values: f"{column} IS NULL OR {column} NOT IN ({allowed(values)})"
    told = lambda what, when, detail: F.when(F.expr(when), F.struct(F.lit(what).alias("what"), F.expr(detail).cast("string").alias("detail")))
    listed = lambda df, *found: df.select("id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.what", "id", "v.detail")
    again = lambda df, what: df.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select(F.lit(what).alias("what"), "id", F.col("times").cast("string").alias("detail"))
    of = lambda found, kind: F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, v)])[F.col(kind)]
    # names of nodes: by whom, as what, and the kind that it must be of
    held = n.where("parent IS NOT NULL").select("id", F.lit("parent").alias("role"), F.col("parent").alias("at"), of(HOLDERS, "kind").alias("wanted"))
    ends = [F.struct(F.lit(end).alias("role"), F.col(end).alias("at"), of({kind: x[k] or "" for kind, x in ENDS.items()}, "kind").alias("wanted")) for k, end in enumerate(("src", "dst"))]
    ends = e.select("id", F.explode(F.array(*ends)).alias("x")).select("id", "x.*")
    refs = n.where("kind = 'table'").select("id", F.explode("columns").alias("c")).where("c.fk_table IS NOT NULL").select("id", F.lit("ref").alias("role"), F.concat(F.lit("tbl:"), "c.fk_table").alias("at"), F.lit(None).cast("string").alias("wanted"))
    kinds = n.select(F.col("id").alias("at"), F.col("kind").alias("is"), F.lit(True).alias("there")).dropDuplicates(["at"])
    named = held.unionByName(ends).unionByName(refs).join(kinds, "at", "left")
    wrong = F.expr("if(role = 'ref', there IS NULL, is IS NULL)")
    named = named.where(wrong | F.expr("wanted <> '' AND is <> wanted"))
    named = named.select(F.when(wrong, F.expr("if(role = 'ref', 'missing referenced table', concat('missing ', role))")).otherwise(F.concat(F.lit("kind of "), "role")).alias("what"), "id", F.when(wrong, F.col("at")).otherwise(F.col("is")).alias("detail"))
    found = listed(n, told("node kind", other("kind", NODE_KINDS), "kind"), told("negative metric", "fan_in < 0 OR fan_out < 0 OR rank < 0 OR loc < 0", "NULL"))
    found = found.unionByName(listed(e, told("edge kind", other("kind", EDGE_KINDS), "kind"), told("edge source", other("source", EDGE_SOURCES), "source"), told("edge confidence", other("confidence", CONFIDENCES), "confidence")))
    return found.unionByName(again(n, "repeated node")).unionByName(again(maybe, "repeated edge")).unionByName(named)


def validate(graph: Graph) -> None:
    """Raise if a kind, source or confidence is unknown, a metric is negative, or an identity repeats."""
    n = graph.nodes.agg(
        F.sum((~F.col("kind").isin(*NODE_KINDS)).cast("int")).alias("kinds"),
        F.sum(F.expr("fan_in < 0 or fan_out < 0 or rank < 0 or loc < 0").cast("int")).alias("negative"),
        (F.count("id") - F.countDistinct("id")).alias("repeated"),
    ).first()
    e = graph.edges.agg(
        F.sum((~F.col("kind").isin(*EDGE_KINDS) | ~F.col("source").isin(*EDGE_SOURCES) | ~F.col("confidence").isin(*CONFIDENCES)).cast("int")).alias("kinds"),
        (F.count("id") - F.countDistinct("id")).alias("repeated"),
    ).first()
    wrong = {f"{what} {k}": v for what, r in (("node", n), ("edge", e)) for k, v in r.asDict().items() if v}
    if wrong:
        raise ValueError(f"not a valid graph: {wrong}")
