"""Graphs made of the star-schema tables, so that every operator runs on data a SQL engine can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.build import first_wins, merge_edges, with_dependencies, with_metrics
from ..operators.drift import Live
from ..schema import Graph, edges_of, nodes_of



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(df: DataFrame, kind: str) -> DataFrame:
    return edges_of(df.withColumns({"kind": F.lit(kind), "source": F.lit("static"), "confidence": F.lit("certain")}))


def supply_files(spark: SparkSession, sf: str, until: str | None = None) -> DataFrame:
    """path, module, layer, module_source, lang, loc, doc: customers (loc: orders) and suppliers (loc: line items)."""
    nation = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.col("n_name").alias("module"), F.col("r_name").alias("layer"))
    orders = read(spark, sf, "orders")
    if until:
        orders = orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    if until:
        items = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    n_orders = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("loc"))
    n_items = items.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("loc"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("what"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("what"))
    how = "inner" if until else "left"
    both = c.join(n_orders, "k", how).unionByName(s.join(n_items, "k", how))
    return both.join(nation, "n_nationkey").select(
        F.concat_ws("/", "what", "k").alias("path"), "module", "layer", F.lit("config").alias("module_source"), F.lit("sql").alias("lang"),
        F.coalesce("loc", F.lit(0)).cast("int").alias("loc"), F.lit(None).cast("string").alias("doc"),
    )


def supply_imports(spark: SparkSession, sf: str, until: str | None = None) -> DataFrame:
    """Customers import the suppliers they bought from; symbols are the return flags."""
    orders = read(spark, sf, "orders")
    if until:
        orders = orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    lines = read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # merged by their keys, which are shorter than the names made of them
    merged = merge_edges(lines.select("o_custkey", "l_suppkey", F.array("l_returnflag").alias("symbols")), ("o_custkey", "l_suppkey"))
    return _edges(merged.select(F.concat(F.lit("file:customer/"), "o_custkey").alias("src"), F.concat(F.lit("file:supplier/"), "l_suppkey").alias("dst"), "symbols"), "imports")


def supply_base(spark: SparkSession, sf: str, until: str | None = None) -> Graph:
    """Modules are nations, files are customers and suppliers, packages are brands; no metrics yet."""
    from ..operators.build import file_nodes, module_nodes

    files = supply_files(spark, sf, until)
    nodes = module_nodes(files).unionByName(file_nodes(files))
    edges = supply_imports(spark, sf, until)
    if not until:
        brands = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        brands = brands.select("l_suppkey", "p_brand").distinct().select(F.concat(F.lit("file:supplier/"), "l_suppkey").alias("src"), F.concat(F.lit("pkg:"), "p_brand").alias("dst"))
        pkg = read(spark, sf, "part").select("p_brand").distinct()
        nodes = nodes.unionByName(nodes_of(pkg.select(F.concat(F.lit("pkg:"), "p_brand").alias("id"), F.lit("extpkg").alias("kind"), F.col("p_brand").alias("name"), F.lit("npm").alias("registry"))))
        edges = edges.unionByName(_edges(brands, "imports_pkg"))
    return Graph(nodes, with_dependencies(nodes, edges))


def supply(spark: SparkSession, sf: str) -> Graph:
    """supply_base with all metrics."""
    return with_metrics(supply_base(spark, sf))


def chain(spark: SparkSession, sf: str) -> Graph:
    """Files are orders, modules are market segments; an order imports the order before it of the same customer."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = o.withColumn("before", before)
    nodes = nodes_of(o.select(F.concat(F.lit("file:order/"), "o_orderkey").alias("id"), F.lit("file").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.concat(F.lit("mod:"), "c_mktsegment").alias("parent")))
    mods = nodes_of(o.select(F.concat(F.lit("mod:"), "c_mktsegment").alias("id"), F.lit("module").alias("kind"), F.col("c_mktsegment").alias("name")).distinct())
    e = o.where("before IS NOT NULL").select(F.concat(F.lit("file:order/"), "o_orderkey").alias("src"), F.concat(F.lit("file:order/"), "before").alias("dst"))
    return Graph(nodes.unionByName(mods), _edges(e, "imports"))


def chain_start(spark: SparkSession, sf: str) -> str:
    """The first order of the customer with the most orders (the smallest key of those)."""
    o = read(spark, sf, "orders")
    top = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")).orderBy(F.desc("n"), "o_custkey").first()
    return f"file:order/{top['first']['o_orderkey']}"


def sessions(spark: SparkSession, sf: str) -> Graph:
    """Modules are event types; a dependency weighs the moves of users from one type to another."""
    e = read(spark, sf, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = e.withColumn("to", nxt).where("to IS NOT NULL AND to <> event_type").groupBy("event_type", "to").agg(F.count("*").alias("weight"))
    nodes = nodes_of(e.select(F.concat(F.lit("mod:"), "event_type").alias("id"), F.lit("module").alias("kind"), F.col("event_type").alias("name")).distinct())
    return Graph(nodes, _edges(moves.select(F.concat(F.lit("mod:"), "event_type").alias("src"), F.concat(F.lit("mod:"), "to").alias("dst"), "weight"), "depends_on"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Declared side of the catalog, by hand: (table, column, type, key, reference). It differs from the files on purpose.
MANIFEST = [
    ("region", "r_regionkey", "Int", True, None), ("region", "r_name", "String", False, None),
    ("nation", "n_nationkey", "int4", True, None), ("nation", "n_name", "varchar(25)", False, None), ("nation", "n_regionkey", "int4", False, "region.r_regionkey"),
    ("customer", "c_custkey", "BigInt", True, None), ("customer", "c_name", "String", False, None), ("customer", "c_nationkey", "Int", False, "nation.n_nationkey"),
    ("customer", "c_acctbal", "Decimal", False, None), ("customer", "c_phone", "String", False, None),
    ("orders", "o_orderkey", "bigint", True, None), ("orders", "o_custkey", "bigint", False, "customer.c_custkey"), ("orders", "o_orderstatus", "text", False, None),
    ("orders", "o_totalprice", "float8", False, None), ("orders", "o_orderdate", "timestamptz", False, None), ("orders", "o_orderpriority", "unknown", False, None),
    ("labels", "doc_id", "bigint", True, "documents.doc_id"), ("labels", "quality", "int", False, None), ("labels", "toxic", "boolean", False, None),
    ("invoices", "id", "Int", True, None),
]
MANIFEST_TABLES = list(dict.fromkeys(t for t, *_ in MANIFEST))


def catalog(spark: SparkSession) -> Graph:
    """Entities and tables of the manifest, with mappings and foreign keys."""
    cols, ents = {}, []
    for t, c, kind, pk, ref in MANIFEST:
        rt, rc = ref.split(".") if ref else (None, None)
        cols.setdefault(t, []).append((c, kind, not pk, pk, f"public.{rt}" if rt else None, rc))
    tables = spark.createDataFrame(
        [(f"tbl:public.{t}", "table", t, "declared", [x for x in cs]) for t, cs in cols.items()],
        "id string, kind string, name string, origin string, columns array<struct<name:string,sql_type:string,nullable:boolean,is_pk:boolean,fk_table:string,fk_column:string>>",
    )
    ents = spark.createDataFrame(
        [(f"ent:models/{t}.py#{t.title()}", "entity", t.title(), f"file:models/{t}.py", "sqlalchemy", t) for t in cols], "id string, kind string, name string, parent string, orm string, declared_table string"
    )
    files = spark.createDataFrame([(f"file:models/{t}.py", "file", f"{t}.py", "mod:models", f"models/{t}.py") for t in cols], "id string, kind string, name string, parent string, path string")
    mod = spark.createDataFrame([("mod:models", "module", "models")], "id string, kind string, name string")
    maps = spark.createDataFrame([("maps_to", f"ent:models/{t}.py#{t.title()}", f"tbl:public.{t}", "static", "certain" if t[0] < "m" else "inferred") for t in cols], "kind string, src string, dst string, source string, confidence string")
    fks = spark.createDataFrame(
        [("fk", f"tbl:public.{t}", f"tbl:public.{r.split('.')[0]}", "static", "certain", [(c, r.split(".")[1])]) for t, c, _, _, r in MANIFEST if r],
        "kind string, src string, dst string, source string, confidence string, fk_columns array<struct<from_col:string,to_col:string>>",
    )
    imports = spark.createDataFrame([("imports", f"file:models/{t}.py", f"file:models/{r.split('.')[0]}.py", "static", "certain") for t, _, _, _, r in MANIFEST if r and r.split(".")[0] in cols], "kind string, src string, dst string, source string, confidence string")
    nodes = nodes_of(tables).unionByName(nodes_of(ents)).unionByName(nodes_of(files)).unionByName(nodes_of(mod))
    return Graph(nodes, first_wins([edges_of(maps).unionByName(edges_of(fks)).unionByName(edges_of(imports))]))


def catalog_live(spark: SparkSession, sf: str) -> Live:
    """The live side: the schemas of the Parquet files, all nullable, with one foreign key."""
    from ..operators.drift import live_from_spark

    live = live_from_spark(spark, {t: read(spark, sf, t) for t in TABLES})
    live.columns = live.columns.withColumn("nullable", F.lit(True))
    live.keys = spark.createDataFrame([("public", "nation", "n_regionkey", "public", "region", "r_regionkey"), ("public", "supplier", "s_nationkey", "public", "nation", "n_nationkey")], live.keys.schema)
    return live


def documents_graph(spark: SparkSession, sf: str) -> Graph:
    """Documents below their sources; a link is certain if the document is labelled."""
    d = read(spark, sf, "documents").select("doc_id", "source", F.concat_ws("/", "source", "doc_id").alias("path"))
    labelled = read(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled")).distinct()
    d = d.join(labelled, "doc_id", "left")
    docs = nodes_of(d.select(F.concat(F.lit("doc:"), "path").alias("id"), F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("name"), "path", F.col("path").alias("title")))
    mods = nodes_of(d.select(F.concat(F.lit("mod:"), "source").alias("id"), F.lit("module").alias("kind"), F.col("source").alias("name")).distinct())
    e = d.select(
        F.lit("documents").alias("kind"), F.concat(F.lit("doc:"), "path").alias("src"), F.concat(F.lit("mod:"), "source").alias("dst"), F.lit("static").alias("source"), F.when(F.col("labelled"), "certain").otherwise("inferred").alias("confidence")
    )
    return Graph(docs.unionByName(mods), edges_of(e))
