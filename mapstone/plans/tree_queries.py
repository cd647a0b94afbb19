"""Registered queries of scanning, nodes and file contexts over paths and events made of the tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import is_node_id_col, node_id_col, rest_col
from ..operators import build, flows, views
from ..schema import Graph, edges_of
from ..sources import scan
from . import adapters as A
from .queries import SUPPLY, query

DIRS = ("src", "node_modules/x", "a/.hidden", "deep/logs", "keep", "distant")
ENDS = (".ts", ".tmp.ts", ".py", ".md", ".txt", ".prisma", ".mjs")
_CASE = lambda k, values: f"CASE {k} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
PATHS = f"x AS (SELECT page_id % {len(DIRS)} AS d, page_id % {len(ENDS)} AS e, {_CASE(f'page_id % {len(DIRS)}', DIRS)} || '/p' || page_id || {_CASE(f'page_id % {len(ENDS)}', ENDS)} AS path FROM pages)"


def _paths(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    return A.read(spark, sf, "pages").select(F.concat(pick(DIRS), F.lit("/p"), "page_id", pick(ENDS)).alias("path"))


@query(f"WITH {PATHS} SELECT path FROM x WHERE d NOT IN (1, 2, 3) AND (e IN (0, 2, 5) OR e = 1 AND d = 4)")
def scan_sources(spark, sf):
    """Sources outside of skipped, hidden, ignored and excluded places; an ignored name is taken back where a later line says so."""
    kept = scan.kept_path(F.col("path"), ["# logs", "logs/", "*.tmp.ts", "!keep/*.tmp.ts"], ["**/*.mjs"])
    return _paths(spark, sf).where(kept & scan.is_source(F.col("path")))


@query("""WITH x AS (SELECT page_id % 6 AS k, CASE page_id % 6 WHEN 0 THEN 'd' || page_id || '/ReadMe.md' WHEN 1 THEN 'docs/x/p' || page_id || '.md' WHEN 2 THEN 'p' || page_id || '.MD' WHEN 3 THEN 'other/p' || page_id || '.md' WHEN 4 THEN 'docs/p' || page_id || '.txt' ELSE 'docs/old/p' || page_id || '.md' END AS path FROM pages)
    SELECT path FROM x WHERE k IN (0, 1, 2)""")
def scan_documents(spark, sf):
    """READMEs anywhere, all below docs, and the root's, without excluded ones."""
    i, k = F.col("page_id"), F.col("page_id") % 6
    path = F.when(k == 0, F.concat(F.lit("d"), i, F.lit("/ReadMe.md"))).when(k == 1, F.concat(F.lit("docs/x/p"), i, F.lit(".md"))).when(k == 2, F.concat(F.lit("p"), i, F.lit(".MD")))
    path = path.when(k == 3, F.concat(F.lit("other/p"), i, F.lit(".md"))).when(k == 4, F.concat(F.lit("docs/p"), i, F.lit(".txt"))).otherwise(F.concat(F.lit("docs/old/p"), i, F.lit(".md")))
    return A.read(spark, sf, "pages").select(path.alias("path")).where(scan.is_doc(F.col("path"), exclude=["docs/old/**"]))


@query("""SELECT 'sym:u' || user_id || '.ts#' || event_type AS id, event_type AS name, 'file:u' || user_id || '.ts' AS parent, CAST(arg_max(event_id % 1000, event_id) AS INT) AS start_line
    FROM events WHERE value > 10 GROUP BY user_id, event_type""")
def symbols_last_wins(spark, sf):
    """Exported symbols; of those that repeat a name in a file the last stays."""
    line = (F.col("event_id") % 1000).cast("int")
    own = A.read(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit(".ts")).alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"), F.lit("ts").alias("lang"), line.alias("start_line"), line.alias("end_line"), F.lit("function").alias("symbol_kind"),
        (F.col("value") > 10).alias("exported"), F.lit(None).cast("string").alias("doc"),
    )
    return build.symbol_nodes(own).select("id", "name", "parent", "start_line")


@query("""SELECT 'imports|file:u' || user_id || '|file:t/' || event_type AS id, string_agg(DISTINCT p, ',' ORDER BY p) AS symbols FROM (SELECT user_id, event_type, CAST(event_id % 7 AS VARCHAR) AS p FROM events) GROUP BY user_id, event_type""")
def edges_merged(spark, sf):
    """One edge for each pair of files, with the sorted union of its symbols."""
    raw = A.read(spark, sf, "events").select(F.lit("imports").alias("kind"), F.concat(F.lit("file:u"), "user_id").alias("src"), F.concat(F.lit("file:t/"), "event_type").alias("dst"), F.array((F.col("event_id") % 7).cast("string")).alias("symbols"))
    return edges_of(build.merge_edges(raw).withColumns({"source": F.lit("static"), "confidence": F.lit("certain")})).select("id", F.array_join("symbols", ",").alias("symbols"))


@query(f"WITH {SUPPLY} SELECT 'out' AS side, 'imports' AS kind, dst AS id, symbols FROM imports WHERE src = 'file:customer/1' UNION ALL SELECT 'in', 'imports', src, symbols FROM imports WHERE dst = 'file:supplier/1' UNION ALL SELECT 'pkg', 'imports_pkg', dst, '' FROM pkgs WHERE src = 'file:supplier/1'")
def file_contexts(spark, sf):
    """What one file imports, what imports another, and the packages of that."""
    g = A.supply_base(spark, sf)
    told = lambda df, side: df.select(F.lit(side).alias("side"), "kind", "id", F.coalesce(F.array_join("symbols", ","), F.lit("")).alias("symbols"))
    out = told(views.file_imports(g, "file:customer/1"), "out").union(told(views.file_imports(g, "file:supplier/1", incoming=True), "in"))
    return out.union(told(views.file_imports(g, "file:supplier/1").where("kind = 'imports_pkg'"), "pkg"))


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), d AS (SELECT doc_id, source FROM documents), e AS (SELECT 'doc:' || source || '/' || d.doc_id AS doc, 'mod:' || source AS module FROM d WHERE source IS NOT NULL)
    SELECT substr(doc, 5) AS path, module FROM e""")
def document_modules(spark, sf):
    g = A.documents_graph(spark, sf)
    docs = views.docs_list(Graph(g.nodes, g.edges)).where("module IS NOT NULL")
    return docs.select("path", "module")


@query("""WITH t AS (SELECT event_id, ts, (SELECT max(ts) FROM events) AS now FROM events), s AS (SELECT event_id, CAST(floor(epoch(now)) - floor(epoch(ts)) AS BIGINT) AS s FROM t)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM s""")
def event_ages(spark, sf):
    e = A.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).select("event_id", flows.relative_time(F.col("ts"), F.col("now")).alias("ago"))  # now is one row


@query("""SELECT doc_id, 'ent:' || source || '/f' || doc_id || '.py#' || lang AS id, source || '/f' || doc_id || '.py#' || lang AS rest, true AS ok, false AS plain_ok FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def node_ids(spark, sf):
    d = A.read(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL").withColumn("path", F.concat("source", F.lit("/f"), "doc_id", F.lit(".py")))
    own = d.withColumn("id", node_id_col("entity", "path", "lang"))
    return own.select("doc_id", "id", rest_col("id").alias("rest"), is_node_id_col("id").alias("ok"), is_node_id_col("path").alias("plain_ok"))
