"""Registered queries of import resolution and of maintenance by differences, over paths and edges made of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build, maintain
from ..operators.resolve import resolve_imports
from . import adapters as A
from .queries import CUTS, SLICES, query

# Documents as files below their language and source; by turns a .ts file, a .tsx file and a folder with an index file. Each imports
# the next document of its source, every other time by the name of the built file.
TREE = """
    t AS (SELECT doc_id, lang, source, lang || '/' || source || '/f' || doc_id AS stem, doc_id % 3 AS kind, n_chars % 2 = 0 AS built FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
    f AS (SELECT *, stem || CASE kind WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS path FROM t),
    n AS (SELECT *, lead(path) OVER w AS to_path, lead(stem) OVER w AS to_stem, lead(kind) OVER w AS to_kind, lead(lang) OVER w AS to_lang, lead(doc_id) OVER w AS to_id FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id))
"""


def _tree(spark, sf):
    d = A.read(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    d = d.select("doc_id", "lang", "source", F.concat_ws("/", "lang", "source", F.concat(F.lit("f"), "doc_id")).alias("stem"), (F.col("doc_id") % 3).alias("kind"), (F.col("n_chars") % 2 == 0).alias("built"))
    d = d.withColumn("path", F.concat("stem", F.when(F.col("kind") == 0, ".ts").when(F.col("kind") == 1, ".tsx").otherwise("/index.ts")))
    w = Window.partitionBy("source").orderBy("doc_id")
    return d, d.withColumns({"to_stem": F.lead("stem").over(w), "to_lang": F.lead("lang").over(w), "to_id": F.lead("doc_id").over(w)}).where("to_stem IS NOT NULL")


def _edges(df):
    return df.select("kind", "src", "dst", F.array_join("symbols", ",").alias("symbols"), "registry")


@query(f"""WITH {TREE} SELECT 'imports' AS kind, 'file:' || path AS src, 'file:' || to_path AS dst, 'doc' AS symbols, CAST(NULL AS VARCHAR) AS registry FROM n WHERE to_path IS NOT NULL AND NOT (built AND to_kind = 2)""")
def resolve_relative(spark, sf):
    d, n = _tree(spark, sf)
    up = F.when(F.col("kind") == 2, "../../../").otherwise("./../../")
    spec = F.concat(up, "to_stem", F.when(F.col("built"), ".js?raw").otherwise(""))
    return _edges(resolve_imports(n.select("path", spec.alias("specifier"), F.array(F.lit("doc")).alias("symbols")), d.select("path"), [], [], []))


@query(f"""WITH {TREE} SELECT CASE WHEN lang = to_lang THEN 'imports' ELSE 'imports_pkg' END AS kind, 'file:' || path AS src, CASE WHEN lang = to_lang THEN 'file:' || to_path ELSE 'pkg:~' END AS dst, '' AS symbols, CASE WHEN lang = to_lang THEN NULL ELSE 'npm' END AS registry
    FROM n WHERE to_path IS NOT NULL""")
def resolve_aliases(spark, sf):
    """The nearest configuration is that of the language's folder; of its patterns the longest that fits holds."""
    d, n = _tree(spark, sf)
    langs = sorted(r[0] for r in d.select("lang").distinct().collect())  # a few languages
    aliases = {"": {"paths": [("~/*", ["nowhere/*"])], "base": "."}} | {x: {"paths": [("*", ["lost/*"]), ("~/*", [f"gone/{x}/*", f"{x}/*"])], "base": None} for x in langs}
    spec = F.concat(F.lit("~/"), "source", F.lit("/f"), "to_id")
    return _edges(resolve_imports(n.select("path", spec.alias("specifier"), F.array().cast("array<string>").alias("symbols")), d.select("path"), aliases, [], []))


@query(f"""WITH {TREE} SELECT CASE WHEN lang = to_lang THEN 'imports' ELSE 'imports_pkg' END AS kind, 'file:' || path AS src, CASE WHEN lang = to_lang THEN 'file:' || to_path ELSE 'pkg:' || source END AS dst, '' AS symbols, CASE WHEN lang = to_lang THEN NULL ELSE 'npm' END AS registry
    FROM n WHERE to_path IS NOT NULL AND lang = to_lang""")
def resolve_base_folders(spark, sf):
    """Plain specifiers below the base folder of the nearest configuration, those that exist there."""
    d, n = _tree(spark, sf)
    langs = sorted(r[0] for r in d.select("lang").distinct().collect())
    aliases = {x: {"paths": [], "base": x} for x in langs}
    spec = F.concat("source", F.lit("/f"), "to_id")
    return _edges(resolve_imports(n.where("lang = to_lang").select("path", spec.alias("specifier"), F.array().cast("array<string>").alias("symbols")), d.select("path"), aliases, [], []))


@query(f"""WITH {TREE} SELECT 'imports' AS kind, 'file:' || path AS src, 'file:' || to_path AS dst, '' AS symbols, CAST(NULL AS VARCHAR) AS registry FROM n WHERE to_path IS NOT NULL""")
def resolve_workspaces(spark, sf):
    """Every language is a package of the workspace; its files are found below it."""
    d, n = _tree(spark, sf)
    members = sorted((f"@w/{r[0]}", r[0]) for r in d.select("lang").distinct().collect())
    spec = F.concat(F.lit("@w/"), "to_lang", F.lit("/"), "source", F.lit("/f"), "to_id")
    return _edges(resolve_imports(n.select("path", spec.alias("specifier"), F.array().cast("array<string>").alias("symbols")), d.select("path"), [], members, []))


@query("""WITH h AS (SELECT DISTINCT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), s AS (SELECT page_id, host, page_id % 5 AS k FROM h)
    SELECT 'imports_pkg' AS kind, 'file:p' || page_id || '.ts' AS src, 'pkg:' || CASE k WHEN 0 THEN host WHEN 1 THEN '@s/' || host WHEN 2 THEN 'fs/promises' WHEN 3 THEN 'buffer' ELSE host || '/x' END AS dst, 'a' AS symbols, CASE WHEN k IN (2, 4) THEN 'stdlib' ELSE 'npm' END AS registry FROM s""")
def resolve_packages(spark, sf):
    h = A.read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), (F.col("page_id") % 5).alias("k")).distinct()
    k = F.col("k")
    spec = F.when(k == 0, F.concat("host", F.lit("/deep/path"))).when(k == 1, F.concat(F.lit("@s/"), "host", F.lit("/deep"))).when(k == 2, "fs/promises").when(k == 3, "buffer/").otherwise(F.concat(F.lit("node:"), "host", F.lit("/x")))
    path = F.concat(F.lit("p"), "page_id", F.lit(".ts"))
    return _edges(resolve_imports(h.select(path.alias("path"), spec.alias("specifier"), F.array(F.lit("a")).alias("symbols")), h.select(path.alias("path")), [], [], []))


PY = """
    m AS (SELECT doc_id, lang, source, 'py/' || lang || '/' || source || '/m' || doc_id || '.py' AS path, doc_id % 4 AS k FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
    n AS (SELECT *, lead(path) OVER w AS to_path, lead(lang) OVER w AS to_lang FROM m WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    e AS (SELECT path, k, to_path, lang = to_lang AS same FROM n WHERE to_path IS NOT NULL)
"""


@query(f"""WITH {PY} SELECT 'imports' AS kind, 'file:' || path AS src, 'file:' || to_path AS dst, 'f' AS symbols, CAST(NULL AS VARCHAR) AS registry FROM e WHERE k = 0 OR k = 1 AND same
    UNION ALL SELECT 'imports', 'file:' || path, 'file:' || to_path, '', NULL FROM e WHERE k = 2 AND same
    UNION ALL SELECT 'imports_pkg', 'file:' || path, 'pkg:' || CASE WHEN same THEN 'os' ELSE 'outside' END, 'f', CASE WHEN same THEN 'stdlib' ELSE 'pypi' END FROM e WHERE k = 3""")
def resolve_python(spark, sf):
    """Whole names from a root, names from the own package, submodules as imported names, and packages from outside."""
    d = A.read(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source", (F.col("doc_id") % 4).alias("k"))
    d = d.withColumn("path", F.concat(F.lit("py/"), "lang", F.lit("/"), "source", F.lit("/m"), "doc_id", F.lit(".py")))
    w = Window.partitionBy("source").orderBy("doc_id")
    n = d.withColumns({"to_id": F.lead("doc_id").over(w), "to_lang": F.lead("lang").over(w)}).where("to_id IS NOT NULL")
    to, k = F.concat(F.lit("m"), "to_id"), F.col("k")
    whole = F.concat_ws(".", "to_lang", "source", to)
    spec = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("."), to)).when(k == 2, ".").otherwise(F.when(F.col("lang") == F.col("to_lang"), "os.path").otherwise("outside.part"))
    symbols = F.when(k == 2, F.array(to)).otherwise(F.array(F.lit("f")))
    files = d.select("path").unionByName(d.select(F.concat(F.lit("py/"), "lang", F.lit("/__init__.py")).alias("path")).distinct())
    return _edges(resolve_imports(n.select("path", spec.alias("specifier"), symbols.alias("symbols")), files, [], [], ["src", "py"]))


def _supply_change(spark, sf):
    """The supply graph of the first cut, and the edges that go and come until the second."""
    base, head = (A.supply_base(spark, sf, c) for c in CUTS)
    kinds = "kind IN ('imports', 'depends_on')"
    gone, come = maintain.one_sided(base.edges.where("kind = 'imports'"), head.edges.where("kind = 'imports'"))
    modules = base.nodes.unionByName(head.nodes).where("kind = 'file'").select("id", F.col("parent").alias("module")).distinct()
    weights = base.edges.where("kind = 'depends_on'").select("src", "dst", "weight")
    return base.edges.where(kinds), gone, come, modules, weights


@query(f"WITH {SLICES} SELECT src, dst, weight FROM h_d")
def maintained_weights(spark, sf):
    """Module dependencies of the second cut, from those of the first and the difference."""
    _, gone, come, modules, weights = _supply_change(spark, sf)
    return maintain.changed_weights(weights, maintain.weight_change(gone, come, modules))


@query(f"""WITH {SLICES}, e AS (SELECT src AS id, 0 AS i, 1 AS o FROM h_i UNION ALL SELECT dst, 1, 0 FROM h_i UNION ALL SELECT src, 0, 1 FROM h_d UNION ALL SELECT dst, 1, 0 FROM h_d)
    SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM e GROUP BY id""")
def maintained_fans(spark, sf):
    edges, gone, come, modules, weights = _supply_change(spark, sf)
    after = maintain.changed_weights(weights, maintain.weight_change(gone, come, modules))
    as_edges = lambda w: w.select(F.lit("depends_on").alias("kind"), "src", "dst")
    less, more = maintain.one_sided(as_edges(weights), as_edges(after))
    return maintain.changed_fans(build.fan_metrics(edges), gone.unionByName(less), come.unionByName(more))
