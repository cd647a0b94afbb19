"""Registered queries of validation, migrations, layer colours and answers of many modules, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build, flows
from ..operators.algo import stored
from ..schema import CHECKED_OF_EDGES, CHECKED_OF_NODES, violations_of
from ..sources import config
from . import adapters as A
from .answers import module_answers as answers_of
from .history_queries import DAG, commits
from .queries import SUPPLY, query


@query(f"""WITH {SUPPLY}, kept AS (SELECT id FROM files WHERE parent NOT IN (SELECT id FROM mods WHERE layer = 'ASIA') UNION ALL SELECT id FROM mods WHERE layer <> 'ASIA' UNION ALL SELECT DISTINCT dst FROM pkgs),
    e AS (SELECT 'imports|' || src || '|' || dst AS id, src, dst FROM imports UNION ALL SELECT 'imports_pkg|' || src || '|' || dst, src, dst FROM pkgs UNION ALL SELECT 'depends_on|' || src || '|' || dst, src, dst FROM deps)
    SELECT 'missing src' AS what, id, src AS detail FROM e WHERE src NOT IN (SELECT id FROM kept) UNION ALL SELECT 'missing dst', id, dst FROM e WHERE dst NOT IN (SELECT id FROM kept)
    UNION ALL SELECT 'kind of parent', id, 'extpkg' FROM files WHERE id IN (SELECT id FROM kept) AND loc = 0
    UNION ALL SELECT 'repeated node', id, '2' FROM mods WHERE layer = 'EUROPE'""")
def graph_violations(spark, sf):
    """Of a damaged graph: Asia's files and modules are lost, files without lines hang below a package, Europe's modules are there twice."""
    g = A.supply_base(spark, sf)
    whole = stored(g.nodes.select(*CHECKED_OF_NODES, "layer"))  # made once: the damage and the dependencies read nodes many times
    links = stored(g.edges.where("kind <> 'depends_on'").select(*CHECKED_OF_EDGES))
    edges = links.unionByName(stored(build.depends_on(whole, links).select(*CHECKED_OF_EDGES)))
    asia = whole.where("kind = 'module' AND layer = 'ASIA'").select(F.col("id").alias("m"))
    nodes = whole.withColumn("m", F.when(F.col("kind") == "module", F.col("id")).when(F.col("kind") == "file", F.col("parent")).otherwise("")).join(asia, "m", "left_anti").drop("m")
    package = nodes.where("kind = 'extpkg'").agg(F.min("id").alias("p"))
    nodes = nodes.join(F.broadcast(package)).withColumn("parent", F.when((F.col("kind") == "file") & (F.col("loc") == 0), F.col("p")).otherwise(F.col("parent"))).drop("p")  # package is one row
    nodes = stored(nodes)
    return violations_of(nodes.unionByName(nodes.where("kind = 'module' AND layer = 'EUROPE'")), edges)


@query(f"""WITH RECURSIVE {DAG}, d AS (SELECT k, p FROM par WHERE p IS NOT NULL AND p % 97 <> 0), a AS (SELECT k FROM o WHERE k % 97 <> 0), l AS (SELECT DISTINCT k, p FROM par WHERE p IS NOT NULL AND k % 97 <> 0),
    f AS (SELECT p AS k, count(*) AS followers FROM l GROUP BY p), x AS (SELECT k, count(*) AS downs, count(*) FILTER (WHERE p % 97 = 0) AS missing FROM l GROUP BY k)
    SELECT CAST(k AS VARCHAR) AS revision, coalesce(followers, 0) AS followers, coalesce(missing, 0) AS missing, followers IS NULL AS head, downs IS NULL AS base, coalesce(followers > 1, false) AS branch, coalesce(downs > 1, false) AS merge
    FROM a LEFT JOIN f USING (k) LEFT JOIN x USING (k)""")
def migration_revisions(spark, sf):
    """Orders as migrations that follow each other; some files are lost, so some links lead nowhere."""
    log, _ = commits(spark, sf)
    quoted = F.array_join(F.transform("parents", lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")
    down = F.when(F.size("parents") == 0, "None").when(F.size("parents") == 1, quoted).otherwise(F.concat(F.lit("("), quoted, F.lit(")")))
    text = F.concat(F.lit('"""Made by hand."""\n\nrevision: str = "'), "sha", F.lit('"\ndown_revision = '), down, F.lit("\nbranch_labels = None\n"))
    files = log.where("CAST(sha AS BIGINT) % 97 <> 0").select(F.concat(F.lit("versions/"), "sha", F.lit(".py")).alias("path"), text.alias("content"))
    got = config.migration_graph(config.migrations(files))
    return got.select("revision", "followers", F.size("missing").cast("long").alias("missing"), "head", "base", "branch", "merge")


def _color_sql(column: str) -> str:
    step = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: ((((h * 31 + c) + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)"
    colors = "[" + ", ".join(f"'{c}'" for c in flows.LAYER_COLORS) + "]"
    return f"{colors}[CAST(abs({step.replace('x', column, 1)}) % {len(flows.LAYER_COLORS)} AS INT) + 1]"


@query(f"SELECT DISTINCT source AS layer, {_color_sql('source')} AS color FROM documents UNION SELECT DISTINCT c_name, {_color_sql('c_name')} FROM customer")
def layer_colors(spark, sf):
    names = A.read(spark, sf, "documents").select(F.col("source").alias("layer")).union(A.read(spark, sf, "customer").select("c_name")).distinct()
    return names.select("layer", flows.layer_color(F.col("layer")).alias("color"))


@query(f"""WITH {SUPPLY}, l AS (SELECT parent AS id, '- ' || substr(id, 6) || ': ' || loc || ' lines' AS line, row_number() OVER (PARTITION BY parent ORDER BY loc DESC, id) AS k FROM files),
    r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k) AS e, count(*) OVER (PARTITION BY id) AS total FROM l),
    h AS (SELECT id, '# ' || name AS title, CAST(floor(200 * 4 / 1.15) AS BIGINT) + 1 - (length('# ' || name) + 1) - 1 AS room FROM mods),
    s AS (SELECT id, any_value(title) AS title, any_value(total) AS total, CASE WHEN max(e) <= any_value(room) THEN any_value(total)
        ELSE coalesce(max(k) FILTER (WHERE k < total AND e + length('+' || (total - k) || ' more files → ask with a budget of 1000') < room), 0) END AS shown FROM r JOIN h USING (id) GROUP BY id)
    SELECT s.id, shown, s.total, title || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (WHERE k <= shown) || CASE WHEN shown < s.total THEN chr(10) || '+' || (s.total - shown) || ' more files → ask with a budget of 1000' ELSE '' END AS answer
    FROM s JOIN r USING (id) GROUP BY s.id, shown, s.total, title""")
def module_answers(spark, sf):
    return answers_of(A.supply_base(spark, sf), 200)
