"""Registered queries: each operator on a graph of the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import budget, text
from ..functions.types import FAMILY, SPARK_FAMILY, sql_family_col
from ..operators import algo, build, diff, drift, flows, history, views
from . import adapters as A

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# --- SQL of the adapters --------------------------------------------------------------------------------------------

SUPPLY = """
    nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    lines AS (SELECT o_custkey, l_suppkey, l_returnflag, l_partkey, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    imports AS (SELECT 'file:customer/' || o_custkey AS src, 'file:supplier/' || l_suppkey AS dst,
        array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS symbols FROM lines GROUP BY ALL),
    pkgs AS (SELECT DISTINCT 'file:supplier/' || l_suppkey AS src, 'pkg:' || p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey),
    files AS (
        SELECT 'file:customer/' || c_custkey AS id, 'mod:' || n_name AS parent, coalesce(n, 0) AS loc FROM customer
        JOIN nat ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey
        UNION ALL
        SELECT 'file:supplier/' || s_suppkey, 'mod:' || n_name, coalesce(n, 0) FROM supplier
        JOIN nat ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = s_suppkey),
    mods AS (SELECT DISTINCT 'mod:' || n_name AS id, n_name AS name, r_name AS layer FROM nat WHERE 'mod:' || n_name IN (SELECT parent FROM files)),
    deps AS (SELECT a.parent AS src, b.parent AS dst, count(*) AS weight FROM imports i JOIN files a ON a.id = i.src JOIN files b ON b.id = i.dst
        WHERE a.parent <> b.parent GROUP BY ALL),
    ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM imports UNION ALL SELECT dst, 1, 0 FROM imports UNION ALL SELECT src, 0, 1 FROM deps
        UNION ALL SELECT dst, 1, 0 FROM deps UNION ALL SELECT dst, 1, 0 FROM pkgs),
    fans AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM ends GROUP BY id)
"""
CHAIN = """
    o AS (SELECT o_orderkey, o_custkey, c_mktsegment, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
        FROM orders JOIN customer ON o_custkey = c_custkey),
    hops AS (SELECT 'file:order/' || before AS at_, 'file:order/' || o_orderkey AS nxt FROM o WHERE before IS NOT NULL),
    top AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1),
    start_ AS (SELECT 'file:order/' || o_orderkey AS id FROM orders WHERE o_custkey = (SELECT o_custkey FROM top) ORDER BY o_orderdate, o_orderkey LIMIT 1),
    reach AS (SELECT id, 0 AS depth FROM start_ UNION SELECT nxt, depth + 1 FROM reach JOIN hops ON at_ = id),
    depths AS (SELECT id, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY id)
"""
SESSIONS = """
    m AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
    deps AS (SELECT 'mod:' || event_type AS src, 'mod:' || nxt AS dst, count(*) AS weight FROM m WHERE nxt <> event_type GROUP BY ALL)
"""
CYCLES = """
    reach AS (SELECT src, dst FROM deps UNION SELECT r.src, d.dst FROM reach r JOIN deps d ON d.src = r.dst)
    SELECT min(b.src) AS cycle, a.src AS member FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src
"""


def _ranks() -> str:
    """Thirty steps of the rank as SQL."""
    out = [
        "fs AS MATERIALIZED (SELECT id, (SELECT count(*) FROM files) AS n, (SELECT count(*) FROM imports WHERE src = id) AS outs FROM files)",
        "r0 AS MATERIALIZED (SELECT id, n, outs, 1.0 / CAST(n AS DOUBLE) AS rank FROM fs)",
    ]
    for k in range(algo.ITERATIONS):
        out += [
            f"g{k} AS MATERIALIZED (SELECT dst AS id, sum(rank / outs) AS s FROM imports JOIN r{k} ON r{k}.id = src GROUP BY dst)",
            f"h{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS d FROM r{k} WHERE outs = 0)",
            f"""r{k + 1} AS MATERIALIZED (SELECT r.id, n, outs, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * coalesce(s, 0) + CAST(0.85 AS DOUBLE) * d / n AS rank
                FROM r{k} r LEFT JOIN g{k} USING (id), h{k})""",
        ]
    return ",\n".join([*out, f"ranks AS MATERIALIZED (SELECT id, round(rank, 6) AS rank FROM r{algo.ITERATIONS})"])


SUPPLY_RANKED = SUPPLY.replace("imports AS (", "imports AS MATERIALIZED (").replace("files AS (", "files AS MATERIALIZED (", 1) + "," + _ranks()
CUTS = ("1998-01-01", "2000-01-01")


def _slice(name: str, until: str) -> str:
    """A supply graph of the orders before a day."""
    return f"""
    {name}_lines AS (SELECT * FROM lines WHERE o_orderdate < TIMESTAMP '{until}'),
    {name}_i AS (SELECT DISTINCT 'file:customer/' || o_custkey AS src, 'file:supplier/' || l_suppkey AS dst FROM {name}_lines),
    {name}_f AS (SELECT 'file:customer/' || c_custkey AS id, 'mod:' || n_name AS parent FROM customer JOIN nat ON c_nationkey = n_nationkey
            WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{until}')
        UNION ALL SELECT 'file:supplier/' || s_suppkey, 'mod:' || n_name FROM supplier JOIN nat ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM {name}_lines)),
    {name}_d AS (SELECT a.parent AS src, b.parent AS dst, count(*) AS weight FROM {name}_i i JOIN {name}_f a ON a.id = i.src JOIN {name}_f b ON b.id = i.dst WHERE a.parent <> b.parent GROUP BY ALL)
    """


SLICES = SUPPLY + "," + _slice("b", CUTS[0]) + "," + _slice("h", CUTS[1])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- build and metrics ----------------------------------------------------------------------------------------------


@query(f"""WITH {SUPPLY}, d AS (SELECT id, CAST(sum(o) AS BIGINT) AS out_deps, CAST(sum(i) AS BIGINT) AS in_deps FROM (SELECT src AS id, 1 AS o, 0 AS i FROM deps UNION ALL SELECT dst, 0, 1 FROM deps) GROUP BY id),
    f AS (SELECT parent AS id, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY 1)
    SELECT m.id, name, layer, files, loc, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(out_deps, 0) AS out_deps, coalesce(in_deps, 0) AS in_deps,
    round(CAST(out_deps AS DOUBLE) / (out_deps + in_deps), 3) AS instability FROM mods m JOIN f USING (id) LEFT JOIN fans USING (id) LEFT JOIN d USING (id)""")
def overview_modules(spark, sf):
    return views.overview_modules(A.supply(spark, sf)).drop("rank")


@query(f"WITH {SUPPLY} SELECT * FROM deps")
def overview_dependencies(spark, sf):
    return views.overview_dependencies(A.supply_base(spark, sf))


@query(f"WITH {SUPPLY} SELECT DISTINCT dst AS id, substr(dst, 5) AS name, 'npm' AS registry, fan_in FROM pkgs JOIN fans ON id = dst")
def overview_packages(spark, sf):
    g = A.supply_base(spark, sf)
    return views.overview_packages(type(g)(g.nodes.drop("fan_in").join(build.fan_metrics(g.edges).select("id", "fan_in"), "id", "left"), g.edges))


@query(f"WITH {SUPPLY} SELECT count(*) AS imports FROM imports")
def total_imports(spark, sf):
    return views.total_imports(A.supply_base(spark, sf))


@query(f"""WITH {SUPPLY}, c AS (SELECT 'module' AS kind, count(*) AS n FROM mods UNION ALL SELECT 'file', count(*) FROM files UNION ALL SELECT 'extpkg', count(DISTINCT p_brand) FROM part
    UNION ALL SELECT unnest(['symbol', 'entity', 'table', 'doc']), 0) SELECT * FROM c""")
def kind_counts(spark, sf):
    return build.kind_counts(A.supply_base(spark, sf).nodes)


@query(f"WITH {SUPPLY} SELECT * FROM fans")
def fan_metrics(spark, sf):
    return build.fan_metrics(A.supply_base(spark, sf).edges)


@query(f"WITH {SUPPLY} SELECT src, dst, symbols FROM imports")
def edge_symbols_union(spark, sf):
    return A.supply_imports(spark, sf).select("src", "dst", F.array_join("symbols", ",").alias("symbols"))


@query(f"WITH {SUPPLY_RANKED} SELECT * FROM ranks")
def pagerank_files(spark, sf):
    g = build.stored_graph(A.supply_base(spark, sf))
    return algo.pagerank(g.nodes, g.edges)


@query(f"WITH {SUPPLY_RANKED} SELECT parent AS id, CAST(sum(loc) AS BIGINT) AS loc, round(sum(rank), 5) AS rank, count(*) AS files FROM files JOIN ranks USING (id) GROUP BY parent")
def module_rank(spark, sf):
    return build.rollup(A.supply(spark, sf).nodes).withColumn("rank", F.round("rank", 5))


@query(f"WITH RECURSIVE {SUPPLY}, {CYCLES}")
def module_cycles(spark, sf):
    return algo.dependency_cycles(A.supply_base(spark, sf).edges)


@query(f"WITH RECURSIVE {SESSIONS}, {CYCLES}")
def session_cycles(spark, sf):
    return algo.dependency_cycles(A.sessions(spark, sf).edges)


@query(f"""WITH {SESSIONS}, d AS (SELECT id, CAST(sum(o) AS BIGINT) AS out_deps, CAST(sum(i) AS BIGINT) AS in_deps FROM (SELECT src AS id, 1 AS o, 0 AS i FROM deps UNION ALL SELECT dst, 0, 1 FROM deps) GROUP BY id)
    SELECT id, out_deps, in_deps, round(CAST(out_deps AS DOUBLE) / (out_deps + in_deps), 3) AS instability FROM d""")
def session_instability(spark, sf):
    return views.module_summaries(A.sessions(spark, sf)).select("id", "out_deps", "in_deps", "instability").where("instability IS NOT NULL")


@query(f"""WITH {SUPPLY}, manual(kind, src, dst, reason) AS (VALUES ('imports', 'file:customer/1', 'file:customer/2', 'by hand'), ('depends_on', 'mod:x', 'mod:y', 'planned')),
    i2 AS (SELECT src, dst FROM imports UNION SELECT src, dst FROM manual WHERE kind = 'imports'),
    d2 AS (SELECT a.parent AS src, b.parent AS dst, count(*) AS weight FROM i2 i JOIN files a ON a.id = i.src JOIN files b ON b.id = i.dst WHERE a.parent <> b.parent GROUP BY ALL)
    SELECT 'depends_on' AS kind, src, dst, 'static' AS source, weight FROM d2 UNION ALL SELECT kind, src, dst, 'manual', NULL FROM manual""")
def manual_edges(spark, sf):
    g = A.supply_base(spark, sf)
    manual = spark.createDataFrame([("imports", "file:customer/1", "file:customer/2", "by hand"), ("depends_on", "mod:x", "mod:y", "planned")], "kind string, src string, dst string, reason string")
    e = build.with_dependencies(g.nodes, build.manual_edges(g.edges.where("kind = 'imports'"), manual))
    return e.where("kind = 'depends_on' OR source = 'manual'").select("kind", "src", "dst", "source", "weight")


# --- impact, modules, search ----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {CHAIN} SELECT * FROM depths")
def impact_depths(spark, sf):
    g = A.chain(spark, sf)
    return algo.impact_depths(g.nodes, g.edges, A.chain_start(spark, sf)).select("id", "depth")


@query(f"WITH RECURSIVE {CHAIN} SELECT 'mod:' || c_mktsegment AS module, count(*) AS files, min(depth) AS min_depth FROM depths JOIN o ON id = 'file:order/' || o_orderkey GROUP BY 1")
def impact_by_module(spark, sf):
    return views.impact_by_module(A.chain(spark, sf), A.chain_start(spark, sf))


@query(f"WITH RECURSIVE {CHAIN} SELECT count(*) AS total_files, max(depth) AS max_depth, count(*) AS visited, false AS truncated FROM depths")
def impact_summary(spark, sf):
    return views.impact_summary(A.chain(spark, sf), A.chain_start(spark, sf))


_MAN = "man(t, c, kind, pk, ref) AS (VALUES " + ", ".join(f"('{t}', '{c}', '{k}', {pk}, {repr(r) if r else 'NULL'})" for t, c, k, pk, r in A.MANIFEST) + ")"


@query(f"""WITH RECURSIVE {_MAN}, hops AS (SELECT split_part(ref, '.', 1) AS at_, t AS nxt FROM man WHERE ref IS NOT NULL AND split_part(ref, '.', 1) IN (SELECT t FROM man)),
    reach AS (SELECT 'region' AS t UNION SELECT nxt FROM reach JOIN hops ON at_ = t) SELECT 'tbl:public.' || t AS id, t AS name FROM reach""")
def impact_tables(spark, sf):
    return views.impact_tables(A.catalog(spark), "file:models/region.py")


@query(f"WITH {SUPPLY} SELECT src AS id, 'customer' AS what, symbols FROM imports WHERE dst = 'file:supplier/1'")
def direct_dependents(spark, sf):
    return views.direct_dependents(A.supply_base(spark, sf), "file:supplier/1").select("id", F.lit("customer").alias("what"), F.array_join("symbols", ",").alias("symbols"))


MODULE = "(SELECT min(parent) FROM files)"


def _module(g) -> str:
    return g.nodes.where("kind = 'file'").agg(F.min("parent")).first()[0]


@query(f"WITH {SUPPLY_RANKED} SELECT id, loc, rank FROM files JOIN ranks USING (id) WHERE parent = {MODULE}")
def module_view_files(spark, sf):
    g = A.supply(spark, sf)
    return views.module_files(g, _module(g)).select("id", "loc", "rank")


@query(f"WITH {SUPPLY} SELECT src, dst, symbols FROM imports JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE a.parent = {MODULE} AND b.parent = {MODULE}")
def internal_imports(spark, sf):
    g = A.supply_base(spark, sf)
    return views.internal_imports(g, _module(g)).select("src", "dst", F.array_join("symbols", ",").alias("symbols"))


@query(f"WITH {SUPPLY} SELECT dst AS id, substr(dst, 5) AS name, 'npm' AS registry, count(*) AS files FROM pkgs JOIN files ON id = src WHERE parent = {MODULE} GROUP BY dst")
def module_packages(spark, sf):
    g = A.supply_base(spark, sf)
    return views.module_packages(g, _module(g))


@query(f"WITH {SUPPLY} SELECT 'out' AS direction, dst AS id, weight FROM deps WHERE src = {MODULE} UNION ALL SELECT 'in', src, weight FROM deps WHERE dst = {MODULE}")
def module_deps(spark, sf):
    g = A.supply_base(spark, sf)
    m = _module(g)
    return views.module_deps(g, m).select(F.lit("out").alias("direction"), "id", "weight").union(views.module_deps(g, m, out=False).select(F.lit("in"), "id", "weight"))


@query(f"""WITH {SUPPLY}, e AS (SELECT 'imports' AS k, src, dst FROM imports UNION ALL SELECT 'imports_pkg', src, dst FROM pkgs)
    SELECT 'out' AS direction, k AS edge_kind, dst AS other_id, 'extpkg' AS other_kind FROM e WHERE src = 'file:supplier/3' UNION ALL SELECT 'in', k, src, 'file' FROM e WHERE dst = 'file:supplier/3'""")
def dependencies_of_node(spark, sf):
    return views.dependencies_of(A.supply_base(spark, sf), "file:supplier/3").select("direction", "edge_kind", "other_id", "other_kind")


@query(f"""WITH {SUPPLY_RANKED}, n AS (SELECT f.id, 'file' AS kind, split_part(f.id, '/', 2) AS name, parent AS module_id, rank FROM files f JOIN ranks USING (id)
    UNION ALL SELECT m.id, 'module', name, m.id, (SELECT round(sum(rank), 6) FROM files f JOIN ranks USING (id) WHERE f.parent = m.id) FROM mods m
    UNION ALL SELECT DISTINCT 'pkg:' || p_brand, 'extpkg', p_brand, NULL, 0 FROM part),
    s AS (SELECT *, CASE WHEN lower(name) = '12' THEN 3.0 WHEN starts_with(lower(name), '12') THEN 2.0 WHEN contains(lower(name), '12') THEN 1.0 WHEN contains(lower(id), '12') THEN 0.5 END AS score FROM n)
    SELECT id, kind, name, module_id, CAST(score AS DOUBLE) AS score, (SELECT count(*) FROM s WHERE score IS NOT NULL) AS total FROM s WHERE score IS NOT NULL
    ORDER BY score DESC, rank DESC, id LIMIT {views.MAX_RESULTS}""")
def search_ranked(spark, sf):
    return views.search(A.supply(spark, sf), "12").select("id", "kind", "name", "module_id", "score", "total")


@query(f"WITH {SUPPLY} SELECT id, parent AS module_id FROM files UNION ALL SELECT id, id FROM mods UNION ALL SELECT DISTINCT 'pkg:' || p_brand, NULL FROM part")
def containing_module(spark, sf):
    return views.containing_modules(A.supply_base(spark, sf))


@query("SELECT * FROM (VALUES ('customer/7', 'file:customer/7', 'file'), ('Brand#11', 'pkg:Brand#11', 'extpkg'), ('mod:NATION_1', 'mod:NATION_1', 'module')) v(ref, id, kind) WHERE id <> 'mod:NATION_1' AND (kind = 'file' OR EXISTS (SELECT 1 FROM part WHERE p_brand = ref))")
def resolve_ref(spark, sf):
    g = A.supply_base(spark, sf)
    out = None
    for ref in ("customer/7", "Brand#11", "no such node"):
        one = views.resolve_ref(g, ref).select(F.lit(ref).alias("ref"), "id", "kind")
        out = one if out is None else out.union(one)
    return out


@query("SELECT * FROM (VALUES ('Orders', 'entity', 'ent:models/orders.py#Orders'), ('orders', 'table', 'tbl:public.orders'), ('public.region', 'entity', 'tbl:public.region')) v(ref, prefer, id)")
def resolve_db_ref(spark, sf):
    g = A.catalog(spark)
    out = None
    for ref, prefer in (("Orders", "entity"), ("orders", "table"), ("public.region", "entity"), ("nothing", "table")):
        one = views.resolve_db_ref(g, ref, prefer).select(F.lit(ref).alias("ref"), F.lit(prefer).alias("prefer"), "id")
        out = one if out is None else out.union(one)
    return out


# --- database -------------------------------------------------------------------------------------------------------

_LIVE = """live AS (SELECT table_name AS t, column_name AS c, lower(data_type) AS kind FROM information_schema.columns WHERE table_name IN ({names}))""".format(names=", ".join(f"'{t}'" for t in A.TABLES))
_FAMILIES = "fam(s, f) AS (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in (FAMILY | SPARK_FAMILY | {"float[]": "array<float>"}).items()) + ")"


@query(f"""WITH {_MAN} SELECT 'tbl:public.' || t AS id, 'public' AS schema, t AS name, count(*) AS n_columns, string_agg(CASE WHEN pk THEN c END, ',') AS pk, 'ent:models/' || t || '.py#' || upper(t[1]) || t[2:] AS entities FROM man GROUP BY t""")
def db_schema(spark, sf):
    return views.table_summaries(A.catalog(spark)).select("id", "schema", "name", F.col("n_columns").cast("long").alias("n_columns"), F.array_join("pk", ",").alias("pk"), F.array_join("entities", ",").alias("entities"))


@query(f"WITH {_MAN} SELECT 'tbl:public.' || t AS table_id, c AS name, kind AS sql_type, NOT pk AS nullable, pk AS is_pk, 'public.' || split_part(ref, '.', 1) AS fk_table, split_part(ref, '.', 2) AS fk_column FROM man")
def erd(spark, sf):
    return views.erd_columns(A.catalog(spark)).drop("pos")


@query(f"WITH {_MAN} SELECT 'tbl:public.' || t AS src, 'tbl:public.' || split_part(ref, '.', 1) AS dst, c || '=' || split_part(ref, '.', 2) AS columns FROM man WHERE ref IS NOT NULL")
def foreign_keys(spark, sf):
    return views.foreign_keys(A.catalog(spark)).select("src", "dst", F.expr("array_join(transform(fk_columns, x -> concat(x.from_col, '=', x.to_col)), ',')").alias("columns"))


@query(f"""WITH {_MAN}, f AS (SELECT t, split_part(ref, '.', 1) AS r FROM man WHERE ref IS NOT NULL)
    SELECT 'out' AS direction, 'tbl:public.' || r AS table_id, r AS table_name FROM f WHERE t = 'customer' UNION ALL SELECT 'in', 'tbl:public.' || t, t FROM f WHERE r = 'customer'""")
def entity_relations(spark, sf):
    g = A.catalog(spark)
    at = views.entity_table(g, "ent:models/customer.py#Customer").first()["table_id"]
    return views.related_tables(g, at).select("direction", "table_id", "table_name")


_DRIFT = f"""WITH {_MAN}, {_LIVE}, {_FAMILIES},
    base AS (SELECT t, c, lower(regexp_replace(kind, '\\(.*\\)$', '')) AS kind, pk, ref FROM man),
    d AS (SELECT t, c, coalesce(f, kind) AS fam, pk, ref FROM base LEFT JOIN fam ON s = kind), l AS (SELECT t, c, coalesce(f, kind) AS fam FROM live LEFT JOIN fam ON s = kind),
    dt AS (SELECT DISTINCT t FROM man), lt AS (SELECT DISTINCT t FROM live),
    lk(t, c, r) AS (VALUES ('nation', 'n_regionkey', 'region.r_regionkey'), ('supplier', 's_nationkey', 'nation.n_nationkey')),
    out_ AS (SELECT t, 'table_missing_in_db' AS kind, NULL AS c FROM dt WHERE t NOT IN (SELECT t FROM lt)
    UNION ALL SELECT t, 'table_missing_in_code', NULL FROM lt WHERE t NOT IN (SELECT t FROM dt)
    UNION ALL SELECT d.t, 'column_missing_in_db', d.c FROM d JOIN lt USING (t) LEFT JOIN l ON l.t = d.t AND l.c = d.c WHERE l.c IS NULL
    UNION ALL SELECT l.t, 'column_missing_in_code', l.c FROM l JOIN dt USING (t) LEFT JOIN d ON l.t = d.t AND l.c = d.c WHERE d.c IS NULL
    UNION ALL SELECT d.t, 'type_mismatch', d.c FROM d JOIN l ON l.t = d.t AND l.c = d.c WHERE d.fam <> 'unknown' AND d.fam <> l.fam
    UNION ALL SELECT d.t, 'nullability_mismatch', d.c FROM d JOIN l ON l.t = d.t AND l.c = d.c WHERE d.pk
    UNION ALL SELECT d.t, 'fk_missing_in_db', d.c FROM d JOIN lt USING (t) LEFT JOIN lk ON lk.t = d.t AND lk.c = d.c AND lk.r = d.ref WHERE d.ref IS NOT NULL AND lk.t IS NULL
    UNION ALL SELECT lk.t, 'fk_missing_in_code', lk.c FROM lk JOIN dt USING (t) LEFT JOIN d ON lk.t = d.t AND lk.c = d.c AND lk.r = d.ref WHERE d.ref IS NULL)"""


@query(_DRIFT + " SELECT t AS \"table\", kind, c AS \"column\" FROM out_")
def schema_drift(spark, sf):
    declared = drift.declared_columns(A.catalog(spark))
    return drift.compute_drift(declared, A.catalog_live(spark, sf), SPARK_FAMILY).select("table", "kind", "column")


@query("WITH v(raw, family) AS (VALUES " + ", ".join(f"('{r}', '{f}')" for r, f in [*FAMILY.items(), ("VARCHAR(255)", "text"), ("tinyint(4)", "integer"), (" Int ", "integer"), ("sa.String(20)", "text"), ("pg.inet", "inet")]) + ") SELECT * FROM v")
def type_families(spark, sf):
    raws = [*FAMILY, "VARCHAR(255)", "tinyint(4)", " Int ", "sa.String(20)", "pg.inet"]
    return spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", sql_family_col("raw").alias("family"))


@query(_DRIFT + """, n AS (SELECT t, count(*) AS n_drift FROM out_ GROUP BY t)
    SELECT 'tbl:public.' || t AS id, CASE WHEN t IN (SELECT t FROM lt) THEN CASE WHEN t IN (SELECT t FROM dt) THEN 'both' ELSE 'live' END ELSE 'declared' END AS origin, coalesce(n_drift, 0) AS n_drift
    FROM (SELECT t FROM dt UNION SELECT t FROM lt) LEFT JOIN n USING (t)""")
def live_merge(spark, sf):
    g = drift.merge_live(A.catalog(spark), A.catalog_live(spark, sf), SPARK_FAMILY)
    return g.nodes.where("kind = 'table'").select("id", "origin", F.coalesce(F.size("drift"), F.lit(0)).cast("long").alias("n_drift"))


@query(f"""WITH {_MAN} SELECT 'tbl:public.' || t AS src, 'tbl:public.' || split_part(ref, '.', 1) AS dst, 'static' AS source FROM man WHERE ref IS NOT NULL
    UNION ALL SELECT 'tbl:public.supplier', 'tbl:public.nation', 'live'""")
def live_merge_keys(spark, sf):
    live = A.catalog_live(spark, sf)
    once = drift.merge_live(A.catalog(spark), live, SPARK_FAMILY)
    return drift.merge_live(once, live, SPARK_FAMILY).edges.where("kind = 'fk'").select("src", "dst", "source")


# --- differences and history ----------------------------------------------------------------------------------------


def _slices(spark, sf):
    return A.supply_base(spark, sf, CUTS[0]), A.supply_base(spark, sf, CUTS[1])


def _moves(spark, sf):
    """Renames: every tenth customer's file moves."""
    c = A.read(spark, sf, "customer").where("c_custkey % 10 = 0")
    return c.select(F.concat(F.lit("customer/"), "c_custkey").alias("old"), F.concat(F.lit("client/"), "c_custkey").alias("new"))


def _moved(g, moves):
    """A graph in which the files have moved."""
    ids = moves.select(F.concat(F.lit("file:"), "old").alias("id"), F.concat(F.lit("file:"), "new").alias("__to"))
    nodes = g.nodes.join(ids, "id", "left").withColumn("id", F.coalesce("__to", "id")).drop("__to")
    return type(g)(nodes, g.edges)


_MOVE = "CASE WHEN id LIKE 'file:customer/%' AND CAST(substr(id, 15) AS BIGINT) % 10 = 0 THEN 'file:client/' || substr(id, 15) ELSE id END"


@query(f"""WITH {SLICES}, b AS (SELECT id AS old, {_MOVE} AS id FROM b_f), h AS (SELECT {_MOVE} AS id FROM h_f)
    SELECT CASE WHEN old IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'moved' END AS change, coalesce(CASE WHEN h.id IS NULL THEN old END, id) AS id, CASE WHEN old IS NOT NULL AND h.id IS NOT NULL THEN old END AS previous_id
    FROM b FULL JOIN h USING (id) WHERE old IS NULL OR h.id IS NULL OR old <> id""")
def diff_files(spark, sf):
    base, head = _slices(spark, sf)
    moves = _moves(spark, sf)
    return diff.diff_files(base, _moved(head, moves), moves)


@query(f"""WITH {SLICES} SELECT 'added' AS change, id AS module FROM (SELECT DISTINCT parent AS id FROM h_f EXCEPT SELECT DISTINCT parent FROM b_f)
    UNION ALL SELECT 'removed', id FROM (SELECT DISTINCT parent AS id FROM b_f EXCEPT SELECT DISTINCT parent FROM h_f)""")
def diff_modules(spark, sf):
    return diff.diff_modules(*_slices(spark, sf)).select("change", "module")


def _renamed(spark, sf):
    """Every second nation's module has a new name in the head."""
    g = A.supply_base(spark, sf)
    even = F.length("id") % 2 == 0
    new = F.when((F.col("kind") == "module") & even, F.concat("id", F.lit("_NEW"))).otherwise(F.col("id"))
    up = F.when(F.length("parent") % 2 == 0, F.concat("parent", F.lit("_NEW"))).otherwise(F.col("parent"))
    nodes = g.nodes.withColumns({"id": new, "parent": up})
    return g, type(g)(nodes, build.with_dependencies(nodes, g.edges.where("kind <> 'depends_on'")))


@query(f"WITH {SUPPLY} SELECT id AS old, id || '_NEW' AS new, CAST(1 AS DOUBLE) AS overlap FROM mods WHERE length(id) % 2 = 0")
def diff_module_renames(spark, sf):
    return diff.module_renames(*_renamed(spark, sf))


@query(f"WITH {SUPPLY} SELECT * FROM deps WHERE false")
def diff_renamed_dependencies(spark, sf):
    return diff.diff_dependencies(*_renamed(spark, sf)).select("src", "dst", F.col("after").alias("weight"))


@query(f"""WITH {SLICES} SELECT CASE WHEN b.weight IS NULL THEN 'added' WHEN h.weight IS NULL THEN 'removed' ELSE 'weight' END AS change, src, dst, b.weight AS before, h.weight AS after
    FROM b_d b FULL JOIN h_d h USING (src, dst) WHERE b.weight IS DISTINCT FROM h.weight""")
def diff_dependencies(spark, sf):
    return diff.diff_dependencies(*_slices(spark, sf))


def _catalogs(spark, sf):
    base = A.catalog(spark)
    head = drift.merge_live(base, A.catalog_live(spark, sf), SPARK_FAMILY)
    nodes = head.nodes.withColumn("columns", F.when(F.col("name") == "orders", F.expr("transform(filter(columns, c -> c.name <> 'o_orderstatus'), c -> named_struct('name', c.name, 'sql_type', if(c.name = 'o_totalprice', 'numeric', c.sql_type), 'nullable', c.nullable, 'is_pk', c.is_pk, 'fk_table', c.fk_table, 'fk_column', c.fk_column))")).otherwise(F.col("columns")))
    return base, type(base)(nodes, head.edges)


@query("SELECT * FROM (VALUES ('tbl:public.orders', 'o_orderstatus', 'text?', '∅'), ('tbl:public.orders', 'o_totalprice', 'float8?', 'numeric?')) v(table_id, \"column\", before, after)")
def diff_columns(spark, sf):
    return diff.diff_columns(*_catalogs(spark, sf))


@query(f"WITH {_MAN}, {_LIVE} SELECT 'added' AS change, 'tbl:public.' || t AS table_id FROM (SELECT DISTINCT t FROM live WHERE t NOT IN (SELECT t FROM man)) UNION ALL SELECT 'changed', 'tbl:public.orders'")
def diff_tables(spark, sf):
    return diff.diff_tables(*_catalogs(spark, sf))


@query("SELECT 'added' AS change, 'tbl:public.supplier' AS src, 'tbl:public.nation' AS dst")
def diff_foreign_keys(spark, sf):
    return diff.diff_foreign_keys(*_catalogs(spark, sf))


@query(_DRIFT + " SELECT 'tbl:public.' || t AS table_id, kind, count(*) AS n FROM out_ GROUP BY ALL")
def diff_drift(spark, sf):
    return diff.diff_drift(*_catalogs(spark, sf)).groupBy("table_id", "kind").agg(F.count("*").alias("n"))


def _commits(spark, sf):
    """A log of months with orders, newest first; tags are quarters' first months and one of long before."""
    m = A.read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sha")).distinct()
    log = m.select((F.row_number().over(A.Window.orderBy(F.desc("sha"))) - 1).alias("pos"), "sha", F.col("sha").alias("date"), F.concat(F.lit("orders of "), "sha").alias("subject"), F.when(F.substring("sha", 6, 2).isin("01", "04", "07", "10"), F.array(F.concat(F.lit("q"), "sha"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    tags = spark.createDataFrame([("v0", "x0", "1990-01"), ("v1", "x1", "1996-06-15"), ("v2", None, None)], "name string, sha string, date string")
    return log, tags, log.where("pos % 3 = 0").select("sha")


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS d FROM orders), p AS (
    SELECT d, 'orders of ' || d AS subject, d[6:7] IN ('01', '04', '07', '10') AS milestone, (row_number() OVER (ORDER BY d DESC) - 1) % 3 = 0 AS built FROM m
    UNION ALL SELECT * FROM (VALUES ('1990-01', 'v0', true, false), ('1996-06-15', 'v1', true, false)))
    SELECT row_number() OVER (ORDER BY d DESC) - 1 AS pos, d AS date, subject, milestone, built FROM p""")
def timeline_points(spark, sf):
    log, tags, built = _commits(spark, sf)
    return history.timeline(log, tags, built).select(F.col("pos").cast("long").alias("pos"), "date", "subject", "milestone", "built")


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS d FROM orders), q AS (SELECT 'q' || d AS label, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n FROM m WHERE d[6:7] IN ('01', '04', '07', '10')),
    s AS (SELECT label, pos FROM q WHERE pos IN (SELECT CAST(floor(i * (n - 1) / 2.0 + 0.5) AS BIGINT) FROM range(3) r(i), (SELECT max(n) AS n FROM q))),
    w AS (SELECT 'first' AS label, -1 AS pos UNION ALL SELECT * FROM s UNION ALL SELECT 'last', 1000000),
    i AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, label AS base, lead(label) OVER (ORDER BY pos) AS head FROM w) SELECT * FROM i WHERE head IS NOT NULL""")
def history_intervals(spark, sf):
    log, _, _ = _commits(spark, sf)
    tagged = log.where("size(tags) > 0").select((F.row_number().over(A.Window.orderBy("sha")) - 1).alias("pos"), F.array_join("tags", ", ").alias("label"))
    return history.intervals(history.waypoints("first", "last", tagged)).select(F.col("pos").cast("long").alias("pos"), "base", "head")


# --- documents ------------------------------------------------------------------------------------------------------


def _markdown(spark, sf):
    """Documents with headings and fences put in, by their numbers."""
    d = A.read(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "doc_id", "text")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Part "), "doc_id", F.lit(" ##\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n# not one\n```\n### Deep\n# Title "), "doc_id", F.lit("\n"))).otherwise("")
    return d.select("path", "doc_id", F.concat(head, "text").alias("content"))


@query("""SELECT source || '/' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'Part ' || doc_id WHEN 1 THEN 'Title ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_headings FROM documents""")
def doc_titles(spark, sf):
    return text.titles(_markdown(spark, sf)).select("path", "title", F.col("n_headings").cast("int").alias("n_headings"))


@query("""SELECT source || '/' || doc_id AS path, 0 AS line_no, 2 AS depth, 'Part ' || doc_id AS "text" FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source || '/' || doc_id, 3, 3, 'Deep' FROM documents WHERE doc_id % 3 = 1
    UNION ALL SELECT source || '/' || doc_id, 4, 1, 'Title ' || doc_id FROM documents WHERE doc_id % 3 = 1""")
def doc_headings(spark, sf):
    return text.headings(_markdown(spark, sf))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM documents")
def line_counts(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", text.count_lines("text").cast("long").alias("lines"))


@query("""WITH r AS (SELECT doc_id, repeat(text, 40) AS t FROM documents WHERE text SIMILAR TO '[\\x00-\\x7F]*')
    SELECT doc_id, strlen(t) > 131072 AS truncated, CASE WHEN strlen(t) > 131072 THEN length(CASE WHEN instr(substr(t, 1, 131072), chr(10)) > 1 THEN substr(t, 1, 131072 - instr(reverse(substr(t, 1, 131072)), chr(10))) ELSE substr(t, 1, 131072) END) + 16 ELSE length(t) END AS n FROM r""")
def doc_truncation(spark, sf):
    d = A.read(spark, sf, "documents").where("octet_length(text) = length(text)").select("doc_id", F.repeat("text", F.lit(40)).alias("t"))
    return d.select("doc_id", text.truncated_document(F.col("t")).alias("truncated"), F.length(text.cut_document(F.col("t"))).cast("long").alias("n"))


@query("""SELECT 'mod:' || source AS module, 'doc:' || arg_min(p, (NOT c, p)) AS doc, max(c) AS certain FROM (SELECT source, source || '/' || doc_id AS p, doc_id IN (SELECT doc_id FROM labels) AS c FROM documents) GROUP BY source""")
def module_readme(spark, sf):
    return views.module_readmes(A.documents_graph(spark, sf)).select("module", "doc", "certain")


@query("SELECT source || '/' || doc_id AS path, 'mod:' || source AS module FROM documents")
def docs_list(spark, sf):
    return views.docs_list(A.documents_graph(spark, sf)).select("path", "module")


@query("""SELECT d.doc_id FROM documents d WHERE doc_id % 2 = 1""")
def facts_cache_misses(spark, sf):
    from ..sources.cache import facts_key, misses

    d = A.read(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"), "doc_id")
    kept = d.where("doc_id % 2 = 0").select(facts_key("path", "content").alias("key"))
    return misses(d, kept).select("doc_id")


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0 * 1.15) AS BIGINT) AS tokens, CAST(least(20000, greatest(200, doc_id * 7)) AS BIGINT) AS budget, CAST(least(20000, ceil(least(20000, greatest(200, doc_id * 7)) * 2 / 1000.0) * 1000) AS BIGINT) AS suggested FROM documents""")
def budget_estimates(spark, sf):
    d = A.read(spark, sf, "documents").withColumn("asked", F.col("doc_id") * 7).withColumn("budget", budget.clamp_budget_col("asked"))
    return d.select("doc_id", budget.estimate_tokens_col("text").cast("long").alias("tokens"), "budget", budget.suggest_budget_col("budget").cast("long").alias("suggested"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no FROM l WHERE contains(lower(line), 'and the')""")
def in_file_search(spark, sf):
    return views.lines_with(A.read(spark, sf, "documents"), " AND the ", "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE line_no BETWEEN 2 AND 4""")
def source_lines(spark, sf):
    return views.source_lines(A.read(spark, sf, "documents"), 2, 4, "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


# --- drawing and modules --------------------------------------------------------------------------------------------

PATCH = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -3,4 +3,5 @@ fn\n keep\n-old\n+new\n+more\n keep\n@@ -20 +21,2 @@\n last\n+end\n\\ No newline at end of file\n"


@query("""SELECT * FROM (VALUES (0, 'meta', NULL, NULL), (1, 'meta', NULL, NULL), (2, 'meta', NULL, NULL), (3, 'meta', NULL, NULL), (4, 'hunk', NULL, NULL), (5, 'ctx', 3, 3), (6, 'del', 4, NULL), (7, 'add', NULL, 4),
    (8, 'add', NULL, 5), (9, 'ctx', 5, 6), (10, 'hunk', NULL, NULL), (11, 'ctx', 20, 21), (12, 'add', NULL, 22), (13, 'meta', NULL, NULL)) v(pos, kind, old_no, new_no)""")
def unified_diff_lines(spark, sf):
    d = views.unified_diff(spark.createDataFrame([("x", PATCH)], "key string, patch string"))
    return d.select("pos", "kind", F.col("old_no").cast("int").alias("old_no"), F.col("new_no").cast("int").alias("new_no"))


@query(f"WITH {SUPPLY} SELECT src, dst, weight, round(least(1 + log2(greatest(weight, 1)), 5), 6) AS width FROM deps")
def flow_edges(spark, sf):
    return views.overview_flow(A.supply_base(spark, sf))


@query(f"""WITH {SUPPLY}, s AS (SELECT dst AS id, 'out' AS r FROM deps WHERE src = {MODULE} UNION ALL SELECT src, 'in' FROM deps WHERE dst = {MODULE}) SELECT id, array_to_string(list_sort(list_distinct(list(r))), '+') AS role FROM s GROUP BY id""")
def module_neighbours(spark, sf):
    g = A.supply_base(spark, sf)
    return views.module_neighbours(g, _module(g))


@query(f"""WITH {SUPPLY}, e AS (SELECT src, dst FROM imports UNION ALL SELECT src, dst FROM pkgs), n AS (SELECT dst AS id FROM e WHERE src = 'file:supplier/2' UNION SELECT src FROM e WHERE dst = 'file:supplier/2' UNION SELECT 'file:supplier/2')
    SELECT id FROM n UNION SELECT parent FROM files WHERE id IN (SELECT id FROM n)""")
def focus_neighbourhood(spark, sf):
    return views.focus(A.supply_base(spark, sf), "file:supplier/2")


@query(f"WITH {SUPPLY} SELECT layer, array_to_string(list_sort(list(name)), ',') AS modules FROM mods GROUP BY layer")
def sidebar_layers(spark, sf):
    return views.layers(A.supply_base(spark, sf)).select("layer", F.array_join("modules", ",").alias("modules"))


@query("""SELECT doc_id, p AS path, CASE WHEN p LIKE 'special/%' THEN 'rules' WHEN p LIKE 'packages/app/%' THEN '@x/app' WHEN p LIKE 'src/%' THEN CASE WHEN len(string_split(substr(p, 5), '/')) = 1 THEN 'root' ELSE string_split(substr(p, 5), '/')[1] END
    WHEN p LIKE 'libs/%' AND len(string_split(p, '/')) > 2 THEN string_split(p, '/')[2] WHEN len(string_split(p, '/')) = 1 THEN 'root' ELSE string_split(p, '/')[1] END AS module
    FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/' || source || '/' || doc_id WHEN 1 THEN 'libs/' || source || '/' || doc_id WHEN 2 THEN 'packages/app/' || doc_id WHEN 3 THEN 'special/' || doc_id WHEN 4 THEN 'f' || doc_id ELSE source || '/' || doc_id END AS p FROM documents)""")
def module_inference(spark, sf):
    from ..operators.resolve import infer_modules

    d = A.read(spark, sf, "documents")
    k = F.col("doc_id") % 6
    path = F.when(k == 0, F.concat(F.lit("src/"), "source", F.lit("/"), "doc_id")).when(k == 1, F.concat(F.lit("libs/"), "source", F.lit("/"), "doc_id")).when(k == 2, F.concat(F.lit("packages/app/"), "doc_id"))
    path = path.when(k == 3, F.concat(F.lit("special/"), "doc_id")).when(k == 4, F.concat(F.lit("f"), "doc_id")).otherwise(F.concat("source", F.lit("/"), "doc_id"))
    got = infer_modules(d.select("doc_id", path.alias("path")), [("rules", None, ["special/**"])], [("@x/app", "packages/app")], "root")
    return got.select("doc_id", "path", "module")


@query(f"""WITH {SUPPLY}, r AS (SELECT id AS old, CASE WHEN length(id) % 2 = 0 THEN id || '_NEW' ELSE id END AS id FROM mods)
    SELECT id, substr(id, 5) AS name, CASE WHEN old <> id THEN 'changed' END AS status, CASE WHEN old <> id THEN 'renamed from ' || substr(old, 5) END AS detail FROM r""")
def diff_flow_nodes(spark, sf):
    base, head = _renamed(spark, sf)
    named = head.nodes.withColumn("name", F.when(F.col("kind") == "module", F.expr("substring(id, 5)")).otherwise(F.col("name")))
    return flows.diff_nodes(base, type(head)(named, head.edges))


@query(f"""WITH {SLICES} SELECT CASE WHEN h.weight IS NULL THEN 'dep-removed:' ELSE 'dep:' END || src || '→' || dst AS id,
    CASE WHEN b.weight IS NULL THEN 'edge-added' WHEN h.weight IS NULL THEN 'edge-removed' WHEN h.weight <> b.weight THEN 'edge-changed' END AS class,
    CASE WHEN h.weight <> b.weight THEN b.weight || ' → ' || h.weight END AS label FROM b_d b FULL JOIN h_d h USING (src, dst)""")
def diff_flow_lines(spark, sf):
    return flows.diff_lines(*_slices(spark, sf)).select("id", "class", "label")


@query(f"""WITH {SUPPLY}, m AS (SELECT min(id) AS id FROM mods) SELECT 'dep:' || src || '→' || dst AS id, CASE WHEN weight > 1 THEN CAST(weight AS VARCHAR) END AS label FROM deps
    UNION ALL SELECT 'imp:' || src || '→' || dst, NULL FROM imports JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE a.parent = b.parent AND a.parent = (SELECT id FROM m)""")
def overview_flow_lines(spark, sf):
    g = A.supply_base(spark, sf)
    return flows.overview_lines(g, [_module(g)]).select("id", "label")


@query(f"""WITH {SUPPLY}, m AS (SELECT min(id) AS id FROM mods), f AS (SELECT parent AS id, count(*) AS files FROM files GROUP BY 1)
    SELECT id, CASE WHEN id = (SELECT id FROM m) THEN 'moduleGroup' ELSE 'module' END AS type, NULL AS parent, files FROM mods JOIN f USING (id)
    UNION ALL SELECT id, 'file', parent, 0 FROM files WHERE parent = (SELECT id FROM m)""")
def overview_flow_nodes(spark, sf):
    g = A.supply_base(spark, sf)
    return flows.overview_nodes(g, [_module(g)]).select("id", "type", "parent", "files")


@query(f"WITH {_MAN} SELECT 'tbl:public.' || t AS id, count(*) AS n_columns, 36 + 22 * count(*) AS height FROM man GROUP BY t")
def table_boxes(spark, sf):
    return flows.table_boxes(A.catalog(spark)).select("id", F.col("n_columns").cast("long").alias("n_columns"), F.col("height").cast("long").alias("height"))


@query(f"WITH {SUPPLY_RANKED} SELECT parent AS id, count(*) AS files FROM files JOIN ranks USING (id) GROUP BY parent ORDER BY round(sum(rank), 6) DESC, parent LIMIT {flows.HOME_MODULES}")
def home_modules(spark, sf):
    return flows.home_modules(A.supply(spark, sf)).select("id", "files")


from . import checking_queries, history_queries, resolution_queries, schema_queries, tree_queries  # noqa: E402, F401  they register their queries with the above
