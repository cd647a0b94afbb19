"""Answers as Markdown under a token budget. Views are collected with their own limits, then written line by line."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions.budget import BudgetWriter, suggest_budget
from ..operators import algo, views
from ..schema import Graph

#: Fixed value: most lines of a module's README in its answer.
PROSE_LINES = 30
#: No line of a list is shorter than this, line end included: so many rows are fetched as an answer can hold.
SHORTEST = 4


def short_sha(sha: str | None) -> str:
    return (sha or "")[:7]


def ago(date: str, now: datetime | None = None, fresh: int = 45) -> str:
    """How long ago an ISO date is."""
    s = ((now or datetime.now(UTC)) - datetime.fromisoformat(date)).total_seconds()
    if s < fresh:
        return "just now"
    for unit, n in (("d", 86_400), ("h", 3_600)):
        if s >= n:
            return f"{int(s // n)}{unit} ago"
    return f"{max(1, round(s / 60))}m ago"


def name_list(names: list[str], most: int = 6) -> str:
    return ", ".join(names[:most]) + (f" +{len(names) - most}" if len(names) > most else "")


def clip(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def _more(w: BudgetWriter, what: str):
    return lambda n: f"+{n} more {what} → ask with a budget of {suggest_budget(w.budget)}"


def _fetch(w: BudgetWriter, df, *order) -> tuple[list, int]:
    """The first rows, as many as the answer can hold, and how many there are."""
    df = df.orderBy(*order) if order else df
    rows = df.limit(w.left // SHORTEST + 1).collect()
    return rows, len(rows) if len(rows) <= w.left // SHORTEST else df.count()


def _section(w: BudgetWriter, title: str, items: list[str], what: str, total: int | None = None) -> None:
    if items:
        w.blank()
        if w.line(f"## {title}"):
            w.list(items, _more(w, what), total)


def overview(g: Graph, budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    w.line("# Architecture overview")
    mods, n_mods = _fetch(w, views.overview_modules(g))
    counts = {r.kind: r.n for r in g.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    w.line(", ".join(f"{n} {k}" for k, n in sorted(counts.items())))
    _section(w, "Modules", [f"- {m.name}: {m.files} files, {m['loc'] or 0} lines, rank {m['rank']:.3f}" + (f", instability {m.instability}" if m.instability is not None else "") for m in mods], "modules", n_mods)
    deps, n = _fetch(w, views.overview_dependencies(g))
    _section(w, "Dependencies", [f"- {d.src[4:]} → {d.dst[4:]} ({d.weight})" for d in deps], "dependencies", n)
    members = F.sort_array(F.collect_list(F.expr("substring(member, 5)")))
    cycles, n = _fetch(w, algo.dependency_cycles(g.edges).groupBy("cycle").agg(F.slice(members, 1, w.left).alias("first"), F.count("*").alias("n")), "cycle")
    _section(w, "Cycles", [f"- {' ↔ '.join(c['first'])}" + (f" and {c['n'] - len(c['first'])} more" if c["n"] > len(c["first"]) else "") for c in cycles], "cycles", n)
    packages, n = _fetch(w, views.overview_packages(g))
    _section(w, "Packages", [f"- {p.name} ({p.registry}): {p.fan_in}" for p in packages], "packages", n)
    return str(w)


def module(g: Graph, ref: str, budget: int | None = None) -> str:
    hit = views.resolve_ref(g, ref).where("kind = 'module'").first()
    if hit is None:
        return not_found(g, ref, budget)
    w = BudgetWriter(budget)
    w.line(f"# Module {hit.name}")
    w.line(f"{hit['loc'] or 0} lines, rank {hit['rank'] or 0:.3f}" + (f", layer {hit.layer}" if hit.layer else ""))
    readme = views.module_readmes(g).where(F.col("module") == hit.id).join(g.nodes.select(F.col("id").alias("doc"), "content"), "doc").first()
    if readme is not None and readme.content:
        lines = readme.content.split("\n")
        w.blank()
        if w.line("## About"):
            w.list(lines[:PROSE_LINES], lambda n: f"+{n + max(0, len(lines) - PROSE_LINES)} more lines → {readme.path}")
    files, n = _fetch(w, views.module_files(g, hit.id))
    _section(w, "Files", [f"- {f.path} ({f['loc'] or 0})" + (f": {name_list(f.exports)}" if f.exports else "") for f in files], "files", n)
    for title, out in (("Depends on", True), ("Dependents", False)):
        rows, n = _fetch(w, views.module_deps(g, hit.id, out), F.desc("weight"), "id")
        _section(w, title, [f"- {r.id[4:]} ({r.weight})" for r in rows], "modules", n)
    packages, n = _fetch(w, views.module_packages(g, hit.id), F.desc("files"), "id")
    _section(w, "Packages", [f"- {p.name} ({p.files})" for p in packages], "packages", n)
    return str(w)


def dependencies(g: Graph, ref: str, budget: int | None = None) -> str:
    hit = views.resolve_ref(g, ref).first()
    if hit is None:
        return not_found(g, ref, budget)
    w = BudgetWriter(budget)
    w.line(f"# Dependencies of {hit.id}")
    found = views.dependencies_of(g, hit.id)
    for title, side in (("Outgoing", "out"), ("Incoming", "in")):
        rows, n = _fetch(w, found.where(F.col("direction") == side), "edge_kind", "other_id")
        _section(w, title, [f"- {r.edge_kind} {r.other_id}" + (f" ({name_list(r.symbols)})" if r.symbols else "") for r in rows], "edges", n)
    return str(w)


def impact(g: Graph, ref: str, budget: int | None = None) -> str:
    hit = views.resolve_ref(g, ref).first()
    if hit is None:
        return not_found(g, ref, budget)
    w, s = BudgetWriter(budget), views.impact_summary(g, hit.id).first()
    w.line(f"# Impact of {hit.id}")
    w.line(f"{s.total_files} files, up to {s.max_depth} hops" + (" (cut short)" if s.truncated else ""))
    rows, n = _fetch(w, views.direct_dependents(g, hit.id))
    _section(w, "Direct dependents", [f"- {r.id}" for r in rows], "dependents", n)
    rows, n = _fetch(w, views.impact_by_module(g, hit.id))
    _section(w, "Modules", [f"- {r.module[4:]}: {r.files} files from hop {r.min_depth}" for r in rows], "modules", n)
    rows, n = _fetch(w, views.impact_tables(g, hit.id), "id")
    _section(w, "Tables", [f"- {r.name}" for r in rows], "tables", n)
    return str(w)


def search(g: Graph, query: str, kinds: list[str] | None = None, budget: int | None = None) -> str:
    w, rows = BudgetWriter(budget), views.search(g, query, kinds).orderBy(F.desc("score"), F.desc("rank"), "id").collect()
    w.line(f"# {rows[0].total if rows else 0} matches for {clip(query, 60)}")
    w.list([f"- {r.id}" + (f" in {r.module_id[4:]}" if r.module_id and r.module_id != r.id else "") for r in rows], _more(w, "matches"))
    return str(w)


def file_context(g: Graph, ref: str, budget: int | None = None) -> str:
    hit = views.resolve_ref(g, ref).where("kind = 'file'").first()
    if hit is None:
        return not_found(g, ref, budget)
    w = BudgetWriter(budget)
    w.line(f"# {hit.path or hit.name}")
    w.line(f"{hit.lang or ''} {hit['loc'] or 0} lines in {(hit.parent or '')[4:]}".strip())
    if hit.doc:
        w.line(hit.doc)
    rows, n = _fetch(w, views.file_exports(g, hit.id))
    _section(w, "Exports", [f"- {r.symbol_kind} {r.name}" + (f": {clip(r.doc, 120)}" if r.doc else "") for r in rows], "exports", n)
    rows, n = _fetch(w, g.nodes.where((F.col("kind") == "entity") & (F.col("parent") == hit.id)), "id")
    _section(w, "Entities", [f"- {r.name} ({r.orm}) → {r.declared_table}" for r in rows], "entities", n)
    for title, incoming in (("Imports", False), ("Imported by", True)):
        rows, n = _fetch(w, views.file_imports(g, hit.id, incoming=incoming))
        _section(w, title, [f"- {r.id}" for r in rows], "files", n)
    return str(w)


def docs(g: Graph, budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    w.line("# Documents")
    rows, n = _fetch(w, views.docs_list(g))
    w.list([f"- {r.path}: {r.title}" for r in rows], _more(w, "documents"), n)
    return str(w)


def doc(g: Graph, ref: str, budget: int | None = None) -> str:
    hit = views.resolve_ref(g, ref if ref.startswith("doc:") else f"doc:{ref}").first()
    if hit is None:
        return not_found(g, ref, budget)
    w = BudgetWriter(budget)
    w.line(f"# {hit.title}")
    at = g.edges.where((F.col("kind") == "documents") & (F.col("src") == hit.id)).orderBy("dst").first()
    if at is not None:
        w.line(f"module {at.dst[4:]}")
    _section(w, "Headings", [f"{'  ' * (h.depth - 1)}- {h.text}" for h in hit.headings or []], "headings")
    w.blank()
    w.list((hit.content or "").split("\n"), lambda n: f"+{n} more lines → {hit.path}")
    return str(w)


def db_schema(g: Graph, budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    tables = views.table_summaries(g)
    sizes = {r.schema: r.n for r in tables.groupBy("schema").agg(F.count("*").alias("n")).orderBy("schema").limit(w.left // SHORTEST + 1).collect()}
    w.line(f"# {tables.count()} tables")
    for schema, n in sorted(sizes.items()):
        rows, _ = _fetch(w, tables.where(F.col("schema") == schema), "name")
        _section(w, schema, [f"- {r.name}: {r.n_columns} columns, key {', '.join(r.pk or []) or 'none'}, {r.origin}" + (f", {r.n_drift} drift" if r.n_drift else "") for r in rows], "tables", n)
        if w.truncated:
            break
    rows, n = _fetch(w, views.foreign_keys(g), "src", "dst")
    _section(w, "Foreign keys", [f"- {r.src[4:]} → {r.dst[4:]}" for r in rows], "keys", n)
    return str(w)


def entity_relations(g: Graph, ref: str, prefer: str = "entity", budget: int | None = None) -> str:
    hit = views.resolve_db_ref(g, ref, prefer).first()
    if hit is None:
        return not_found(g, ref, budget)
    w, at = BudgetWriter(budget), views.entity_table(g, hit.id).first()
    w.line(f"# {hit.kind} {hit.name}")
    if at is not None:
        w.line(f"table {at.table_id[4:]}")
        columns = views.erd_columns(g).where(F.col("table_id") == at.table_id).orderBy("pos").collect()
        _section(w, "Columns", [f"- {c.name} {c.sql_type}{'?' if c.nullable else ''}{' pk' if c.is_pk else ''}" + (f" → {c.fk_table}.{c.fk_column}" if c.fk_table else "") for c in columns], "columns")
        _section(w, "Related", [f"- {r.direction} {r.table_name}" for r in views.related_tables(g, at.table_id).collect()], "tables")
    return str(w)


def schema_drift(g: Graph, budget: int | None = None) -> str:
    w, found = BudgetWriter(budget), views.drifted_tables(g)
    rows, n = _fetch(w, found, "table_id", "kind", "detail")
    w.line(f"# Drift: {n} findings in {found.select('table_id').distinct().count()} tables" if n else "# No drift")
    w.list([f"- {r.table_id[4:]}: {r.kind}: {r.detail}" for r in rows], _more(w, "findings"), n)
    return str(w)


def diff(changes: dict, budget: int | None = None) -> str:
    """Differences as plans.analyze.compare gives them."""
    w, total = BudgetWriter(budget), 0
    w.line("# Architecture diff")
    for title, df in changes.items():
        rows, n = _fetch(w, df, *df.columns)
        total += n
        _section(w, title.replace("_", " ").capitalize(), ["- " + " ".join(str(v) for v in r if v is not None) for r in rows], title.replace("_", " "), n)
    if not total:
        w.line("No architectural changes.")
    return str(w)


def timeline(points, budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    w.line("# Timeline")
    rows, n = _fetch(w, points, "pos")
    w.list([f"- {short_sha(r.sha)} {r.date[:10]} {clip(r.subject, 80)}" + (f" [{', '.join(r.tags)}]" if r.tags else "") for r in rows], _more(w, "points"), n)
    return str(w)


def history(intervals: list[tuple[str, str, dict]], budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    w.line("# History")
    for base, head, changes in intervals:
        counts = {k: df.count() for k, df in changes.items()}
        w.line(f"- {base} → {head}: " + (", ".join(f"{n} {k.replace('_', ' ')}" for k, n in counts.items() if n) or "no changes"))
    return str(w)


def not_found(g: Graph, ref: str, budget: int | None = None) -> str:
    w = BudgetWriter(budget)
    w.line(f"Nothing is named {clip(ref, 120)}.")
    near = [r.id for r in views.suggestions(g, ref).collect()]
    if near:
        w.line("Did you mean " + ", ".join(near) + "?")
    return str(w)


def staleness(graph_sha: str | None, head_sha: str | None, dirty: bool) -> list[str]:
    if graph_sha is None or head_sha is None:
        return []
    if graph_sha != head_sha:
        return [f"The graph is of {short_sha(graph_sha)}, the tree is at {short_sha(head_sha)}: analyze again."]
    return ["The tree has changes that the graph doesn't have."] if dirty else []
