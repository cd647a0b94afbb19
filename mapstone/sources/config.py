"""Configuration, workspaces, path aliases and migration heads of a repository; small files, read by the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIG_NAME = "mapstone.yml"


@dataclass
class Config:
    """What a repository may configure; all of it is optional."""

    exclude: list[str] = field(default_factory=list)
    modules: list[tuple[str, str | None, list[str]]] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    docs_include: list[str] = field(default_factory=list)
    docs_exclude: list[str] = field(default_factory=list)
    python_roots: list[str] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)


def parse_config(data: dict | None) -> Config:
    """Validate and convert; raises ValueError with the place of what is wrong."""
    data = data or {}
    if not isinstance(data, dict):
        raise ValueError("the configuration must be a mapping")
    known = {"version", "exclude", "modules", "layers", "edges", "docs", "python", "db"}
    if unknown := set(data) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = Config(exclude=list(data.get("exclude") or []))
    for k, m in enumerate(data.get("modules") or []):
        if not isinstance(m, dict) or "name" not in m or "include" not in m:
            raise ValueError(f"modules[{k}]: name and include are needed")
        include = [m["include"]] if isinstance(m["include"], str) else list(m["include"])
        out.modules.append((m["name"], m.get("layer"), include))
    for k, e in enumerate(data.get("edges") or []):
        if not {"kind", "from", "to"} <= set(e):
            raise ValueError(f"edges[{k}]: kind, from and to are needed")
        out.edges.append({"kind": e["kind"], "src": e["from"], "dst": e["to"], "reason": e.get("reason")})
    docs = data.get("docs") or {}
    out.docs_include, out.docs_exclude = list(docs.get("include") or []), list(docs.get("exclude") or [])
    out.python_roots = list((data.get("python") or {}).get("roots") or [])
    out.sources = list((data.get("db") or {}).get("live") or [])
    return out


def load_config(root: str) -> Config:
    path = Path(root, CONFIG_NAME)
    if not path.exists():
        return Config()
    import yaml

    return parse_config(yaml.safe_load(path.read_text()))


def pick_source(sources: list[dict], name: str | None = None) -> dict:
    """The named live source; a single one needs no name."""
    if not sources:
        raise ValueError("no live source is configured")
    if name is None:
        if len(sources) > 1:
            raise ValueError(f"several live sources; name one of {[s.get('name') for s in sources]}")
        return sources[0]
    for s in sources:
        if s.get("name") == name:
            return s
    raise ValueError(f"no live source named {name}")


#: Conditions of package exports, in order.
EXPORT_CONDITIONS = ("types", "import", "default", "require", "node")


def _json(path: Path) -> dict:
    """JSON with comments and trailing commas; an unreadable file counts as empty."""
    try:
        text = path.read_text()
    except OSError:
        return {}
    strings: list[str] = []

    def keep(m):
        if m[0][0] != '"':
            return ""
        strings.append(m[0])
        return f'"\0{len(strings) - 1}"'

    text = re.sub(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', keep, text, flags=re.S)
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    text = re.sub(r'"\x00(\d+)"', lambda m: strings[int(m[1])], text)
    try:
        got = json.loads(text)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def workspaces(root: str) -> list[tuple[str, str]]:
    """(name, directory) of workspace packages: exact directories and one-level globs of the first list that exists."""
    globs: list[str] = []
    pnpm, base = Path(root, "pnpm-workspace.yaml"), Path(root)
    if pnpm.exists():
        import yaml

        globs = (yaml.safe_load(pnpm.read_text()) or {}).get("packages") or []
    if not globs:
        ws = _json(base / "package.json").get("workspaces") or []
        globs = ws.get("packages", []) if isinstance(ws, dict) else ws
    if not globs:
        globs = _json(base / "lerna.json").get("packages") or []
    dirs: list[Path] = []
    for g in globs:
        if g.startswith("!"):
            continue
        g = g.rstrip("/").removeprefix("./")
        if g.endswith("/*") and "*" not in g[:-2]:
            dirs += sorted(p for p in (base / g[:-2]).glob("*") if p.is_dir())
        elif "*" not in g:
            dirs.append(base / g)
    out = []
    for d in dict.fromkeys(dirs):
        if (d / "package.json").exists():
            at = str(d.relative_to(base))
            out.append((_json(d / "package.json").get("name") or d.name, at))
    return out


def workspace_entries(root: str, members: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Declared entries of each workspace package by its directory: its root export by condition, then types, module, main."""
    out = {}
    for _, at in members:
        data = _json(Path(root, at, "package.json"))
        exported, found = data.get("exports"), []
        if isinstance(exported, dict) and "." in exported:
            exported = exported["."]
        pending = [exported]
        while pending:
            x = pending.pop()
            if isinstance(x, str):
                found.append(x)
            elif isinstance(x, dict):
                pending += [x[k] for k in reversed(EXPORT_CONDITIONS) if k in x]
        out[at] = found + [data[k] for k in ("types", "module", "main") if isinstance(data.get(k), str)]
    return out


def _extended(root: str, at: Path, name: str) -> Path | None:
    """The file that an `extends` names: relative to the configuration, or an installed package's."""
    if name.startswith((".", "/")):
        tries = [at.parent / name, at.parent / f"{name}.json"]
    else:
        top = Path(root).resolve()
        above = [p for p in (at.parent, *at.parent.parents) if p == top or top in p.parents]
        tries = [p / "node_modules" / x for p in above for x in (name, f"{name}.json", f"{name}/tsconfig.json")]
    return next((p.resolve() for p in tries if p.is_file()), None)


def _compiler_options(root: str, path: Path, seen: frozenset[Path] = frozenset()) -> dict | None:
    """baseUrl and paths of a tsconfig over those it extends, later ones first; whence: the folder that each is relative to. None if
    one that it extends is missing."""
    data, out = _json(path), {}
    extends = data.get("extends") or []
    for name in [extends] if isinstance(extends, str) else extends:
        parent = _extended(root, path, name)
        if parent is None:
            return None
        if parent in seen:
            continue
        got = _compiler_options(root, parent, seen | {path})
        if got is None:
            return None
        out |= got
    for key in ("baseUrl", "paths"):
        if key in (data.get("compilerOptions") or {}):
            out[key] = ((data["compilerOptions"])[key], path.parent)
    return out


def tsconfig_aliases(root: str, path: Path) -> dict:
    """paths: (pattern, targets) in order; base: the folder of plain specifiers, or None. All relative to the root."""
    top = Path(root).resolve()
    options = _compiler_options(root, path.resolve()) or {}
    base, whence = options.get("baseUrl", (None, None))
    at = (whence / base).resolve() if isinstance(base, str) else None
    inside = lambda p: "" if p == top else str(p.relative_to(top)) if p.is_relative_to(top) else None
    paths, whence = options.get("paths", (None, None))
    out = []
    for pattern, targets in (paths or {}).items() if isinstance(paths, dict) else ():
        own = [inside(((at or whence) / t).resolve()) for t in targets if isinstance(t, str)]
        out.append((pattern, [t for t in own if t is not None]))
    return {"paths": out, "base": inside(at) if at is not None else None}


def path_aliases(root: str, paths: list[str] | None = None) -> dict[str, dict]:
    """Aliases by directory of their tsconfig ("" is the root), for the scanned paths or the root alone."""
    found = [p for p in paths or [] if p.rpartition("/")[2] == "tsconfig.json"]
    if Path(root, "tsconfig.json").exists() or not Path(root, "tsconfig.base.json").exists():
        found.append("tsconfig.json")
    else:
        found.append("tsconfig.base.json")
    return {p.rpartition("/")[0]: tsconfig_aliases(root, Path(root, p)) for p in dict.fromkeys(found) if Path(root, p).exists()}


def gitignore(root: str) -> list[str]:
    path = Path(root, ".gitignore")
    return path.read_text().splitlines() if path.exists() else []


def _assigned(content: str, name: str) -> Column:
    """The value of a module-level assignment, with or without an annotation, as it is written."""
    return F.regexp_extract(content, rf"(?m)^{name}(?::[^=\n]+)?\s*=\s*(.+)$", 1)


def migrations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """revision, path, down (the revisions that it follows) of migration files; of files with one revision the last by path counts."""
    quoted = F.lit(r"['\"]([^'\"]+)['\"]")
    own = files.select(F.col(path).alias("path"), F.get(F.regexp_extract_all(_assigned(content, "revision"), quoted, 1), 0).alias("revision"), F.regexp_extract_all(_assigned(content, "down_revision"), quoted, 1).alias("down"))
    last = own.where("revision IS NOT NULL").groupBy("revision").agg(F.max_by(F.struct("path", "down"), "path").alias("m"))
    return last.select("revision", "m.path", F.array_distinct("m.down").alias("down"))


def migration_graph(found: DataFrame) -> DataFrame:
    """revision, path, down, followers, missing (followed revisions that aren't there), head, base, branch (several follow), merge (it
    follows several) of every migration."""
    links = found.select("revision", F.explode("down").alias("to"))
    after = links.groupBy(F.col("to").alias("revision")).agg(F.count("*").alias("followers"))
    broken = links.join(found.select(F.col("revision").alias("to")), "to", "left_anti").groupBy("revision").agg(F.sort_array(F.collect_set("to")).alias("missing"))
    own = found.join(after, "revision", "left").join(broken, "revision", "left").na.fill({"followers": 0})
    own = own.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return own.withColumns({"head": F.col("followers") == 0, "base": F.size("down") == 0, "branch": F.col("followers") > 1, "merge": F.size("down") > 1})


def migration_heads(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """revision, path of migrations that no other migration follows."""
    return migration_graph(migrations(files, path, content)).where("head").select("revision", "path").orderBy("revision")


def versions_dir(root: str, paths: list[str]) -> str | None:
    """The folder of migrations: where the ini file points to, else the first env.py beside a folder versions, at most three levels down."""
    ini = Path(root, "alembic.ini")
    if ini.exists() and (m := re.search(r"(?m)^\s*script_location\s*=\s*(.+)$", ini.read_text())):
        at = Path(m[1].strip().replace("%(here)s", "."), "versions")
        if Path(root, at).is_dir():
            return str(at)
    dirs = {str(Path(p).parent) for p in paths}
    found = sorted((p for p in paths if p.rpartition("/")[2] == "env.py" and p.count("/") <= 3), key=lambda p: (p.count("/"), p))
    beside = (str(Path(p).parent / "versions") for p in found)
    return next((v for v in beside if any(d == v or d.startswith(v + "/") for d in dirs)), None)


#: Layer that a directory's name suggests. Fixed values.
LAYER_HINTS = {
    "api": "api", "routes": "api", "controllers": "api", "handlers": "api", "services": "domain", "domain": "domain", "core": "domain",
    "models": "data", "db": "data", "repositories": "data", "entities": "data",
}


def detect_stack(files: DataFrame, path: str = "path") -> dict:
    """Which languages a tree has, its Prisma files, and layer hints of its first directories."""
    p = F.col(path)
    flags = files.agg(F.max(p.rlike(r"\.[mc]?[tj]sx?$")).alias("ts"), F.max(p.endswith(".py")).alias("py")).first()
    first = F.split(F.regexp_replace(p, "^src/", ""), "/")
    hints = F.create_map(*[F.lit(x) for kv in LAYER_HINTS.items() for x in kv])
    found = files.where(F.size(first) > 1).select(first[0].alias("name")).distinct().withColumn("layer", hints[F.col("name")]).where("layer IS NOT NULL").collect()
    prisma = [r[0] for r in files.where(p.endswith(".prisma")).select(path).orderBy(path).limit(100).collect()]
    return {"typescript": bool(flags["ts"]), "python": bool(flags["py"]), "prisma": prisma, "layers": {r["name"]: r["layer"] for r in sorted(found)}}


def write_config(root: str, stack: dict) -> bool:
    """A commented configuration, unless there is one; and the output folder in the ignore file."""
    path, ignore = Path(root, CONFIG_NAME), Path(root, ".gitignore")
    lines = ignore.read_text().splitlines() if ignore.exists() else []
    if ".mapstone/" not in lines:
        ignore.write_text("\n".join([*lines, ".mapstone/"]) + "\n")
    if path.exists():
        return False
    rules = "".join(f"#  - name: {n}\n#    layer: {layer}\n#    include: ['{n}/**', 'src/{n}/**']\n" for n, layer in stack["layers"].items())
    path.write_text(f"# languages found: {', '.join(k for k in ('typescript', 'python') if stack[k]) or 'none'}\nversion: 1\n# exclude: ['**/generated/**']\n# modules:\n{rules}# edges: []\n")
    return True
