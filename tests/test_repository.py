"""A small repository end to end: extraction, resolution, graph, cache, snapshots, differences, answers, watching."""

import subprocess

import pytest
from mapstone.api import TOOLS, call
from mapstone.extract.facts import extract
from mapstone.functions.budget import estimate_tokens
from mapstone.operators.resolve import glob_regex
from mapstone.plans import analyze as A
from mapstone.schema import validate
from mapstone.sources import config, git, scan
from mapstone.sources.database import mysql_queries, postgres_queries, redact
from mapstone.sources.store import Store, export_json, import_json
from mapstone.streaming import watch

FILES = {
    "package.json": '{"workspaces": ["packages/*"]}',
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"]}}} // c',
    ".gitignore": "generated/\n*.tmp.ts\n!keep.tmp.ts\n",
    "src/main.ts": '/** @fileoverview Starts it. */\nimport { login } from "./auth/index.js";\nimport fmt, { pad as p } from "@app/util/format";\nimport fs from "node:fs";\nimport type { X } from "left-pad";\nexport const run = () => import("./auth/login");\n',
    "src/auth/index.ts": 'export { login } from "./login";\nexport * from "./login";\n',
    "src/auth/login.ts": 'import { pad } from "../util/format";\n/** Logs in. */\nexport async function login(a: { b: string }): Promise<{ ok: boolean }> { return { ok: /x}/.test(`${a.b}}`) }; }\nclass Hidden {}\n',
    "src/util/format.ts": "export default function fmt() {}\nexport const pad = 1, other = 2;\nexport interface Shape { a: string }\nexport type T = { b: 1 };\nexport enum E { A }\nfunction late() {}\nexport { late };\n",
    "generated/skip.ts": "export const no = 1;",
    "a.tmp.ts": "export const no = 1;",
    "keep.tmp.ts": "export const yes = 1;",
    "packages/core/package.json": '{"name": "@w/core"}',
    "packages/core/src/index.ts": 'import { login } from "@app/auth/login";\nexport const core = 1;\n',
    "packages/ui/package.json": '{"name": "@w/ui"}',
    "packages/ui/src/view.ts": 'import { core } from "@w/core";\nimport "react";\n',
    "py/app/__init__.py": "",
    "py/app/models.py": '"""Data."""\nfrom __future__ import annotations\nimport os\nfrom sqlalchemy import Column, ForeignKey, Integer, String\nfrom sqlalchemy.orm import Mapped, mapped_column\nfrom .base import Base\n\n__all__ = ["User", "Post"]\n\nclass User(Base):\n    """A user."""\n    __tablename__ = "users"\n    id = Column(Integer, primary_key=True)\n    name = Column("full_name", String, nullable=False)\n\nclass Post(Base):\n    __tablename__ = "posts"\n    id: Mapped[int] = mapped_column(primary_key=True)\n    title: Mapped[str | None]\n    user_id: Mapped[int] = mapped_column(ForeignKey("users.id"))\n',
    "py/app/base.py": "class Base: ...\n_private = 1\nPUBLIC: int = 2\n",
    "py/app/broken.py": "import json\ndef f(:\n  pass\nclass Fine:\n    pass\n",
    "README.md": "# Demo\n\nText.\n## Part\n",
    "src/auth/README.md": "no heading",
    "schema.prisma": 'model Account {\n  id Int @id\n  email String? @map("mail")\n  items Item[]\n}\nmodel Item {\n  a Int\n  b Int\n  owner Account @relation(fields: [a], references: [id])\n  @@id([a, b])\n  @@map("item_rows")\n}\n',
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("demo") / "demo"
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "-A", "-f")
    run("commit", "-qm", "first")
    run("tag", "v1")
    return root, run


@pytest.fixture(scope="module")
def graph(spark, repo):
    return A.analyze(spark, str(repo[0]))


def ids(df, kind):
    return {r.id for r in df.where(f"kind = '{kind}'").collect()}


def test_nodes(graph):
    validate(graph)
    assert ids(graph.nodes, "file") == {"file:" + p for p in FILES if p.endswith((".ts", ".py", ".prisma")) and not p.startswith("generated") and p != "a.tmp.ts"}
    assert ids(graph.nodes, "module") == {"mod:auth", "mod:util", "mod:demo", "mod:@w/core", "mod:@w/ui", "mod:py"}
    assert ids(graph.nodes, "doc") == {"doc:README.md", "doc:src/auth/README.md"}
    assert ids(graph.nodes, "extpkg") == {"pkg:fs", "pkg:left-pad", "pkg:react", "pkg:os", "pkg:sqlalchemy", "pkg:json"}
    symbols = ids(graph.nodes, "symbol")
    assert {"sym:src/util/format.ts#" + s for s in ("fmt", "pad", "other", "Shape", "T", "E", "late")} <= symbols
    assert "sym:src/auth/login.ts#Hidden" not in symbols and "sym:py/app/base.py#_private" not in symbols and "sym:py/app/base.py#PUBLIC" in symbols
    by = {r.id: r for r in graph.nodes.collect()}
    assert by["sym:src/auth/login.ts#login"].doc == "Logs in." and by["file:src/main.ts"].doc == "Starts it." and by["file:py/app/models.py"].doc == "Data."
    assert by["pkg:fs"].registry == "stdlib" and by["pkg:sqlalchemy"].registry == "pypi" and by["pkg:react"].registry == "npm"
    assert by["doc:README.md"].title == "Demo" and by["doc:src/auth/README.md"].title == "README.md"


def test_edges(graph):
    got = {(r.src[5:], r.dst[5:]): r.symbols for r in graph.edges.where("kind = 'imports'").collect()}
    assert got == {
        ("src/main.ts", "src/auth/index.ts"): ["login"],
        ("src/main.ts", "src/util/format.ts"): ["default", "pad"],
        ("src/main.ts", "src/auth/login.ts"): [],
        ("src/auth/index.ts", "src/auth/login.ts"): ["*", "login"],
        ("src/auth/login.ts", "src/util/format.ts"): ["pad"],
        ("packages/core/src/index.ts", "src/auth/login.ts"): ["login"],
        ("packages/ui/src/view.ts", "packages/core/src/index.ts"): ["core"],
        ("py/app/models.py", "py/app/base.py"): ["Base"],
    }
    deps = {(r.src, r.dst): r.weight for r in graph.edges.where("kind = 'depends_on'").collect()}
    assert deps[("mod:demo", "mod:auth")] == 2 and deps[("mod:@w/ui", "mod:@w/core")] == 1
    assert {(r.src, r.dst, r.confidence) for r in graph.edges.where("kind = 'documents'").collect()} == {("doc:README.md", "mod:demo", "certain"), ("doc:src/auth/README.md", "mod:auth", "certain")}


def test_tables(graph):
    tables = {r.id: {c.name: c for c in r["columns"]} for r in graph.nodes.where("kind = 'table'").collect()}
    assert set(tables) == {"tbl:public.users", "tbl:public.posts", "tbl:public.Account", "tbl:public.item_rows"}
    assert tables["tbl:public.posts"]["user_id"].fk_table == "public.users" and tables["tbl:public.posts"]["title"].nullable
    assert "full_name" in tables["tbl:public.users"] and not tables["tbl:public.users"]["full_name"].nullable
    assert "mail" in tables["tbl:public.Account"] and tables["tbl:public.item_rows"]["b"].is_pk
    fks = {(r.src, r.dst) for r in graph.edges.where("kind = 'fk'").collect()}
    assert fks == {("tbl:public.posts", "tbl:public.users"), ("tbl:public.item_rows", "tbl:public.Account")}
    maps = {r.dst: r.confidence for r in graph.edges.where("kind = 'maps_to'").collect()}
    assert maps["tbl:public.users"] == "certain" and maps["tbl:public.Account"] == "inferred"


def test_all_tools_keep_their_budget(graph):
    for b in (200, 450, 3000):
        answers = [
            call("get_architecture_overview", graph, budget=b), call("get_module", graph, "auth", budget=b), call("get_module", graph, "nothing", budget=b), call("find_dependencies", graph, "src/main.ts", budget=b),
            call("get_impact", graph, "src/util/format.ts", budget=b), call("search_nodes", graph, "log", budget=b), call("get_file_context", graph, "src/auth/login.ts", budget=b), call("get_doc", graph, "README.md", budget=b),
            call("get_db_schema", graph, budget=b), call("get_entity_relations", graph, "Post", budget=b), call("get_schema_drift", graph, budget=b),
        ]
        assert all(a and estimate_tokens(a) <= b for a in answers)
    assert "auth" in call("get_impact", graph, "src/util/format.ts") and len(TOOLS) == 13
    with pytest.raises(ValueError):
        call("no_tool", graph)


def test_cache_store_and_snapshots(spark, repo, tmp_path):
    root, run = repo
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.load_graph()
    first = A.analyze(spark, str(root), store)
    keys = spark.read.parquet(f"{store.at}/facts").count()
    A.analyze(spark, str(root), store)
    assert spark.read.parquet(f"{store.at}/facts").count() == keys == first.nodes.where("kind = 'file'").count()
    assert store.list_snapshots() == [git.info(str(root))["sha"]]
    again = import_json(export_json(store.load_graph().edges), __import__("mapstone.schema", fromlist=["EDGE"]).EDGE)
    assert again.count() == first.edges.count()
    (root / "src/util/fmt.ts").write_text((root / "src/util/format.ts").read_text())
    (root / "src/util/format.ts").unlink()
    (root / "src/auth/login.ts").write_text((root / "src/auth/login.ts").read_text().replace("../util/format", "../util/fmt"))
    (root / "src/pay").mkdir()
    (root / "src/pay/charge.ts").write_text('import { pad } from "../util/fmt";\n')
    assert git.info(str(root))["dirty"] and not store.save_snapshot(first, git.info(str(root)))
    run("add", "-A")
    run("commit", "-qm", "second")
    changes = A.compare(spark, str(root), "v1", "HEAD", store)
    assert {(r.change, r.id) for r in changes["files"].collect()} == {("moved", "file:src/util/fmt.ts"), ("added", "file:src/pay/charge.ts")}
    assert [(r.change, r.module) for r in changes["modules"].collect()] == [("added", "mod:pay")]
    assert ("added", "mod:pay", "mod:util") in {(r.change, r.src, r.dst) for r in changes["dependencies"].collect()}
    assert len(store.list_snapshots()) == 2
    same = A.compare(spark, str(root), "HEAD", "HEAD", store)
    assert all(df.isEmpty() for df in same.values())
    log = git.log(spark, str(root)).collect()
    assert [r.subject for r in log] == ["second", "first"] and log[1].tags == ["v1"]
    with pytest.raises(ValueError, match="Not a commit"):
        git.resolve_ref(str(root), "nope")


def test_watch_calls_rebuild(spark, repo, tmp_path):
    seen = []
    watch.watch(spark, str(repo[0]), seen.append, str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert len(seen) == 1 and any(p.endswith("src/main.ts") for p in seen[0]) and not any(p.endswith(".prisma") for p in seen[0])


def test_globs_and_ignores(spark):
    import re

    assert re.match(glob_regex("src/**/*.ts"), "src/a/b.ts") and re.match(glob_regex("src/**/*.ts"), "src/b.ts") and not re.match(glob_regex("src/*.ts"), "src/a/b.ts")
    assert re.match(glob_regex("**/{a,b}/*"), "x/a/f")
    paths = ["a.log", "b/a.log", "build2/x", "keep/a.log", "docs/x/y", "docs/z", "top"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    from pyspark.sql import functions as F

    out = {r.p for r in df.where(scan.ignored(F.col("p"), ["*.log", "!keep/a.log", "# c", "", "/top", "docs/x/"])).collect()}
    assert out == {"a.log", "b/a.log", "docs/x/y", "top"}


def test_config(tmp_path):
    assert config.load_config(str(tmp_path)).modules == []
    (tmp_path / config.CONFIG_NAME).write_text("version: 1\nmodules:\n - name: web\n   include: 'web/**'\n   layer: ui\nedges:\n - {kind: depends_on, from: 'mod:a', to: 'mod:b'}\n")
    c = config.load_config(str(tmp_path))
    assert c.modules == [("web", "ui", ["web/**"])] and c.edges[0]["src"] == "mod:a"
    for bad in ({"x": 1}, {"modules": [{}]}, {"edges": [{"kind": "x"}]}, []):
        with pytest.raises(ValueError):
            config.parse_config(bad or [1])
    assert config.pick_source([{"name": "a"}])["name"] == "a"
    with pytest.raises(ValueError):
        config.pick_source([{"name": "a"}, {"name": "b"}])


def test_detect_and_init(spark, tmp_path):
    df = spark.createDataFrame([("src/api/x.ts",), ("models/a.py",), ("s.prisma",)], "path string")
    stack = config.detect_stack(df)
    assert stack == {"typescript": True, "python": True, "prisma": ["s.prisma"], "layers": {"api": "api", "models": "data"}}
    assert config.write_config(str(tmp_path), stack) and not config.write_config(str(tmp_path), stack)
    assert (tmp_path / ".gitignore").read_text().count(".mapstone/") == 1


def test_migration_heads(spark):
    rows = [("v/1.py", "revision = 'a'\ndown_revision = None\n"), ("v/2.py", 'revision: str = "b"\ndown_revision: str = "a"\n'), ("v/3.py", "revision = 'c'\ndown_revision = ('a', 'b')\n"), ("v/x.py", "")]
    assert [r.revision for r in config.migration_heads(spark.createDataFrame(rows, "path string, content string")).collect()] == ["c"]


def test_other_mappers():
    ts = extract("u.ts", 'import { Entity } from "typeorm";\n@Entity()\nexport class OrderItem {\n  @PrimaryGeneratedColumn() id!: number;\n  @Column({ nullable: true, name: "note_text" }) note?: string;\n  @ManyToOne(() => User, (u) => u.items)\n  user!: User;\n  @CreateDateColumn() at!: Date;\n}\n')
    e = ts["entities"][0]
    assert (e["table_name"], e["explicit"]) == ("order_item", False)
    assert [(f["column"], f["type"], f["is_pk"], f["is_fk"]) for f in e["fields"]] == [("id", "int", True, False), ("note_text", "varchar", False, False), ("userId", "unknown", False, True), ("at", "timestamp", False, False)]
    dz = extract("d.ts", 'import { pgTable, text, pgSchema } from "drizzle-orm/pg-core";\nconst s = pgSchema("audit");\nexport const users = pgTable("users", { id: text("id").primaryKey(), name: text().notNull() });\nexport const logs = s.table("logs", { by: text("by_user").references(() => users.id) });\n')
    assert [(x["name"], x["table_schema"], x["table_name"]) for x in dz["entities"]] == [("users", None, "users"), ("logs", "audit", "logs")]
    assert dz["entities"][1]["relations"] == [{"from_field": "by", "from_col": "by_user", "target": "users", "target_col": "id"}]
    dj = extract("shop/models.py", "from django.db import models\nclass Base(models.Model):\n    class Meta:\n        abstract = True\nclass Item(models.Model):\n    owner = models.ForeignKey('auth.User', on_delete=models.CASCADE, null=True)\n    tags = models.ManyToManyField('Tag')\n    title = models.CharField(max_length=3)\n")
    assert [x["table_name"] for x in dj["entities"]] == ["shop_item"]
    assert [(f["column"], f["is_pk"]) for f in dj["entities"][0]["fields"]] == [("id", True), ("owner_id", False), ("title", False)]
    assert extract("x.md", "") is None and extract("x.py", "def f(:")["lang"] == "py"


def test_database_queries_and_redaction():
    assert "IN ('a', 'b''c')" in postgres_queries(["a", "b'c"])["tables"] and "tinyint(1)" in mysql_queries(None, "shop")["columns"]
    assert "pw1" not in redact("cannot reach postgres://u:pw1@h/db with pw1", "postgres://u:pw1@h/db")


def test_commands(spark, tmp_path):
    from mapstone import commands
    from mapstone.operators.drift import Live

    root = tmp_path / "shop"
    (root / "migrations" / "versions").mkdir(parents=True)
    (root / "migrations" / "versions" / "1.py").write_text("revision = 'r1'\ndown_revision = None\n")
    (root / "models.py").write_text('from sqlalchemy import Column, Integer, String\nclass U(Base):\n    __tablename__ = "users"\n    id = Column(Integer, primary_key=True)\n    mail = Column(String)\n')
    assert commands.init(spark, str(root))["python"]
    store = Store(spark, str(tmp_path / "out"))
    commands.analyze(spark, str(root), store)
    live = Live(
        spark.createDataFrame([("public", "users"), ("public", "stray"), ("other", "x")], "schema string, table string"),
        spark.createDataFrame([("public", "users", "id", 0, "int4", False, True), ("public", "users", "mail", 1, "int4", True, False), ("public", "stray", "id", 0, "int4", False, True)], "schema string, table string, column string, pos int, sql_type string, nullable boolean, is_pk boolean"),
        spark.createDataFrame([], "schema string, table string, from_col string, to_schema string, to_table string, to_col string"),
    )
    got = commands.db_drift(spark, str(root), store, live=live)
    assert {(f["table"], f["kind"]) for f in got["findings"]} == {("users", "type_mismatch"), ("stray", "table_missing_in_code")} and got["exit"] == 1 and got["heads"] == ["r1"]
    assert commands.db_introspect(spark, str(root), store, live=live) == {"both": 1, "live": 1, "declared": 0}
    assert commands.db_introspect(spark, str(root), store, live=live) == {"both": 1, "live": 1, "declared": 0}
    assert "drift" in call("get_schema_drift", store.load_graph()).lower()
    with pytest.raises(ValueError):
        commands.db_drift(spark, str(root), store)


def test_links_keep_named_tables_and_map_fields(spark):
    from mapstone.operators.build import link_declared_schema

    f = lambda n, c: (n, "Int", c, False, False, False)
    rows = [
        ("ent:a#User", "a", "User", "prisma", None, "users", True, [f("id", "user_id")], []),
        ("ent:b#Post", "b", "Post", "prisma", None, "posts", True, [f("by", "by_id")], [("by", "by_id", "User", "id"), ("by", "by_id", "Gone", "id")]),
        ("ent:c#Log", "c", "Log", "sqlalchemy", None, "logs", True, [f("at", "at")], [("at", "at", "audit.places", "key")]),
    ]
    field = "array<struct<name:string,type:string,column:string,nullable:boolean,is_pk:boolean,is_fk:boolean>>"
    ents = spark.createDataFrame(rows, f"id string, path string, name string, orm string, table_schema string, table_name string, explicit boolean, fields {field}, relations array<struct<from_field:string,from_col:string,target:string,target_col:string>>")
    tables, links = link_declared_schema(ents)
    fks = {(r.src, r.dst): [tuple(c) for c in r.fk_columns] for r in links.where("kind = 'fk'").collect()}
    assert fks == {("tbl:public.posts", "tbl:public.users"): [("by_id", "user_id")], ("tbl:public.logs", "tbl:audit.places"): [("at", "key")]}
    assert tables.count() == 3
