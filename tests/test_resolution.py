"""Resolution of specifiers by joins: what each import of small trees leads to."""

import json

import pytest
from mapstone.operators.resolve import resolve_imports
from mapstone.sources import config


def edges(spark, imports, files, aliases=(), workspaces=(), roots=("",), entries=None):
    rows = [(p, s, list(x)) for p, s, *x in imports]
    got = resolve_imports(spark.createDataFrame(rows, "path string, specifier string, symbols array<string>"), spark.createDataFrame([(f,) for f in files], "path string"), aliases if isinstance(aliases, dict) else list(aliases), list(workspaces), list(roots), entries)
    return {(r["src"][5:], r["dst"], tuple(r["symbols"]), r["registry"]) for r in got.collect()}


def test_scripts(spark):
    files = ["a/b.ts", "a/c.ts", "a/c.js", "a/d/index.tsx", "a/m.mts", "index.ts", "a/e.tsx", "a/e/index.ts", "top.cts", "a/x.jsx"]
    asked = {
        "./c.js?raw": "file:a/c.ts", "./c": "file:a/c.ts", "./d": "file:a/d/index.tsx", "./m.mjs": "file:a/m.mts", "..": "file:index.ts", "../": "file:index.ts", "./e": "file:a/e.tsx", "../top.cjs": "file:top.cts",
        "./x.jsx": "file:a/x.jsx", "../../up": None, "./missing": None, "": None, "?q": None, "/abs": None, "./b": None,
        "node:fs/promises": "pkg:fs/promises", "fs/promises": "pkg:fs/promises", "fs": "pkg:fs", "node:whatever": "pkg:whatever", "buffer/": "pkg:buffer", "process/browser": "pkg:process", "punycode/": "pkg:punycode",
        "react": "pkg:react", "@s/n/deep": "pkg:@s/n", "lodash/fp": "pkg:lodash",
    }
    got = edges(spark, [("a/b.ts", s, s) for s in asked], files)
    assert {(x[2][0], x[1]) for x in got} == {(s, d) for s, d in asked.items() if d}
    kind = {x[2][0]: x[3] for x in got}
    assert kind["fs"] == kind["fs/promises"] == kind["node:whatever"] == "stdlib" and kind["buffer/"] == kind["react"] == "npm" and kind["./c"] is None


def test_python(spark):
    files = ["p/q/r.py", "p/q/__init__.py", "p/__init__.py", "p/x.py", "p/y/__init__.py", "src/lib/a.py", "src/lib/__init__.py", "lib/b.py", "json.py", "plain/z.py", "n/inner.py", "top.py"]
    asked = [
        ("p/q/r.py", "..x", "f"), ("p/q/r.py", "..", "x", "y", "attr"), ("p/q/r.py", "..", "x"), ("p/q/r.py", ".", "*"), ("p/q/r.py", "....z", "a"), ("p/q/r.py", "p.y"), ("p/q/r.py", "lib.a"), ("p/q/r.py", "lib.b", "k"),
        ("p/q/r.py", "json"), ("p/q/r.py", "os.path", "join"), ("p/q/r.py", "numpy.linalg"), ("p/q/r.py", "plain.z"), ("p/q/r.py", "plain.none"), ("top.py", ".json"), ("n/inner.py", ".", "inner", "gone"), ("top.py", "distutils"), ("top.py", ""),
    ]
    got = edges(spark, asked, files, roots=("src", ""))
    want = {
        ("p/q/r.py", "file:p/x.py", ("f",), None), ("p/q/r.py", "file:p/x.py", (), None), ("p/q/r.py", "file:p/y/__init__.py", (), None), ("p/q/r.py", "file:p/__init__.py", ("attr",), None), ("p/q/r.py", "file:p/q/__init__.py", ("*",), None),
        ("p/q/r.py", "file:src/lib/a.py", (), None), ("p/q/r.py", "file:json.py", (), None), ("p/q/r.py", "pkg:os", ("join",), "stdlib"), ("p/q/r.py", "pkg:numpy", (), "pypi"), ("p/q/r.py", "file:plain/z.py", (), None),
        ("p/q/r.py", "pkg:plain", (), "pypi"), ("top.py", "file:json.py", (), None),
    }
    assert {x for x in got if x[1] != "pkg:distutils"} == want  # lib.b: the first root has lib, so it is looked for nowhere else


@pytest.fixture
def tree(tmp_path):
    def make(**files):
        for name, data in files.items():
            at = tmp_path / name.replace("__", "/")
            at = at.with_name(at.name + ".json")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(json.dumps(data))
        return str(tmp_path)

    return make


def test_aliases_and_base_folders(spark, tree):
    root = tree(
        tsconfig={"compilerOptions": {"baseUrl": "src"}}, web__tsconfig={"extends": ["./first", "./second.json"], "compilerOptions": {"paths": {"~/*": ["./lib/*"], "~/deep/*": ["./deep/*", "./other/*"], "one": ["./lib/one.ts"]}}},
        web__first={"compilerOptions": {"baseUrl": "./nowhere", "paths": {"lost/*": ["x/*"]}}}, web__second={"compilerOptions": {"baseUrl": "./base"}}, gone__tsconfig={"extends": "@none/config", "compilerOptions": {"baseUrl": "."}}, bare__tsconfig={"compilerOptions": {}},
    )
    aliases = config.path_aliases(root, ["web/tsconfig.json", "gone/tsconfig.json", "bare/tsconfig.json"])
    files = ["src/components/Button.tsx", "web/base/lib/a.ts", "web/base/deep/a.ts", "web/base/other/b.ts", "web/base/lib/deep/c.ts", "web/base/plain.ts", "web/base/lib/one.ts", "gone/x.ts", "bare/x.ts"]
    asked = {
        ("app/a.ts", "components/Button"): "file:src/components/Button.tsx", ("web/z/a.ts", "~/a"): "file:web/base/lib/a.ts", ("web/z/a.ts", "~/deep/a"): "file:web/base/deep/a.ts", ("web/z/a.ts", "~/deep/b"): "file:web/base/other/b.ts",
        ("web/z/a.ts", "~/deep/c"): "pkg:~", ("web/z/a.ts", "plain"): "file:web/base/plain.ts", ("web/z/a.ts", "one"): "file:web/base/lib/one.ts", ("web/z/a.ts", "lost/x"): "pkg:lost", ("gone/y.ts", "x"): "pkg:x", ("bare/y.ts", "x"): "pkg:x", ("bare/y.ts", "components/Button"): "pkg:components",
        ("web/z/a.ts", "fs"): "pkg:fs",
    }
    got = edges(spark, [(p, s, s) for p, s in asked], files, aliases)
    assert {((x[0], x[2][0]), x[1]) for x in got} == set(asked.items())


def test_workspace_packages(spark, tree):
    root = tree(
        package={"workspaces": ["packages/*"]}, packages__ui__package={"name": "@s/ui", "exports": {".": {"import": "./dist/main.js", "types": "./dist/types.d.ts"}}, "main": "lib/old.cjs"}, packages__core__package={"name": "core"}, packages__none__package={"name": "none", "main": "dist/gone.js"}
    )
    members = config.workspaces(root)
    entries = config.workspace_entries(root, members)
    assert entries["packages/ui"] == ["./dist/types.d.ts", "./dist/main.js", "lib/old.cjs"]
    files = ["packages/ui/src/main.ts", "packages/ui/dist/main.js", "packages/ui/src/old.ts", "packages/core/index.ts", "packages/core/src/util/x.ts", "packages/core/util/x.ts", "app/a.ts"]
    asked = {"@s/ui": "file:packages/ui/src/main.ts", "core": "file:packages/core/index.ts", "core/util/x": "file:packages/core/src/util/x.ts", "core/none": None, "none": None, "corex": "pkg:corex", "@s/other": "pkg:@s/other"}
    got = edges(spark, [("app/a.ts", s, s) for s in asked], files, {}, members, entries=entries)
    assert {(x[2][0], x[1]) for x in got} == {(s, d) for s, d in asked.items() if d}


def test_nothing_and_nulls(spark):
    assert edges(spark, [], []) == set()
    assert edges(spark, [(None, "./a"), ("a.ts", None), ("a.ts", "./b")], ["b.ts", "b.ts"]) == {("a.ts", "file:b.ts", (), None)}
