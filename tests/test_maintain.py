"""Graphs kept up to date by differences against graphs built anew."""

import random

import pytest
from mapstone.operators import build
from mapstone.operators.maintain import Maintained, Resolution
from mapstone.plans.analyze import analyze
from mapstone.plans.live import LiveGraph
from pyspark.sql import functions as F

HOW = Resolution({"": {"paths": [("~/*", ["a/*"])], "base": None}}, [("@w/b", "b")], [""], {})


def rows_of(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def random_file(r, path):
    names = [f"f{k}" for k in range(8)]
    if path.endswith(".py"):
        return [(path, r.choice([f"a.{n}", f".{n}", ".", "os", "numpy", "..b." + n]), r.sample(names, 2)) for n in r.sample(names, 2)]
    return [(path, r.choice([f"./{n}", f"../b/{n}.js", f"~/{n}", f"@w/b/{n}", "react", "fs", f"../a/{n}"]), [n]) for n in r.sample(names, 3)]


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_building_anew(spark, seed):
    r = random.Random(seed)
    every = [f"{d}/{n}{x}" for d in "ab" for n in (f"f{k}" for k in range(8)) for x in (".ts", ".py")] + ["a/__init__.py", "b/f3/index.ts", "b/f4/__init__.py"]
    frame = lambda x, ddl: spark.createDataFrame(x, ddl)
    files = lambda paths: frame([(p, p[0]) for p in paths], "path string, module string")
    imports = lambda x: frame([i for p in x for i in x[p]], "path string, specifier string, symbols array<string>")
    tree = {p: random_file(r, p) for p in r.sample(every, 20)}
    kept = Maintained.start(HOW, files(tree), imports(tree))
    for _ in range(2):
        gone = r.sample(sorted(tree), 4)
        new = r.sample([p for p in every if p not in tree], 4) + r.sample([p for p in tree if p not in gone], 3)
        change = {p: random_file(r, p) for p in new}
        tree = {p: x for p, x in tree.items() if p not in gone} | change
        kept = kept.update(files(change), imports(change), frame([(p,) for p in gone], "path string"))
        anew = Maintained.start(HOW, files(tree), imports(tree))
        for part, columns in (("edges", ["kind", "src", "dst", "symbols", "registry"]), ("weights", ["src", "dst", "weight"]), ("fans", ["id", "fan_in", "fan_out"]), ("files", ["path", "module"])):
            assert rows_of(getattr(kept, part), *columns) == rows_of(getattr(anew, part), *columns), part
    nodes = files(tree).select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.concat(F.lit("mod:"), "module").alias("parent"))
    assert rows_of(kept.weights, "src", "dst", "weight") == rows_of(build.depends_on(nodes, kept.merged()), "src", "dst", "weight")


def test_a_live_graph_equals_an_analyzed_one(spark, tmp_path):
    root = tmp_path / "tree"

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    put("src/a/x.ts", 'import { y } from "../b/y";\nimport "left-pad";\nexport const x = y;\n')
    put("src/b/y.ts", "export const y = 1;\n")
    put("models.py", "from sqlalchemy import Column, Integer\nclass User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer, primary_key=True)\n")
    put("README.md", "# Top\n")
    live = LiveGraph(spark, str(root))
    (root / "src/b/y.ts").unlink()
    put("src/b/y/index.ts", 'import { z } from "../../c/z";\nexport const y = z;\n')
    put("src/c/z.ts", "export const z = 2;\n")
    put("README.md", "# Changed\n")
    got = live.apply([str(root / "src/b/y.ts"), "src/b/y/index.ts", "src/c/z.ts", "README.md"])
    want = analyze(spark, str(root))
    assert rows_of(got.edges, "id", "weight", "symbols", "source") == rows_of(want.edges, "id", "weight", "symbols", "source")
    columns = ["id", "kind", "parent", "fan_in", "fan_out", "rank", "loc", "title", "registry", "columns"]
    assert rows_of(got.nodes, *columns) == rows_of(want.nodes, *columns)
