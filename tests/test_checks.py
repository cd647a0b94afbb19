"""Violations, migrations, colours, many answers at once, and the compacted store."""

import random

import pytest
from mapstone.functions.budget import BudgetWriter, fitted_lists
from mapstone.operators.flows import LAYER_COLORS, layer_color
from mapstone.schema import Graph, edges_of, nodes_of, violations
from mapstone.sources import config
from mapstone.sources.store import Store
from pyspark.sql import functions as F


def graph(spark, nodes, edges):
    n = nodes_of(spark.createDataFrame(nodes, "id string, kind string, parent string, loc int"))
    return Graph(n, edges_of(spark.createDataFrame(edges, "kind string, src string, dst string, source string, confidence string")))


def test_every_violation_is_told(spark):
    nodes = [("mod:m", "module", None, 1), ("file:a", "file", "mod:m", 1), ("file:a", "file", "mod:m", 1), ("file:b", "file", "mod:gone", -1), ("sym:a#x", "symbol", "mod:m", 1), ("pkg:p", "extpkg", None, None), ("odd", "thing", None, None)]
    edges = [("imports", "file:a", "pkg:p", "static", "certain"), ("imports_pkg", "file:a", "pkg:p", "static", "certain"), ("imports_pkg", "file:a", "pkg:p", "guess", "maybe"), ("depends_on", "mod:m", "mod:none", "static", "certain"), ("goes", "file:a", "file:b", "static", "certain")]
    got = sorted((r["what"], r["id"], r["detail"]) for r in violations(graph(spark, nodes, edges)).collect())
    assert got == sorted([
        ("repeated node", "file:a", "2"), ("negative metric", "file:b", None), ("missing parent", "file:b", "mod:gone"), ("kind of parent", "sym:a#x", "module"), ("node kind", "odd", "thing"), ("kind of dst", "imports|file:a|pkg:p", "extpkg"),
        ("repeated edge", "imports_pkg|file:a|pkg:p", "2"), ("edge source", "imports_pkg|file:a|pkg:p", "guess"), ("edge confidence", "imports_pkg|file:a|pkg:p", "maybe"), ("missing dst", "depends_on|mod:m|mod:none", "mod:none"), ("edge kind", "goes|file:a|file:b", "goes"),
    ])
    assert violations(graph(spark, nodes[:2], edges[:0])).count() == 0 and violations(graph(spark, [], [])).count() == 0


def test_migrations_with_several_heads(spark, tmp_path):
    rows = [
        ("v/1.py", "revision = 'a'\ndown_revision = None\n"), ("v/2.py", 'revision: str = "b"\ndown_revision: Union[str, None] = "a"\n'), ("v/3.py", "revision = 'c'\ndown_revision = 'a'\n"), ("v/4.py", "revision='d'\ndown_revision=('b', 'c')\n"),
        ("v/5.py", "revision = 'e'\ndown_revision = 'lost'\n"), ("v/6.py", "no = 1\n"), ("v/7.py", "revision = 'f'\n"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r["revision"]: r for r in config.migration_graph(config.migrations(files)).collect()}
    assert {k for k, r in got.items() if r["head"]} == {"d", "e", "f"} and {k for k, r in got.items() if r["base"]} == {"a", "f"}
    assert got["a"]["branch"] and got["d"]["merge"] and got["e"]["missing"] == ["lost"] and not got["b"]["missing"]
    assert config.migration_graph(config.migrations(files.limit(0))).count() == 0
    (tmp_path / "db/mig/versions").mkdir(parents=True)
    (tmp_path / "db/mig/versions/x.py").write_text("")
    (tmp_path / "db/mig/env.py").write_text("")
    assert config.versions_dir(str(tmp_path), ["db/mig/env.py", "db/mig/versions/x.py"]) == "db/mig/versions" and config.versions_dir(str(tmp_path), ["a/env.py"]) is None
    (tmp_path / "alembic.ini").write_text("[alembic]\nscript_location = %(here)s/db/mig\n")
    assert config.versions_dir(str(tmp_path), []) == "db/mig/versions"


def test_layer_colours(spark):
    def plain(layer):
        h = 0
        for c in layer:
            unit = ord(c) if ord(c) < 0x10000 else 0xD800 + ((ord(c) - 0x10000) >> 10)
            h = ((h * 31 + unit + 2**31) % 2**32) - 2**31
        return LAYER_COLORS[abs(h) % len(LAYER_COLORS)]

    names = ["api", "domain", "", "infrastructure of a very long name", "Übersicht", "😀 layer", "データ"]
    got = dict(tuple(r) for r in spark.createDataFrame([(x,) for x in [*names, None]], "layer string").select("layer", layer_color(F.col("layer"))).collect())
    assert got == {x: plain(x) for x in names} | {None: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_answers_equal_the_writers(spark, seed):
    r = random.Random(seed)
    lists = {f"k{k}": ["x" * r.randint(0, 30) + r.choice(["", "é", "😀"]) for _ in range(r.randint(1, 120))] for k in range(25)}
    room = {k: r.choice([0, 5, 20, 60, 200, 900, 4000]) for k in lists}
    rows = [(k, i, x) for k, v in lists.items() for i, x in enumerate(v)]
    hint = lambda n: F.concat(F.lit("+"), n.cast("string"), F.lit(" more"))
    got = fitted_lists(spark.createDataFrame(rows, "key string, pos int, line string"), spark.createDataFrame(list(room.items()), "key string, left int"), hint)
    for x in got.collect():
        w = BudgetWriter()
        w.left = room[x["key"]]
        shown = w.list(lists[x["key"]], lambda n: f"+{n} more")
        assert (x["shown"], x["total"], x["listed"]) == (shown, len(lists[x["key"]]), w.blocks), x["key"]


def test_compacted_facts_keep_each_key_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.compact_facts() == 0
    for lo in (0, 5):
        spark.range(lo, lo + 10).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("path")).write.mode("append").parquet(f"{store.at}/facts")
    assert store.compact_facts(per_file=4) == 15
    assert store.compact_facts(spark.createDataFrame([("3",), ("3",), ("99",)], "key string")) == 1
    assert [r["key"] for r in spark.read.parquet(f"{store.at}/facts").collect()] == ["3"]
