import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mapstone.functions import budget, ids, text, types
from pyspark.sql import functions as F


def test_ids_round_trip():
    for kind, parts in (("module", ["auth"]), ("file", ["src/a.ts"]), ("symbol", ["src/a.ts", "f"]), ("entity", ["m.py", "User"]), ("table", ["public", "users"]), ("extpkg", ["@x/y"]), ("doc", ["README.md"])):
        got = ids.parse_node_id(ids.node_id(kind, *parts))
        assert got["kind"] == kind
    assert ids.parse_node_id("sym:a#b#c") == {"kind": "symbol", "rest": "a#b#c", "path": "a", "name": "b#c"}
    assert ids.edge_id("imports", "a", "b") == "imports|a|b" and ids.normalize_path(".\\a\\b") == "a/b"
    for bad in ("x:y", "mod:", "plain", "sym:nohash", "sym:#x"):
        with pytest.raises(ValueError):
            ids.parse_node_id(bad)
    assert ids.is_node_id("tbl:a.b") and not ids.is_node_id("tbl:")


def test_id_columns_agree(spark):
    df = spark.createDataFrame([("./a\\b.ts", "f", "sym:x#y")], "p string, n string, i string")
    r = df.select(ids.normalize_path_col("p"), ids.node_id_col("symbol", "p", "n"), ids.is_node_id_col("i"), ids.rest_col("i")).first()
    assert list(r) == ["a/b.ts", "sym:./a\\b.ts#f", True, "x#y"]


def test_type_families(spark):
    raws = [*types.FAMILY, "VARCHAR(10)", "tinyint(1)", "tinyint(4)", "datetime.datetime", "x.String(2)", "weird", " TEXT "]
    got = {r.raw: r.f for r in spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", types.sql_family_col("raw").alias("f")).collect()}
    assert got == {r: types.sql_family(r) for r in raws}
    assert got["tinyint(1)"] == "boolean" and got["tinyint(4)"] == "integer" and got["weird"] == "weird" and len(types.FAMILY) == 82


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30_000), st.lists(st.text(min_size=0, max_size=200), max_size=60))
def test_writer_never_exceeds_its_budget(asked, items):
    items = [i.replace("\n", " ") for i in items]
    w = budget.BudgetWriter(asked)
    w.line("title")
    w.blank()
    n = w.list(items, lambda k: f"+{k} more")
    assert budget.estimate_tokens(str(w)) <= w.budget
    assert n == len(items) or f"+{len(items) - n} more" in str(w) or w.truncated


def test_hints_count_what_was_not_fetched(spark):
    w = budget.BudgetWriter(200)
    n = w.list([f"- item {k}" for k in range(200)], lambda k: f"+{k} more", 5_000)
    assert f"+{5_000 - n} more" in str(w) and 0 < n < 200 and budget.estimate_tokens(str(w)) <= 200
    w = budget.BudgetWriter(200)
    assert w.list(["a", "b"], lambda k: f"+{k} more", 3) == 2 and str(w) == "a\nb\n+1 more" and w.truncated
    w = budget.BudgetWriter(200)
    assert w.list(["a", "b"], lambda k: f"+{k} more") == 2 and str(w) == "a\nb" and not w.truncated


def test_fitting_lines_as_a_column(spark):
    rows = [([5, 5, 5], 15), ([5, 5, 5], 14), ([5, 5, 5], 3), ([], 0), ([9, 1, 1], 8)]
    for costs, room in rows:
        got = spark.createDataFrame([(costs,)], "c array<int>").select(budget.fitting_col(F.col("c"), room, 4).alias("n")).first().n
        want = len(costs) if sum(costs) <= room else max([k for k in range(len(costs)) if sum(costs[:k]) + 4 <= room], default=0)
        assert got == want


def test_budget_columns(spark):
    rows = [(t, b) for t, b in (("", None), ("abc", 10.0), ("x" * 999, 5000.7), ("é😀", 99999.0))]
    df = spark.createDataFrame(rows, "t string, b double")
    got = df.select("t", budget.estimate_tokens_col("t").alias("e"), budget.clamp_budget_col("b").alias("c")).collect()
    assert {(r.t, r.e, r.c) for r in got} == {(t, budget.estimate_tokens(t), budget.clamp_budget(b)) for t, b in rows}
    assert budget.suggest_budget(2000) == 4000 and budget.suggest_budget(15_000) == 20_000 and budget.clamp_budget(math.nan) == 2000


MD = "intro\n```\n# no\n```\n## Two ##\ntext\n# One\n~~~\n# no\n~~~\n###### Six\n####### seven\n"


def test_markdown_facts_agree_with_columns(spark):
    cases = {"docs/a.md": MD, "b.md": "no heading", "c.md": "x\r\n# T\r\n", "d.md": ("line é\n" * 40_000), "e.md": "é" * 100_000, "f.md": ""}
    df = spark.createDataFrame(list(cases.items()), "path string, source string")
    cut = df.select("path", text.cut_document(F.col("source")).alias("content"), text.truncated_document(F.col("source")).alias("truncated"))
    content = {r.path: (r.content, r.truncated) for r in cut.collect()}
    title = {r.path: (r.title, r.n_headings) for r in text.titles(cut).collect()}
    for path, source in cases.items():
        want = text.markdown_facts(path, source)
        assert content[path] == (want["content"], want["truncated"]), path
        assert title[path] == (want["title"], len(want["headings"])), path
    assert [(h["depth"], h["text"]) for h in text.markdown_facts("a.md", MD)["headings"]] == [(2, "Two"), (1, "One"), (6, "Six")]


def test_doc_comments():
    assert text.js_doc("/**\n * Adds two.\n * Numbers.\n *\n * More.\n * @param a x\n */") == "Adds two. Numbers."
    assert text.js_doc("/** @fileoverview Login code. */") == "Login code."
    assert text.js_doc("/** @internal */") is None
    assert text.py_doc("First line\n    goes on.\n\n    Later.") == "First line goes on."
    assert len(text.py_doc("x" * 3000)) == 1000


def test_line_counts(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",)], "t string")
    assert [r[0] for r in df.select(text.count_lines("t")).collect()] == [text.count_lines_py(t) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 2, 2]
