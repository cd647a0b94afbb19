"""What beyond a size is joined, sent and stored, and that the results stay the same."""

import pytest
from mapstone.operators import algo, build
from mapstone.plans import adapters, queries  # noqa: F401  registers all queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def seen(monkeypatch):
    """Columns and plan of what is checkpointed."""
    got, own = [], algo.checkpointed
    monkeypatch.setattr(algo, "checkpointed", lambda df: got.append((df.columns, plan(df))) or own(df))
    return got


@pytest.mark.parametrize("links", [[(f"c{i}", f"s{i % 3}") for i in range(9)], [(f"c{i}", f"s{i % 3}") for i in range(9)] + [("s0", "s1"), ("s1", "s0"), ("s1", "gone")]])
def test_rank_joins_only_what_is_imported(spark, seen, links, monkeypatch):
    monkeypatch.setattr(algo, "ITERATIONS", 4)
    ids = sorted({x for e in links for x in e} - {"gone"} | {"alone"})
    files, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "src string, dst string")
    got = {r.id: r["rank"] for r in algo._rank_loop(files, edges).collect()}
    want = algo._rank_kernel(files.toPandas(), edges.toPandas())
    assert got == pytest.approx(dict(zip(want["id"], want["rank"], strict=True)), abs=2e-6)
    assert not any({"src", "dst"} & set(c) for c, _ in seen)  # edges are held as numbers, no names of them are written again


def test_reached_levels_are_sent_to_the_hops(spark, seen):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hops = spark.createDataFrame([(f"f{i // 2}", f"f{i}") for i in range(1, 20)], "at string, next string")
        got = {r.id: r.depth for r in algo._impact_loop(hops, "f0", 100).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"f{i}": i.bit_length() for i in range(1, 20)}
    assert not any("SortMergeJoin" in p for _, p in seen)


def test_imports_are_merged_by_their_keys(spark):
    df = adapters.supply_imports(spark, SF)
    assert "hashpartitioning(o_custkey" in plan(df) and "hashpartitioning(kind" not in plan(df)


def test_what_imports_a_file_is_found_without_counting_dependencies(spark):
    df = queries.QUERIES["direct_dependents"](spark, SF)
    read = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in read and "to_module" not in read and "LeftAnti" not in read
    assert df.count() > 0


def test_dependencies_by_hand_lead_to_files_too(spark):
    from mapstone.operators import views
    from mapstone.schema import Graph, edges_of, nodes_of

    nodes = nodes_of(spark.createDataFrame([("file:a", "file", "mod:m"), ("file:b", "file", "mod:n"), ("mod:m", "module", None), ("mod:n", "module", None)], "id string, kind string, parent string"))
    rows = [("imports", "file:a", "file:b", "static"), ("depends_on", "mod:m", "file:b", "manual"), ("depends_on", "mod:n", "file:b", None), ("depends_on", "mod:m", "mod:n", "static")]
    g = Graph(nodes, edges_of(spark.createDataFrame(rows, "kind string, src string, dst string, source string")))
    assert [[r.id for r in views.direct_dependents(g, x).collect()] for x in ("file:b", "mod:n", "file:a")] == [["file:a", "mod:m", "mod:n"], ["mod:m"], []]


def test_edges_are_stored_without_identities(spark):
    g = adapters.supply_base(spark, SF)
    got = build.stored_graph(g)
    assert got.edges.dtypes == g.edges.dtypes and sorted(map(str, got.edges.collect())) == sorted(map(str, g.edges.collect()))
    assert not any(f.endswith("id") for f in spark.read.parquet(*{x.rsplit("/", 1)[0] for x in got.edges.inputFiles()}).columns)


def test_years_count_pairs_before_they_spread_them(spark, monkeypatch):
    from mapstone.plans import history_queries

    kept, own = [], history_queries.checkpointed
    monkeypatch.setattr(history_queries, "checkpointed", lambda df: kept.append(own(df)) or kept[-1])
    got = history_queries.history_diff_dependencies(spark, SF)
    assert [df.columns for df in kept] == [["src", "dst", "made", "n"]] and got.count() > 0
    assert "l_suppkey" not in plan(got)  # the lines are read for those rows only


def test_violations_read_the_graph_once(spark):
    from mapstone.schema import Graph, edges_of, nodes_of, violations

    nodes = nodes_of(spark.createDataFrame([("file:a", "file", "mod:m"), ("mod:m", "module", None), ("file:b", "file", "mod:m")], "id string, kind string, parent string"))
    edge = spark.createDataFrame([("imports", "file:a", "file:b", "static", "certain")] * 2 + [("imports", "file:a", "file:z", "static", "certain")], "kind string, src string, dst string, source string, confidence string")
    got = violations(Graph(nodes, edges_of(edge)))
    assert sorted(map(tuple, got.collect())) == [("missing dst", "imports|file:a|file:z", "file:z"), ("repeated edge", "imports|file:a|file:b", "2")]
    assert "ExistingRDD" not in plan(got)


def test_estimates_do_not_grow_with_the_rounds(spark):
    from mapstone.operators import ancestry

    bytes_of = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    log = spark.createDataFrame([(f"c{i}", i, [f"c{i + 1}"], ["t"] if i % 9 == 0 else [], "d") for i in range(200)], "sha string, pos long, parents array<string>, tags array<string>, date string")
    h = ancestry.History(log)
    got = h.reached(spark.createDataFrame([(1, "c0"), (2, "c150")], "key int, sha string"))
    assert max(bytes_of(x) for x in (h.chains, h.links, got)) < 2**200
    assert {(r.key, r.place) for r in got.collect()} == {(1, 0), (2, 150)}


def test_a_checkpoint_without_estimate_keeps_rows_and_partitioning(spark, monkeypatch):
    monkeypatch.setattr(algo, "MOST_BYTES", 0)
    df = spark.range(100).selectExpr("id % 7 AS a", "id AS b").repartition("a")
    got, own = algo.checkpointed(df), df.checkpoint()
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert plan(got.groupBy("a").count()).count("Exchange") == plan(own.groupBy("a").count()).count("Exchange")


def test_waypoints_of_a_long_line_have_a_bounded_estimate(spark):
    from mapstone.operators import ancestry

    log = spark.createDataFrame([(f"c{i}", i, [f"c{i + 1}"], ["t"] if i % 50 == 0 else [], "d") for i in range(200)], "sha string, pos long, parents array<string>, tags array<string>, date string")
    got = ancestry.History(log).waypoints(spark.createDataFrame([(1, "c199", "c0", "base", "head")], "key int, base string, head string, base_label string, head_label string"), 7)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**2000
    assert [r.sha for r in got.orderBy("nth").collect()] == ["c199", "c150", "c100", "c50", "c0"]


def test_violations_join_all_names_of_nodes_at_once(spark):
    from mapstone.schema import Graph, edges_of, nodes_of, violations

    nodes = nodes_of(spark.createDataFrame([("file:a", "file", "mod:m"), ("mod:m", "module", None), ("file:b", "file", "file:a"), ("file:c", "file", "gone")], "id string, kind string, parent string"))
    edge = spark.createDataFrame([("imports", "file:a", "mod:m", "static", "certain"), ("imports", "file:a", "file:z", "static", None)], "kind string, src string, dst string, source string, confidence string")
    got = violations(Graph(nodes, edges_of(edge)))
    want = [("edge confidence", "imports|file:a|file:z", None), ("kind of dst", "imports|file:a|mod:m", "module"), ("kind of parent", "file:b", "file"), ("missing dst", "imports|file:a|file:z", "file:z"), ("missing parent", "file:c", "gone")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") == 1
