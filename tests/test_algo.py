import random

import pytest
from mapstone.operators import algo


def graph(spark, edges, kind="imports"):
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, "file", None) for i in ids], "id string, kind string, parent string")
    return nodes, spark.createDataFrame([(kind, a, b) for a, b in edges], "kind string, src string, dst string")


def random_edges(seed, n=12, m=26):
    r = random.Random(seed)
    return sorted({(f"f{r.randrange(n)}", f"f{r.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_kernel_equals_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(algo, "ITERATIONS", 4)
    nodes, edges = graph(spark, random_edges(seed))
    a = {r.id: r["rank"] for r in algo._rank_loop(nodes.select("id"), edges.select("src", "dst")).collect()}
    b = algo._rank_kernel(nodes.toPandas(), edges.toPandas())
    assert a == pytest.approx(dict(zip(b["id"], b["rank"], strict=True)), abs=2e-6)


def test_rank_sums_to_one(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "zzz")])
    got = {r.id: r["rank"] for r in algo.pagerank(nodes, edges).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-5) and got["a"] > got["d"]


@pytest.mark.parametrize("seed", [3, 4])
def test_impact_kernel_equals_loop(spark, seed):
    nodes, edges = graph(spark, random_edges(seed))
    a = {r.id: r.depth for r in algo.impact_depths(nodes, edges, "f0").collect()}
    b = {r.id: r.depth for r in algo.impact_depths(nodes, edges, "f0", kernel_edges=0).collect()}
    assert a == b


def test_impact_stops_at_the_most(spark):
    nodes, edges = graph(spark, [(f"f{i + 1}", f"f{i}") for i in range(30)])
    got = algo.impact_depths(nodes, edges, "f0", most=10).collect()
    assert len(got) == 9 and all(r.truncated for r in got)
    assert not any(r.truncated for r in algo.impact_depths(nodes, edges, "f0").collect())


@pytest.mark.parametrize("most", [1, 2, 5, 8, 13, 60])
def test_impact_stops_alike_at_any_size(spark, most):
    tree = [(f"t{i}", f"t{(i - 1) // 3}") for i in range(1, 40)]
    for links, start in ((tree, "t0"), (random_edges(7), "f0")):
        nodes, edges = graph(spark, links)
        a, b = (sorted(map(tuple, algo.impact_depths(nodes, edges, start, most=most, kernel_edges=k).collect())) for k in (algo.KERNEL_EDGES, 0))
        assert a == b


@pytest.mark.parametrize("kernel", [algo.KERNEL_EDGES, 0])
def test_impact_reaches_all_of_a_large_graph(spark, kernel, monkeypatch):
    from mapstone.operators import views
    from mapstone.schema import Graph

    if not kernel:
        monkeypatch.setattr(algo, "SENT_ROWS", 100)  # the first level is sent, the others are joined
    nodes = spark.range(11_601).selectExpr("concat('f', id) AS id", "'file' AS kind", "concat('mod:', id % 2) AS parent").localCheckpoint()
    edges = spark.range(1, 11_601).selectExpr("'imports' AS kind", "concat('f', id) AS src", "if(id <= 5800, 'f0', concat('f', id - 5800)) AS dst")
    got = algo.impact_depths(nodes, edges, "f0", kernel_edges=kernel)
    assert {(r.depth, r.truncated, r.n) for r in got.groupBy("depth", "truncated").agg(algo.F.count("*").alias("n")).collect()} == {(1, False, 5800), (2, False, 5800)}
    monkeypatch.setattr(views, "impact_depths", lambda n, e, start: got)
    assert sorted(map(tuple, views.impact_by_module(Graph(nodes, edges), "f0").collect())) == [("mod:0", 5800, 1), ("mod:1", 5800, 1)]


@pytest.mark.parametrize("sent", [0, 3, 20_000])
def test_levels_are_sent_or_joined_alike(spark, sent, monkeypatch):
    monkeypatch.setattr(algo, "SENT_ROWS", sent)
    nodes, edges = graph(spark, random_edges(5))
    a, b = (sorted(map(tuple, algo.impact_depths(nodes, edges, "f0", kernel_edges=k).collect())) for k in (algo.KERNEL_EDGES, 0))
    assert a == b and len(a) > 3


def test_symbols_are_felt_in_their_file(spark):
    nodes = spark.createDataFrame([("sym:a#f", "symbol", "file:a"), ("file:a", "file", "mod:m"), ("file:b", "file", "mod:m")], "id string, kind string, parent string")
    edges = spark.createDataFrame([("imports", "file:b", "file:a")], "kind string, src string, dst string")
    assert {r.id: r.depth for r in algo.impact_depths(nodes, edges, "sym:a#f").collect()} == {"file:a": 1, "file:b": 2}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_kernel_equals_loop(spark, seed):
    _, edges = graph(spark, random_edges(seed, 9, 14), "depends_on")
    a = sorted(map(tuple, algo.dependency_cycles(edges).collect()))
    b = sorted(map(tuple, algo.dependency_cycles(edges, kernel_edges=0).collect()))
    assert a == b


def test_many_cycles_and_long_chains(spark):
    links = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [("r3", "s0"), ("s0", "s1"), ("s1", "s0"), ("s1", "x"), ("x", "x"), ("x", "y"), ("y", "z"), ("a", "r0")]
    _, edges = graph(spark, links, "depends_on")
    a, b = (sorted(map(tuple, algo.dependency_cycles(edges, kernel_edges=k).collect())) for k in (algo.KERNEL_EDGES, 0))
    assert a == b and {c for c, _ in a} == {"r0", "s0", "x"}


def test_self_loop_is_a_cycle(spark):
    _, edges = graph(spark, [("a", "a"), ("b", "c")], "depends_on")
    assert [tuple(r) for r in algo.dependency_cycles(edges).collect()] == [("a", "a")]
