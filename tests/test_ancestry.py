"""Commit graphs against a walk over sets, and the history of a branched repository."""

import random
import subprocess

import pytest
from mapstone.operators.ancestry import History, chains, neighbours
from mapstone.plans import analyze as A
from mapstone.sources import git
from mapstone.sources.store import Store

DDL = "sha string, pos long, parents array<string>, tags array<string>, date string"


def random_log(seed, n=60):
    r = random.Random(seed)
    rows, tip = [], []
    for k in range(n):  # oldest first: mostly a line, with forks and merges
        above = [] if k == 0 or r.random() < 0.03 else [str(k - 1) if r.random() < 0.6 else str(r.randrange(k))]
        if above and r.random() < 0.3:
            above.append(str(r.randrange(k)))
        rows.append((str(k), n - k, list(dict.fromkeys(above)) + (["missing"] if r.random() < 0.05 else []), [f"v{k}", "x"] if r.random() < 0.4 else [], f"d{k}"))
        tip.append(k)
    return rows


def walk(rows, sha):
    by, out, todo = {x[0]: x[2] for x in rows}, set(), [sha]
    while todo:
        s = todo.pop()
        if s in by and s not in out:
            out.add(s)
            todo += by[s]
    return out


@pytest.mark.parametrize("seed", [1])
def test_ranges_and_ancestors_equal_a_walk(spark, seed):
    rows = random_log(seed)
    h = History(spark.createDataFrame(rows + rows[:5], DDL))
    r = random.Random(seed)
    asked = [(f"q{k}", str(r.randrange(60)), str(r.randrange(60))) for k in range(12)] + [("gone", "missing", "3"), ("none", "3", "missing")]
    got = h.between(spark.createDataFrame(asked, "key string, base string, head string"))
    want = {(k, s) for k, b, e in asked for s in walk(rows, e) - walk(rows, b)}
    found = [(x["key"], x["sha"]) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)
    is_up = {x["key"]: x["ancestor"] for x in h.is_ancestor(spark.createDataFrame(asked, "key string, base string, head string")).collect()}
    assert is_up == {k: b in walk(rows, e) for k, b, e in asked}


def test_chains_cover_every_commit_once(spark):
    rows = [(str(k), 100 - k, [str(k - 1)] if k else [], [], "") for k in range(40)] + [("b1", 50, ["20"], [], ""), ("b2", 49, ["b1", "30"], [], "")]
    got = {r["sha"]: (r["chain"], r["place"]) for r in chains(spark.createDataFrame(rows, DDL)).collect()}
    assert len(got) == 42 and len(set(got.values())) == 42
    assert {c for c, _ in got.values()} == {"39", "b2", "20"} or {c for c, _ in got.values()} == {"39", "b2"}
    assert chains(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("most", [2, 5, 40])
def test_waypoints_are_sampled_evenly(spark, most):
    rows = random_log(4)
    ranges = [("a", "2", "59"), ("b", "50", "50"), ("c", "0", "40")]
    h = History(spark.createDataFrame(rows, DDL))
    points = h.waypoints(spark.createDataFrame([(*x, "from", "to") for x in ranges], "key string, base string, head string, base_label string, head_label string"), most, limit=30)
    for key, b, e in ranges:
        log = sorted((x for x in rows if x[0] in walk(rows, e) - walk(rows, b)), key=lambda x: x[1])[:30]
        tagged, room = [x for x in reversed(log) if x[3] and x[0] != e], max(0, most - 2)
        picked = tagged if len(tagged) <= room else [tagged[i] for i in sorted({int(k * (len(tagged) - 1) / max(1, room - 1) + 0.5) for k in range(room)})]
        want = [(b, "from")] + [(x[0], ", ".join(x[3])) for x in picked] + ([(e, "to")] if e != b else [])
        got = points.where(f"key = '{key}'").orderBy("nth").collect()
        assert [(r["sha"], r["label"]) for r in got] == want and [r["nth"] for r in got] == list(range(len(want)))
    assert neighbours(points).count() == points.count() - len(ranges)


def test_history_of_a_branched_repository(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)

    def commit(message, tag=None, **files):
        for name, text in files.items():
            at = root / "src" / name.replace("__", "/")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.with_suffix(".ts").write_text(text)
        run("add", "-A")
        run("commit", "-qm", message)
        if tag:
            run("tag", tag)

    run("init", "-q", "-b", "main")
    commit("one", "v1", a__x="export const x = 1;\n", b__y='import { x } from "../a/x";\nexport const y = x;\n')
    run("checkout", "-qb", "side")
    commit("side", "s1", c__z='import { x } from "../a/x";\nexport const z = x;\n')
    run("checkout", "-q", "main")
    commit("two", "v2", a__w='import { y } from "../b/y";\nexport const w = y;\n')
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    run("mv", "src/b/y.ts", "src/b/moved.ts")
    (root / "src/a/w.ts").write_text('import { y } from "../b/moved";\nexport const w = y;\n')
    commit("three")
    got = A.history(spark, str(root), "v1", Store(spark, str(tmp_path / "store")), most=4)
    labels = [r["label"] for r in got["points"].orderBy("nth").collect()]
    assert labels[0] == "v1" and labels[-1] == "HEAD" and set(labels[1:-1]) == {"s1", "v2"}
    files = {(r["interval"], r["change"], r["id"]) for r in got["files"].collect()}
    last = f"range/{len(labels) - 2}"
    assert (last, "moved", "file:src/b/moved.ts") in files
    for i, r in enumerate(got["intervals"].orderBy("nth").collect()):  # one plan gives what the comparison of two commits gives
        two = A.compare(spark, str(root), r["base"], r["head"], Store(spark, str(tmp_path / "store")))
        assert {x[1:] for x in files if x[0] == f"range/{i}"} == {(x["change"], x["id"]) for x in two["files"].collect()}
        deps = {tuple(x)[1:] for x in got["dependencies"].collect() if x["interval"] == f"range/{i}"}
        assert deps == {tuple(x) for x in two["dependencies"].collect()}
    assert git.commits(spark, str(root), "HEAD").count() == 5


def test_short_branches_leave_the_trunk_whole(spark, monkeypatch):
    rows = []  # a trunk; from each of its commits a branch that is merged, and whose commits are newer than the trunk's next ones
    for k in range(40):
        rows += [(f"t{k}", 1000 - 10 * k, ([f"t{k - 1}"] if k else []) + ([f"b{k - 4}"] if k > 3 else []), [], ""), (f"b{k}", 1000 - 10 * k - 35, [f"t{k}"], [], "")]
    at = History(spark.createDataFrame(rows, DDL))
    assert at.chains.where("sha LIKE 't%'").select("chain").distinct().count() == 1
    starts, reached = [], at.reached
    monkeypatch.setattr(at, "reached", lambda df: starts.append(df.count()) or reached(df))
    asked = [(f"q{k}", f"t{k}", "t30") for k in range(40)]
    got = {r["key"]: r["ancestor"] for r in at.is_ancestor(spark.createDataFrame(asked, "key string, base string, head string")).collect()}
    assert got == {f"q{k}": k <= 30 for k in range(40)} and starts == [1]  # a head that is asked for often is walked once
