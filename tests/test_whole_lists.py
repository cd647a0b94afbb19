"""Lists that nothing cuts: watched paths and drift findings."""

from mapstone import commands
from mapstone.operators import drift
from mapstone.streaming.watch import watch


def test_watch_delivers_every_path(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    for i in range(10_003):
        (root / f"f{i}.md").write_text("x")
    got = []
    watch(spark, str(root), got.append, str(tmp_path / "state"), once=True).awaitTermination()
    assert len({p for paths in got for p in paths}) == 10_003


def test_drift_returns_every_finding(spark, tmp_path, monkeypatch):
    found = spark.range(10_003).selectExpr("'public' AS schema", "concat('t', id) AS table", "'extra_table' AS kind", "'x' AS detail")
    monkeypatch.setattr(drift, "declared_columns", lambda g: None)
    monkeypatch.setattr(drift, "compute_drift", lambda *a: found)
    monkeypatch.setattr(drift, "drift_summary", lambda *a: {})

    class Store:
        load_graph = staticmethod(lambda: None)

    (tmp_path / "versions").mkdir()
    (tmp_path / "versions" / "a.py").write_text("revision = 'a'\ndown_revision = None\n")
    assert len(commands.db_drift(spark, str(tmp_path), Store(), live=object())["findings"]) == 10_003
