"""Graph algorithms: PageRank, reverse reachability and strongly connected components.

Each has a kernel that takes one whole graph in one Arrow-fed task (parallel over snapshots, if there is a snapshot
column) and a distributed loop for graphs beyond a stated number of edges. Sizes are counted before the choice.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Damping and iterations of the rank.
DAMPING, ITERATIONS = 0.85, 30
KERNEL_EDGES = 4_000_000
#: Rows of a level of reachability, or of all that was reached, that are sent to what they are joined with; more are shuffled.
SENT_ROWS = 20_000
#: What Spark takes a table of unknown size for; an estimate beyond it says no more than that.
MOST_BYTES = (1 << 63) - 1
TRANSMITS = ("imports", "depends_on", "maps_to")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that spark.checkpoint.dir names; a folder of our own only where it is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mapstone-"))
    return _estimated_anew(df.checkpoint(eager=True))


def _estimated_anew(df: DataFrame) -> DataFrame:
    """df, a checkpoint, as a table of unknown size if its estimated size is beyond all sizes. A checkpoint keeps the estimate of the plan
    that it cut off, and a join's is the product of its sides': where a loop joins what it has checkpointed, the estimate gets
    twice as many digits in each round, until the numbers alone fill the driver's memory. Rows, partitioning and order stay."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < MOST_BYTES:
        return df
    none = spark._jvm.scala.Option.empty()
    bare = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the same folder; much smaller than a checkpoint where columns are null or repeat, and read by column."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mapstone-"))
    at = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _rank_kernel(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    ids = nodes["id"].to_numpy()
    n = len(ids)
    if not n:
        return pd.DataFrame({"id": [], "rank": []})
    at = pd.Index(ids)
    src, dst = at.get_indexer(edges["src"]), at.get_indexer(edges["dst"])
    ok = (src >= 0) & (dst >= 0)
    src, dst = src[ok], dst[ok]
    out = np.bincount(src, minlength=n).astype(float)
    hang, rank = out == 0, np.full(n, 1.0 / n)
    for _ in range(ITERATIONS):
        share = rank / np.where(hang, 1, out)
        rank = (1 - DAMPING) / n + DAMPING * np.bincount(dst, share[src], n) + DAMPING * rank[hang].sum() / n
    return pd.DataFrame({"id": ids, "rank": np.round(rank, 6)})


def pagerank(nodes: DataFrame, edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, rank of every file over file-to-file imports, rounded to 6 decimals."""
    files = nodes.where("kind = 'file'").select("id")
    links = edges.where("kind = 'imports'").select("src", "dst")
    if max(links.count(), files.count()) > kernel_edges:
        return _rank_loop(files, links)
    one = F.lit(1).alias("k")
    return files.select(one, "id").groupBy("k").cogroup(links.select(one, "src", "dst").groupBy("k")).applyInPandas(
        lambda a, b: _rank_kernel(a, b), "id string, rank double"
    )


def _rank_loop(files: DataFrame, links: DataFrame) -> DataFrame:
    """The same by joins, over numbers for names. Files that nobody imports all have one rank, so that what they pass on is that rank
    times a sum that is taken once; only the links between files that are imported are joined in each step."""
    ids = checkpointed(files.withColumn("no", F.monotonically_increasing_id()))
    n = ids.count()
    numbered = links.join(ids.toDF("src", "a"), "src").select("a", "dst").join(ids.toDF("dst", "b"), "dst")
    numbered = stored(numbered.select("a", "b"))
    degree = numbered.groupBy("a").agg(F.count("*").alias("out"))
    fed = numbered.select(F.col("b").alias("a")).distinct().withColumn("fed", F.lit(True))
    every = checkpointed(ids.select(F.col("no").alias("a")).join(degree, "a", "left").join(fed, "a", "left"))
    weighed = numbered.join(every.where("out IS NOT NULL"), "a")
    once = weighed.where("fed IS NULL").groupBy("b").agg(F.sum(1 / F.col("out")).alias("once"))
    core = checkpointed(weighed.where("fed").select("a", "b").repartition("a"))
    rank = checkpointed(every.where("fed").select(F.col("a").alias("no"), "out", F.lit(1.0 / n).alias("rank")).join(once.withColumnRenamed("b", "no"), "no", "left"))
    alone, loose, linked = 1.0 / n, every.where("fed IS NULL AND out IS NULL").count(), not core.isEmpty()
    for _ in range(ITERATIONS):
        hang = (rank.where("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0) + loose * alone
        base = (1 - DAMPING) / n + DAMPING * hang / n
        got = F.lit(alone) * F.coalesce("once", F.lit(0.0))
        if linked:
            share = core.join(rank.select(F.col("no").alias("a"), (F.col("rank") / F.col("out")).alias("share")), "a")
            rank = rank.join(share.groupBy(F.col("b").alias("no")).agg(F.sum("share").alias("s")), "no", "left")
            got = got + F.coalesce("s", F.lit(0.0))
        rank = checkpointed(rank.select("no", "out", (F.lit(base) + DAMPING * got).alias("rank"), "once"))
        alone = base
    return ids.join(rank.select("no", "rank"), "no", "left").select("id", F.round(F.coalesce("rank", F.lit(alone)), 6).alias("rank"))


def reverse_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """at, next: where a change to `at` is felt next. Symbols and entities are felt in the file that holds them."""
    direct = edges.where(F.col("kind").isin(*TRANSMITS)).select(F.col("dst").alias("at"), F.col("src").alias("next"))
    held = nodes.where("kind IN ('symbol', 'entity') AND parent IS NOT NULL").select(F.col("id").alias("at"), F.col("parent").alias("next"))
    return direct.union(held).distinct()


def _bfs(hops: pd.DataFrame, start: str, most: int | None) -> tuple[list[str], list[int], bool]:
    near: dict[str, list[str]] = {}
    for a, b in zip(hops["at"], hops["next"], strict=True):
        near.setdefault(a, []).append(b)
    depth, queue, k, cut = {start: 0}, [start], 0, False
    while k < len(queue):
        at, k = queue[k], k + 1
        if most is not None and len(depth) >= most:
            cut = True
            break
        for x in sorted(near.get(at, ())):
            if x not in depth:
                depth[x] = depth[at] + 1
                queue.append(x)
    del depth[start]
    return list(depth), list(depth.values()), cut


def impact_depths(nodes: DataFrame, edges: DataFrame, start: str, most: int | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, depth, truncated: all that a change to start reaches, by least number of hops.

    Where a caller asks for `most`, the search stops once so many identities are visited, checked before each expansion, whatever
    the size of the graph.
    """
    hops = stored(reverse_hops(nodes, edges))
    if hops.count() <= kernel_edges:

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, depths, cut = _bfs(pdf, start, most)
            return pd.DataFrame({"id": pd.Series(ids, dtype=object), "depth": pd.Series(depths, dtype="int32"), "truncated": pd.Series([cut] * len(ids), dtype=bool)})

        return hops.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(run, "id string, depth int, truncated boolean")
    return _reach_loop(hops, start) if most is None else _impact_loop(hops, start, most)


def _reach_loop(hops: DataFrame, start: str) -> DataFrame:
    """All levels by joins, to the last. Nothing of a level but its size comes to the driver."""
    seen = level = hops.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    n, size, parts = 1, 1, int(hops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size:
        near, known = level.select(F.col("id").alias("at"), (F.col("depth") + 1).alias("depth")), seen.select("id")
        found = hops.join(F.broadcast(near) if size <= SENT_ROWS else near, "at").select(F.col("next").alias("id"), "depth").distinct()
        level = checkpointed(found.join(F.broadcast(known) if n <= SENT_ROWS else known, "id", "left_anti"))
        size = level.count()
        if size:
            n, seen = n + size, checkpointed(seen.unionByName(level).coalesce(parts))
    return seen.where(F.col("id") != start).withColumn("truncated", F.lit(False))


def _impact_loop(hops: DataFrame, start: str, most: int) -> DataFrame:
    """The first `most` by joins, level by level. pos is a node's place in the queue; of what a level finds, only that is kept which
    nodes find that are expanded before `most` identities are visited. While that isn't so a level has fewer than `most`, and so has
    what was seen: both are sent to the hops, which stay where they are."""
    spark = hops.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id string, depth int")
    edge, places, n, cut, d = spark.createDataFrame([(start, 0)], "id string, pos long"), [0], 1, most <= 1, 0
    while places and not cut:
        d += 1
        found = hops.join(F.broadcast(edge.select(F.col("id").alias("at"), "pos")), "at").groupBy(F.col("next").alias("id")).agg(F.min("pos").alias("pos"))
        found = checkpointed(found.join(F.broadcast(seen), "id", "left_anti"))
        of = {r["pos"]: r["n"] for r in found.groupBy("pos").agg(F.count("*").alias("n")).collect()}  # fewer than `most`
        until = None
        for place in places:
            if n >= most:
                until, cut = place, True
                break
            n += of.get(place, 0)
        fresh = found if until is None else found.where(F.col("pos") < until)
        seen = checkpointed(seen.union(fresh.select("id", F.lit(d).alias("depth"))))
        size = sum(of.values()) if not cut else 0
        cut = cut or size > 0 and n >= most
        edge = fresh.withColumn("pos", F.row_number().over(Window.orderBy("pos", "id")).cast("long") - 1) if size and not cut else edge
        places = list(range(size)) if not cut else []
    return seen.where(F.col("id") != start).withColumn("truncated", F.lit(cut))


def _components(edges: pd.DataFrame) -> list[list[str]]:
    """Strongly connected components of more than one node, or with an edge to themselves."""
    near: dict[str, list[str]] = {}
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    number, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(near):
        if root in number:
            continue
        work = [(root, iter(near[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            at, rest = work[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(near[x])))
                    break
                if x in on:
                    low[at] = min(low[at], number[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or at in near[at]:
                        out.append(sorted(part))
    return sorted(out)


def dependency_cycles(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """cycle (its first member), member: modules that depend on each other in a circle, or on themselves."""
    deps = edges.where("kind = 'depends_on'").select("src", "dst")
    if deps.count() > kernel_edges:
        return _cycles_loop(deps)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(c[0], m) for c in _components(pdf) for m in c], columns=["cycle", "member"])

    return deps.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(run, "cycle string, member string")


def _cycles_loop(deps: DataFrame) -> DataFrame:
    """By colours: each node takes the greatest name that reaches it; a colour's cycle is what its name is reached from
    within the colour. Cycles go, and what is left is coloured again. Rows never exceed the edges, ends without a way on or
    back are trimmed first."""
    spark = deps.sparkSession
    edges, parts = checkpointed(deps.distinct()), []
    while not edges.isEmpty():
        n = -1
        while (now := edges.count()) != n:  # trim
            n = now
            edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            edges = checkpointed(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        colour, changed = checkpointed(nodes.withColumn("c", F.col("id"))), 1
        while changed:
            sent = edges.join(colour.toDF("src", "s"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("s").alias("s"))
            after = checkpointed(colour.join(sent, "id", "left").select("id", F.greatest("c", F.coalesce("s", "c")).alias("c"), F.coalesce(F.col("s") > F.col("c"), F.lit(False)).alias("new")))
            changed, colour = after.where("new").count(), after.select("id", "c")
        inside = edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "e"), "dst").where("c = e").select("src", "dst", "c")
        inside = checkpointed(inside)
        back = checkpointed(colour.where("id = c"))
        edge = back
        while not edge.isEmpty():
            edge = checkpointed(inside.join(edge.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti"))
            back = checkpointed(back.union(edge))
        parts.append(back)
        gone = back.select("id")
        edges = checkpointed(edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    out = spark.createDataFrame([], "id string, c string")
    for x in parts:
        out = out.union(x)
    alone = deps.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("own", F.lit(True))
    size = out.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("cycle"))
    return out.join(size, "c").join(alone, "id", "left").where("n > 1 OR own").select("cycle", F.col("id").alias("member"))
