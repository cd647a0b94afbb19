"""Connected components over DataFrames of links: of few links in one task, of more by alternating large-star and
small-star steps. Links are counted first; the result is the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: Links that one task may hold: some 20 MB.
FEW = 300_000


class Forest:
    """Union-find over arbitrary integers, fed with arrays; keeps the smallest member as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in {(int(x), int(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}:
            x, y = self.root(x), self.root(y)
            if x != y:
                lo, hi = min(x, y), max(x, y)
                self.up[hi] = lo
                self.up.setdefault(lo, lo)

    def edges(self) -> tuple[list[int], list[int]]:
        hi = [x for x, p in self.up.items() if x != p]
        return hi, [self.root(x) for x in hi]


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links and the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for ends in (x, y, label[x], label[y]):  # the nodes, and the roots that they had
            np.minimum.at(after, ends, low)
        while (further := after[after] != after).any():
            after[further] = after[after[further]]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _in_one_task(batches):
    parts = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
    if parts:
        e = np.concatenate(parts)
        nodes, roots = least_of(e[:, 0], e[:, 1])
        linked = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(roots[linked])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, few: int | None = None) -> DataFrame:
    """node, root for every linked node but the roots themselves; root is the smallest node reachable.

    Beyond `few` links, every round costs two keyed minima and two joins on the remaining links; no group is ever collected, and links
    that repeat collapse before each shuffle. An empty table gives an empty result; null ends are ignored.
    Rounds grow with the logarithm of the longest path; a run that isn't settled after `most` rounds raises rather than
    giving an unfinished answer.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct()
    e, seen = checkpoint(e), None
    if e.count() <= (FEW if few is None else few):
        ship(e.sparkSession)
        return checkpoint(e.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    for _ in range(most):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(small_least.select("u", "m")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 999983)).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")
