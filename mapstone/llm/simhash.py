"""SimHash near-duplicate detection with a distributed vantage-point tree over Hamming space.

A tree node measures the Hamming distance of a fingerprint to its vantage point and has one branch for each distance.
Nodes on one level measure on one of eight disjoint slices of the 64 bits. Each slice distance is a metric, and they
add up to the whole distance, so by the triangle inequality the shells of two linked fingerprints, summed over the
levels, differ by no more than the link radius: a query enters a branch only while its remaining radius allows, and
all other branches are pruned without loss. Leaves are shards. A fingerprint is stored in its own leaf and travels as a
query to the later leaves whose boundary it overlaps, where its exact distance to the stored ones is taken; every
linked pair meets exactly once. A shard returns a spanning forest of its links, never the pairs.

The tree is shaped by a bounded sample (SAMPLE fingerprints); every fingerprint is indexed and queried, so the sample
affects balance only. Equal fingerprints are one node: copies of a text never meet each other.

Stages of a pipeline take another rule: two texts link if the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more (drop_near_copies with `similarity`). Most such pairs differ by 4 to 14 of 64 bits. A radius as wide as
that prunes no branch, but few of these bits lie in the slices above a leaf: the tree is entered with the narrow radius, and
in the leaves each fingerprint meets the nearest one, up to APART bits away. These pairs are verified by whole sets and
linked first. What the tree misses is found among the texts that it left apart, by wider fingerprints in Hamming space
with a radius for each pair (see setjoin), so that no link is lost.

Defined results: null and wordless texts have fingerprint zero and link like any other; a null identifier is larger
than every other; repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, majority, materialize, numbered, partitions, ship, without
from .components import Forest, components
from .setjoin import sets_of, similar_components

SAMPLE = 65_536
LEVELS = 8
APART = 12  # some 2 of 10 million pairs of unrelated fingerprints differ by no more bits
NO_ID = 2**63 - 1
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    h, join = xxhash.xxh64_intdigest, b" ".join
    n = len(w) - words + 1

    def parts():
        for lo in range(0, n, _CHUNK):
            part = w[lo : min(n, lo + _CHUNK) + words - 1]
            yield np.array([h(join(x), seed) for x in zip(*(part[i:] for i in range(words)), strict=False)], dtype="<u8")

    return majority(parts(), n)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, rid: str | None = None) -> DataFrame:
    """One stored row per document: id, rid (a row number of its own, or the given one), fp (as a signed long)."""
    ship(docs.sparkSession)
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    own = docs.select(F.col(doc_id).cast("long").alias("id"), number.alias("rid"), F.col(text).cast("string").alias("body"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in b.column("body")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array(fps.view(np.int64))], names=["id", "rid", "fp"])

    return materialize(own.mapInArrow(run, "id long, rid long, fp long"), "fingerprints")


class Tree:
    """A vantage-point tree over uint64 fingerprints, built from a sample; its leaves cover the whole space."""

    MASKS = np.array([sum(1 << (8 * k + j) for k in range(8)) for j in range(LEVELS)], np.uint64)

    def __init__(self, sample: np.ndarray, expected: int, leaf: int, radius: int) -> None:
        self.radius, self.leaves = radius, 0
        self.scale = max(1.0, expected / max(1, len(sample)))
        self.leaf, self.root = leaf, None
        self.root = self._grow(sample, 0)

    def _grow(self, own: np.ndarray, level: int):
        if level == LEVELS or len(own) * self.scale <= self.leaf or len(own) < 4:
            self.leaves += 1
            return self.leaves - 1
        best = None
        for v in own[:: max(1, len(own) // 8)][:8]:  # the vantage point whose shells are the most even
            d = np.bitwise_count((own ^ v) & self.MASKS[level])
            n = np.bincount(d, minlength=9)
            if best is None or (n**2).sum() < best[0]:
                best = (n**2).sum(), v, d
        _, v, d = best
        return level, v, [self._grow(own[d == c], level + 1) for c in range(9)]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """own: the leaf of each; then (leaf, index) of the later leaves that it must visit."""
        own = np.zeros(len(fps), np.int32)
        visits: list[tuple[int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(fps)), np.full(len(fps), self.radius, np.int8))]
        while todo:
            node, at, left = todo.pop()
            if isinstance(node, int):
                own[at[left == self.radius]] = node
                visits.append((node, at))
                continue
            level, v, kids = node
            d = np.bitwise_count((fps[at] ^ v) & self.MASKS[level]).astype(np.int8)
            for c, kid in enumerate(kids):
                rest = left - np.abs(d - c)
                if (ok := rest >= 0).any():
                    todo.append((kid, at[ok], rest[ok]))
        leaf = np.concatenate([np.full(len(at), k, np.int32) for k, at in visits]) if visits else np.zeros(0, np.int32)
        at = np.concatenate([at for _, at in visits]) if visits else np.zeros(0, np.int64)
        later = leaf > own[at]
        return own, leaf[later], at[later]


def balanced(load: np.ndarray, bins: int) -> np.ndarray:
    """Leaf to bin, the heaviest first into the lightest bin."""
    import heapq

    heap, to = [(0.0, i) for i in range(bins)], np.zeros(len(load), np.int32)
    for k in np.argsort(-load, kind="stable"):
        w, i = heapq.heappop(heap)
        to[k] = i
        heapq.heappush(heap, (w + float(load[k]) + 1, i))
    return to


def near(a: np.ndarray, b: np.ndarray, radius: int):
    """Index pairs (i of a, j of b) at most radius bits apart, block by block."""
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 4096):
            x, y = np.nonzero(np.bitwise_count(a[i : i + 1024, None] ^ b[None, j : j + 4096]) <= radius)
            if len(x):
                yield x + i, y + j


class Nearest:
    """Each fingerprint with the nearest other one, not farther than `apart`, of every block that it meets."""

    def __init__(self, apart: int) -> None:
        self.apart, self.up, self.pairs = apart, (), []

    def meet(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 4096):
                x, y = a[i : i + 1024], b[j : j + 4096]
                d = np.bitwise_count(x[:, None] ^ y[None])
                d[d == 0] = 255  # itself
                at = d.argmin(1)
                ok = d[np.arange(len(x)), at] <= self.apart
                self.pairs.append(np.stack([x[ok], y[at[ok]]], 1).view(np.int64))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        got = np.concatenate([np.zeros((0, 2), np.int64), *self.pairs])
        return got[:, 0], got[:, 1]


class Linked(Forest):
    """A spanning forest of all pairs that are at most radius bits apart."""

    def __init__(self, radius: int) -> None:
        super().__init__()
        self.radius = radius

    def meet(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in near(a, b, self.radius):
            x, y = a[i].view(np.int64), b[j].view(np.int64)
            differ = x != y
            self.link(x[differ], y[differ])


def _search(new):
    """Over rows sorted by leaf and kind: the stored fingerprints (kind 0) meet each other and the queries; new() keeps what they give."""

    def run(batches):
        leaf, own, forest = None, [], new()
        stored = None

        def close():
            hi, lo = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["a", "b"])

        def settle():
            nonlocal stored
            if stored is None:
                stored = np.concatenate(own) if own else np.zeros(0, np.uint64)
                forest.meet(stored, stored)

        for b in batches:
            leaves, kinds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((leaves[1:] != leaves[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for part in np.split(np.arange(len(fps)), cuts):
                if not len(part):
                    continue
                if leaves[part[0]] != leaf:
                    settle()
                    if len(forest.up) > 200_000:
                        yield close()
                        forest = new()
                    leaf, own, stored = leaves[part[0]], [], None
                if kinds[part[0]] == 0:
                    own.append(fps[part])
                else:
                    settle()
                    forest.meet(fps[part], stored)
        settle()
        yield close()

    return run


def links(nodes: DataFrame, radius: int = 2, sample: int = SAMPLE, apart: int | None = None) -> DataFrame:
    """a, b: a forest of links whose components are those of all pairs of distinct fp at most radius bits apart.

    With apart: pairs up to that many bits apart, of each fp and the nearest one in every leaf that the radius makes it visit.
    """
    spark = nodes.sparkSession
    ship(spark)
    n, p = nodes.count(), partitions(spark)
    frac = sample / max(1, n)
    some = nodes.select("fp")
    if frac < 1:
        some = some.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(frac * (1 << 30)))
    got = np.array([r[0] for r in some.collect()], np.int64).view(np.uint64)  # bounded by sample
    got.sort()
    tree = Tree(got, n, min(4096, max(64, n // (4 * p))), radius)
    own, leaf, at = tree.route(got)
    stored = np.bincount(own, minlength=tree.leaves).astype(float)
    asked = np.bincount(leaf, minlength=tree.leaves)
    to = balanced(stored * (stored + asked) + 0.05 * (stored + asked), p)

    def route(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            own, leaf, at = tree.route(fps.view(np.uint64))
            all_leaf = np.concatenate([own, leaf])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to[all_leaf]),
                    pa.array(all_leaf),
                    pa.array(np.repeat([0, 1], [len(own), len(leaf)]).astype(np.int8)),
                    pa.array(np.concatenate([fps, fps[at]])),
                ],
                names=["bin", "leaf", "kind", "fp"],
            )

    routed = nodes.select("fp").mapInArrow(route, "bin int, leaf int, kind byte, fp long")
    dealt = routed.repartitionById(p, F.col("bin")).sortWithinPartitions("leaf", "kind", "fp").select("leaf", "kind", "fp")
    return dealt.mapInArrow(_search((lambda: Linked(radius)) if apart is None else (lambda: Nearest(apart))), "a long, b long")


def near_components(stored: DataFrame, radius: int = 2) -> DataFrame:
    """fp, comp: the representative fingerprint of each linked fingerprint that is not its own."""
    nodes = checkpoint(stored.select("fp").distinct())
    return components(links(nodes, radius)).toDF("fp", "comp")


def _by_component(stored: DataFrame, comps: DataFrame) -> DataFrame:
    """fp, best (id, rid): for each distinct fp, the smallest identifier of its component."""
    per_fp = stored.groupBy("fp").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "rid")).alias("least"))
    with_comp = per_fp.join(comps, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least")
    best = with_comp.groupBy("comp").agg(F.min("least").alias("best"))
    return with_comp.join(best, "comp").select("fp", "best")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    stored = fingerprints(docs, text, doc_id, words)
    return stored.join(_by_component(stored, near_components(stored, radius)), "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("best.id", F.lit(NO_ID)).alias("component_id"),
    )


def tree_pairs(stored: DataFrame, radius: int = 2, apart: int = APART) -> DataFrame:
    """a, b of fp: the pairs of sets that the tree finds by their fingerprints (sim), sets of one fingerprint included."""
    sets = checkpoint(stored.select("sim", "fp").distinct())
    first = sets.groupBy("sim").agg(F.min("fp").alias("fp"))
    found = materialize(links(checkpoint(first.select("sim").toDF("fp")), radius, apart=apart).distinct(), "tree")
    ends = found.toDF("sim", "other").join(first.toDF("sim", "a"), "sim").select(F.col("other").alias("sim"), "a").join(first.toDF("sim", "b"), "sim").select("a", "b")
    same = sets.join(first.toDF("sim", "a"), "sim").where("fp <> a").select("a", F.col("fp").alias("b"))
    return ends.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """The documents, all columns, one (of the smallest identifier) for each group of near-duplicates.

    With a similarity, texts link by the Jaccard similarity of their shingles: the tree, entered with the radius, finds pairs to verify, and
    setjoin the rest.
    """
    rows = numbered(docs, doc_id)
    body = rows.select("id", "rid", F.col("whole").getField(text).cast("string").alias("body"))
    if similarity is None:
        stored = fingerprints(body, "body", "id", words, rid="rid")
        comps = near_components(stored, radius)
    else:
        stored = sets_of(body, "body", words, similarity)
        comps = similar_components(body, stored, "body", words, similarity, tree_pairs(stored, radius))
    kept = _by_component(stored.select("id", "rid", "fp"), comps).select(F.col("best.rid").alias("rid")).distinct()
    return without(rows, stored.select("rid").join(kept, "rid", "left_anti"))
