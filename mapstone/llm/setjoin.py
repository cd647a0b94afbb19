"""Exact similarity join of texts by the Jaccard similarity of their sets of word shingles.

Fingerprints: a set's parity fingerprint has one bit for about each element (a power of two); a bit is the parity of the
elements that fall on it. Two fingerprints differ in at most as many bits as their sets have elements that aren't
shared, and a wider one folds onto a narrower one by exclusive or. So sets that are similar enough lie within a radius
in Hamming space that follows from their sizes, and what is farther apart is left out without loss.

Pairs that are likely by another search (see simhash) are verified first, and what they link is one component from the start.

Candidates: with shingles in one order for all texts, the first n - ceil(s n) + 1 of the n of two texts with similarity
s or more share one. Texts that share such a shingle form a shard. In a first pass neighbours within a shard, in order
of size, are compared; this connects groups of copies, however large, without pairing all of them. Two more passes
take the shards that still hold several components, in blocks of BLOCK texts, and compare across components: first each
text with the nearest one, then, where more pairs are within the radius, all of these. There a pair
that is known to share a lower shingle (of the LOW lowest of its prefixes) is left to that one's shard. What passes the
radius is verified by whole sets. No shard is ever held in one task: it streams in the first pass and is cut
into pairs of blocks in the others.

The order puts shingles that are common in a sample (ORDER_SAMPLE texts) last; it affects the work only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, majority, materialize, partitions, ship, small
from .components import components

ORDER_SAMPLE, COMMON, BLOCK, LOW = 20_000, 65_536, 4_096, 8
_CHUNK = 1 << 16


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted hashes; a shorter text is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h(join(w), 42)], np.uint64)
    return np.unique(np.fromiter((h(join(x), 42) for x in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1))


def least_shared(n, similarity: float):
    """How many of n elements a set shares at least with one that is similar enough."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def radius(n, m, similarity: float):
    """How many elements of two sets of n and m, similar enough, are in one of them only, at most."""
    return np.floor((1 - similarity) / (1 + similarity) * (n + m) + 1e-6).astype(np.int64)


def parity(s: np.ndarray) -> bytes:
    """The parity fingerprint of a set of hashes."""
    bits = max(64, 2 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _matrix(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def _fold(m: np.ndarray) -> np.ndarray:
    half = m.shape[1] // 2
    return m[:, :half] ^ m[:, half:]


def _common(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a sample, sorted, and their counts there."""
    n = docs.count()
    some = docs.select(F.col(text).cast("string").alias("body"))
    if n > ORDER_SAMPLE:
        some = some.where(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < int((1 << 30) * ORDER_SAMPLE / n))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [shingles(x.as_py(), words) for x in b.column(0).slice(lo, 500)]
                g, k = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(k)], names=["g", "n"])

    counts = some.mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n >= 3")
    got = sorted((r.g, r.n) for r in counts.orderBy(F.desc("n"), "g").limit(COMMON).collect())
    return np.array([g for g, _ in got], np.int64), np.array([k for _, k in got], np.int64)


def sets_of(docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """docs: id, rid and text. One stored row each: id, rid, fp (a hash of the set), sim (its SimHash), n (its size), prefix, low, print."""
    ship(docs.sparkSession)
    common, counts = _common(docs, text, words)

    def first(s: np.ndarray) -> np.ndarray:
        g = s.view(np.int64)
        rank = np.zeros(len(g), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, g), len(common) - 1)
            rank = np.where(common[at] == g, counts[at], 0)
        return g[np.lexsort((g, rank))[: len(g) - int(least_shared(len(g), similarity)) + 1]]

    def run(batches):
        names, kinds = ["fp", "sim", "n", "prefix", "low", "print"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part, rows = b.slice(lo, 500), []
                for x in part.column("body"):
                    s = shingles(x.as_py(), words)
                    fp = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))
                    sim = majority((s[k : k + _CHUNK] for k in range(0, len(s), _CHUNK)), len(s))
                    prefix = first(s)
                    rows.append((fp, int(np.uint64(sim).view(np.int64)), len(s), prefix.tobytes(), np.sort(prefix)[:LOW].tobytes(), parity(s)))
                made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rid"), *made], names=["id", "rid", *names])

    own = docs.select("id", "rid", F.col(text).cast("string").alias("body"))
    return materialize(own.mapInArrow(lean(run), "id long, rid long, fp long, sim long, n long, prefix binary, low binary, print binary"), "sets")


def _exploded(batches):
    """Rows (g, n, fp) for the shingles of each prefix; a task names each set once, as far as it remembers."""
    seen: set[int] = set()
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part, fps = b.slice(lo, 2000), b.column("fp").slice(lo, 2000).to_pylist()
            take = []
            for k, fp in enumerate(fps):
                if fp not in seen:
                    seen.add(fp)
                    take.append(k)
            if len(seen) > 100_000:
                seen.clear()
            part = part.take(pa.array(take, pa.int64()))
            raw = part.column("prefix").to_pylist()
            k = [len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *(pa.array(np.repeat(part.column(c).to_numpy(), k)) for c in ("n", "fp"))], names=["g", "n", "fp"])


def _shards(similarity: float):
    """Over rows (g, n, fp) in order: those of shards of two sets and more, with the set before (if its size allows a link)."""

    def out(x, at, before):
        prev = np.where(before, x[at - 1, 2], 0)
        linked = before & (x[at - 1, 1] >= least_shared(x[at, 1], similarity))
        return pa.RecordBatch.from_arrays([*(pa.array(x[at, c]) for c in range(3)), pa.array(prev, mask=~linked)], names=["g", "n", "fp", "prev"])

    def run(batches):
        held, told = np.zeros((0, 3), np.int64), 0  # the last rows, and how many of them were given out
        for b in batches:
            x = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns], 1)])
            if len(x) > 1:  # repeated rows are one
                keep = np.append(True, (x[1:] != x[:-1]).any(1))
                x = x[keep]
            if len(x) < 2:
                held = x
                continue
            same = np.concatenate([[False], x[1:, 0] == x[:-1, 0], [False]])
            at = np.arange(told, len(x) - 1)
            at = at[same[at] | same[at + 1]]
            if len(at):
                yield out(x, at, same[at])
            held, told = x[-2:], 1
        if len(held) == 2 and held[0, 0] == held[1, 0]:
            yield out(held, np.array([1]), np.array([True]))

    return run


def _within(similarity: float):
    """Over pairs with the sizes and fingerprints of both: those within the radius."""

    def run(batches):
        for b in batches:
            n, m, p, q = (b.column(c) for c in ("n_a", "n_b", "print_a", "print_b"))
            most = radius(n.to_numpy(), m.to_numpy(), similarity)
            ok = []
            for x, y, r in zip(p.to_pylist(), q.to_pylist(), most.tolist(), strict=True):
                u, v = _matrix([x]), _matrix([y])
                while u.shape[1] > v.shape[1]:
                    u = _fold(u)
                while v.shape[1] > u.shape[1]:
                    v = _fold(v)
                ok.append(int(np.bitwise_count(u ^ v).sum()) <= r)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "rid_a", "rid_b")], names=["a", "b", "rid_a", "rid_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def across(n: np.ndarray, comp: np.ndarray, side: np.ndarray, prints: list[bytes], similarity: float, g: int = 0, lows: list[bytes] | None = None):
    """Index pairs (and distances) of sets of different components that lie within the radius; of two sides, pairs across them only.

    With lows: but for pairs that both have a shingle lower than g there.
    """
    values, counts = np.unique(comp, return_counts=True)
    if len(values) < 2:
        return
    other = comp != values[counts.argmax()]  # one of two components isn't the largest
    both = side.min() != side.max()
    words = np.array([len(p) // 8 for p in prints])
    none = np.iinfo(np.int64).max
    low = np.array([[*np.frombuffer(x, np.int64).tolist(), *[none] * (LOW - len(x) // 8)] for x in lows], np.int64) if lows else None

    def elsewhere(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        x, y = low[u][:, :, None], low[v][:, None, :]
        return ((x == y) & (x < g)).any((1, 2))

    def compare(i, j, x, y):
        step = max(1, 1_000_000 // max(1, len(j) * (x.shape[1] if len(x) else 1)))
        for lo in range(0, len(i), step):
            a = i[lo : lo + step]
            d = np.bitwise_count(x[lo : lo + step, None] ^ y[None]).sum(2, dtype=np.int64)
            u, v = np.nonzero(d <= radius(n[a][:, None], n[j][None], similarity))
            u, v, d = a[u], j[v], d[u, v]
            ok = (comp[u] != comp[v]) & (np.minimum(n[u], n[v]) >= least_shared(np.maximum(n[u], n[v]), similarity))
            if both:
                ok &= side[u] != side[v]
            u, v, d = u[ok], v[ok], d[ok]
            for k in range(0, len(u), 20_000):
                a, b, c = u[k : k + 20_000], v[k : k + 20_000], d[k : k + 20_000]
                if low is not None:
                    here = ~elsewhere(a, b)
                    a, b, c = a[here], b[here], c[here]
                if len(a):
                    yield a, b, c

    for w in np.unique(words):
        at, wide = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        x = _matrix([prints[k] for k in at])
        yield from compare(at[other[at]], at, x[other[at]], x)
        if len(wide):
            y = _fold(_matrix([prints[k] for k in wide]))
            yield from compare(at[other[at]], wide, x[other[at]], y)
            yield from compare(at[~other[at]], wide[other[wide]], x[~other[at]], y[other[wide]])


PAIRS = "a long, b long, g long"


def _across(similarity: float, nearest: bool):
    """Over rows in order of shard and pair of blocks: pairs (a, b) of fp of different components within the radius; or the
    nearest of each, and rows of g alone for the shards that have more pairs."""

    def run(batches):
        unit, rows = None, []

        def out(pairs: np.ndarray, more: list[int]):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            ends = [pa.array([*pairs[:, k].tolist(), *[None] * len(more)], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*ends, pa.array([None] * len(pairs) + more, pa.int64())], names=["a", "b", "g"])

        def solve():
            if len(rows) < 2:
                return
            n, fp, comp, side = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            best: dict[int, tuple[int, int]] = {}
            met = 0
            for u, v, d in across(n, comp, side, [r[4] for r in rows], similarity, unit[0], [r[5] for r in rows]):
                if not nearest:
                    yield out(np.stack([fp[u], fp[v]], 1), [])
                    continue
                met += len(u)
                for i, j, k in zip(u.tolist(), v.tolist(), d.tolist(), strict=True):
                    if i not in best or best[i][0] > k:
                        best[i] = k, j
            if best:
                pairs = np.array([[fp[i], fp[j]] for i, (_, j) in best.items()], np.int64)
                yield out(pairs, [unit[0]] if met > len(best) else [])

        for b in batches:
            for *key, n, fp, comp, side, p, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != unit:
                    yield from solve()
                    unit, rows = key, []
                rows.append((n, fp, comp, side, p, low))
        yield from solve()

    return run


def _verified(words: int, similarity: float):
    """Over pairs with both texts: those that are similar enough."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            a, c, ok = b.column("rid_a").to_pylist(), b.column("rid_b").to_pylist(), []
            for i, j, x, y in zip(a, c, b.column("text_a"), b.column("text_b"), strict=True):
                held = {k: held[k] for k in (i, j) if k in held}  # neighbouring pairs have a text in common
                for k, t in ((i, x), (j, y)):
                    if k not in held:
                        held[k] = shingles(t.as_py(), words)
                s, t = held[i], held[j]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(shared >= similarity * (len(s) + len(t) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def similar_components(docs: DataFrame, sets: DataFrame, text: str, words: int, similarity: float, likely: DataFrame) -> DataFrame:
    """fp, comp: the representative of each linked fp that is not its own, by exact Jaccard similarity.

    docs has rid and text of the rows behind sets (sets_of). likely (a, b of fp) are verified first; what they link isn't searched again.
    """
    spark = sets.sparkSession
    p = partitions(spark)
    rows = sets.select("fp", "n", "prefix").mapInArrow(lean(_exploded), "g long, n long, fp long")
    rows = rows.repartition(p, "g").sortWithinPartitions("g", "n", "fp")
    shared = materialize(rows.mapInArrow(_shards(similarity), "g long, n long, fp long, prev long"), "shards")
    inside = sets.select("fp", "rid", "n", "print", "low").join(shared.select("fp").distinct(), "fp", "left_semi")
    nodes = materialize(inside.groupBy("fp").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("low").alias("low")), "nodes")

    def end(x: str) -> DataFrame:
        return nodes.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("rid", "n", "print")))

    def verify(pairs: DataFrame) -> DataFrame:
        near = materialize(pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(_within(similarity), "a long, b long, rid_a long, rid_b long"), "pairs")
        wanted = small(materialize(near.select(F.col("rid_a").alias("rid")).union(near.select("rid_b")).distinct(), "wanted"))
        texts = docs.select("rid", F.col(text).cast("string").alias("body")).join(wanted, "rid", "left_semi")
        both = near.join(texts.toDF("rid_a", "text_a"), "rid_a").join(texts.toDF("rid_b", "text_b"), "rid_b")
        return materialize(both.mapInArrow(lean(_verified(words, similarity)), "a long, b long"), "links")

    found = verify(likely)
    linked, beside = small(components(found).toDF("fp", "comp")), shared.where("prev IS NOT NULL").select(F.least("prev", "fp").alias("a"), F.greatest("prev", "fp").alias("b")).distinct()
    for x in "ab":
        beside = beside.join(linked.toDF(x, f"comp_{x}"), x, "left")
    found = found.union(verify(beside.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")))
    open_shards = None
    for nearest in (True, False):
        own = nodes.select("fp", "print", "low").join(components(found).toDF("fp", "comp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "print", "low")
        own = materialize(own, "owners")
        rows = shared.select("g", "n", "fp")
        if open_shards is not None:
            rows = rows.join(open_shards, "g", "left_semi")
        member = rows.join(own.select("fp", "comp"), "fp")
        left = member.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi AND m > 2")  # two were compared in the first pass
        blocks = member.join(left.select("g", F.expr(f"(m - 1) div {BLOCK} + 1").alias("blocks")), "g").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        units = blocks.join(own.select("fp", "print", "low"), "fp").withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
        units = units.select("g", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "n", "fp", "comp", F.col("block").alias("side"), "print", "low")
        units = units.repartition(p, "g", "i", "j").sortWithinPartitions("g", "i", "j")
        met = materialize(units.mapInArrow(lean(_across(similarity, nearest)), PAIRS), "met")
        found = found.union(verify(met.where("a IS NOT NULL").select("a", "b").distinct()))
        open_shards = small(materialize(met.where("a IS NULL").select("g").distinct(), "open"))
    return components(found).toDF("fp", "comp")
