"""Embedding near-dedup with product quantisation: inverted lists, residual codes, asymmetric distances, exact rerank.

A coarse quantiser (k-means centroids) deals the vectors into inverted lists; the residual to the centroid is coded in
SUBSPACES parts with up to 256 codewords each. A query reads asymmetric distances to the codes of a list from a table
of its own distances to the codewords. The triangle inequality makes this filter lossless: a vector whose table
distance exceeds the link radius by more than its own stored coding error can't be a link. What passes is reranked by
its exact cosine in double precision.

Sufficient probes: a list is probed if a link of the query could lie beyond the border to it. The exact bound on the
distance to that border is the link radius. A link's difference seldom points straight at a border, so the margin is
the radius times the share of the vectors' spread within their lists that lies along that border's direction (its
standard deviation), times a factor. The factor is measured on each table: PROBES sampled vectors are compared with
all others, and it is the one at which FOUND of their links are met, PROBE_Z at least. Where it reaches the radius,
the bound is exact.

Equal vectors are one class with a weight. Lists are cut into shards of at most about SHARD stored classes. A class is
stored in one shard and visits only later shards, so each pair meets at most once, and counts both ways. A shard
returns link counts and a spanning forest, never the pairs. Centroids and codewords are trained on at most about
SAMPLE vectors; every vector is indexed and queried, among those of its own length.
Components of single precision are kept as such, any others in double precision.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing and is its own component; a null identifier takes part and is larger than any other; an empty table gives
an empty result; labels and other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, ship
from .components import Forest, components
from .simhash import balanced

SAMPLE, SHARD, SUBSPACES, PROBE_Z = 20_000, 8_192, 8, 3.5
PROBES, FOUND, LEAST_SPREAD, BIN = 2_000, 0.999, 1 / 64, 0.25
NO_ID = 2**63 - 1


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])  # exact, and its squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Index:
    """Centroids, codebooks, and the shards that the lists are cut into."""

    def __init__(self, sample: np.ndarray, expected: int, cosine: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        u = _unit(sample).astype(np.float32)
        self.cosine, self.radius = cosine, math.sqrt(2 - 2 * cosine)
        lists = max(1, min(4096, int(math.sqrt(expected)), len(u) // 8))
        self.centroids = _kmeans(u, lists, 8, rng)
        d = u.shape[1]
        cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = _nearest(u, self.centroids)
        res = u - self.centroids[at]
        self.words = [_kmeans(res[:, p], max(1, min(256, len(u) // 4)), 6, rng) for p in self.parts]
        diff = self.centroids[:, None] - self.centroids[None] if lists <= 512 else None
        self.between = (np.sqrt((diff**2).sum(2)) if diff is not None else np.sqrt(np.maximum(0, self._square(self.centroids)))).astype(np.float32)
        cov = res.T @ res / len(u)
        along = self.centroids @ cov @ self.centroids.T
        along = np.diag(along)[:, None] + np.diag(along)[None] - 2 * along  # of the spread, by direction from list to list
        scale = self.between.astype(np.float64) ** 2 * float(np.trace(cov))
        self.spread = np.sqrt(np.clip(np.divide(along, scale, out=np.ones(scale.shape), where=scale > 1e-12), LEAST_SPREAD**2, 1)).astype(np.float32)
        self.widen(PROBE_Z)
        share = np.bincount(at, minlength=len(self.centroids)) / len(u) * expected
        self.blocks = np.maximum(1, np.ceil(share / SHARD)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.list_of = np.repeat(np.arange(len(self.blocks)), self.blocks)

    def widen(self, z: float) -> None:
        """Set the margins: z standard deviations, the link radius at most."""
        self.width = (2 * self.radius * np.minimum(1, z * self.spread) * self.between * (1 + 1e-5) + 1e-5).astype(np.float32)

    def needed(self, raw: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """How many links of the probes (unit vectors) with these vectors need a z in each bin of BIN."""
        u = _unit(raw)
        i, j = np.nonzero(u @ probes.T >= self.cosine)
        du, dp = self._square(u[i].astype(np.float32)), self._square(probes[j].astype(np.float32))
        a, b, k = du.argmin(1), dp.argmin(1), np.arange(len(i))
        first = a <= b  # the vector of the earlier list is the one that visits
        gap = np.where(first, du[k, b] - du[k, a], dp[k, a] - dp[k, b])
        z = np.where(a == b, 0, gap / np.maximum(2 * self.radius * self.spread[a, b] * self.between[a, b], 1e-12))
        return np.bincount((np.clip(z, 0, 1 / LEAST_SPREAD) / BIN).astype(int), minlength=int(1 / LEAST_SPREAD / BIN) + 1)

    def _square(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T

    def place(self, raw: np.ndarray, ids: np.ndarray):
        """Codes, coding error and shard of each vector; then (index, shard) of the later shards it visits."""
        u = _unit(raw).astype(np.float32)
        dist = self._square(u)
        own = dist.argmin(1)
        res = u - self.centroids[own]
        codes = np.stack([_nearest(res[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], 1)
        error = np.sqrt(((res - coded) ** 2).sum(1))
        shard = self.first[own] + (ids * 2654435761 >> 7) % self.blocks[own]
        gap = dist - dist[np.arange(len(u)), own][:, None]
        probe = gap <= self.width[own]
        probe[np.arange(len(u)), own] = True
        i, lst = np.nonzero(probe)
        n = self.blocks[lst]
        i, to = np.repeat(i, n), np.repeat(self.first[lst], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        later = to > shard[i]
        return codes, error, shard, i[later], to[later]

    def links(self, lst: int, q: np.ndarray, codes: np.ndarray, error: np.ndarray, v: np.ndarray):
        """Pairs (query, stored) with cosine at least the bound; q and v are unit vectors in double."""
        far = (((self.radius + error) * (1 + 1e-5) + 1e-5) ** 2).astype(np.float32)[:, None]
        step = max(64, 1_000_000 // max(1, len(v)))
        for a in range(0, len(q), step):
            res = (q[a : a + step] - self.centroids[lst]).astype(np.float32)
            d = np.broadcast_to((res * res).sum(1), (len(v), len(res))).copy()
            for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
                d += ((w * w).sum(1)[:, None] - 2 * w @ res[:, p].T)[codes[:, k]]  # a codeword's row holds all queries
            j, i = np.nonzero(d <= far)
            for b in range(0, len(i), 100_000):
                x, y = i[b : b + 100_000] + a, j[b : b + 100_000]
                ok = np.einsum("ij,ij->i", q[x], v[y]) >= self.cosine
                yield x[ok], y[ok]


def _search(index: Index, dtype: str):
    """Over rows sorted by shard and kind: stored classes (kind 0) against each other, then each visit against them."""

    def run(batches):
        at, own, forest, counts = None, [], Forest(), {}
        stored = None

        def close():
            hi, lo = forest.edges()
            ids = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(hi + ids, pa.int64()), pa.array(lo + [None] * len(ids), pa.int64()), pa.array([0] * len(hi) + [counts[i] for i in ids], pa.int64())],
                names=["a", "b", "n"],
            )

        def add(ids, n):
            for i, k in zip(ids.tolist(), n.tolist(), strict=True):
                if k:
                    counts[i] = counts.get(i, 0) + int(k)

        def link(q, same):
            ids, w, v, codes, error = stored
            qi, qw, qv = q
            lst = int(index.list_of[at])
            nq, ns = np.zeros(len(qi), np.int64), np.zeros(len(ids), np.int64)
            for x, y in index.links(lst, qv, codes, error, v):
                if same:
                    x, y = x[x != y], y[x != y]
                np.add.at(nq, x, w[y])
                if not same:
                    np.add.at(ns, y, qw[x])
                forest.link(qi[x], ids[y])
            add(qi, nq)
            add(ids, ns)

        def settle():
            nonlocal stored
            if stored is None and own:
                stored = tuple(np.concatenate(x) for x in zip(*own, strict=True))
                link(stored[:3], True)

        for b in batches:
            shard, kind, cid, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for part in np.split(np.arange(len(cid)), cuts):
                if not len(part):
                    continue
                lo, n = int(part[0]), len(part)
                if shard[lo] != at:
                    settle()
                    if len(counts) > 100_000:
                        yield close()
                        forest, counts = Forest(), {}
                    at, own, stored = shard[lo], [], None
                vec = _unit(np.frombuffer(b"".join(b.column(4).slice(lo, n).to_pylist()), dtype).reshape(n, -1))
                if kind[lo] == 0:
                    codes = np.frombuffer(b"".join(b.column(5).slice(lo, n).to_pylist()), np.uint8).reshape(n, -1)
                    own.append((cid[part], w[part], vec, codes, b.column(6).to_numpy(zero_copy_only=False)[part]))
                else:
                    settle()
                    if stored is not None:
                        link((cid[part], w[part], vec), False)
        settle()
        yield close()

    return run


def _rows(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """One stored row per vector: id, rid, key (its components as bytes; null if it can't link); the components' type."""
    single = vectors.select(embedding).schema[0].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def run(batches):
        for b in batches:
            v = b.column("v")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            flat = v.flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            ends = np.cumsum(size)
            starts = ends - size
            bad, full = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(x), x != 0))
            ok = (bad[ends] == bad[starts]) & (full[ends] > full[starts])
            keys = [x[lo:hi].tobytes() if good else None for lo, hi, good in zip(starts.tolist(), ends.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array(keys, pa.binary())], names=["id", "rid", "key"])

    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    return materialize(own.mapInArrow(run, "id long, rid long, key binary"), "vectors"), kind


def near_embeddings(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    rows, kind = _rows(vectors, vec_id, embedding)
    size = F.octet_length("key")
    sizes = [r["size"] for r in rows.where("key IS NOT NULL").groupBy(size.alias("size")).count().where("count > 1").orderBy("size").collect()]
    alone = rows.where(F.col("key").isNull() | ~size.isin(sizes))
    got = alone.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for k in sizes:
        got = _linked(rows.where(size == k), k // np.dtype(kind).itemsize, cosine, kind).union(got)
    return got


def _factor(classes: DataFrame, index: Index, sample: np.ndarray, kind: str) -> float:
    """The z at which FOUND of the links of PROBES sampled vectors with all vectors are met."""
    probes = _unit(sample[np.unique(np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int))])
    held = classes.sparkSession.sparkContext.broadcast((index, probes))  # at most PROBES vectors

    def run(batches):
        index, probes = held.value
        n = np.zeros(int(1 / LEAST_SPREAD / BIN) + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                keys = b.column(0).slice(lo, 1000)
                n += index.needed(np.frombuffer(b"".join(keys.to_pylist()), kind).reshape(len(keys), -1), probes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["bin", "n"])

    n = np.zeros(int(1 / LEAST_SPREAD / BIN) + 1, np.int64)
    for r in classes.select("key").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        n[r["bin"]] = r["n"]
    n[0] -= len(probes)  # each with itself
    return max(PROBE_Z, BIN * (1 + int(np.searchsorted(np.cumsum(n), FOUND * n.sum())))) if n.sum() > 0 else PROBE_Z


def _linked(linked: DataFrame, length: int, cosine: float, kind: str) -> DataFrame:
    """The same for vectors of one length that can link."""
    spark = linked.sparkSession
    least = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "rid")).alias("least")
    classes = materialize(linked.groupBy("key").agg(F.count("*").alias("w"), least).withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, p = classes.count(), partitions(spark)
    some = classes.select("key")
    if n > SAMPLE:
        some = some.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    sample = np.frombuffer(b"".join(sorted(r[0] for r in some.collect())), kind).reshape(-1, length)  # bounded by SAMPLE
    index = Index(sample, n, cosine)
    if len(index.centroids) > 1:
        index.widen(_factor(classes, index, sample, kind))
    _, _, shard, _, to = index.place(sample, np.arange(len(sample)))
    stored, visits = (np.bincount(x, minlength=len(index.list_of)).astype(float) for x in (shard, to))
    bins = balanced(stored * (stored + visits) + 0.05 * (stored + visits), p)
    held = spark.sparkContext.broadcast((index, bins))  # at most 4096 centroids and their distances

    def route(batches):
        index, bins = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                keys = part.column("key")
                raw = np.frombuffer(b"".join(keys.to_pylist()), kind).reshape(part.num_rows, -1)
                cid = part.column("cid").to_numpy(zero_copy_only=False)
                codes, error, shard, i, to = index.place(raw, cid)
                at = np.concatenate([np.arange(len(cid)), i])
                where = np.concatenate([shard, to])
                m, k = len(cid), len(i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bins[where]),
                        pa.array(where.astype(np.int32)),
                        pa.array(np.repeat([0, 1], [m, k]).astype(np.int8)),
                        pa.array(cid[at]),
                        part.column("w").take(pa.array(at)),
                        keys.take(pa.array(at)),
                        pa.array([c.tobytes() for c in codes] + [None] * k, pa.binary()),
                        pa.array(np.concatenate([error, np.zeros(k)]).astype(np.float64)),
                    ],
                    names=["bin", "shard", "kind", "cid", "w", "key", "code", "error"],
                )

    routed = classes.select("cid", "w", "key").mapInArrow(route, "bin int, shard int, kind byte, cid long, w long, key binary, code binary, error double")
    dealt = routed.repartitionById(p, F.col("bin")).sortWithinPartitions("shard", "kind", "cid").select("shard", "kind", "cid", "w", "key", "code", "error")
    found = materialize(dealt.mapInArrow(_search(index, kind), "a long, b long, n long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL"), "a", "b").toDF("cid", "root")
    per = classes.select("cid", "w", "least").join(roots, "cid", "left").join(counts, "cid", "left")
    per = per.select("cid", F.coalesce("root", "cid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "least")
    best = per.groupBy("root").agg(F.min("least").alias("best"))
    known = classes.select("cid", "key").join(per.join(best, "root").select("cid", "n_links", "best"), "cid").select("key", "n_links", "best")
    return linked.join(known, "key").select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.nullif("best.id", F.lit(NO_ID)).alias("component_id"),
        F.when(F.col("id").isNull(), F.col("rid") == F.col("best.rid")).otherwise(F.col("id") == F.col("best.id")).alias("kept"),
    )


SQL = """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    ), ok AS (
        SELECT vec_id, e FROM v
        WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
    ), pairs AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
    ), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN comp ON comp.a = vec_id
"""
