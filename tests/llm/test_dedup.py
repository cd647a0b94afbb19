"""Exact and near-duplicate operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from mapstone.llm import exact_dedup, simhash
from mapstone.llm.components import components
from mapstone.llm.embedding_dedup import near_embeddings

DOC = "doc_id long, text string, keep_id string, rid int, node string, digest string, fp string, whole string, kept string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x", 1, *["y"] * 6]) for i, t in rows], DOC)


def some_texts(seed=1):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    base = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0].replace(" ", "\t \n")) for i in range(80)]  # a large group of copies
    out += [(300 + i, base[1] + f" w{i}") for i in range(40)]
    out += [(400, None), (401, ""), (402, None), (None, base[2]), (403, base[2]), (None, "only nulls"), (None, "only nulls")]
    out += [(500, "same row"), (500, "same row"), (501, "word " * 30_000), (502, "ÄÖ ü é 日本 "), (503, "ÄÖ ü é 日本 "), (504, "A b C"), (505, "a B c")]
    return out


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_matches_brute_force(spark):
    rows = some_texts()
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert {(g.text_sha256, g.keep_id, g.group_size) for g in got} == {(h, k, n) for h, (k, n) in want.items()}
    kept = [g for g in got if g.kept]
    assert len(kept) == len(groups) and len({g.text_sha256 for g in kept}) == len(groups)
    assert all(g.doc_id == g.keep_id for g in kept)


@pytest.mark.parametrize("nodes,radix", [(1, 1), (2, 1), (16, 1), (16, 3), (64, 2)])
def test_tree_shape_does_not_matter(spark, nodes, radix):
    stored = exact_dedup.digests(docs(spark, some_texts()))
    got = exact_dedup.tree_merge(stored, nodes, radix).collect()
    assert len(got) == len({g.digest for g in got}) == len({norm(t) for _, t in some_texts()})
    assert sum(g.group_size for g in got) == len(some_texts())


def test_drop_copies_keeps_columns_and_rows(spark):
    df = docs(spark, some_texts())
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(t) for _, t in some_texts()})


def test_empty_tables(spark):
    df = docs(spark, [])
    assert exact_dedup.exact_dedup(df).count() == 0 and exact_dedup.drop_copies(df).count() == 0
    assert simhash.near_dedup(df).count() == 0 and simhash.drop_near_copies(df).count() == 0


def slow_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(keys, linked):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ks = list(keys)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in ks}


def test_simhash_matches_brute_force(spark):
    rows = some_texts(3)
    got = simhash.near_dedup(docs(spark, rows)).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    assert {(g.doc_id, g.fingerprint) for g in got if g.doc_id is not None} == {(i, f"{f:016x}") for i, f in fps.items()}
    all_fps = {slow_fingerprint(t) for _, t in rows}
    comp = brute_components(all_fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[slow_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    for g in got:
        assert g.component_id == least.get(comp[int(g.fingerprint, 16)])
    kept = simhash.drop_near_copies(docs(spark, rows)).collect()
    assert len(kept) == len(set(comp.values()))


def test_vantage_tree_finds_all_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    tight = base[0] ^ (rng.integers(0, 2**10, 600, dtype=np.uint64))  # a dense ball
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), tight, np.zeros(1, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for sample in (200, 65_536):
        got = {r.node: r.root for r in components(simhash.links(df, sample=sample)).collect()}
        want = {}
        x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
        up = {int(k): int(k) for k in fps.view(np.int64)}

        def root(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for a, b in zip(fps[x].view(np.int64).tolist(), fps[y].view(np.int64).tolist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        want = {k: root(k) for k in up}
        assert {k: got.get(k, k) for k in want} == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(1000, 2000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and all(got[2000 + i] == 1000 for i in range(200)) and len(got) == 59 + 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 24))
    at = np.concatenate([np.arange(400), rng.integers(0, 60, 700), np.full(150, 3)])
    x = base[at] + rng.normal(size=(len(at), 24)) * rng.choice([0.02, 0.1, 0.25, 0.4], size=(len(at), 1))
    x[-20:] = x[-1]  # exact copies
    return x.astype(np.float32)


def test_embeddings_match_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(x)]
    odd = [(9001, None, 1, "a"), (9002, [0.0] * 24, 1, "a"), (9003, [1.0] * 23 + [None], 1, "a"), (9004, [float("nan")] * 24, 1, "a"), (9005, [float("inf")] + [1.0] * 23, 1, "a"), (9006, [1.0, 2.0], 1, "a"), (9007, [], 1, "a")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in near_embeddings(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= g[i].sum() for i in range(len(x)))
    assert found >= 0.98 * g.sum()  # recall of links
    comp = brute_components(range(len(x)), lambda a, b: g[a, b])
    same = sum(got[i].component_id == comp[i] for i in range(len(x)))
    assert same >= 0.97 * len(x)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9008))
    assert near_embeddings(df.limit(0)).count() == 0
    assert near_embeddings(df.where("vec_id > 9000 AND vec_id < 9006")).count() == 5
