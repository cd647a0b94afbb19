"""The near-dedup stage of the pipeline against brute force over all pairs of five-word shingle sets."""

import random

import corpus_pipeline
import numpy as np
from mapstone.llm import setjoin, simhash

from .test_dedup import brute_components


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    line = " ".join(word() for _ in range(12))
    out = []
    for n in (8, 20, 60, 150, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for k in range(4):  # near copies on both sides of 0.8, and chains of them
                for _ in range(max(1, n * k // 100)):
                    base[r.randrange(n)] = word()
                out.append(" ".join(base))
            out.append(" ".join(base) + " " + line)  # a line that many share
    out += [line] * 3 + [line + f" w{i}" for i in range(30)] + [None, "", " ", "one", "One", "one two"]
    r.shuffle(out)
    return out


def least(rows):
    rows = list(rows)
    sets = {i: grams(t) for i, t in rows}
    comp = brute_components(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    return sorted({min(i for i in comp if comp[i] == c) for c in comp.values()})


def test_stage_drops_all_near_copies_and_no_others(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = least(rows)
    for common, block in ((setjoin.COMMON, setjoin.BLOCK), (1, 5)):  # neither the order of shingles nor the size of blocks matters
        monkeypatch.setattr(setjoin, "COMMON", common)
        monkeypatch.setattr(setjoin, "BLOCK", block)
        got = corpus_pipeline.near_dedup(spark, df, "")
        assert got.columns == df.columns
        assert sorted(r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0
    assert len(want) < len({i for i in simhash.drop_near_copies(df).select("doc_id").toPandas()["doc_id"]})


def test_odd_rows_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, 1, 1, 1), (5, base.upper(), 2, 2, 2), (5, base.upper(), 2, 2, 2), (9, base + " end", 3, 3, 3), (3, None, 4, 4, 4), (4, "", 5, 5, 5), (4, " \t", 6, 6, 6), (8, "x y " * 100_000, 7, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, `my col` int, whole int")
    got = simhash.drop_near_copies(df, words=5, similarity=0.8)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.rid) for r in got.collect()) == [(3, 4), (5, 2), (8, 7)]  # a null identifier is the largest; wordless texts are alike


def test_the_radius_loses_no_similar_pair():
    r = np.random.default_rng(3)
    n_near = 0
    for _ in range(300):
        n = int(r.integers(1, 600))
        whole = np.unique(r.integers(0, 1 << 63, n + 200).astype(np.uint64))
        a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[int(n * r.random() * 0.25) : n], whole[n : n + int(n * r.random() * 0.2)]]))
        if not len(b):
            continue
        sets, shared = [a, b], len(np.intersect1d(a, b))
        near = shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9
        size = np.array([len(a), len(b)])
        found = list(setjoin.across(size, np.array([0, 1]), np.array([0, 0]), [setjoin.parity(x) for x in sets], 0.8))
        assert found or not near
        n_near += near
    assert n_near > 50
    far = [np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(40)]  # and it leaves out what has nothing in common
    assert not list(setjoin.across(np.full(40, 400), np.arange(40), np.zeros(40, int), [setjoin.parity(x) for x in far], 0.8))


def test_many_copies_of_one_text_are_one_group(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10_000)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(2):
            w[r.randrange(200)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows.append((5000, " ".join(base[:150] + [f"z{k}" for k in range(50)])))  # shares a passage only
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8)
    assert sorted(x.doc_id for x in got.collect()) == [0, 5000]


def test_components_of_few_and_of_many_links_are_the_same(spark):
    from mapstone.llm.components import components

    r = random.Random(6)
    for n, m in ((40, 25), (300, 280), (50, 400)):
        links = [(r.randrange(n) * 7 - 90, r.randrange(n) * 7 - 90) for _ in range(m)] + [(i, i + 1) for i in range(10_000, 10_060)]
        df = spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long")
        one, loop = (sorted(map(tuple, components(df, few=few).collect())) for few in (1_000, 0))
        want = {}
        for x, y in links:
            want.setdefault(x, {x}), want.setdefault(y, {y})
            if want[x] is not want[y]:
                both = want[x] | want[y]
                want.update(dict.fromkeys(both, both))
        assert one == loop == sorted((x, min(c)) for x, c in want.items() if x != min(c))
    assert components(df.limit(0)).count() == 0
