"""The near-dedup stage of the pipeline goes through the tree of fingerprints."""

import random

import corpus_pipeline
from mapstone.llm import setjoin, simhash

from .test_near_stage import grams, jaccard, least


def texts(seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    out = []
    for n in r.choices((60, 150, 400), k=700):
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        if r.random() < 0.2:
            at = r.randrange(n - 5)
            out.append(" ".join(base[:at] + [word() for _ in range(1 + n // 100)] + base[at:]))
    r.shuffle(out)
    return out


def test_the_tree_finds_most_similar_pairs_and_few_others(spark):
    rows = [(i, i, t) for i, t in enumerate(texts())]
    stored = setjoin.sets_of(spark.createDataFrame(rows, "id long, rid long, body string"), "body", 5, 0.8)
    fp = {r.rid: (r.fp, r.sim) for r in stored.collect()}
    got = {(r.a, r.b) for r in simhash.tree_pairs(stored).collect()}
    sets = {i: grams(t) for i, _, t in rows}
    want = {tuple(sorted((fp[i][0], fp[j][0]))) for i in sets for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    assert len(want) > 100 and len(got & want) >= 0.6 * len(want)
    sim = dict(fp.values())
    assert all((sim[a] ^ sim[b]) & (2**64 - 1) and ((sim[a] ^ sim[b]) & (2**64 - 1)).bit_count() <= simhash.APART for a, b in got)


def test_the_stage_links_what_the_tree_finds_and_searches_the_rest(spark, monkeypatch):
    rows = list(enumerate(texts(9)[:300]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked, own = [], simhash.tree_pairs
    monkeypatch.setattr(simhash, "tree_pairs", lambda *a: asked.append(own(*a).count()) or own(*a))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == least(rows)
    assert asked and asked[0] > 0
    monkeypatch.setattr(setjoin, "_shards", lambda similarity: lambda batches: (b for b in _with_null(batches)))  # neighbours of shards aren't compared: what goes, goes by the tree
    monkeypatch.setattr(setjoin, "_across", lambda similarity, nearest: lambda batches: iter(()))
    assert len(least(rows)) <= corpus_pipeline.near_dedup(spark, df, "").count() < len(rows)


def _with_null(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], names=["g", "n", "fp", "prev"])


def test_sets_of_one_fingerprint_are_a_pair(spark):
    df = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7 ^ 0b111, 4), (-1, 5)], "sim long, fp long")
    assert sorted(map(tuple, simhash.tree_pairs(df).collect())) == [(1, 2), (1, 3), (1, 4)]
