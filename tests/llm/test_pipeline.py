"""The pipeline, each stage held against a brute-force version of it on what the stage before kept."""

import zlib

import corpus_pipeline
import numpy as np
from mapstone.llm import toxicity
from mapstone.llm.mixing import WEIGHTS
from mapstone.llm.queries import QUERIES

from .test_dedup import norm
from .test_learned import water_fill
from .test_near_stage import least
from .test_tokens import plain_ids

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def domain_of(source):
    import hashlib

    return f"d{int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 4}"


def mixed(rows, share=0.8, seed=7):
    """One epoch of hierarchical budgeting in plain Python: the chosen identifiers."""
    import hashlib

    tokens = {r.doc_id: (len((r.text or "").encode()) + 3) // 4 for r in rows}
    leaf = {}
    for r in rows:
        leaf.setdefault((domain_of(r.source), r.lang, r.source), []).append(r.doc_id)
    supply = {k: sum(tokens[i] for i in v) for k, v in leaf.items()}
    weight = lambda level, v: WEIGHTS[level].get(v, 1)
    total, chosen = int(sum(supply.values()) * share), []
    cap = lambda *key: sum(n for k, n in supply.items() if k[: len(key)] == key)
    for d, b in water_fill([(d, weight("domain", d), cap(d)) for d in {k[0] for k in leaf}], total).items():
        for x, b2 in water_fill([(x, weight("lang", x), cap(d, x)) for x in {k[1] for k in leaf if k[0] == d}], b).items():
            for s, b3 in water_fill([(s, 1, supply[d, x, s]) for s in {k[2] for k in leaf if k[:2] == (d, x)}], b2).items():
                own = leaf[d, x, s]
                if supply[d, x, s] and b3 >= supply[d, x, s]:
                    chosen += own
                    continue
                used = 0
                for i in sorted(own, key=lambda i: (hashlib.md5(f"{seed}:0:{i}".encode()).hexdigest(), i)):
                    used += tokens[i]
                    if used > b3:
                        break
                    chosen.append(i)
    return sorted(chosen)


def test_each_stage_equals_its_brute_force_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows, got = at.collect(), stage(spark, at, SF)
        assert got.columns == docs.columns
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.train(at, labels))
            want = [r.doc_id for r in rows if scorer.score(r.text or "") < 0.5]
        elif name == "exact_dedup":
            first = {}
            for r in sorted(rows, key=lambda r: r.doc_id):
                first.setdefault(norm(r.text), r.doc_id)
            want = list(first.values())
        elif name == "simhash_near_dedup":
            want = least((r.doc_id, r.text) for r in rows)
        else:
            want = mixed(rows)
        assert ids(got) == sorted(want), name
        assert got.count() > 0
        at = spark.createDataFrame(got.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    pieces = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packed}
    want = {}
    for r in at.collect():
        x = np.array(plain_ids("word_bpe_49k.json", r.text, 0), "<u4")
        want |= {(r.doc_id, k): (len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(x), 2048))}
    assert pieces == want
    fill = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted([*[f"op{k}" for k in range(1, 14)], "pipeline"])
