"""Every stage of the pipeline on odd rows: nulls, empty and repeated texts, clashing columns, an empty table."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, `my col` string, rid int, id string, body string, whole int, node string, root string, fp int, n int, length int"
LONG = " ".join(f"word{k}" for k in range(400))
ROWS = [
    (1, "the same text of a few words here", "en", "s0"), (2, "the same text of a few words here", "en", "s0"), (2, "the same text of a few words here", "en", "s0"), (None, "the same text of a few words here", "en", None), (3, None, None, None), (None, None, "de", "s1"), (4, "", "en", "s1"),
    (5, "   ", None, "s0"), (6, LONG, "en", "s2"), (7, LONG + " end", "en", "s2"), (8, "x", "fr", "s3"), (9, "日本 語 é", "und", ""),
]


def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "a b", k, "i", "b", 1, "n", "r", 2, 3, 4) for k, r in enumerate(ROWS)], DDL)


def kept(df):
    return sorted((r["rid"] for r in df.select("rid").collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs(spark), SF)
    empty = stage(spark, docs(spark).limit(0), SF)
    assert empty.count() == 0
    if name == "best_fit_packing":
        assert sum(r["length"] for r in got.collect()) > 400 and got.count() == len(ROWS)
        return
    assert got.columns == docs(spark).columns == empty.columns
    if name == "toxicity":
        assert kept(got) == list(range(len(ROWS)))
    elif name == "exact_dedup":
        assert kept(got) == [0, 4, 7, 8, 9, 10, 11]  # null and empty texts are equal, three spaces are another text
    elif name == "simhash_near_dedup":
        left = kept(got)
        assert 8 in left and 9 not in left and 0 in left and not {1, 2, 3} & set(left)
    else:
        assert set(kept(got)) <= set(range(len(ROWS))) and got.count() > 0
