"""Token records and packing: exact round trips against the tokenizers library."""

import glob
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from mapstone.llm import packing, records
from mapstone.llm.common import tokenizer_path
from mapstone.llm.tokens import encoder

TEXTS = [
    "", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "it's don't I'LL, go. now", "ÀÉ. Ünï, éa ́b", "a\tb c", "<|endoftext|> x", "a <|endoftext|> b", "a<|startoftext|>b <|ENDOFTEXT|>.", "<|endoftext",  "x\0 a", "日本 語。テスト ok.", "x.\r\ny z",
    "ΣΑΣ. ΟΔΟΣ", "İstanbul I.", "foo.. bar,, baz!. 12. a1. 3,", "\n a", "a\n", "_. a_, x._y ..", "word " * 9000, "é. café, x", "ﬁ ﬂ Å Ω", "　 a b",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_the_librarys(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(name))
    r = random.Random(4)
    alphabet = list("abcdeAÉéß .,\n'!#1½ıſ") + ["  ", ". ", ", "]
    texts = TEXTS + ["".join(r.choices(alphabet, k=r.randint(1, 80))) for _ in range(1500)]
    enc = encoder(name)
    for t in texts + texts:  # the second time from the cache
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def plain_ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def docs(spark):
    rows = [(i * 7 % 23, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (99, None, "x", 1), (99, None, "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, id string, part int")


def test_records_round_trip(spark, tmp_path):
    rows, df = docs(spark)
    got = records.tokens_to_records(df, out=str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(((-1 if i is None else i), plain_ids("byte_bpe_50k.json", t, 2)) for i, t, *_ in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None if i < 0 else i for i, _ in want]
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, x in want)


def test_seek_by_index_and_damage(spark, tmp_path):
    _, df = docs(spark)
    manifest = records.write_records(df, str(tmp_path), "byte_bpe_50k.json", 2)
    for m in manifest:
        back = [records.read_at(m["file"], k) for k in reversed(range(m["records"]))]
        assert sum(len(x) for _, x in back) == m["ids"] and all(x[-1] == 2 for _, x in back)
    path = glob.glob(str(tmp_path / "*.rec"))[0]
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError), open(path, "rb") as f:
        records.read_frame(f)
    assert records.tokens_to_records(df.limit(0), out=str(tmp_path / "none")).count() == 0


def test_packing_is_gapless_and_tight(spark):
    rows, df = docs(spark)
    got = packing.best_fit_pack(df, with_ids=True).collect()
    by_seq = {}
    for r in got:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert total == sum(len(plain_ids("word_bpe_49k.json", t, 0)) for _, t, *_ in rows)
    assert len(by_seq) == -(-total // 2048)
    long = sorted((r for r in got if r.doc_id == TEXTS.index("word " * 9000) * 7 % 23 and (r.length == 2048 or r.piece)), key=lambda r: r.piece)
    assert [r.piece for r in long] == list(range(len(long))) and all(r.length == 2048 for r in long[:-1]) and [r.start for r in long] == [2048 * k for k in range(len(long))]
    assert packing.best_fit_pack(df.limit(0)).count() == 0


def best_fit_one_by_one(lengths, room):
    """The plain algorithm, item by item."""
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits)[1]] -= x
        else:
            left.append(room - x)
    return len(left)


def test_plan_on_counts_equals_best_fit_on_items():
    r = random.Random(8)
    cases = [{33: 9, 5: 9, 50: 8, 8: 11}, {40: 5, 20: 20, 1: 3}]
    cases += [{r.randint(1, r.choice([20, 60, 100])): r.randint(1, 12) for _ in range(r.randint(1, 10))} for _ in range(2_000)]
    cases += [Counter(r.randint(1, r.choice([20, 60, 100])) for _ in range(r.randint(1, 300))) for _ in range(40)]
    for histogram in cases:
        lengths = [x for x, n in histogram.items() for _ in range(n)]
        got = packing.plan(histogram, 100)
        assert sum(n for _, n in got) == best_fit_one_by_one(lengths, 100)
        assert sorted(x for p, n in got for x in p for _ in range(n)) == sorted(lengths) and all(sum(p) <= 100 for p, _ in got)
        ranks = sorted((a, b + i) for a, b, n, _, _ in packing.slots(got) for i in range(n))
        assert ranks == sorted((x, i) for x in histogram for i in range(histogram[x]))
