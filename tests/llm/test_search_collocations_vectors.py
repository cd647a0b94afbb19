"""Lexical search, collocations and vector packing against brute force, on odd rows as well."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from mapstone.llm import collocations, lexical_search, vector_packing, words
from mapstone.llm.common import tokenizer_path
from mapstone.llm.tokens import Encoder
from pyspark.sql import functions as F

WORDS = "the cat Sat on É mat été 日本 a1 x".split()


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ".", "\n", "\t", " - "]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_search(docs, items, most):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    terms = [(i, x) for i, x in terms if x]
    n, total = len(terms), sum(len(x) for _, x in terms)
    df = Counter(w for _, x in terms for w in set(x))
    out = []
    for item, t in items:
        found = []
        for i, x in terms:
            m, tf, score = 100 - 50 + (50 * len(x) * n) // total, Counter(x), 0
            for w in set(TERM.findall((t or "").translate(LOW))):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("limit", [lexical_search.WANTED, 0])
def test_search_equals_brute_force(spark, limit):
    docs = [(i * 7 % 97, t) for i, t in enumerate(texts(60))] + [(200, None), (201, ""), (202, "ONLY once"), (203, "the " * 40_000), (204, "…—–")]
    items = [(1, "the CAT, the été"), (2, None), (3, "nothing"), (4, "once only 日本 a1"), (5, "")]
    got = lexical_search.search(frame(spark, [(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, rid int"), frame(spark, items, "item_id long, text string"), most=7, wanted_limit=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_search(docs, items, 7)


def test_search_repeats_nulls_and_empty(spark):
    docs = frame(spark, [(1, "cat mat"), (1, "cat mat"), (None, "cat mat"), (2, "sat")], "doc_id long, text string")
    items = frame(spark, [(1, "cat"), (1, "cat"), (None, "cat")], "item_id long, text string")
    got = lexical_search.search(docs, items).collect()
    assert len(got) == 9 and sorted(r["rank"] for r in got) == [1, 1, 1, 2, 2, 2, 3, 3, 3] and all(r["doc_id"] is None for r in got if r["rank"] == 3)
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def plain_collocations(docs, least, longest, most):
    f, n = Counter(), Counter()
    for lang, t in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    rows, over = defaultdict(list), Counter()
    for (lang, p), a in f.items():
        if len(p) > 2 and a >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[lang, p[i : i + k]] = max(over[lang, p[i : i + k]], a)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and not (over[lang, p] and 100 * over[lang, p] >= 80 * a):
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, got in rows.items() for k, (s, a, p, x, y) in enumerate(sorted(got)[:most]))


@pytest.mark.parametrize(("wave", "vocabulary"), [(collocations.WAVE_WORDS, collocations.VOCABULARY), (20_000, collocations.VOCABULARY), (30_000, 0)])
def test_collocations_equal_brute_force(spark, wave, vocabulary):
    docs = [(["en", None, "und", "de"][i % 4], t) for i, t in enumerate(texts(160, 5))] + [("en", None), ("en", ""), ("fr", " .,;"), ("de", "so so so so so " * 9000)] + [("es", "uno dos  tres\tcuatro")] * 9
    df = frame(spark, [(lang, t, 1, "b") for lang, t in docs], "lang string, text string, part int, word string").repartition(5)
    got = collocations.collocations(df, least=8, most=40, wave_words=wave, vocabulary_limit=vocabulary)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(docs, 8, 4, 40)


def test_collocations_of_nothing_and_exact_scores(spark):
    empty = frame(spark, [], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(frame(spark, [("en", "a b"), ("en", None)], "lang string, text string")).count() == 0
    big = frame(spark, [([1, 2], 9 * 10**17, [10**18, 9 * 10**17])], "ids array<long>, a long, parts array<long>")
    cut = big.select(collocations.lowest_cut(F.col("parts"), F.col("a")).alias("c")).first()["c"]
    assert cut["score"] == 2000000 * 9 * 10**17 // (10**18 + 9 * 10**17)


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 20_000))
    n = collocations.Numbers(keys)
    assert sorted(n(keys).tolist()) == list(range(len(keys)))
    assert (n(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (collocations.Numbers(np.zeros(0, np.int64))(keys) == -1).all()


def test_batch_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(2)
    bits = list("abcÉéß .,\n'!#1½ſ_—×日́ \u0085\t\0İ²") + ["  ", ". ", ", ", " word", "<|endoftext|>"]
    some = [None, "", *["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(4000)], *[" ".join("".join(r.choices("abÉé.,1İ—", k=r.randint(1, 6))) for _ in range(r.randint(1, 8))) for _ in range(4000)]]
    enc = Encoder("byte_bpe_50k.json", 5000)
    for lo in range(0, len(some), 900):
        ids, offs = enc.encode_batch(pa.array(some[lo : lo + 900], pa.string()).slice(1))
        for k, t in enumerate(some[lo + 1 : lo + 900]):
            assert ids[offs[k] : offs[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_word_encoding_of_dotted_capitals():
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Encoder("word_bpe_49k.json", 5000)
    r = random.Random(3)
    cased = [chr(c) for c in range(0x41, 0x2000) if chr(c).lower() != chr(c) or 0x300 <= c < 0x370]
    for _ in range(4000):
        t = "".join(r.choice(cased) if r.random() < 0.5 else r.choice("İa .,") for _ in range(r.randint(1, 12)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_gathered_splits_and_joins():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k % 7) for k in range(50)])], names=["rid", "body"])
    for most in (1, 10, 1000):
        got = list(words.gathered([b.slice(0, 20), b.slice(20, 0), b.slice(20)], most=most))
        assert [x for t in got for x in t.column("rid").to_pylist()] == list(range(50))
    assert list(words.gathered([])) == [] and list(words.gathered([b.slice(0, 0)])) == []


def pieces_of(rows):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    return by, seq


def test_vector_packing_is_whole_and_unpadded(spark):
    enc = Encoder("byte_bpe_50k.json")
    some = [(i, t) for i, t in enumerate(texts(300, 9))] + [(400, None), (401, ""), (402, "long words " * 9000), (None, "no id")] + [(500 + k, "x") for k in range(300)]
    df = frame(spark, [(i, t, "s", 2) for i, t in some], "doc_id long, text string, parts string, tokens int").repartition(3)
    rows = vector_packing.pack_examples(df, vector_packing.Limits(512, 6, 512)).collect()
    by, seq = pieces_of(rows)
    for i, t in some:
        ids, at = np.append(np.frombuffer(enc.encode(t or ""), "<u4"), np.uint32(1)), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in seq.values():
        n = sum(r.length for r in s)
        assert len(s) <= 6 and n <= 512 and n & (n - 1) == 0
    assert vector_packing.pack_examples(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_packing.pack_examples(df, vector_packing.Limits(0, 1, 1))


@pytest.mark.parametrize("cut", [True, False])
def test_vector_packing_of_answers(spark, cut):
    r = random.Random(5)
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(r.choices(WORDS, k=r.randint(0, 90)))) for c in range(40) for t in range(6)] + [(99, 0, "assistant", "no prompt"), (None, 1, "assistant", None)]
    ex = vector_packing.answers(frame(spark, talk, "conv_id long, turn long, role string, text string"))
    assert ex.count() == 40 * 3 + 2
    lim = vector_packing.Limits(256, 5, 100)
    rows = vector_packing.pack_examples(ex.repartition(2), lim, cut=cut, parts="parts").collect()
    _, seq = pieces_of(rows)
    for s in seq.values():
        n = sum(r.length for r in s)
        assert len(s) <= 5 and n <= 256 and sum(r.loss_tokens for r in s) <= 100 and (not cut or n & (n - 1) == 0)
    enc = Encoder("byte_bpe_50k.json")
    told = {(c, t): x for c, t, _, x in talk}
    size = lambda x: len(enc.encode(x or "")) // 4
    assert sum(r.loss_tokens for r in rows) == sum(size(x) + 1 for c, t, who, x in talk if who == "assistant")
    assert sum(r.length for r in rows) == sum(size(x) + size(told.get((c, t - 1))) + 1 for c, t, who, x in talk if who == "assistant")
    if not cut:
        assert all(r.length == r.doc_tokens for r in rows if r.doc_tokens < 100)


def test_keys_are_not_sorted_again_for_each_array(monkeypatch):
    import numpy as np
    from mapstone.llm import collocations as C

    r, work, own = np.random.default_rng(5), [], np.union1d
    arrays = [np.unique(r.integers(0, 1 << 40, 100)) for _ in range(256)] + [np.zeros(0, np.int64), np.array([-5, 7])]
    monkeypatch.setattr(np, "union1d", lambda a, b: work.append(len(a) + len(b)) or own(a, b))
    got = C.united(iter(arrays))
    assert got.tolist() == sorted({x for a in arrays for x in a.tolist()}) and got.dtype == np.int64
    assert sum(work) < 20 * sum(map(len, arrays))  # one by one it were 129 times
    assert C.united([]).tolist() == []
