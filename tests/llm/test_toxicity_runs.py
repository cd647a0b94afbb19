"""Disguises of any length, and words inside of spaced runs."""

import random
from collections import Counter

import pytest
from mapstone.llm import toxicity

WORDS = "he is a an and you are the one who said that idiot fool clever person over there know it was good bad day".split()


def scorer():
    r = random.Random(1)
    words = Counter(r.choices(WORDS, k=5_000))
    return toxicity.Scorer({"bias": -4.6, "weights": {"idiot": 6.0, "idio~": 3.0}, "grams": toxicity.char_grams(words)})


@pytest.mark.parametrize(
    "text",
    [
        "he is " + " ".join("aidiot"),
        " ".join("youareanidiot"),
        " ".join("youareanidiotandthatisgoodandthatisbadandyouknowitwasagoodday"),
        "idi" + "o" * 100 + "t",
        "you-are-the-one-who-said-that-it-was-good-1d10t-and-bad",
        "i-d-i-o-t" + "-and-that-was-good" * 5,
    ],
)
def test_insults_are_found_at_any_length(text):
    assert "idiot" in scorer().features(text)


def test_clean_runs_stay_clean():
    for text in (" ".join("heisagoodperson"), " ".join("youknowthatitwasabadday" * 5), "good-day-to-the-clever-person-over-there-and-you", "goo" + "o" * 90 + "d"):
        assert not scorer().features(text)


def test_character_model_is_of_all_texts(spark):
    rows = [(i, "clever person over there" if i % 2 else "idiot person over there") for i in range(60)] + [(i, "xylophon zzyzx xylophon") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    words = Counter(w for _, t in rows for w in t.split())
    assert toxicity.corpus_grams(docs, held=3) == toxicity.char_grams(words)
    grams = toxicity.train(docs, labels, rows=20)["grams"]
    assert grams["zzyz"] == 40 and grams["^xyl"] == 80


def by_brute_force(token, lm, spaced):
    """The score of the best of all readings of a lattice."""
    ways = [[]]
    for c, n in toxicity.runs_of(token):
        ways = [w + [(b, *x)] for w in ways for b in ((False, True) if spaced and w else (False,)) for x in toxicity.readings(c, n)]
    best = {}
    for way in ways:
        text, score, broken = "", 0.0, 0.0
        for b, x, cost in way:
            if b and text and text[-1] != " ":
                text, broken = text + " ", broken + toxicity.BROKEN
            text, score = text + x, score - cost
        for word in text.split():
            s = "^" * (toxicity.ORDER - 1) + word + "$"
            score += sum(lm.log(s[i - toxicity.ORDER + 1 : i], s[i]) for i in range(toxicity.ORDER - 1, len(s)))
        text = " ".join(text.split())
        best[text] = max(best.get(text, -1e9), score - broken)
    return best


@pytest.mark.parametrize("token,spaced", [("1d10t", False), ("i-d!0t", False), ("foool", False), ("b@d,1t", False), ("iidioott", False), ("go0dd@y", False), ("isabad", True), ("heis1t", True), ("y.0.u", True)])
def test_the_best_path_is_that_of_all_readings(token, spaced):
    lm = scorer().lm
    best = by_brute_force(token, lm, spaced)
    got = " ".join(toxicity.restore(token, lm, spaced=spaced)[0].split())
    assert best[got] == pytest.approx(max(best.values()), abs=1e-9)


@pytest.mark.parametrize("text", ["i   d   i   o   t", "i\nd\ni\no\nt", "1d10t,you", "you,1d10t!ok", "idiiot", "iidioot", "ｉｄｉｏｔ", "ID​IOT", "y o u i d i o t"])
def test_other_disguises(text):
    assert "idiot" in scorer().features(text)


def test_ngrams_are_those_of_a_plain_count():
    words = Counter({"idiot": 3, "é": 2, "漢字": 1, "straße": 7, "a" * 50: 2})
    want = Counter()
    for w, n in words.items():
        s = "^^^" + w + "$"
        for i in range(3, len(s)):
            for k in range(1, 5):
                want[s[i - k + 1 : i + 1]] += n
    assert toxicity.char_grams(words) == want
    many = Counter({"".join(chr(0x4E00 + 7 * i + j) for j in range(7)): 1 for i in range(2900)} | {"".join(chr(0xAC00 + i) for i in range(11_000)): 1, "".join(chr(0x3400 + i) for i in range(6_000)): 2})
    assert sum(toxicity.char_grams(many).values()) == sum(n * (4 * len(w) + 4) for w, n in many.items())  # more letters than a key holds


def test_a_repeated_identifier_doesnt_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, "bad words") for _ in range(500)] + [(i, f"text {i}") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, "text", "doc_id", 100).where("id = 1").count() <= 1


@pytest.mark.parametrize("toxic", [[0, 1] * 5, [1] * 10, []])
def test_nothing_is_dropped_where_nothing_is_learned(spark, toxic):
    from mapstone.llm.toxicity import drop_toxic, toxicity

    docs = spark.createDataFrame([(k, f"plain text of number {k}" if k else None) for k in range(21)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert drop_toxic(docs, labels).count() == 21
    assert {r["predicted"] for r in toxicity(docs, labels).collect()} == {0}
