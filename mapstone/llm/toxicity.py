"""Toxicity by noisy-channel deobfuscation: restore disguised words first, then score the restored text.

A token may be disguised by look-alike signs (1d10t), by separators between its letters (i-d-i-o-t, i d i o t, one
letter a line) or by repeated letters (idiooot, iidioot). Such tokens are found in the whole text; each is a lattice in which every character has
readings (itself, the letters it looks like, nothing for a separator, one or two letters for a run of repeats) with
channel costs. A sign may also end a word, and so may every letter of a spaced run. The Viterbi path under a character language model of the corpus restores the words, whatever the length.

The score is a logistic model over the presence of words and word beginnings that the labels show to be toxic, in the
text as it stands and in its restored tokens. Features are chosen by a likelihood-ratio test whose level falls with the
number of candidates, so chance words don't enter.

Training takes a bounded sample: at most about TRAIN_ROWS labelled documents outside the held-out fold, chosen by a
hash of the identifier. The character model counts the n-grams of all texts. Scoring reads whole texts.

Defined results: null and empty texts score the model's bias, which is always below 0.5; with no labelled row, one label only,
or no feature that the labels show, every score is that, so nothing is dropped for want of a model; labels that are null are
not used; null identifiers are not held out and not trained on; repeated rows score alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, materialize, ship

TRAIN_ROWS = 12_000
MAX_FEATURES = 4_000
BEGINNINGS = (4, 5, 6)
ORDER = 4
#: What a sign may stand for, with the cost (negative log probability) of the disguise.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou", "%": "",
}
#: The bias goes no lower, so that one plain piece of evidence can decide: about 1 in 100 without any.
#: The highest log odds of a text without evidence.
CLEAN = -0.1
NO_EVIDENCE = -4.6
SUBSTITUTED, DROPPED, DOUBLED, BROKEN = 2.0, 1.0, 1.0, 0.5
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:(?:\s+|[ .\-_*]{1,2})[^\W_]){2,}(?![^\W_])")
_GAP = re.compile(r"\s+")
_EDGES = ".,;:?!\"'()[]{}<>«»„“”‘’¿¡…-–—_#%&*$=/\\~^`+|"
_PLAIN_EDGES = "".join(c for c in _EDGES if c not in LOOKS)
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
_ANY_SIGN = re.compile(r"[\W_]+")
_INNER = re.compile("[" + re.escape("".join(c for c in _EDGES if c not in LOOKS)) + "]+")  # signs that look like no letter


def lowered(text: str) -> str:
    """The text in lower case, with compatibility forms (full-width letters and the like) as plain ones."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def char_grams(words: Counter) -> Counter:
    """Counts of the characters of words between boundaries, and of those with up to ORDER - 1 before them."""
    grams, pad = Counter(), "^" * (ORDER - 1)
    if not words:
        return grams
    codes = np.frombuffer("".join([f"{pad}{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    alphabet, ids = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * ORDER > 63:  # more letters than a key holds: by parts with fewer, or longer words alone by their parts
        if len(words) > 1:
            items = list(words.items())
            return char_grams(Counter(dict(items[::2]))) + char_grams(Counter(dict(items[1::2])))
        (w, n), = words.items()
        s = pad + w + "$"
        for i in range(ORDER - 1, len(s)):
            for k in range(1, ORDER + 1):
                grams[s[i - k + 1 : i + 1]] += n
        return grams
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(np.arange(len(codes)) - first >= ORDER - 1)
    weight, key = np.repeat(np.fromiter(words.values(), np.int64, len(words)), size)[at], np.zeros(len(at), np.int64)
    for k in range(ORDER):
        key |= ids[at - k].astype(np.int64) << (bits * k)
        u, inverse = np.unique(key, return_inverse=True)
        letters = np.stack([alphabet[u >> (bits * j) & ((1 << bits) - 1)] for j in range(k, -1, -1)], 1)
        text = np.ascontiguousarray(letters, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
        n = np.bincount(inverse, weight).astype(np.int64).tolist()
        grams.update(dict(zip((text[i : i + k + 1] for i in range(0, len(text), k + 1)), n, strict=True)))
    return grams


def corpus_grams(docs: DataFrame, text: str = "text", held: int = 60_000) -> dict[str, int]:
    """char_grams of all words of all texts. What comes to the driver grows with the alphabets, not with the rows."""
    ship(docs.sparkSession)

    def run(batches):
        words, grams = Counter(), Counter()
        for b in batches:
            for body in b.column(0):
                words.update(_WORD.findall(lowered(body.as_py())))
            if len(words) > held:
                grams.update(char_grams(words))
                words = Counter()
        grams.update(char_grams(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["g", "n"])

    own = docs.select(F.col(text).cast("string").alias("body")).where("body IS NOT NULL")
    return {r.g: r.n for r in own.mapInArrow(lean(run), "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}


class CharModel:
    """A character language model with stupid backoff, of char_grams."""

    def __init__(self, counts: dict[str, int]) -> None:
        grams: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        for g, n in counts.items():
            grams[len(g)][g] = n
        self.total = max(1, sum(grams[1].values()))
        self.logs: dict[str, float] = {c: math.log(n / self.total) for c, n in grams[1].items()}
        heads: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for k in range(2, ORDER + 1):
            for g, n in grams[k].items():
                heads[k][g[:-1]] += n
            for g, n in grams[k].items():
                self.logs[g] = math.log(n / heads[k][g[:-1]])
        self.unseen = math.log(0.5 / self.total)

    def log(self, before: str, c: str) -> float:
        cost = 0.0
        for k in range(ORDER - 1, -1, -1):
            got = self.logs.get((before[-k:] if k else "") + c)
            if got is not None:
                return cost + got
            cost -= 0.9
        return cost + self.unseen


def readings(c: str, n: int) -> list[tuple[str, float]]:
    """What n times a sign may stand for, with costs; a space ends a word."""
    if c.isalpha():
        if n == 1:
            return [(c, 0.0)]
        return [(c + c, 0.0), (c, 3 * DOUBLED)] if n == 2 else [(c, 0.0), (c + c, DOUBLED)]  # two of a letter are mostly meant
    letters = [(x, SUBSTITUTED) for x in LOOKS.get(c, "")]
    if n > 1:
        letters = [y for x, cost in letters for y in ((x, cost), (x + x, cost + (DOUBLED if n > 2 else 0.0)))]
    return [*letters, ("", DROPPED * n), (" ", DROPPED * n)]


def runs_of(token: str) -> list[tuple[str, int]]:
    return [(c, len(list(g))) for c, g in groupby(token)]


def restore(token: str, lm: CharModel, within: float = 4.0, most: int = 4, spaced: bool = False) -> list[str]:
    """The likeliest words behind a disguised token, best first: Viterbi over its lattice, states being the last letters.

    Several words are one reading, with spaces between; in a spaced run a word may end after each letter. All states are
    kept. Paths are linked back, so the work grows with the length only.
    """
    start = "^" * (ORDER - 1)
    beams: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for c, n in runs_of(token):
        choices = readings(c, n)
        after: dict[str, tuple[float, tuple | None]] = {}
        if spaced:
            ended = max(((score + lm.log(s, "$") - BROKEN, path) for s, (score, path) in beams.items() if s != start), key=lambda x: x[0], default=None)
            if ended and (start not in beams or beams[start][0] < ended[0]):
                beams[start] = ended[0], (ended[1], " ")
        for state, (score, path) in beams.items():
            for text, cost in choices:
                s, total = state, score - cost
                for x in text:
                    if x == " ":
                        total += lm.log(s, "$") if s != start else 0.0
                        s = start
                        continue
                    total += lm.log(s, x)
                    s = (s + x)[1 - ORDER :]
                if s not in after or after[s][0] < total:
                    after[s] = total, (path, text) if text else path
        beams = after

    def read(path) -> str:
        texts = []
        while path is not None:
            path, text = path
            texts.append(text)
        return "".join(reversed(texts)).strip()

    ends = sorted(((score + (lm.log(s, "$") if s != start else 0.0), path) for s, (score, path) in beams.items()), key=lambda x: -x[0])
    return list(dict.fromkeys(read(path) for score, path in ends[:most] if score >= ends[0][0] - within))


def squeezed(word: str) -> str:
    return _DOUBLE.sub(r"\1", word)


def disguised(low: str, known: frozenset[str] = frozenset()) -> set[tuple[str, bool]]:
    """Tokens of a lower-case text that may be disguised words, without the signs around them; with whether they are spaced runs.

    A token with signs inside counts whole and by its parts. A word whose only repeats are of two letters counts if it is
    one of known (squeezed words) without them.
    """
    words = set(low.split())
    signed = {w for w in words if not w.isalpha()}
    pieces = {w.rstrip(_EDGES).lstrip(_PLAIN_EDGES) for w in signed}
    for w in [w for w in pieces if not w.isalpha()]:
        pieces.update(_INNER.split(w))
        pieces.update(_ANY_SIGN.split(w))
    out = {(w, False) for w in pieces if 3 <= len(w) and not w.isalpha() and not w.isdigit() and sum(map(str.isalpha, w)) >= 2}
    if _REPEAT.search(low):
        out |= {(w, False) for w in _WORD.findall(low) if _REPEAT.search(w)}
    if known:
        plain = (words - signed) | {p for p in pieces if p.isalpha()}
        out |= {(w, False) for w in plain if _DOUBLE.search(w) and squeezed(w) in known}
    out |= {(_GAP.sub("", m), True) for m in _SPACED.findall(low)}
    return out


def parts(word: str) -> list[str]:
    """The features of a word: the word and its beginnings (marked by ~)."""
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) >= k)]


class Scorer:
    """Finds a model's features in texts."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.model, self.weights = model, model["weights"]
        self.lm = CharModel(model["grams"])
        self.restored: dict[tuple[str, bool], tuple[str, ...]] = {}
        self.find = ahocorasick.Automaton()
        for f in self.weights:
            bare = f.rstrip("~")
            held = self.find.get(bare, ())
            self.find.add_word(bare, (*held, f))
        if len(self.find):
            self.find.make_automaton()
        self.known = frozenset(squeezed(f) for f in self.weights if f[-1] != "~")

    def features(self, text: str) -> set[str]:
        low, found = lowered(text), set()
        if len(self.find):
            n = len(low)
            for end, names in self.find.iter(low):
                for f in names:
                    start = end + 1 - len(f.rstrip("~"))
                    if start and low[start - 1].isalpha():
                        continue
                    if f[-1] == "~" or end + 1 == n or not low[end + 1].isalpha():
                        found.add(f)
        for w in disguised(low, self.known):
            got = self.restored.get(w)
            if got is None:
                got = tuple({f for x in restore(w[0], self.lm, spaced=w[1]) for y in x.split() for f in parts(y) if f in self.weights})
                if len(self.restored) < 50_000:
                    self.restored[w] = got
            found.update(got)
        return found

    def score(self, text: str) -> float:
        z = self.model["bias"] + sum(self.weights[f] for f in self.features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _g2(n1: int, n0: int):
    """Likelihood-ratio statistic of a feature that pos of n1 toxic and neg of n0 clean documents have, if it speaks for toxic."""
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    p = (a + b) / (n1 + n0)
    part = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)
    both = part(a, n1 * p) + part(n1 - a, n1 * (1 - p)) + part(b, n0 * p) + part(n0 - b, n0 * (1 - p))
    return F.when(a / n1 > b / n0, 2 * both).otherwise(0.0)


def fit(rows: list[tuple[int, list[str]]], weights_from: list[str], steps: int = 800) -> tuple[dict[str, float], float]:
    """Logistic weights (never negative: a feature is evidence) and bias from (label, features of a document)."""
    index = {f: k for k, f in enumerate(weights_from)}
    doc = np.array([i for i, (_, fs) in enumerate(rows) for f in fs if f in index], int)
    feat = np.array([index[f] for _, fs in rows for f in fs if f in index], int)
    y = np.array([t for t, _ in rows], float)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))  # both labels weigh the same
    prior = min(math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), CLEAN)
    w, bias = np.zeros(len(index)), prior
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[feat], len(y)) + bias
        e = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append((np.bincount(feat, e[doc], len(w)) if len(w) else np.zeros(0)) / len(y) + 1e-5 * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = np.maximum(w - step[:-1], 0), min(max(bias - step[-1], NO_EVIDENCE), prior)  # no evidence never speaks for toxic
    return {f: float(w[k]) for f, k in index.items() if w[k] > 1e-3}, float(bias)


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, rows: int) -> DataFrame:
    """toxic, body of a bounded sample of the labelled documents outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("id")) != 0))
    own = own.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    if n > rows:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body")).where("body IS NOT NULL")
    both = texts.join(F.broadcast(own), "id")  # about `rows` pairs of numbers
    n = both.count()
    if n > 2 * rows:  # identifiers repeat
        both = both.where(F.pmod(F.xxhash64("id", "body"), F.lit(1 << 30)) < int((1 << 30) * rows / n)).distinct()
    return materialize(both, "labelled")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> dict:
    """The model: bias, weights of features and the n-grams of the character model, which are those of all texts."""
    spark = docs.sparkSession
    ship(spark)
    some = labelled(docs, labels, text, doc_id, rows)

    def count(batches):
        pos, neg, words, n = Counter(), Counter(), Counter(), [0, 0]
        for b in batches:
            for t, body in zip(b.column("toxic").to_pylist(), b.column("body"), strict=True):
                seen = Counter(_WORD.findall(lowered(body.as_py())))
                words.update(seen)
                (pos if t else neg).update({f for w in seen if len(w) >= 3 for f in parts(w)})
                n[t] += 1
        out = [("", n[1], n[0], 0)] + [(f, pos[f], neg[f], words.get(f, 0)) for f in pos.keys() | neg.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["f", "pos", "neg", "n"])

    schema = "f string, pos long, neg long, n long"
    counts = some.select("toxic", "body").mapInArrow(lean(count), schema).groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n"))
    counts = materialize(counts.where("f = '' OR pos >= 3 OR n >= 2"), "counts")
    total = next(((r["pos"], r["neg"]) for r in counts.where("f = ''").collect()), (0, 0))
    if not total[0] or not total[1]:
        return {"bias": CLEAN, "weights": {}, "grams": char_grams(Counter("a"))}  # nothing to learn from: nothing is toxic
    level = 2 * math.log(max(2, counts.count())) + 4
    rated = counts.where("f <> '' AND pos >= 3").withColumn("g", F.round(_g2(*total), 9)).where(F.col("g") > level)
    got = rated.orderBy(F.desc("g"), F.desc("f")).limit(MAX_FEATURES).collect()
    chosen, seen = [r["f"] for r in got], {r["f"]: r["n"] for r in got}
    grams = Counter(corpus_grams(docs, text))
    grams += char_grams(Counter({f: 50 - seen[f] for f in chosen if f[-1] != "~" and seen[f] < 50}))  # words that matter are well known to the language model
    first = {"bias": 0.0, "weights": dict.fromkeys(chosen, 0.0), "grams": dict(grams)}
    held = spark.sparkContext.broadcast(first)  # at most MAX_FEATURES weights, and n-grams of ORDER characters

    def find(batches):
        scorer = Scorer(held.value)
        for b in batches:
            found = [sorted(scorer.features(x.as_py())) for x in b.column("body")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    rows_ = [(r["toxic"], r["found"]) for r in some.select("toxic", "body").mapInArrow(lean(find), "toxic int, found array<string>").collect()]  # bounded by rows
    weights, bias = fit(sorted(rows_), sorted(chosen))
    return {"bias": bias, "weights": weights, "grams": dict(grams)}


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Reads nothing but the text to score."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(F.col(doc_id).cast("long")) == 0, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("body"),
    )
    held = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights, and n-grams of ORDER characters

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            got = [scorer.score(x.as_py() or "") for x in b.column("body")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return own.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labels outside the held-out fold and score every document."""
    return score(docs, train(docs, labels, text, doc_id, rows), text, doc_id)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    held = spark.sparkContext.broadcast(train(docs, labels, text, doc_id, rows))

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(x.as_py() or "") < 0.5 for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)  # each row goes through once and comes back as it is
