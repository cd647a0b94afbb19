"""Language identification by error-correcting output codes over character n-grams.

Every language gets a binary codeword. For each bit a logistic classifier over hashed character n-grams (1 to 3, lower
case, signs and digits as space) says how likely the bit is set. Decoding is loss-weighted: the codeword with the least
sum of logistic losses over the bits, each weighted by how reliable its classifier was on a held-back part of the
training sample, is the prediction; where the second codeword is nearly as near, the prediction is flagged ambiguous.

Training takes a bounded sample: at most about TRAIN_ROWS labelled documents, chosen by a hash of the identifier; their
n-gram counts (at most BUCKETS numbers a document) are counted on the executors. Predictions read whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; with no labelled document at all every
prediction is `und`; with one language only, it is predicted with score 1; null identifiers count as not held
out and are never used to train; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship

TRAIN_ROWS = 4_000
BUCKETS = 1 << 13
AMBIGUOUS = 0.2
_CHUNK = 1 << 20


def _space_table() -> np.ndarray:
    """For each code point below 0x3000: itself if a letter, else a space."""
    t = np.arange(0x3000, dtype=np.uint32)
    t[[c for c in range(0x3000) if not chr(c).isalpha()]] = 32
    return t


_TABLE: np.ndarray | None = None


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of a whole text."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _space_table()
    out = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(text), _CHUNK):
        a = np.frombuffer(text[max(0, lo - 2) : lo + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        low = np.minimum(a, 0x2FFF)
        a = np.where(a < 0x3000, _TABLE[low], a)
        b = a[1:] * np.uint32(0x9E3779B1) ^ a[:-1] * np.uint32(0x85EBCA77)
        c = b[1:] * np.uint32(0xC2B2AE3D) ^ a[:-2] * np.uint32(0x27D4EB2F) if len(a) > 2 else b[:0]
        for h in (a * np.uint32(0x9E3779B1), b, c):
            out += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares, of unit length: long and short texts look alike."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """n rows of -1 and 1. Up to 7 classes: every split into two sides. More: random columns, the best of many tries."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(2 ** (n - 1) - 1, 2**n - 1)] for i in range(n)])
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        m = rng.choice([-1, 1], size=(n, bits))
        d = (bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)
        if d.min() > best[0] and np.all(np.abs(m.sum(0)) < n):
            best = d.min(), m
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 120, l2: float = 1e-5) -> np.ndarray:
    """Weights (with a last row of biases) of one logistic classifier a column of y; Adam on the whole sample."""
    p = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = np.clip(x @ p[:-1] + p[-1], -30, 30)
        g = w[:, None] * (-y / (1 + np.exp(y * z))) / len(x)
        g = np.vstack([x.T @ g, g.sum(0, keepdims=True)]).astype(np.float32) + l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= (2.0 * 0.97**t + 0.02) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p


def fit(counts: np.ndarray, langs: list[str]) -> dict:
    """A model from n-gram counts and their languages."""
    names = sorted(set(langs))
    code = codebook(len(names)).astype(np.float32)
    if len(names) < 2:
        return {"names": names, "code": code, "p": None, "bits": None, "sharp": 1.0}
    cls = np.array([names.index(x) for x in langs])
    x, y = features(counts), code[cls]
    w = (len(cls) / (len(names) * np.bincount(cls, minlength=len(names))))[cls].astype(np.float32)
    back = np.arange(len(cls)) % 5 == 4 if len(cls) >= 50 else np.ones(len(cls), bool)
    use = ~back if len(cls) >= 50 else back
    p = _logistic(x[use], y[use], w[use])
    z = x[back] @ p[:-1] + p[-1]
    right = ((z > 0) == (y[back] > 0)).mean(0)
    bits = np.log((right * back.sum() + 1) / ((1 - right) * back.sum() + 1))  # log odds that the bit is right
    bits = np.maximum(bits, 0.05) / np.maximum(bits, 0.05).sum()
    model = {"names": names, "code": code, "p": p, "bits": bits.astype(np.float32), "sharp": 1.0}
    losses = _losses(model, z)
    best = None
    for sharp in (1, 2, 4, 8, 16, 32):  # the scale under which the held-back part is the likeliest
        q = _softmax(-sharp * losses)
        nll = -np.log(np.maximum(q[np.arange(len(q)), cls[back]], 1e-6)).mean()
        if best is None or nll < best[0]:
            best = nll, float(sharp)
    return model | {"sharp": best[1]}


def _losses(model: dict, z: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of every codeword."""
    margin = z[:, None, :] * model["code"][None]
    return (np.logaddexp(0, -margin) * model["bits"]).sum(-1)


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def decode(model: dict, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its probability, whether the second is nearly as near."""
    n = len(counts)
    if model["p"] is None:
        return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    q = _softmax(-model["sharp"] * _losses(model, features(counts) @ model["p"][:-1] + model["p"][-1]))
    order = np.sort(q, axis=1)
    return q.argmax(1), order[:, -1], order[:, -1] - order[:, -2] < AMBIGUOUS


def _sampled(docs: DataFrame, rows: int) -> DataFrame:
    n = docs.count()
    return docs if n <= rows else docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", rows: int = TRAIN_ROWS) -> dict | None:
    """Fit on a bounded sample of the documents that are not held out."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("body").isNotNull() & (fold(F.col("id")) != 0))
    ship(docs.sparkSession)

    def count(batches):
        for b in batches:
            got = [(i, np.flatnonzero(c), c) for i, t in zip(b.column("id").to_pylist(), b.column("body"), strict=True) for c in [ngram_counts(t.as_py())]]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    b.column("lang"),
                    pa.array([k.astype("<u2").tobytes() for _, k, _ in got], pa.binary()),
                    pa.array([c[k].astype("<u4").tobytes() for _, k, c in got], pa.binary()),
                ],
                names=["id", "lang", "at", "n"],
            )

    got = _sampled(own, rows).mapInArrow(count, "id long, lang string, at binary, n binary").collect()  # bounded by rows
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["id"], r["lang"]))
    if not got:
        return None
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        counts[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    return fit(counts, [r["lang"] for r in got])


def identify(docs: DataFrame, model: dict | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous. Reads nothing but the text to predict."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    own = own.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "body")

    def run(batches):
        for b in batches:
            lang, score, unsure = [], [], []
            for lo in range(0, b.num_rows, 256):
                texts = [t.as_py() or "" for t in b.column("body").slice(lo, 256)]
                said = np.array([any(map(str.isalpha, t)) for t in texts], bool) & (model is not None)
                names, p, close = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if said.any():
                    k, q, a = decode(model, np.stack([ngram_counts(t) for t, ok in zip(texts, said, strict=True) if ok]))
                    names[said], p[said], close[said] = np.array(model["names"], object)[k], q, a
                lang += names.tolist()
                score += p.tolist()
                unsure += close.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the documents that are not held out and predict all of them."""
    return identify(docs, train(docs, text, doc_id, lang, rows), text, doc_id)
