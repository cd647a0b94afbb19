"""Phrase collocations by counting arrays under minimal perfect hashes.

Words are counted first, for each language; those seen often enough get numbers, and the corpus is stored once as
arrays of word numbers, in which 0 stands for a rare word or the border of a piece. Phrases grow word by word. For each
length three passes go over the stored arrays:

- sieve: every phrase whose parts may be frequent falls into one of a wave's counters (one for LOAD words); a phrase whose
  counter stays below the limit is rare for certain (Apriori holds for its parts: beginnings and, where known, ends are frequent);
- candidates: the phrases that pass, each once; a minimal perfect hash gives each a slot, and the slot stores its key;
- count: the slots of all phrases, verified by the stored key, are counted by bincount.

A key is exact: the slot of the phrase without its last word, and the number of that word. Arrays of counters leave a
task as sparse blocks and are summed in a tree, RADIX arrays in a group. Parts of a phrase are read by their slots.

Phrases are dealt with in waves by their first word, so that counters and hashes of a wave have a bounded size (a wave
is some WAVE_WORDS words; there are at most WAVE_WORDS / least frequent phrases in it). The stored corpus is dealt to the
waves likewise, each word with the words that may follow it in a phrase, so a wave's passes read its own share only. A part
that belongs to another wave is joined. Word numbers are a minimal perfect hash as well if they are counted to be at most VOCABULARY; beyond it
they are joined.

Defined results: a null text has no words; a null language is `und`; repeated rows count each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, ship, small_batches
from .words import classes, cut, gathered

KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words for each counter of the sieve, slots of a block of counters, arrays that are summed at once.
LOAD, BLOCK, RADIX = 4, 1 << 16, 16
KEY_BLOCKS = 64  # arrays that a task's candidates are split into
#: Bytes of text that are cut at once.
AT_ONCE = 2 << 20
#: Words of a wave, and numbered words that are sent to the tasks, at most.
WAVE_WORDS, VOCABULARY = 1 << 28, 4_000_000
GAMMA = 2.0
COUNTS = "block int, part int, at binary, n binary"


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing of integers."""
    x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash of distinct 64-bit hashes: in each level, those alone at their place keep it, the rest go on to the next level."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.tops, bits, rest, top = [], [], hashes, 0
        while len(rest):
            m = max(64, int(GAMMA * len(rest)) + 63 & ~63)
            place = (mixed(rest, len(self.tops)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(place, minlength=m) == 1
            self.tops.append((top, m))
            bits.append(alone)
            rest, top = rest[~alone[place]], top + m
            if len(self.tops) > 200:
                raise ValueError("hashes repeat")
        self.words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Slots; -1 or any slot for a hash that isn't among the keys."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (top, m) in enumerate(self.tops):
            at = top + (mixed(hashes[left], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Numbers:
    """Slots of integer keys, each verified by the key that its slot stores."""

    def __init__(self, keys: np.ndarray) -> None:
        self.slots = Slots(keys.astype(np.uint64))
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self.slots(keys.astype(np.uint64))] = keys

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        s = self.slots(keys.astype(np.uint64))
        if len(self.keys):
            s[self.keys[s] != keys] = -1  # -1 reads the last key, which is another one or it wouldn't be -1
        return s


class Vocabulary:
    """Slots of (language, word), verified by the stored bytes."""

    def __init__(self, langs: list[str], words: list[bytes], counts: np.ndarray) -> None:
        keys = [f"{lang}\0".encode() + w for lang, w in zip(langs, words, strict=True)]
        for self.seed in range(100):
            hashes = self._hash(keys)
            if len(np.unique(hashes)) == len(hashes):
                break
        self.slots = Slots(hashes)
        at = self.slots(hashes)
        order = np.empty(len(keys), np.int64)
        order[at] = np.arange(len(keys))
        self.keys = pa.array(keys, pa.large_binary()).take(pa.array(order))
        self.counts = counts[order]

    def _hash(self, keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """Numbers from 1; 0 for a word that has none."""
        s = self.slots(self._hash(keys))
        known = s >= 0
        if known.any():
            known[known] = pc.equal(self.keys.take(pa.array(s[known])), pa.array([k for k, x in zip(keys, known.tolist(), strict=True) if x], pa.large_binary())).to_numpy(zero_copy_only=False)
        return np.where(known, s + 1, 0)


def _local(t: pa.Table) -> tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]:
    """The different (language, word) of a table of texts, the number among them of each word, and where a piece begins."""
    w = cut(t.column("body").combine_chunks(), KINDS)
    lang = t.column("lang").combine_chunks().dictionary_encode()
    of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both, codes = np.unique(of[w.doc] * max(1, len(w.terms)) + w.codes, return_inverse=True)
    langs, terms = np.divmod(both, max(1, len(w.terms)))
    names = lang.dictionary.to_pylist()
    return list(zip([names[x] for x in langs.tolist()], w.terms.take(pa.array(terms)).to_pylist(), strict=True)), codes, w.fresh


def _own(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("body"))


def word_counts(own: DataFrame, least: int) -> DataFrame:
    """Stored: lang, word, f of the words seen often enough, and for each language a row without word, f being all its words."""

    def run(batches):
        for t in gathered(batches, most=AT_ONCE):
            pairs, codes, _ = _local(t)
            n = np.bincount(codes, minlength=len(pairs))
            of: dict[str, int] = {}
            for (lang, _w), c in zip(pairs, n.tolist(), strict=True):
                of[lang] = of.get(lang, 0) + c
            for lo in range(0, len(pairs), 100_000):
                some = pairs[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.string()), pa.array([p[1] for p in some], pa.binary()).cast(pa.string()), pa.array(n[lo : lo + 100_000])], names=["lang", "word", "f"])
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), pa.nulls(len(of), pa.string()), pa.array(list(of.values()), pa.int64())], names=["lang", "word", "f"])

    made = own.mapInArrow(lean(run), "lang string, word string, f long")
    return materialize(made.groupBy("lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull()), "word-counts")


def _broken(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Numbers with a 0 before each piece."""
    return np.insert(codes, np.flatnonzero(fresh), 0).astype("<i4")


def wave_of(first: np.ndarray, waves: int) -> np.ndarray:
    return (mixed(first, 7) % np.uint64(waves)).astype(np.int64)


def _dealt(codes: np.ndarray, waves: int, longest: int) -> pa.RecordBatch:
    """A row for each wave: its words, each with those that may follow it in a phrase, and a 0 where others are left out."""
    of = np.where(codes > 0, wave_of(codes, waves), -1)
    rows = []
    for w in range(waves):
        own = of == w
        keep = own.copy()
        for k in range(1, longest):
            keep[k:] |= own[:-k] if k < len(own) else False
        at = np.flatnonzero(keep)
        rows.append(np.insert(codes[at], np.flatnonzero(np.diff(at, prepend=-1) > 1), 0).astype("<i4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(range(waves), pa.int32()), pa.array(rows, pa.binary())], names=["wave", "codes"])


def encoded(own: DataFrame, vocabulary: Vocabulary, waves: int, longest: int) -> DataFrame:
    """Stored arrays of word numbers: wave, codes."""
    sent = own.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for t in gathered(batches, most=AT_ONCE):
            pairs, codes, fresh = _local(t)
            known = sent.value([f"{lang}\0".encode() + w for lang, w in pairs])
            if len(codes):
                yield _dealt(_broken(known[codes], fresh), waves, longest)

    return materialize(own.mapInArrow(lean(run), "wave int, codes binary"), "encoded", by=["wave"])


def encoded_by_join(own: DataFrame, numbered: DataFrame, waves: int, longest: int) -> DataFrame:
    """The same for a vocabulary (lang, word, number) of any size."""

    def local(batches):
        from pyspark import TaskContext

        for k, t in enumerate(gathered(batches, most=AT_ONCE)):
            pairs, codes, fresh = _local(t)
            if len(codes):
                rows = pa.array([{"lang": lang, "word": w.decode()} for lang, w in pairs], pa.struct([("lang", pa.string()), ("word", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() << 32 | k]), pa.array([_broken(codes + 1, fresh).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), rows)], names=["batch", "codes", "words"]
                )

    def translate(batches):
        for b in batches:
            for codes, words in zip(b.column("codes").to_pylist(), b.column("known"), strict=True):
                c, known = np.frombuffer(codes, "<i4"), words.as_py() or []
                to = np.zeros(int(c.max(initial=0)) + 1, "<i4")
                to[[x["pos"] + 1 for x in known]] = [x["number"] for x in known]
                yield _dealt(to[c], waves, longest)

    batches = materialize(own.mapInArrow(local, "batch long, codes binary, words array<struct<lang:string,word:string>>"), "local-words")
    words = batches.select("batch", F.posexplode("words").alias("pos", "w")).select("batch", "pos", "w.*")
    known = words.join(numbered.select("lang", "word", "number"), ["lang", "word"]).groupBy("batch").agg(F.collect_list(F.struct("pos", "number")).alias("known"))
    return materialize(batches.select("batch", "codes").join(known, "batch", "left").select("codes", "known").mapInArrow(translate, "wave int, codes binary"), "encoded", by=["wave"])


@dataclass
class Level:
    """What is known of the phrases of one length in a wave: which counters pass the sieve (bits), the candidates, their counts."""

    passed: np.ndarray
    numbers: Numbers | None = None
    counts: np.ndarray | None = None


@dataclass
class Wave:
    number: int
    waves: int
    least: int
    sketch: int  # counters of its sieve, a power of two
    words: np.ndarray | None = None
    levels: dict[int, Level] = field(default_factory=dict)

    def own(self, first: np.ndarray) -> np.ndarray:
        return wave_of(first, self.waves) == self.number if self.waves > 1 else np.ones(len(first), bool)

    def keys(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of this wave's phrases of k words, those whose parts may be frequent."""
        if k == 2:
            at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            at = at[self.own(codes[at])] if self.waves > 1 else at
            return at, codes[at] << 32 | codes[at + 1]
        at, slots = self.frequent(codes, k - 1)
        ok = (at + k - 1 < len(codes)) & (codes[np.minimum(at + k - 1, len(codes) - 1)] > 0)
        at, slots = at[ok], slots[ok]
        rest = np.zeros(len(codes) + 1, bool)  # places where the phrase without its first word is frequent, or not known
        rest[self.frequent_at] = True
        ok = rest[at + 1] | ~self.own(codes[at + 1])
        at, slots = at[ok], slots[ok]
        return at, slots << 32 | codes[at + k - 1]

    def passing(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, keys = self.keys(codes, k)
        s = (mixed(keys) & np.uint64(self.sketch - 1)).astype(np.int64)
        ok = (self.levels[k].passed[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
        return at[ok], keys[ok]

    def slots(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, keys = self.passing(codes, k)
        s = self.levels[k].numbers(keys)
        return at[s >= 0], s[s >= 0]

    def frequent(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, s = self.slots(codes, k)
        ok = self.levels[k].counts[s] >= self.least
        self.frequent_at = at[ok]
        return at[ok], s[ok]

    def spelled(self, k: int, slots: np.ndarray) -> np.ndarray:
        """The word numbers of phrases, a row each."""
        keys = self.levels[k].numbers.keys[slots]
        head = (keys >> 32)[:, None] if k == 2 else self.spelled(k - 1, keys >> 32)
        return np.concatenate([head, (keys & 0xFFFFFFFF)[:, None]], 1)

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """How often phrases (rows of word numbers) are seen, read by their slots; -1 where that is another wave's."""
        k = ids.shape[1]
        if k == 1:
            return self.words[ids[:, 0] - 1] if self.words is not None else np.full(len(ids), -1, np.int64)
        slot = ids[:, 0]
        for j in range(2, k + 1):
            slot = np.where(slot >= 0, self.levels[j].numbers(np.maximum(slot, 0) << 32 | ids[:, j - 1]), -1)
        return np.where(self.own(ids[:, 0]) & (slot >= 0), self.levels[k].counts[slot], -1)


def _blocks(counts: np.ndarray, part: int, kind: str):
    """The counters that aren't 0, block by block."""
    for block, lo in enumerate(range(0, len(counts), BLOCK)):
        at = np.flatnonzero(counts[lo : lo + BLOCK])
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([counts[lo : lo + BLOCK][at].astype(kind).tobytes()], pa.binary())], names=["block", "part", "at", "n"]
            )


def tree_sum(blocks: DataFrame, parts: int, kind: str = "<i8", most: int | None = None) -> DataFrame:
    """The sum of the arrays of `parts` parts, RADIX of them at a time; no counter goes beyond `most`."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for at, n in zip(t.column("at"), t.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), kind)
        total = total if most is None else np.minimum(total, most)
        at = np.flatnonzero(total)
        return pa.table([t.column("block").slice(0, 1), t.column("part").slice(0, 1), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[at].astype(kind).tobytes()], pa.binary())], names=["block", "part", "at", "n"])

    while True:
        blocks = blocks.withColumn("part", F.expr(f"part div {RADIX}").cast("int")).groupBy("block", "part").applyInArrow(add, COUNTS)
        parts = -(-parts // RADIX)
        if parts <= 1:
            return blocks


def _counted(corpus: DataFrame, wave: Wave, size: int, slots, kind: str = "<i8", most: int | None = None) -> DataFrame:
    """The stored sums of the counting arrays of what slots(wave, codes) gives for each array of word numbers."""
    sent = corpus.sparkSession.sparkContext.broadcast(wave)

    def run(batches):
        from pyspark import TaskContext

        w, total, held, n = sent.value, np.zeros(size, kind), [], 0
        for b in batches:
            for c in b.column("codes"):
                s = slots(w, np.frombuffer(c.as_buffer(), "<i4").astype(np.int64))
                if most is None:  # as many are held as there are counters, so that passes over all counters cost no more than the words
                    held, n = [*held, s], n + len(s)
                    if n >= size:
                        total += np.bincount(np.concatenate(held), minlength=size)
                        held, n = [], 0
                else:  # few of many counters, cut off
                    s.sort()
                    at = np.flatnonzero(np.diff(s, prepend=-1))
                    total[s[at]] = np.minimum(total[s[at]] + np.diff(at, append=len(s)), most)
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        yield from _blocks(total, TaskContext.get().partitionId(), kind)

    out = materialize(tree_sum(corpus.mapInArrow(lean(run), COUNTS), corpus.rdd.getNumPartitions(), kind, most), "counts")
    sent.destroy()
    return out


def _array(summed: DataFrame, size: int) -> np.ndarray:
    """Summed blocks as one array; its size is bounded by the wave's."""
    out, t = np.zeros(size, np.int64), summed.select("block", "at", "n").toArrow()
    for block, at, n in zip(*[c.to_pylist() for c in t.columns], strict=True):
        out[block * BLOCK + np.frombuffer(at, "<u2").astype(np.int64)] = np.frombuffer(n, "<i8")
    return out


def _sieve(corpus: DataFrame, wave: Wave, k: int) -> np.ndarray:
    """A bit for each counter of the sieve that reaches the limit; counters are cut off at it."""
    least, kind = wave.least, "<u1" if wave.least < 1 << 8 else "<u4"
    summed = _counted(corpus, wave, wave.sketch, lambda w, c: (mixed(w.keys(c, k)[1]) & np.uint64(w.sketch - 1)).astype(np.int64), kind, least)

    def run(batches):
        for b in batches:
            for block, at, n in zip(b.column("block"), b.column("at"), b.column("n"), strict=True):
                full = np.zeros(BLOCK, bool)
                full[np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(n.as_buffer(), kind) >= least
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros(wave.sketch // 8, np.uint8)
    for r in summed.mapInArrow(run, "block int, bits binary").collect():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def united(arrays) -> np.ndarray:
    """The union of sorted arrays. Each is united with those of about its own length, so that a key is sorted again as often as that
    length doubles, not once for each array that comes."""
    stack: list[np.ndarray] = []
    for x in arrays:
        while stack and len(stack[-1]) <= 2 * len(x):
            x = np.union1d(stack.pop(), x)
        stack.append(x)
    out = np.zeros(0, np.int64)
    while stack:
        out = np.union1d(stack.pop(), out)
    return out


def _candidates(corpus: DataFrame, wave: Wave, k: int) -> np.ndarray:
    """The different keys that pass the sieve, sorted. Each task finds its own; sorted arrays of them, by blocks of their hashes, are
    united in a tree, RADIX at a time."""
    sent = corpus.sparkSession.sparkContext.broadcast(wave)
    schema = "block int, part int, keys binary"

    def run(batches):
        from pyspark import TaskContext

        seen = united(np.unique(sent.value.passing(np.frombuffer(c.as_buffer(), "<i4").astype(np.int64), k)[1]) for b in batches for c in b.column("codes"))
        of = (mixed(seen, 3) % np.uint64(KEY_BLOCKS)).astype(np.int64)
        for block in np.unique(of).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen[of == block].tobytes()], pa.binary())], names=["block", "part", "keys"])

    def unite(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("keys")]))
        return pa.table([t.column("block").slice(0, 1), t.column("part").slice(0, 1), pa.array([keys.tobytes()], pa.binary())], names=["block", "part", "keys"])

    keys, parts = corpus.mapInArrow(lean(run), schema), corpus.rdd.getNumPartitions()
    while True:
        keys = keys.withColumn("part", F.expr(f"part div {RADIX}").cast("int")).groupBy("block", "part").applyInArrow(unite, schema)
        parts = -(-parts // RADIX)
        if parts <= 1:
            break
    found = materialize(keys, "candidates").select("keys").toArrow().column("keys").to_pylist()
    sent.destroy()
    return np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in found])) if found else np.zeros(0, np.int64)


def _phrases(summed: DataFrame, wave, k: int, longest: int) -> DataFrame:
    """ids, a, and for each cut k, l, r of the frequent phrases among summed counters; -1 where a part is another wave's."""

    def run(batches):
        w = wave.value
        for b in batches:
            for block, at, n in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
                slots, a = block * BLOCK + np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<i8")
                slots, a = slots[a >= w.least], a[a >= w.least]
                ids = w.spelled(k, slots)
                parts = [x for j in range(1, k) for x in (w.count_of(ids[:, :j]), w.count_of(ids[:, j:]))]
                flat = pa.array(ids.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), flat), pa.array(a), pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) * len(parts) + 1, len(parts)), pa.int32()), pa.array(np.stack(parts, 1).reshape(-1)))], names=["ids", "a", "parts"]
                )

    return materialize(summed.select("block", "at", "n").mapInArrow(run, "ids array<long>, a long, parts array<long>"), f"phrases-{k}")


def mine_wave(corpus: DataFrame, wave: Wave, longest: int) -> list[DataFrame]:
    """The frequent phrases of a wave, of 2 to `longest` words."""
    corpus, out = corpus.where(F.col("wave") == wave.number).select("codes"), []
    for k in range(2, longest + 1):
        wave.levels[k] = Level(_sieve(corpus, wave, k))
        wave.levels[k].numbers = Numbers(_candidates(corpus, wave, k))
        size = len(wave.levels[k].numbers.keys)
        if not size:
            break
        summed = _counted(corpus, wave, size, lambda w, c, k=k: w.slots(c, k)[1])
        wave.levels[k].counts = _array(summed, size)
        out.append((k, summed))
    whole = corpus.sparkSession.sparkContext.broadcast(wave)
    found = [_phrases(summed, whole, k, longest) for k, summed in out]
    whole.destroy()
    return found


def _joined_parts(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """phrases with parts of other waves filled in."""
    known = phrases.select("ids", "a").unionByName(vocabulary.select(F.array("number").alias("ids"), F.col("f").alias("a"))).toDF("of", "f")
    part = F.expr("if(i % 2 = 0, slice(ids, 1, i div 2 + 1), slice(ids, i div 2 + 2, size(ids)))")
    each = phrases.select("ids", "a", F.posexplode("parts").alias("i", "n")).withColumn("of", F.when(F.col("n") < 0, part))
    each = each.join(known, "of", "left").withColumn("n", F.when(F.col("n") < 0, F.col("f")).otherwise(F.col("n")))
    return each.groupBy("ids", "a").agg(F.expr("transform(array_sort(collect_list(struct(i, n))), x -> x.n)").alias("parts"))


def lowest_cut(parts: Column, a: Column) -> Column:
    """The cut of least score, the first of equals: score, k, l, r. Exact: decimals of 38 digits."""
    whole = "cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0)) div (cast(parts[2 * i] AS decimal(19,0)) + cast(parts[2 * i + 1] AS decimal(19,0)))"
    return F.expr(f"array_min(transform(sequence(0, size(parts) div 2 - 1), i -> struct({whole} AS score, i + 1 AS k, parts[2 * i] AS l, parts[2 * i + 1] AS r)))")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, text: str = "text", lang: str = "lang", wave_words: int = WAVE_WORDS, vocabulary_limit: int = VOCABULARY
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        phrases, vocabulary, totals = _mined(docs, least, longest, text, lang, wave_words, vocabulary_limit)
    return best(phrases, vocabulary, totals, most)


def _mined(docs: DataFrame, least: int, longest: int, text: str, lang: str, wave_words: int, vocabulary_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored phrases (ids, a, parts), the numbered words, and the words of each language."""
    own = _own(docs, text, lang)
    counts = word_counts(own, least)
    words, totals = counts.where("word IS NOT NULL"), counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    size, used = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    waves = max(1, -(-used // wave_words))
    known = None
    if size <= vocabulary_limit:
        t = words.toArrow()
        known = Vocabulary(t.column("lang").to_pylist(), [x.encode() for x in t.column("word").to_pylist()], t.column("f").to_numpy().astype(np.int64))
        corpus = encoded(own, known, waves, longest)
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def number(batches):
            for b in batches:
                got = sent.value([f"{x}\0".encode() + y.encode() for x, y in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "number"])

        vocabulary = materialize(words.mapInArrow(number, "lang string, word string, f long, number long"), "vocabulary")
    else:
        shards = -(-size // 1_000_000)
        shard = F.pmod(F.xxhash64("lang", "word"), F.lit(shards))
        inside = Window.partitionBy("shard").orderBy("lang", "word")
        vocabulary = materialize(words.withColumn("shard", shard).withColumn("number", F.row_number().over(inside).cast("long") * shards + F.col("shard")).drop("shard"), "vocabulary")
        corpus = encoded_by_join(own, vocabulary, waves, longest)
    sketch = max(BLOCK, 1 << (used // waves // LOAD).bit_length())
    found = [x for w in range(waves) for x in mine_wave(corpus, Wave(w, waves, least, sketch, known.counts if known else None), longest)]
    if not found:
        return docs.sparkSession.createDataFrame([], "ids array<long>, a long, parts array<long>"), vocabulary, totals
    phrases = found[0]
    for x in found[1:]:
        phrases = phrases.unionByName(x)
    if waves > 1 or known is None:
        phrases = materialize(_joined_parts(phrases, vocabulary), "phrases")
    return phrases, vocabulary, totals


def best(phrases: DataFrame, vocabulary: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """phrases (ids, a, parts) scored, without those that a longer one explains, spelled and ranked."""
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))")
    longer = phrases.where("size(ids) > 2").select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("over"))
    kept = phrases.join(longer, "ids", "left").where("over IS NULL OR CAST(100 AS decimal(7,0)) * CAST(over AS decimal(19,0)) < CAST(80 AS decimal(7,0)) * CAST(a AS decimal(19,0))")
    kept = kept.withColumn("cut", lowest_cut(F.col("parts"), F.col("a"))).select("ids", "a", "cut.score", "cut.l", "cut.r")
    spelled = kept.select("*", F.posexplode("ids").alias("pos", "number")).join(vocabulary.select("number", "lang", "word"), "number")
    named = spelled.groupBy("ids").agg(*[F.first(c).alias(c) for c in ("lang", "a", "l", "r", "score")], F.expr("array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), ' ')").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, '{UPPER}', '{LOWER}') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS s(k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
    u AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1 : j], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[j + 1 : c.k], ' ') AS tail FROM c, range(1, 4) AS s(j) WHERE j < c.k),
    x AS (SELECT u.lang, u.phrase, u.a, j, h.a AS l, t.a AS r, ((2000000::HUGEINT * u.a) // (h.a + t.a))::BIGINT AS score FROM u JOIN f h ON h.lang = u.lang AND h.phrase = u.head JOIN f t ON t.lang = u.lang AND t.phrase = u.tail),
    b AS (SELECT lang, phrase, a, l, r, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (
        SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2
    ), o AS (SELECT lang, phrase, max(a) AS over FROM i GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase)::INT AS rank, b.phrase, b.a, l, r, n, score
    FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE over IS NULL OR 100 * over < 80 * b.a
    QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
