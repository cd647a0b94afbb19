"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most one sequence. Only the histogram of piece lengths (at most seq_len rows,
whatever the input) reaches the driver, where best-fit decreasing runs over counts: equal sequences are one pattern
with a multiplicity. The plan gives every length consecutive slot ranks; pieces get ranks within their length and take
their slots by an equi-join on (length, rank). Ranks within a length are counted in hash buckets, so that one very
frequent length doesn't gather in a task.

Defined results: a null text counts as empty and packs its end id; a null identifier and repeated rows are packed like
any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, partitions, ship
from .tokens import encoder

PER_BUCKET = 20_000
CHUNK = 10_000
CACHE = 200_000  # words, of one task; other stages of a pipeline run in the same workers


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, seq_len: int, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, stored."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        enc, end = encoder(tokenizer, CACHE), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("body"), strict=True):
                ids = enc.encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    def run_and_forget(batches):
        yield from run(batches)
        encoder(tokenizer, CACHE).cache.clear()

    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return materialize(own.mapInArrow(lean(run_and_forget), schema), "pieces")


def plan(histogram: dict[int, int], seq_len: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: (lengths of a sequence, how many such sequences)."""
    open_: dict[int, list[list]] = {}  # room left: [[count, lengths], ...]
    rooms: list[int] = []

    def put(room: int, count: int, lengths: list[int]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = seq_len // length
                if left >= each:
                    put(seq_len - each * length, left // each, [length] * each)
                if left % each:
                    put(seq_len - (left % each) * length, 1, [length] * (left % each))
                break
            room = rooms[k]
            group = open_[room][-1]
            each = min(left, room // length)  # the tightest sequence stays the tightest until no more fit
            take = min(left // each, group[0])
            group[0] -= take
            if not group[0]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            put(room - each * length, take, [*group[1], *[length] * each])
            left -= take * each
    return [(lengths, count) for room in sorted(open_) for count, lengths in open_[room]]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): the ranks first.. first+count-1 take sequences in order."""
    out, used, sequence = [], {}, 0
    for lengths, count in patterns:
        at = 0
        for length in lengths:
            out.append((length, used.get(length, 0), count, sequence, at))
            used[length] = used.get(length, 0) + count
            at += length
        sequence += count
    return out


def assign(cut: DataFrame, seq_len: int) -> DataFrame:
    """The stored pieces with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most seq_len rows
    planned = spark.createDataFrame(slots(plan(histogram, seq_len)), "length long, first long, n long, sequence long, offset long")
    slot = (
        planned.withColumn("c", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}"))))
        .withColumn("i", F.explode(F.expr(f"sequence(c * {CHUNK}, least(n, (c + 1) * {CHUNK}) - 1)")))
        .select("length", (F.col("first") + F.col("i")).alias("rank"), (F.col("sequence") + F.col("i")).alias("sequence_id"), "offset")
    )
    buckets = max(partitions(spark), sum(histogram.values()) // PER_BUCKET + 1)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    ranked = own.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    return ranked.join(slot, ["length", "rank"]).select(*[c for c in cut.columns], "sequence_id", "offset")


def best_fit_pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 0,
    seq_len: int = 2048,
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return assign(pieces(docs, tokenizer, end_id, seq_len, text, doc_id, with_ids), seq_len)
