"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition sorts its digests into a run and collapses equal ones. The runs then travel along a binomial
exchange (recursive halving): in each round a node sends the parts of its run that belong to other sub-trees and
merges, in digest order, what it gets from its partners. After log_radix(nodes) rounds each node owns one slice of
the digest space, whole and without repeats, so no task ever holds more than its slice, and a group of copies, however
large, shrinks to one entry per node in the first round. At every level the smallest (identifier, row) is retained, and
checked against the minimum over the merged entries; a digest counts as equal only if length and a second hash agree.

Defined results: a null text counts as empty; a null identifier sorts after every other; of rows that repeat text and
identifier exactly one is kept; an empty table gives an empty result; other columns are ignored unless asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, numbered, partitions, ship, without

NO_ID = 2**63 - 1
RADIX_BITS = 3
RUN = "node int, digest binary, check long, size int, min_id long, min_rid long, copies long"


def normalized(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """One stored row per document: id, rid (a row number of its own, or the given one), digest, check, size."""
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    own = docs.select(F.col(doc_id).cast("long").alias("id"), number.alias("rid"), normalized(F.col(text)).alias("norm"))
    hashed = own.select("id", "rid", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("size"))
    return materialize(hashed, "digests")


def merger(bits: int, done: int, take: int):
    """A pass over sorted runs that merges a node's equal digests and names the node each entry goes to next.

    bits: of a node's number. done: bits already settled. take: bits that the next round settles. Holds one batch.
    """

    def merge(batches):
        held = None

        def out(node, raw, rest):
            first = np.frombuffer(raw.tobytes(), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
            owner = (first >> np.uint64(64 - bits)).astype(np.int64)
            mask = ((1 << take) - 1) << (bits - done - take)
            dest = (node & ~mask) | (owner & mask)
            return pa.RecordBatch.from_arrays(
                [pa.array(dest.astype(np.int32)), pa.array([x.tobytes() for x in raw], pa.binary()), *(pa.array(x) for x in rest)],
                names=["node", "digest", "check", "size", "min_id", "min_rid", "copies"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.array(b.column(1).to_pylist(), dtype="V32")
            rest = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7)]
            if held is not None:
                node, raw = np.concatenate([held[0], node]), np.concatenate([held[1], raw])
                rest = [np.concatenate([x, y]) for x, y in zip(held[2], rest, strict=True)]
            words = raw.view("<u8").reshape(-1, 4)
            same = (words[1:] == words[:-1]).all(1) & (node[1:] == node[:-1])
            for x in rest[:2]:
                same &= x[1:] == x[:-1]
            at = np.concatenate([[0], np.flatnonzero(~same) + 1])
            copies = np.add.reduceat(rest[4], at)
            if not np.array_equal(np.minimum.reduceat(rest[2], at), rest[2][at]):
                raise ValueError("a run is out of order: its first identifier is not its smallest")
            node, raw, rest = node[at], raw[at], [x[at] for x in rest[:4]] + [copies]
            held = node[-1:], raw[-1:], [x[-1:] for x in rest]
            if len(raw) > 1:
                yield out(node[:-1], raw[:-1], [x[:-1] for x in rest])
        if held is not None:
            yield out(*held)

    return merge


def tree_merge(stored: DataFrame, nodes: int | None = None, radix_bits: int = RADIX_BITS) -> DataFrame:
    """digest, check, size, keep_id, keep_rid, group_size: one row for each distinct text."""
    spark = stored.sparkSession
    ship(spark)
    bits = max(1, ((nodes or partitions(spark)) - 1).bit_length())
    keys = ["node", "digest", "check", "size", "min_id", "min_rid"]
    runs = stored.select(
        F.pmod(F.spark_partition_id(), F.lit(1 << bits)).alias("node"), "digest", "check", "size", F.coalesce("id", F.lit(NO_ID)).alias("min_id"), F.col("rid").alias("min_rid"), F.lit(1).cast("long").alias("copies")
    )
    done = 0
    while True:
        take = min(radix_bits, bits - done)
        runs = runs.sortWithinPartitions(*keys).mapInArrow(merger(bits, done, take), RUN)
        if not take:
            break
        runs = runs.repartitionById(1 << bits, F.col("node"))
        done += take
    return runs.select(
        "digest", "check", "size", F.nullif("min_id", F.lit(NO_ID)).alias("keep_id"), F.col("min_rid").alias("keep_rid"), F.col("copies").alias("group_size")
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    stored = digests(docs, text, doc_id)
    return stored.join(tree_merge(stored), ["digest", "check", "size"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, all columns, without those whose text an earlier identifier has."""
    rows = numbered(docs, doc_id)
    stored = digests(rows.select("id", "rid", F.col("whole").getField(text).alias("body")), "body", "id", "rid")
    kept = tree_merge(stored).select(F.col("keep_rid").alias("rid"))
    return without(rows, stored.select("rid").join(kept, "rid", "left_anti"))
