"""Ranked lexical search: postings as a term-bucketed table, joined with the terms of the searching items.

A posting says that a document holds a term: bucket (of the term), term, document, occurrences, terms of the document.
Postings are made where a document is read, so that its counts need no shuffle, and stored by bucket: a search reads
the buckets that its terms fall in. Terms that nobody asks for are left out while postings are made, if the asked ones
are counted to be few enough to be sent along (WANTED); else a semi-join leaves them out.

A search dealt by document scores each posting once, joins the weighted terms of the items, sums by item and document
without another shuffle, and numbers the documents of each item; Spark keeps the first `most` of each task only. All is
integer arithmetic but the weight of a term.

Defined results: a null or empty text has no terms, is never found and finds nothing, and doesn't count for N; null and
repeated identifiers are documents or items of their own (a null document comes after others of its score, rows that
repeat an identifier in any order); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, partitions, ship, small
from .words import SPACE, classes, cut, gathered

#: ASCII that belongs to no term: all but digits and letters.
KINDS = classes(bytes(c for c in range(128) if not chr(c).isalnum()))
assert SPACE in KINDS
#: Asked terms that are sent to the tasks, at most: some 20 MB. Beyond it a semi-join does the same.
WANTED = 500_000
BUCKETS = 16
POSTING = "term string, rid long, doc_id long, tf long, n long, bucket int"


def bucket_of(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


def _own(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(name).cast("long").alias("id"), F.col(text).cast("string").alias("body"))


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", wanted: pa.Array | None = None) -> DataFrame:
    """The stored postings, and for each part of the input a row without term: documents with terms (tf), all their terms (n)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        asked = sent.value
        for t in gathered(batches):
            body = t.column("body").combine_chunks()
            w = cut(body, KINDS)
            n = np.bincount(w.doc, minlength=t.num_rows)
            yield _posting_batch(pa.nulls(1, pa.string()), [0], pa.nulls(1, pa.int64()), [int((n > 0).sum())], [int(n.sum())], [0])
            codes, doc = w.codes, w.doc
            if asked is not None:
                keep = pc.is_in(w.terms, value_set=asked).to_numpy(zero_copy_only=False)[codes]
                codes, doc = codes[keep], doc[keep]
            both, tf = np.unique(doc * max(1, len(w.terms)) + codes, return_counts=True)
            doc, codes = np.divmod(both, max(1, len(w.terms)))
            of = np.zeros(len(w.terms), np.int32)
            for c in np.unique(codes).tolist():
                of[c] = bucket_of(w.terms[c].as_py())
            for lo in range(0, len(codes), 200_000):
                s = slice(lo, lo + 200_000)
                at = pa.array(doc[s])
                yield _posting_batch(w.terms.take(pa.array(codes[s])).cast(pa.large_string()).cast(pa.string()), t.column("rid").combine_chunks().take(at), t.column("id").combine_chunks().take(at), tf[s], n[doc[s]], of[codes[s]])

    made = _own(docs, text, doc_id).mapInArrow(lean(run), POSTING)
    return materialize(made, "postings", by=["bucket"])


def _posting_batch(term, rid, doc_id, tf, n, bucket):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    arrays = [x if isinstance(x, pa.Array) else pa.array(np.asarray(x), k) for x, k in zip((term, rid, doc_id, tf, n, bucket), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "rid", "doc_id", "tf", "n", "bucket"])


def item_terms(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The stored terms of the items, once each: item (a row number of its own), item_id, term, bucket."""
    ship(items.sparkSession)

    def run(batches):
        for t in gathered(batches):
            w = cut(t.column("body").combine_chunks(), KINDS)
            both = np.unique(w.doc * max(1, len(w.terms)) + w.codes)
            doc, codes = np.divmod(both, max(1, len(w.terms)))
            at, terms = pa.array(doc), w.terms.take(pa.array(codes))
            buckets = pa.array([bucket_of(x) for x in terms.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([t.column("rid").combine_chunks().take(at), t.column("id").combine_chunks().take(at), terms.cast(pa.large_string()).cast(pa.string()), buckets], names=["item", "item_id", "term", "bucket"])

    return materialize(_own(items, text, item_id).mapInArrow(run, "item long, item_id long, term string, bucket int"), "item-terms")


def search(docs: DataFrame, items: DataFrame, most: int = 50, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", wanted_limit: int = WANTED) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each item."""
    spark = docs.sparkSession
    asked = item_terms(items, item_text, item_id)
    wanted = materialize(asked.select("term", "bucket").distinct(), "wanted")
    few = wanted.count() <= wanted_limit
    index = postings(docs, text, doc_id, pa.array([r[0].encode() for r in wanted.select("term").collect()], pa.large_binary()) if few else None)
    n = index.where("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    found = index.where("term IS NOT NULL")
    if not few:
        found = found.join(wanted, ["bucket", "term"], "left_semi")
    return ranked(found, asked, n["docs"], n["terms"], most, partitions(spark))


def ranked(found: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, most: int, parts: int) -> DataFrame:
    """The search proper, over the postings of the asked terms."""
    df = found.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.expr(f"CAST(floor(1000 * ln(CAST(2L * {n_docs} + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS LONG)")
    weighted = materialize(asked.join(df, ["bucket", "term"]).select("item", "item_id", "term", weight.alias("w")), "weighted-terms")
    m = f"(100 - 50 + ((50 * n * {n_docs}L) div {max(1, n_terms)}L))"
    scored = found.select("rid", "doc_id", "term", F.expr(f"(1000000000L * tf) div (1000 * tf + 20 * {m})").alias("part"))
    matches = scored.repartition(parts, "rid").join(small(weighted), "term")
    sums = matches.groupBy("rid", "item").agg(F.sum(F.col("w") * F.col("part")).alias("score"), F.min("doc_id").alias("doc_id"), F.min("item_id").alias("item_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid")
    return sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL
    ), s AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
    c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM s),
    p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM s) GROUP BY ALL),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
    w AS (SELECT item_id, term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM i JOIN f USING (term), c),
    m AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nl)))) AS x FROM p JOIN w USING (term), c),
    t AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM m GROUP BY ALL HAVING sum(x) > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM t
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
