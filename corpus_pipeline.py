"""A training-data pipeline over `documents`: each stage takes what the stage before it kept, written as Parquet.

Toxic documents go; of equal texts one stays; of near-duplicates one stays; sources are mixed to target weights; the
rest is packed into sequences. All stages but the last return the columns of documents.

Defined results, of every stage: other columns come through whole, whatever they are called; an empty table gives an empty
result. Rows that repeat are one document after exact_dedup. A null text counts as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mapstone.llm.common import shared_dir, table
from mapstone.llm.exact_dedup import drop_copies
from mapstone.llm.mixing import mix_documents
from mapstone.llm.packing import best_fit_pack
from mapstone.llm.simhash import drop_near_copies
from mapstone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. All stay if the labels show nothing; null and empty texts stay; repeated rows go or stay alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text, that of the smallest doc_id; one of null doc_id only if no other has the text, one of equal rows."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more), that of the smallest doc_id.

    The tree of fingerprints finds most such pairs, and a join of shingles those that it misses; all are verified by their shingles. Texts of
    fewer than five words are alike only if they are equal; null doc_ids come last, ties go by row.
    """
    return drop_near_copies(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that domains, languages and sources come as near to their weights as one epoch allows; null languages and sources
    are a label of their own, ties in order are broken by row."""
    return mix_documents(docs, max_epochs=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences; a null text packs its end id."""
    return best_fit_pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Toxicity is learned and packing needs a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.option("compression", "zstd").parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
