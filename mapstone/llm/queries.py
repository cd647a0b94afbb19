"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from . import collocations, embedding_dedup, lexical_search, mixing
from .common import table
from .embedding_dedup import near_embeddings
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .langid import language_id
from .license_scan import scan_licenses
from .packing import best_fit_pack
from .records import tokens_to_records
from .simhash import near_dedup
from .toxicity import toxicity
from .vector_packing import pack_examples


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op4_token_records(spark, sf_dir):
    return tokens_to_records(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_packing(spark, sf_dir):
    return pack_examples(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_exact_dedup, op2_html_text, op3_language_id, op4_token_records, op5_toxicity, op6_simhash_near_dedup,
    op7_source_mixing, op8_best_fit_packing, op9_license_scan, op10_embedding_near_dedup,
    op11_lexical_search, op12_collocations, op13_vector_packing, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}

SQL = {
    "op12_collocations": collocations.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op10_embedding_near_dedup": embedding_dedup.SQL,
    "op7_source_mixing": mixing.sql(),
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
}
