"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from refrain.llm import centroids, html_extract, language_id, line_dedup, minhash, mixing, sentencepiece_fst, simhash, suffix_dedup, token_counts, topk, vector_codes
from refrain.llm.exact_dedup import exact_dedup
from refrain.session import table


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract_html(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.encoded(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_minhash(spark, sf_dir):
    return minhash.minhash_dedup(table(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_suffix_dedup, op3_sentencepiece, op4_mixing, op5_simhash,
        op6_language_id, op7_exact_dedup, op8_topk, op9_line_dedup, op10_token_counts,
        op11_minhash, op12_centroids, op13_vector_codes,
    )
}

EXACT_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

SQL = {
    "op4_mixing": mixing.MIX_SQL.replace("{documents}", "documents"),
    "op7_exact_dedup": EXACT_SQL,
    "op8_topk": topk.TOPK_SQL.replace("{embeddings}", "embeddings"),
    "op9_line_dedup": line_dedup.LINES_SQL.replace("{documents}", "documents"),
    "op11_minhash": minhash.MINHASH_SQL.replace("{documents}", "documents"),
    "op12_centroids": centroids.clusters_sql().replace("{embeddings}", "embeddings"),
    "op13_vector_codes": vector_codes.codes_sql().replace("{embeddings}", "embeddings"),
}
