"""The registered queries of this subpackage, their SQL where SQL can express them, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest_join, language, lloyd, main_text, mixing, part_codes
from .chunk_dedup import dedup_chunks
from .common import read_table
from .epsilon_join import near_duplicates
from .hnsw import build_index, search
from .packing import pack
from .suffix_dedup import digests
from .token_tables import encode_to_tables
from .tokens import public_tokenizer
from .warc import deduplicated_archives


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; models fitted on a bounded sample of documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit_on(docs)
    found = language.of_documents(docs, model).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "declared", "host", "language", "posterior", "accepted")
    pages = language.of_pages(read_table(spark, sf_dir, "pages"), model)
    return found.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id"), "declared", "host", "language", "posterior", "accepted"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=1, length=2048, with_ids=False)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_chunks(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("lexi_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", F.col("lexi_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("lexi_spans").cast("long").alias("n_spans"), "text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(read_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_to_tables(read_table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.9)


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def op12_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.encode(read_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_hnsw": op2_hnsw,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_forest_join": op8_forest_join,
    "op9_token_tables": op9_token_tables,
    "op10_epsilon_grid_join": op10_epsilon_grid_join,
    "op11_lloyd": op11_lloyd,
    "op12_ball_tree_codes": op12_ball_tree_codes,
    "op13_text_density": op13_text_density,
}

#: The digest's 160 bits, five at a time, are the letters of its base32 form.
OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, payload, octet_length(payload) AS n, unhex(sha1(payload))::BIT::VARCHAR AS bits FROM p),
d AS (SELECT page_id, n, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
  + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1) FOR k IN range(32)], 'string_agg', '') AS digest, max(page_id) OVER (PARTITION BY payload) AS origin FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to FROM d
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON e.vec_id = c.node
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op7_warc_revisits": OP7_SQL, "op10_epsilon_grid_join": OP10_SQL, "op11_lloyd": lloyd.sql(), "op12_ball_tree_codes": part_codes.sql()}
