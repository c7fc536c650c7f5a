"""The queries of this subpackage: name -> function(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import alignment, conversations, extraction, hnsw, katz, language, mixing, multi_index, ngram_join, packing, pii, quality, warc
from stayline.llm.common import table
from stayline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_transactions(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


@query
def op2_prefix_tree_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op3_pattern_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op4_template_text(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op5_rank_order_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op6_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_byte_cnn_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_bootstrapped_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op9_graph_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 20 = 0"))


@query
def op10_multi_index_near_duplicates(spark, sf_dir):
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_wagner_fischer_repair(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query
def op12_katz_backoff(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"))


@query
def op13_exact_text_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


ORACLE["op1_warc_transactions"] = """
with d as (select page_id, url, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
r as (select *, row_number() over (partition by digest, n order by page_id desc nulls last, url desc nulls last) as place,
  max(page_id) over (partition by digest, n) as keep from d)
select page_id, url, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and place > 1 then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and place > 1 then keep end as refers_to
from r
"""
