"""The queries of this subpackage over the test tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import html_extraction as html
from . import language_id as languages
from . import mixing, near_dedup, packing, pii
from . import quality_rules as rules
from . import token_counts as tokens
from . import warc
from .common import table


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op2_token_counts(spark, sf_dir):
    return tokens.token_counts(_documents(spark, sf_dir))


def op3_exact_dedup(spark, sf_dir):
    return dedup.exact_groups(_documents(spark, sf_dir), keep="max")


def op4_html_extraction(spark, sf_dir):
    return html.main_text(_pages(spark, sf_dir))


def op5_warc(spark, sf_dir):
    archives = table(warc.bundles(_pages(spark, sf_dir)), "warc")
    return warc.records(archives).drop("url", "html")


def op6_pii(spark, sf_dir):
    return pii.digests(pii.spans(_documents(spark, sf_dir)))


def op7_language_id(spark, sf_dir):
    return languages.language_id(_documents(spark, sf_dir))


def op8_source_mixing(spark, sf_dir):
    return mixing.scheduled(_documents(spark, sf_dir).select("doc_id", "source"))


def op9_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(_documents(spark, sf_dir), words=4, percent=80)


def op10_quality_rules(spark, sf_dir):
    return rules.quality_rules(_documents(spark, sf_dir)).drop("source")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(b) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY b)""",
    "op5_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS f FROM t)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> f THEN f END AS refers_to
        FROM s""",
}
