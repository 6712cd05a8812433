"""Queries of operators that judge each row by itself."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trustweave.llm.common import table
from trustweave.llm.html_text import extract
from trustweave.llm.packing import pack_documents
from trustweave.llm.quality import classify
from trustweave.llm.query_registry import query
from trustweave.llm.url_filter import Rule, filter_urls
from trustweave.llm.winnowing import compare_with_edit_and_next

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op8_url_filters",
    """
    WITH rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), hosts AS (
        SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
    ), parts AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM hosts
    ), rules(action, rule_host, rule_path) AS (
        VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
    ), fits AS (
        SELECT p.page_id, p.host, p.path, r.*,
            row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
        FROM parts p LEFT JOIN rules r
            ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
    )
    SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit_and_next(table(spark, sf_dir, "documents"))
