"""Queries of operators that compare texts with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustweave.llm.chunk_dedup import repeated_spans
from trustweave.llm.common import table
from trustweave.llm.decontamination import contaminated, lengths_of, masks_for
from trustweave.llm.jaccard_join import similar_groups
from trustweave.llm.line_dedup import repeated_lines
from trustweave.llm.query_registry import query
from trustweave.llm.suffix_dedup import cut_repeats, summary


def _mask_rows() -> str:
    """(m, p, lo, hi): the places of a mask's ones, and the item lengths that need it."""
    masks = sorted({m for n in range(1, 14) for m in masks_for(n)}, key=lambda m: (len(m), m))
    return ", ".join(f"({k}, {[i for i, bit in enumerate(m) if bit == '1']}, {lengths[0]}, {lengths[-1]})" for k, (m, lengths) in enumerate(lengths_of(tuple(masks))))


@query(
    "op5_decontamination",
    rf"""
    WITH dw AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
    ), iw AS (
        SELECT * FROM (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
        ) WHERE len(w) > 0
    ), masks AS (
        SELECT * FROM (VALUES {_mask_rows()}) v(m, p, lo, hi) WHERE EXISTS (SELECT 1 FROM iw WHERE least(len(w), 13) BETWEEN lo AND hi)
    ), ds AS (
        SELECT DISTINCT doc_id, i, m, array_to_string(list_transform(p, lambda x: w[i + x]), ' ') AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw), masks WHERE i + list_max(p) <= len(w)
    ), bs AS (
        SELECT item_id, j, m, array_to_string(list_transform(p, lambda x: w[j + x]), ' ') AS h
        FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS j FROM iw), masks WHERE j + list_max(p) <= len(w) AND least(len(w), 13) BETWEEN lo AND hi
    ), hits AS (
        SELECT DISTINCT doc_id, item_id, i - j AS shift FROM ds JOIN bs USING (m, h)
    ), aligned AS (
        SELECT h.doc_id, h.item_id, least(len(iw.w), 20) AS width, len(iw.w) AS n,
            list_transform(range(1, len(iw.w) + 1), lambda k: CASE WHEN k + shift > 0 AND iw.w[k] = dw.w[k + shift] THEN 1 ELSE 0 END) AS same
        FROM hits h JOIN dw USING (doc_id) JOIN iw USING (item_id)
    ), best AS (
        SELECT doc_id, item_id, width,
            list_max(list_transform(range(1, n - width + 2), lambda k: list_sum(same[k : k + width - 1]))) AS matched
        FROM aligned
    )
    SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched_words, CAST(max(width) AS INTEGER) AS window_words
    FROM best GROUP BY doc_id, item_id HAVING max(matched) >= ceil(0.8 * max(width))
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_line_dedup",
    r"""
    WITH split_lines AS (
        SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS line_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    ), found AS (
        SELECT doc_id, line, list_filter(regexp_split_to_array(line_text, '\s+'), lambda x: x <> '') AS w FROM split_lines
    ), long_lines AS (
        SELECT doc_id, line, {'d': doc_id, 'l': line} AS place, w, array_to_string(w, ' ') AS words FROM found WHERE len(w) >= 1
    ), firsts AS (
        SELECT words, any_value(w) AS w, min(place) AS first FROM long_lines GROUP BY words
    ), less AS (
        SELECT first, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS v
        FROM (SELECT first, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 2)
    ), replaced AS (
        SELECT b.first, min(a.first) AS keep FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.first < b.first GROUP BY b.first
    ), inserted AS (
        SELECT greatest(l.first, f.first) AS first, min(least(l.first, f.first)) AS keep
        FROM less l JOIN firsts f ON l.v = f.words AND len(f.w) >= 2 GROUP BY greatest(l.first, f.first)
    ), near AS (
        SELECT first, min(keep) AS keep FROM (SELECT * FROM replaced UNION ALL SELECT * FROM inserted) GROUP BY first
    )
    SELECT l.doc_id, CAST(l.line AS INTEGER) AS line, f.first.d AS keep_doc, CAST(f.first.l AS INTEGER) AS keep_line, 0 AS distance
    FROM long_lines l JOIN firsts f USING (words) WHERE l.place > f.first
    UNION ALL
    SELECT first.d, CAST(first.l AS INTEGER), keep.d, CAST(keep.l AS INTEGER), 1 FROM near
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(cut_repeats(table(spark, sf_dir, "documents")))


@query(
    "op10_jaccard_join",
    r"""
    WITH RECURSIVE ws AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, list_distinct(CASE
            WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM ws
    ), grams AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS shared
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id
    ), links AS (
        SELECT a, b FROM common WHERE 100 * shared >= 90 * (x + y - shared)
    ), reach(a, b) AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = doc_id), doc_id)) AS component_id
    FROM sets
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)
