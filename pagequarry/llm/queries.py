"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontaminate, embedding_dups, fill_in_middle, mixing, quality, separator_scan, simhash_gray, suffix_dedup, token_files, url_filter, wrapper_extract
from .common import stage_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, path and verdict of the rules that op4 applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_documents(files)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.components(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, eod=50256)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.main_text(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=50)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words("text").alias("size"))
    mixed = mixing.mix(stage_table(rows, "sizes"), cycle=(3.0, 1.0, 2.0), share=1.5, epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_embedding_near_dedup,
        op3_token_counts,
        op4_url_filter,
        op5_bpe_round_trip,
        op6_decontamination,
        op7_main_text,
        op8_quality_classifier,
        op9_simhash_near_dedup,
        op10_suffix_dedup,
        op11_fill_in_middle,
        op12_conversation_repair,
        op13_source_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        p AS (
            SELECT page_id, row_number() OVER () AS n_row,
                translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM u),
        r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (
            SELECT n_row, h || q AS rule, v, length(h || q) * 1000 + length(h) AS weight
            FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
        SELECT p.page_id, p.host, p.path, arg_max(f.rule, f.weight) AS rule, coalesce(arg_max(f.v, f.weight), 'allow') AS verdict
        FROM p LEFT JOIN f ON p.n_row = f.n_row GROUP BY p.n_row, p.page_id, p.host, p.path
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 32) AS place FROM documents),
        s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
        w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
        o AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, k) - cap AS held, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, k) + weight AS rest FROM w),
        first_free AS (SELECT (total - held) / rest AS level FROM o WHERE cap / weight > (total - held) / rest ORDER BY cap / weight, k LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM first_free) = 0 THEN cap ELSE least(cap, weight * (SELECT level FROM first_free)) END AS target FROM w),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
        g AS (SELECT source, place, sum(size) AS unit FROM d GROUP BY source, place),
        r AS (SELECT source, place, unit, sum(unit) OVER (PARTITION BY source ORDER BY place) AS upto FROM g),
        x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, r.upto - r.unit / 2 <= e.target - e.whole * e.source_size AND e.target - e.whole * e.source_size > 0 AS more
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.place = r.place)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
    """,
}
