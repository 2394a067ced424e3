"""Queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import bpe, exact_dedup, html_text, license_scan, media, mixing, ngram_join, secret_scan, toxicity, url_filter
from contactloom.session import prepare, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.duplicate_groups(table(prepare(spark), sf_dir, "documents")).drop("n_chars")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive image, read back."""
    return media.digests(media.media(table(prepare(spark), sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    return license_scan.digest(license_scan.scan(table(prepare(spark), sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.digest(secret_scan.secrets(table(prepare(spark), sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).drop("html").withColumn("n_chars", F.char_length("text").cast("long"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(table(prepare(spark), sf_dir, "pages")).drop("hits")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    prepare(spark)
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and links of every document."""
    return ngram_join.near_groups(table(prepare(spark), sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded again."""
    return bpe.digests(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    planned = mixing.plan(table(prepare(spark), sf_dir, "documents"))
    return planned.selectExpr("id AS doc_id", "size", "source_size", "target", "size * copies AS taken")


OP1_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
r AS (SELECT *, sha256(norm) AS text_sha256,
  row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS place,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""

OP10_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '~' || coalesce(text, '')) AS word, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS below,
  sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  sum(source_size) OVER () AS total FROM c),
l AS (SELECT arg_min((1.5::DOUBLE * total - below) / rest, (ratio, place)) FILTER ((1.5::DOUBLE * total - below) / rest <= ratio) AS level FROM o),
t AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0.0::DOUBLE END AS rate FROM c, l),
u AS (SELECT *, ('0x' || substr(md5(word), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM d)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_url_filter": url_filter.oracle(), "op10_mixing": OP10_SQL}
