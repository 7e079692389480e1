"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, packing, pii, quality, tokens, toxicity, urls, warc

#: (verdict, host, path prefix)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that the URL list blocks, under each of the domains (fixed values).
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "malware-drop", "phish-bank", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{host}.{domain}/",) for host in LISTED_HOSTS for domain in LISTED_DOMAINS], "listed string")
    return urls.filter_urls(_table(spark, sf_dir, "pages"), listed, URL_RULES, canonical=True).select("page_id", "host", "path", "rule", "verdict")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).drop("cleaned")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents"), secret=pii.session_secret(spark)).select("doc_id", "text", "n_entities")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1, "op2_token_counts": op2, "op3_url_filter": op3, "op4_toxicity": op4, "op5_jaccard_join": op5,
        "op6_quality_rules": op6, "op7_packing": op7, "op8_pii_surrogates": op8, "op9_language_id": op9, "op10_warc": op10,
    }


_FITS = {f"{host}{path}": f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '{path}'))" for _, host, path in URL_RULES}
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
_LISTED = " OR ".join(f"('.' || plain) LIKE '%.{host}.{domain}'" for host in LISTED_HOSTS for domain in LISTED_DOMAINS)

OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id, strpos(url, '://') AS p, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), hosts AS (
  SELECT page_id,
    CASE WHEN p > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN p > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), split AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS plain FROM hosts
)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{v}'" for v, h, p in _BY_LENGTH)}
    WHEN plain <> '' AND ({_LISTED}) THEN 'block' ELSE 'allow' END AS verdict
FROM split
"""

_LINE_MARKS = "len(l) - len(translate(l, '|›»•', ''))"
OP6_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), grams AS (
  SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS ks(k) GROUP BY r
), judged AS (
  SELECT r, sum(len(l)) AS total,
    sum(CASE WHEN regexp_matches(l, '{quality.SENTENCE_MARKS}') AND (len(l) - len(translate(l, '{quality.SYMBOLS}', ''))) * 100 <= len(l) * {quality.SYMBOL_PERCENT} AND NOT regexp_matches(lower(l), '{"|".join(quality.BOILERPLATE)}')
      AND NOT ({_LINE_MARKS} >= {quality.NAV_LEAST} AND ({_LINE_MARKS}) * {quality.NAV_WORDS} >= len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) - ({_LINE_MARKS}))
      THEN len(l) ELSE 0 END) AS good
  FROM (SELECT r, unnest(lines) AS l FROM base) GROUP BY r
), counted AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(t) - len(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(total, 0) AS total, coalesce(good, 0) AS good
  FROM base b LEFT JOIN covered c USING (r) LEFT JOIN judged j USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good * 100 >= total * {quality.LEFT_PERCENT} AS kept
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_quality_rules": OP6_SQL}
