"""The queries of this subpackage: each operator over its whole table, and digests of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import bpe, chat, decontam, embedding_dedup, html_extract, pii, quality, simhash, substring_dedup, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of documents, and the terms that disclose it."""
    out = pii.protected_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(n, pii.KINDS), F.sha2(pii.joined(F.col("_base")), 256).alias("base_sha256"), pii.joined(F.col("_spans")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in passages of benchmark items."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their decoding, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rules and by the reputation of its host."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.labelled_outcomes(pages, _table(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_decontamination, op3_embedding_dedup, op4_substring_dedup, op5_simhash, op6_html_extraction, op7_bpe, op8_quality, op9_url_filter, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": _OP9, "op10_chat_format": _OP10}


_OP9 = r"""
WITH parts AS (
  SELECT page_id, instr(url, '://') AS p, substr(url, instr(url, '://') + 3) AS rest FROM pages
), urls AS (
  SELECT page_id,
         CASE WHEN p > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN p > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), rules(rule, action, h, s) AS (
  VALUES ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'),
         ('net/de/', 'block', 'net', '/de/'), ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
), known AS (
  SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), outcomes AS (
  SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site, bad FROM (SELECT host, TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1) AS BIGINT) AS doc_id FROM urls) JOIN known USING (doc_id)
), hosts AS (
  SELECT *, regexp_replace(domain, '^[^.]*\.', '') AS suffix FROM (
    SELECT site, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad,
           array_to_string(string_split(site, '.')[CASE WHEN regexp_matches(site, '(^|\.)(ac|co|com|edu|gov|net|or|org)\.[^.][^.]$') THEN -3 ELSE -2 END:], '.') AS domain
    FROM outcomes WHERE site <> '' GROUP BY site)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), sums AS (
  SELECT 3 AS level, '' AS key, n, bad FROM suffixes UNION ALL SELECT 2, suffix, n, bad FROM domains UNION ALL SELECT 1, domain, n, bad FROM hosts
), moments AS (
  SELECT level, key, sum(n) AS nn, sum(bad) AS bb, count(*)::DOUBLE AS k, sum(n * n) AS n2, sum(bad * (bad / n)) AS bp, sum(bad) / sum(n) AS m FROM sums GROUP BY ALL
), rho AS (
  SELECT *, CASE WHEN m * (1 - m) * (nn - n2 / nn - (k - 1)) > 0
                 THEN (bp - nn * m * m - m * (1 - m) * (k - 1)) / (m * (1 - m) * (nn - n2 / nn - (k - 1))) END AS r FROM moments
), priors AS (
  SELECT level, key, nn, bb, CASE WHEN r > 0 THEN least(1000.0, greatest(1.0, (1 - r) / r)) ELSE 1000.0 END AS strength FROM rho
), m_suffix AS (
  SELECT a.key AS suffix, a.strength, (a.bb + o.strength * (o.bb / o.nn)) / (a.nn + o.strength) AS m FROM priors a, priors o WHERE a.level = 2 AND o.level = 3
), m_domain AS (
  SELECT d.domain, p.strength, (d.bad + s.strength * s.m) / (d.n + s.strength) AS m
  FROM domains d JOIN m_suffix s USING (suffix) JOIN priors p ON p.level = 1 AND p.key = d.domain
), posterior AS (
  SELECT site, bad + strength * m AS a, n - bad + strength * (1 - m) AS b FROM hosts JOIN m_domain USING (domain)
), reputation AS (
  SELECT site, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM posterior
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN low > 0.5 THEN 'block' END, 'allow') AS verdict,
       round(rate, 9) AS bad_rate, round(low, 9) AS bad_rate_low
FROM urls LEFT JOIN fit USING (page_id) LEFT JOIN reputation ON site = regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')
"""

_OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, role = 'assistant' AS learned,
         length(text) + len(regexp_extract_all(text, '### Assistant:|### System:|### User:|</turn>|###|\\')) AS hidden,
         CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 END AS named,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (learned), '')) AS loss_sha256,
       sum(4 + named + 2 + hidden + 8)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN k = 1 WHEN 'user' THEN before IN ('', 'system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END)
         AND arg_max(role, k) = 'assistant' AS valid
FROM marked GROUP BY conv_id
"""
