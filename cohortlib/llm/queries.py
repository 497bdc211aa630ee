"""The named queries of this subpackage, one for each operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlib.llm import bpe, conversation_repair, fingerprint, host_rules, langid, mixing, ordinal, paragraphs, ppm, ranked_search, simhash, tool_calls, url_filter
from cohortlib.llm.helpers import documents, prepare


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every text and of its edited text."""
    return fingerprint.compare_neighbours(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and their decoding."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word-unigram log probabilities of every text."""
    return ppm.score(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and the component of its near duplicates."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every text, the verdict on its host, and whether it stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return host_rules.judged(docs).drop("source").withColumn("host_rate", F.round("host_rate", 6))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) AS n
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT r, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS x FROM f GROUP BY source),
p AS (SELECT sum(x) / sum(n) AS mean FROM h),
q AS (
  SELECT mean, sum(n * (x / n - mean) ** 2) - (count(*) - 1) * mean * (1 - mean) AS over,
         (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) * mean * (1 - mean) AS below FROM h, p GROUP BY mean),
a AS (SELECT mean, CASE WHEN below > 0 THEN 1 / greatest(least(over / below, 1.0), 1e-6) - 1 ELSE 0 END AS weight FROM q),
v AS (SELECT source, (x + mean * weight) / (n + weight) AS host_rate FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) AS host_rate,
       host_rate > 0.5 AS host_rejected, NOT base_failed AND NOT host_rate > 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the sources, and how much of each document the mix takes from where on."""
    return mixing.mixed(documents(spark, sf_dir))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, checked and serialised."""
    prepare(spark)
    calls, results = tool_calls.from_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.link(calls, results)


OP7_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c0 AS (
  SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, turn, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text,
         count(*) OVER (PARTITION BY conv_id, turn) AS n_calls, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text) AS k
  FROM m WHERE role IN ('user', 'system')),
c AS (SELECT conv_id, call_id, turn, name, text, n_calls FROM c0 WHERE k = 1),
r AS (
  SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM m WHERE role = 'assistant' GROUP BY ALL),
edge AS (SELECT a.conv_id, a.call_id, b.call_id AS waits_for FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
walk(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0 FROM c
  UNION
  SELECT edge.conv_id, edge.call_id, level + 1 FROM walk JOIN edge ON edge.conv_id = walk.conv_id AND edge.waits_for = walk.call_id),
lev AS (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL),
o AS (
  SELECT lev.*, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position FROM lev JOIN c USING (conv_id, call_id)),
j AS (
  SELECT c.*, level, position, CASE WHEN text IS NULL THEN 'text: missing' WHEN length(text) < 1 THEN 'text: too short'
           WHEN length(text) > CASE name WHEN 'ask' THEN 1500 ELSE 500 END THEN 'text: too long' WHEN turn < 0 THEN 'turn: too small' END AS error
  FROM c JOIN o USING (conv_id, call_id))
SELECT conv_id, call_id, name, turn, level, position, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       CASE WHEN n_calls IS NOT NULL THEN error IS NULL END AS valid, error,
       '{' || CASE WHEN n_calls IS NOT NULL THEN '"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END
         || '"turn":' || turn || '},' ELSE '' END || '"id":"' || call_id || '"'
         || CASE WHEN n_calls IS NOT NULL THEN ',"name":"' || name || '"' ELSE '' END
         || CASE WHEN n_results IS NOT NULL THEN ',"result":' || coalesce(to_json(content), 'null') ELSE '' END || '}' AS json
FROM j FULL JOIN r USING (conv_id, call_id)
"""


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every text, fitted on rated ones."""
    return ordinal.select(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the labelled ones."""
    return langid.identify(documents(spark, sf_dir))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages that an earlier document has."""
    return paragraphs.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest repair of its structure."""
    prepare(spark)
    return conversation_repair.audit_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: its rule's, or that of the urls it leads to or comes from."""
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge(pages.select("page_id", "url"), rules, url_filter.page_links(pages)).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, on_host, start) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
attr AS (
  SELECT url, trim(regexp_extract(tag, '(?is)\srel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''') AS rel,
         trim(regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''') AS href,
         trim(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''') AS equiv,
         trim(regexp_extract(tag, '(?is)\scontent\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''') AS content
  FROM tags),
found AS (
  SELECT url, trim(replace(CASE WHEN regexp_matches(lower(rel), '(^|\s)canonical(\s|$)') THEN href
                                ELSE regexp_extract(content, '(?is)url\s*=\s*[''"]?([^''"]*)', 1) END, '&amp;', '&')) AS link
  FROM attr WHERE regexp_matches(lower(rel), '(^|\s)canonical(\s|$)') OR lower(trim(equiv)) = 'refresh'),
declared AS (
  SELECT url AS src, CASE WHEN contains(link, '://') THEN link
                          WHEN starts_with(link, '//') AND contains(url, '://') THEN regexp_extract(url, '^([^:/?#]+):', 1) || ':' || link
                          WHEN starts_with(link, '/') AND contains(url, '://') THEN regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) || link END AS dst
  FROM found),
urls AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT dst FROM declared WHERE contains(dst, '://')),
named AS (
  SELECT url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '&'),
                                     lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS q
  FROM urls),
links AS (
  SELECT src, dst FROM declared WHERE src <> dst
  UNION
  SELECT url, 'http://' || regexp_replace(host, '^(www|m)\.([^.]+\.)', '\2') || regexp_replace(path, '(\.html|\.htm|/)$', '')
         || CASE WHEN q <> '' THEN '?' || q ELSE '' END FROM named),
edge AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
every AS (SELECT url, host, path FROM p WHERE url IS NOT NULL UNION SELECT url, host, path FROM named UNION
          SELECT b, translate(regexp_extract(b, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 regexp_extract(b, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) FROM edge),
best AS (
  SELECT url, max({'size': length(on_host) + length(start), 'rule': on_host || start, 'action': action}) AS best
  FROM every JOIN r ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, start) GROUP BY url),
blocked AS (SELECT DISTINCT a AS url FROM reach JOIN best ON best.url = b WHERE best.action = 'block')
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN b.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (url) LEFT JOIN blocked b USING (url)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    index = ranked_search.build(documents(spark, sf_dir))
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_byte_bpe, op3_ppm, op4_simhash, op5_host_rules, op6_mixing, op7_tool_calls, op8_ordinal,
                                    op9_language_id, op10_paragraphs, op11_conversation_repair, op12_url_filter, op13_ranked_search)}


def all_sql() -> dict[str, str]:
    return {"op5_host_rules": OP5_SQL, "op7_tool_calls": OP7_SQL, "op12_url_filter": OP12_SQL}
