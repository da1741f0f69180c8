"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlens.llm import (
    bpe, language, licences, merkle, mixing, neighbours, perplexity, simhash, toxicity, turn_trie, url_rules,
    whitening, wrappers,
)
from lendlens.llm.common import crc_bucket

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(parts: int, part: int):
    return F.coalesce(crc_bucket(F.col("doc_id"), parts) == part, F.lit(False))


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.edit_report(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    members = F.array("source")
    mix = mixing.plan_mix(docs, members)
    rows = mixing.with_copies(docs, mix, members).select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "copies")
    sources = mix.source_table(spark)
    return rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out(3, 1))
    model = neighbours.fit_quality(docs, labels)
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), neighbours.quality(spark, F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", bpe.encoded_digest(spark, F.col("text"), vocabulary()).alias("r")).select("doc_id", "r.*")


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url")) \
        .select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out(4, 2))
    model = toxicity.fit_toxicity(docs, labels)
    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), toxicity.toxicity(spark, F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judge_texts(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs.where(~held_out(4, 2)))
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), language.language(spark, F.col("text"), model).alias("r")) \
        .select("doc_id", "held_out", "r.*")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = turn_trie.numbered_turns(table(spark, folder, "conversations"))
    conv = F.col("conv_id")
    shared = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6))
    return turn_trie.prefix_trie(*turn_trie.rebuilt(turns, shared, conv - conv % 100, most=5))


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, folder, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_fingerprints, op2_mixing, op3_quality, op4_bpe, op5_url_filters, op6_toxicity, op7_licences,
    op8_quality_rules, op9_simhash, op10_language, op11_whitening, op12_prefix_trie,
    op13_main_text)}

URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])(casino|bets|poker|pills|viagra|porn|xxx|escort|payday|torrent)([^a-z0-9]|$)')
    OR regexp_matches(path, '/(adserver|doubleclick|wp-login\.php|cgi-bin)(/|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

LICENCE_SQL = r"""
WITH templates AS (
  SELECT licence, list_filter(string_split(body, ' '), lambda x: x <> '') AS w FROM (VALUES
  %s) AS t(licence, body)),
normal AS (
  SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10)) AS lines FROM documents),
units AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) AS body FROM normal
  UNION ALL SELECT doc_id, 0, array_to_string(lines, ' ') FROM normal WHERE len(lines) > 1),
words AS (SELECT doc_id, unit, list_filter(string_split(body, ' '), lambda x: x <> '') AS w FROM units),
pairs AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p
  FROM words WHERE len(w) >= 2),
shapes AS (
  SELECT licence, len(w) AS m, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM templates),
scored AS (
  SELECT doc_id, unit, licence, 2 * len(list_intersect(p, t)) / (len(p) + len(t)) AS dice
  FROM pairs JOIN shapes ON len(p) BETWEEN len(t) * 0.66 AND len(t) * 1.51 AND list_has_any(p, t)),
anchors AS (
  SELECT licence, word, min(i) AS spot FROM (SELECT licence, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM templates)
  WHERE length(word) >= 4 GROUP BY licence, word HAVING count(*) = 1),
texts AS (
  SELECT doc_id, list_filter(string_split(array_to_string(lines, ' '), ' '), lambda x: x <> '') AS w FROM normal),
spots AS (
  SELECT DISTINCT doc_id, licence, greatest(i - spot, 0) AS start
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts) JOIN anchors USING (word)),
windows AS (
  SELECT doc_id, licence, start, t, list_slice(w, start + 1, start + m) AS w FROM spots JOIN shapes USING (licence) JOIN texts USING (doc_id)),
passages AS (
  SELECT doc_id, licence, start, 2 * len(list_intersect(p, t)) / (len(p) + len(t)) AS dice
  FROM (SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM windows)),
found AS (
  SELECT doc_id, unit, 0 AS first_word, licence, dice, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence) AS place FROM scored
  UNION ALL
  SELECT doc_id, -1, start + 1, licence, dice, row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, start) FROM passages)
SELECT doc_id, unit::BIGINT AS unit, first_word::BIGINT AS first_word, licence, dice FROM found WHERE place = 1 AND dice >= 0.8
""" % ",\n  ".join(f"('{name}', '{' '.join(licences.words_of(body))}')" for name, body in sorted(licences.TEMPLATES.items()))

# Prefixes as joined digests; totals reach a node over the paths of its descendants' smallest members.
TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
    sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS d, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, count(*) AS own, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
sized AS (SELECT i.*, least(h, coalesce(b.own, 0)) AS taken FROM ids i LEFT JOIN (SELECT conv_id AS base, own FROM ids) b ON base = conv_id - conv_id % 100),
made AS (
  SELECT s.conv_id, p, d, chars FROM sized s JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 100 AND p <= h
  UNION ALL SELECT s.conv_id, p - h + taken, d, chars FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND p > h),
paths AS (
  SELECT conv_id, p, chars, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY p) AS prefix FROM made
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
ends AS (SELECT conv_id, max(p) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p, prefix, min(conv_id) AS owner, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (p = n), '')) AS ends_sha256
  FROM paths JOIN ends USING (conv_id) GROUP BY p, prefix),
linked AS (
  SELECT n.*, u.owner AS parent, (SELECT count(*) FROM nodes k WHERE k.p = n.p + 1 AND k.prefix[:-65] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.p = n.p - 1 AND u.prefix = n.prefix[:-65]),
totals AS (
  SELECT a.p, a.prefix, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM linked x JOIN paths a ON a.conv_id = x.owner AND a.p <= x.p GROUP BY a.p, a.prefix)
SELECT owner AS conv_id, p::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN totals USING (p, prefix)
"""

# The given pages hold their main text in one article element of headings and paragraphs.
ARTICLE_SQL = r"""
WITH inner_html AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS a FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM inner_html),
decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
    t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM decoded
"""

ORACLES: dict[str, str] = {
    "op5_url_filters": URL_SQL, "op7_licences": LICENCE_SQL, "op12_prefix_trie": TRIE_SQL, "op13_main_text": ARTICLE_SQL}
