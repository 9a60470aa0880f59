"""The thin ``opN_<name>`` queries: each applies its operator, with production parameters, to its whole table
and derives the digest columns, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, langid, licenses, line_dedup, mixing, simhash, spelling, substring_dedup, token_counts, toxicity, warc
from .common import held_out, scratch_path, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and label of the labelled rows outside the held-out fold."""
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_labels(spark, sf_dir))
    return toxicity.score(docs, model, [held_out(F.col("doc_id")).alias("held_out")]).select("doc_id", "held_out", "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    read = warc.read_archives(spark, written)
    # the archives were written just now: a gap is an error, not a loss
    damage = F.raise_error(F.concat(F.lit("damaged archive "), "path", F.lit(" at "), F.col("offset").cast("string"))).cast("boolean")
    records = read.where(F.when(F.col("kind") == "gap", damage).otherwise(F.lit(True)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_passages", "repeated_words")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, profiles, [held_out(F.col("doc_id")).alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined.values(), F.round("score", 6).alias("score"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, drop_one_in=199)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, [F.col("doc_id")])


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_toxicity, op3_warc, op4_substring_dedup, op5_language_id, op6_line_dedup, op7_exact_dedup, op8_license_scan, op9_simhash,
        op10_decontamination, op11_spelling_variants, op12_filter_audit, op13_token_counts,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line,
    translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_license_scan": licenses.oracle(),
    "op10_decontamination": f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(_LOW)} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(ws[s:s + 9], ' ') AS win, least(len(ws), 10) AS n FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(s) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
p AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM g), unnest(range(1, len(ws) - n + 2)) AS t(s)),
h AS (SELECT doc_id, s, p.n, item_id FROM p JOIN g ON p.win = g.win AND p.n = g.n),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (coalesce(min(doc_id) OVER (PARTITION BY text) < w.doc_id, false))::INT AS fails
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT i, substr('ABCDE', i + 1, 1) AS c, CAST(pow(2, i) AS INT) AS bit FROM range(5) AS t(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, range(1, 6) AS t(k)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(concat('0b', substr(bits, 1 + 5 * j, 5)) AS INTEGER), 1) FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM f)""",
}
