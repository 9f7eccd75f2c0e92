"""Queries over the driver's tables, one for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planimetra.llm import audit, decontamination, html, language, lines, minhash, mixing, negatives, quality, substring, suffixes, syncmers, toxicity
from planimetra.llm.tables import public_id


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.decide(_read(spark, sf_dir, "documents"))
    return decided.select(public_id(), "size", "source_size", "target", "taken")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = decontamination.flag(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", "item_id", "overlap", "contaminated")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("row_key")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents"), with_bytes=False).drop("kept_bytes")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.prepared(_read(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = audit.failures(_read(spark, sf_dir, "documents"))
    return audit.audit(audit.labelled(failed, _read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS d FROM hashed GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hashed JOIN firsts USING (h) WHERE d < doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i AS line, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
), worded AS (
  SELECT doc_id, line, len(w) AS n, w, (doc_id, line) AS p, md5(array_to_string(w, ' ')) AS h FROM lines WHERE len(w) > 0
), kinds AS (
  SELECT h, any_value(n) AS n, any_value(w) AS w, min(p) AS p FROM worded GROUP BY h
), deleted AS (
  SELECT h, n, p, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kinds WHERE n >= 8)
), replaced AS (
  SELECT v, n, i, min(p) AS least FROM deleted GROUP BY v, n, i
), shorter AS (
  SELECT h AS v, min(p) AS least FROM kinds WHERE n >= 8 GROUP BY h
), longer AS (
  SELECT v, min(p) AS least FROM deleted GROUP BY v
), near AS (
  SELECT h FROM deleted JOIN replaced USING (v, n, i) WHERE least < p
  UNION SELECT h FROM deleted JOIN shorter USING (v) WHERE least < p
  UNION SELECT h FROM kinds JOIN longer ON kinds.h = longer.v WHERE kinds.n >= 8 AND least < p
), gone AS (
  SELECT doc_id, line FROM worded JOIN kinds USING (h) WHERE worded.p <> kinds.p OR h IN (SELECT h FROM near)
), kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY line) AS text, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER by_score)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW by_score AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER by_score <= 10
""",
    "op13_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT doc_id, part, (len(w) < 200)::INTEGER AS A, (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER AS B,
         (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INTEGER AS C, regexp_matches(text, '[#$%&*|]')::INTEGER AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS E
  FROM words
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) t(step)
), told AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own,
         len([1 FOR x IN string_split(earlier, '') IF coalesce(fails[x], 0) = 1]) > 0 AS gone, A + B + C + D + E = 1 AS alone
  FROM (SELECT *, MAP {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS fails FROM kinds), steps
), summed AS (
  SELECT part, filter_order, step, f, sum(n) AS total, coalesce(sum(n) FILTER (own = 1 AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (own = 1 AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own = 1 AND alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (own = 1 AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own = 1 AND NOT gone), 0) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
""",
}
