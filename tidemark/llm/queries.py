"""One query per corpus operator over whole tables, with the equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, line_dedup, lm_score, media, mixing, packing, quality_qda, quality_rules, simhash, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(divisor: int):
    """crc32 of the id as text, modulo divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def held_out(divisor: int, own: int):
    """Whether the id has that remainder; a null id is never learned from, so it is held out too."""
    return F.coalesce(remainder(divisor) == own, F.lit(True)).alias("held_out")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path()))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.drop_lines(docs)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = simhash.near_duplicates(docs)
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, manifest = media.write_archives(documents(spark, sf_dir).select("doc_id", "text"))
    return media.described(media.read_archives(spark, root, manifest))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    models = langid.LanguageModels(langid.training_sample(docs, remainder(5) != 0))
    out = langid.identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", held_out(5, 0), "lang_pred", "score", "cross_entropy", "rejected")


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality_qda.learn_and_classify(docs, labels, remainder(4) != 2)
    return out.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("doc.doc_id", *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scores(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    plan = mixing.mixing_plan(docs.select("doc_id", "source", "text"))
    return plan.select("doc.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_warc, op4_simhash, op5_media_columns, op6_language_id, op7_quality_qda, op8_quality_rules, op9_lm_score, op10_mixing)}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    "op8_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words FROM twice GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
), judged AS (
  SELECT doc_id, line, n,
    (NOT regexp_matches(line, '{end}') AND (n <= 3 OR n >= 10 AND 2 * len(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) < n))
    OR 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
    OR 2 * len(regexp_extract_all(line, '[!?]')) > n
    OR (len(regexp_extract_all(line, '[|»›•·]')) + len(regexp_extract_all(line || ' ', '(^|\s)[>/]\s')) >= 3
        AND 7 * (len(regexp_extract_all(line, '[|»›•·]')) + len(regexp_extract_all(line || ' ', '(^|\s)[>/]\s'))) >= n)
    OR (n <= 40 AND regexp_matches(lower(line), '{boilerplate}')) AS failed
  FROM lines WHERE n > 0
), per AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS lost FROM judged GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost <= n_words AS kept
FROM base""".replace("{boilerplate}", quality_rules.BOILERPLATE_PATTERN.replace("'", "''")).replace("{end}", quality_rules.SENTENCE_END.replace("'", "''")),
    "op9_lm_score": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS c FROM d),
tok AS (SELECT r, i, c, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM words WINDOW w AS (PARTITION BY r ORDER BY i)),
total AS (SELECT count(*) AS n FROM tok),
counted AS (
  SELECT r, i, (SELECT n FROM total) - count(*) OVER (PARTITION BY r) AS n0,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS n1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) ELSE 0 END AS n2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) ELSE 0 END AS n3
  FROM tok
), s AS (
  SELECT r,
    CASE WHEN n3 > 0 THEN ln(n3 / (lag(n2) OVER w)::DOUBLE)
         WHEN n2 > 0 THEN CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + ln(n2 / (lag(n1) OVER w)::DOUBLE)
         ELSE CASE WHEN i > 2 THEN 2 WHEN i > 1 THEN 1 ELSE 0 END * ln(0.4) + CASE WHEN n1 > 0 THEN ln(n1 / n0::DOUBLE) ELSE -ln(n0 + 1.0::DOUBLE) END END AS s
  FROM counted WINDOW w AS (PARTITION BY r ORDER BY i)
), sums AS (SELECT r, sum(s) AS score FROM s GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(score, 0), 3) AS score, round(score / len(words), 6) AS mean_score
FROM d LEFT JOIN sums USING (r)""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM src
), filled AS (
  SELECT *, cap / weight AS full_at,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_below,
    sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_above
  FROM weighted
), levels AS (
  SELECT full_at, k, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM src) - cap_below) / weight_above AS level FROM filled
), level AS (
  SELECT coalesce((SELECT level FROM levels WHERE full_at > level ORDER BY full_at, k LIMIT 1), 'inf'::DOUBLE) AS level
), planned AS (
  SELECT source, source_size, CASE WHEN full_at <= level THEN cap ELSE weight * level END AS target FROM filled, level
), rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated""",
}
