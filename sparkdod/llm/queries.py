"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, exact_dedup, line_dedup, mixing, near_dup, pii, quality, secret_scan, substring_dedup, token_align, token_count, toxicity
from .common import documents

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), size=4)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = pii.find_pii(documents(spark, sf_dir)), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return out.select("doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                      F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean(documents(spark, sf_dir), texts=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_words")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = secret_scan.find_secrets(documents(spark, sf_dir)), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.KINDS))
    return out.select("doc_id", *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in secret_scan.KINDS],
                      F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def severity_grade() -> Column:
    """Grades from the table ``labels``: 0 not toxic, 1 toxic, 2 toxic in a text of low quality."""
    return F.col("toxic") + F.col("toxic") * (1 - F.coalesce(F.col("quality"), F.lit(1)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), severity_grade())
    return toxicity.severity(docs, model).withColumn("kept", ~F.col("toxic"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.digests_of_all(rows, conversation_repair.repair(conversation_repair.damaged(rows)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_align.align(documents(spark, sf_dir))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"), "n_group_links")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_substring_dedup, op3_bpe, op4_pii, op5_quality, op6_exact_dedup, op7_line_dedup, op8_secrets, op9_mixing, op10_toxicity,
                                   op11_conversation_repair, op12_token_alignment, op13_token_counts)}

ORACLE = {
    # all pairs that share a shingle, then components by repeated relaxation
    "op1_near_dup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                    ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)""",
    # windows by their text; a word goes if one of the twenty windows over it starts earlier somewhere else
    "op2_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
        w AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS i, ws FROM d WHERE len(ws) >= 20),
        h AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t FROM w),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
        gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS j FROM late) GROUP BY doc_id),
        k AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
                     list_filter(ws, lambda x, j: NOT list_contains(coalesce(js, []), j)) AS kept
              FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    # the line rules spelt out once more, in SQL
    "op5_quality": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS ws FROM documents),
        w AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
        rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS j
                FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM w) WHERE c > 1) GROUP BY r),
        l AS (SELECT r, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw, length(l) AS n,
                     length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS sym, length(l) - length(replace(replace(l, '|', ''), '>', '')) AS bars,
                     length(l) - length(replace(l, '!', '')) AS marks, len(regexp_extract_all(replace(l, ' ', '  '), ' [|>»·] ')) AS seps
              FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
        v AS (SELECT r, l, lw, len(lw) > 0 AND (
                  100 * sym > 10 * n OR (len(lw) > 1 AND contains(l, '!!') AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}')) OR marks > len(lw)
                  OR (seps >= 2 AND 5 * seps >= len(lw))
                  OR (len(lw) <= 30 AND regexp_matches(l, '(?i)cookie (policy|settings)|privacy policy|terms (of use|of service|and conditions)|all rights reserved|subscribe to our|sign up for|click here|read more|share this|enable javascript|powered by|lorem ipsum|back to top'))
                  OR (len(lw) >= 10 AND 100 * len(list_distinct(lw)) * (1000 + len(lw)) <= 25 * len(lw) * 1000)) AS bad FROM l),
        q AS (SELECT r, count(*) FILTER (len(lw) > 0) - count(DISTINCT l) FILTER (len(lw) > 0) AS n_dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(len(lw)) FILTER (bad), 0) AS lost FROM v GROUP BY r),
        a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                     n_bad::BIGINT AS n_bad_lines, lost::BIGINT AS lost_words FROM d JOIN q USING (r) LEFT JOIN rep USING (r))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept FROM a""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)""",
}
