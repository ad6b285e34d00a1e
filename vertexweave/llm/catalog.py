"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexweave.llm import bpe, exact, idfiles, langid, licenses, minhash, negatives, packing, phrases, quality, toxicity, urls, vectors
from vertexweave.llm.frames import id_and_text, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(_documents(spark, sf_dir), "doc_id", "text")
    return quality.with_quality(docs).select(
        "doc_id", *[f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        )]
    )


# The rules of the query.
_URL_RULES = (
    urls.Rule(urls.ALLOW, "com", "/"),
    urls.Rule(urls.BLOCK, "example.com", "/en/"),
    urls.Rule(urls.ALLOW, "www.example.com", "/en/"),
    urls.Rule(urls.BLOCK, "net", "/es/"),
    urls.Rule(urls.BLOCK, "net", "/fr/"),
)


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), _URL_RULES)


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = id_and_text(_documents(spark, sf_dir), "doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern).select("doc_id", "ids")
    return bpe.decode(ids, ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
        F.size("language.spans").alias("n_spans"),
    )


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(_documents(spark, sf_dir), "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic",
        (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_low_quality"),
    )
    chain = toxicity.train(docs, labels, ["low_quality", "toxic", "toxic_low_quality"])
    t = F.col("toxicity")
    return toxicity.classify(docs, chain).select(
        "doc_id", t["is_toxic"].alias("toxic"), t["p_toxic"].alias("p_toxic"), t["p_low_quality"].alias("p_low_quality"),
        t["p_toxic_low_quality"].alias("p_toxic_low_quality"),
    )


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfiles.write_ids(
        _documents(spark, sf_dir), idfiles.new_folder(spark), public_tokenizers.path("byte_bpe_50k.json")
    )
    return idfiles.read_ids(files).select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), similarity=minhash.Similarity(shingle=2, percent=80))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(id_and_text(_documents(spark, sf_dir), "doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda m: F.struct(m["coverage"], -m["start"], m["end"], m["license"])))
    return found.select("doc_id", F.size("licenses").alias("n_notices"), "licenses", best.alias("best")).select(
        "doc_id", "n_notices", "licenses", F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"),
        (-F.col("best.col2")).alias("start"), F.col("best.end").alias("end"),
    )


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(_documents(spark, sf_dir))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    shifted = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", shifted)
    return negatives.hard_negatives(rows, vec_id % 100 == 0)


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _op1,
        "op2_url_filter": _op2,
        "op3_byte_bpe": _op3,
        "op4_packing": _op4,
        "op5_language_id": _op5,
        "op6_exact_dedup": _op6,
        "op7_toxicity": _op7,
        "op8_id_files": _op8,
        "op9_minhash_near_dedup": _op9,
        "op10_license_scan": _op10,
        "op11_phrase_mining": _op11,
        "op12_hard_negatives": _op12,
        "op13_embedding_near_dedup": _op13,
    }


_STOP_WORDS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

_OP1 = rf"""
WITH words AS (
    SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
    FROM (
        SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)
    )
),
windows AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
    FROM (
        SELECT doc_id, pos, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c
        FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
    )
    WHERE c IS NOT NULL
),
repeats AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
    FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id
),
counts AS (
    SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
        count(*) FILTER (lower(w) IN ({_STOP_WORDS})) AS n_stop_words,
        count(*) FILTER (w LIKE '%!!') AS n_exclaimed
    FROM words GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
measured AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        coalesce(length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g')), 0)::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        n_lines, n_stop_words, n_exclaimed
    FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
        AND word_chars / n_words BETWEEN 2 AND 15
        AND n_symbols / n_words <= 0.25
        AND n_stop_words / n_words >= 0.02
        AND n_dup_lines / n_lines <= 0.5
        AND n_exclaimed / n_words <= 0.3 AS kept
FROM measured
"""

_OP6 = r"""
WITH digests AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
),
groups AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM digests JOIN groups USING (text_sha256)
"""

_OP11 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
    )) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM words, (VALUES (1), (2), (3)) AS t(k) WHERE len(ws) >= k
),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
    SELECT lang, phrase, f, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS tail
    FROM candidates, (VALUES (1), (2)) AS t(c) WHERE c < k
),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.f AS a, h.f AS l, t.f AS r,
        CAST(1000000::HUGEINT * cuts.f * cuts.f // (h.f::HUGEINT * t.f) AS BIGINT) AS score
    FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.phrase = head JOIN counts t ON t.lang = cuts.lang AND t.phrase = tail
    QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1
),
inside AS (
    SELECT lang, part AS phrase, max(f) AS longer
    FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM candidates WHERE k = 3)
    GROUP BY lang, part
),
ranked AS (
    SELECT scored.*, row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, scored.phrase) AS rank
    FROM scored LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_OP12 = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
        CAST(list_dot_product(a.ints, b.ints) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
best AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op6_exact_dedup": _OP6, "op11_phrase_mining": _OP11, "op12_hard_negatives": _OP12}
