"""The operators as queries over the synthetic tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, shared_base, shared_dir, table, whole


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(whole()).cast("long").alias("n_bytes"))
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), f"{shared_base(spark)}/token-cache")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import read_records, write_records

    path = shared_dir(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


#: Mean log-ratio that a document must reach.
QUALITY_THRESHOLD = -0.25


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ratio import grams, judge, log_ratios

    docs, labels = grams(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    return judge(docs, log_ratios(docs, labels.filter("quality = 1")), QUALITY_THRESHOLD)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row for each benchmark item found in them."""
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter("contaminated").select("doc_id", F.explode("item_ids").alias("item_id"), F.round("overlap", 6).alias("overlap"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages, one row for each document and span of words."""
    from .substring_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.first_id").alias("first_doc_id"), F.col("s.exact").alias("exact"))


def op9_interpolation_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolation_lm import score

    return score(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score, training_labels

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, training_labels(labels)))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    ranks = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_token_records, op3_jaccard_join, op4_quality_ratio, op5_bpe, op6_decontamination, op7_html_extraction, op8_substring_dedup, op9_interpolation_lm, op10_toxicity, op11_resampling, op12_whitening, op13_setsketch_dedup)}


#: Words by splitting at ASCII white space after lower-casing A-Z; components by walking all links, which suits small tables.
_CLASSES_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN ways ON x = b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{more} FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""
JACCARD_SQL = _CLASSES_SQL.format(width=5, percent=75, more="")
SETSKETCH_SQL = _CLASSES_SQL.format(width=3, percent=85, more=", doc_id = component_id AS kept")


#: crc32 byte by byte over distinct features, with the table of its polynomial worked out first; range() of DuckDB ends before its end.
RESAMPLING_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
texts AS (SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT kind, doc_id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
grams AS (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT kind, r, f, count(*) AS c FROM grams GROUP BY ALL),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
codes AS (SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexes CROSS JOIN bits),
known AS (SELECT kind, r, c, bucket FROM counted JOIN codes USING (f)),
held AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(c) FILTER (WHERE kind = 'b'), 0) AS t FROM known GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM held),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM held CROSS JOIN totals),
sums AS (SELECT r, sum(c)::BIGINT AS n, floor(sum(c * g)::DOUBLE / sum(c))::BIGINT AS w FROM known JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(words.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(sums.w, 0) AS weight,
        (coalesce(sums.w, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM words LEFT JOIN sums USING (r) WHERE kind = 'd'),
placed AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": JACCARD_SQL, "op11_resampling": RESAMPLING_SQL, "op13_setsketch_dedup": SETSKETCH_SQL}
