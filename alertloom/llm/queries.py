"""The operators with production parameters over whole tables, and equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_warc_zip, op2_bloom_lm, op3_hilbert_ann, op4_packing, op5_decontaminate, op6_quality, op7_line_dedup, op8_language_id, op9_token_files, op10_jaccard, op11_whitening, op12_vector_codes, op13_quality_rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_zip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = op1_warc_zip.write_archives(_table(spark, sf_dir, "pages"))
    return op1_warc_zip.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bloom_lm.score_texts(_table(spark, sf_dir, "documents"))


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_hilbert_ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key", "hit")


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    languages, table = op8_language_id.learn(docs.where(~op8_language_id.held_out()))
    found = op8_language_id.identify(docs.select("doc_id", op8_language_id.held_out().alias("held_out"), "text"), languages, table)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op9_token_files_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_files.token_table(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


def op12_segment_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_zip_records, op2_bloom_lm_scores, op3_hilbert_neighbours, op4_vector_packing, op5_benchmark_decontamination, op6_quality_scores, op7_line_edit_join, op8_language_scores, op9_token_files_digest, op10_ngram_jaccard_classes, op11_whitened_embeddings, op12_segment_bound_codes, op13_likelihood_rules)
}

def _code_rounds(rounds: int = 6) -> str:
    """Rounds of assigning parts (to the smallest of 16 * distance + index) and moving entries, one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (SELECT vec_id, part.p, min(list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + e) AS v, any_value(y) AS y
  FROM part JOIN book{k} ON part.p = book{k}.p GROUP BY vec_id, part.p)""")
        if k < rounds:
            steps.append(f"""
sum{k} AS (SELECT p, CAST(v % 16 AS BIGINT) AS e, i, CAST(sum(y[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM near{k}) GROUP BY ALL),
moved{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m USING (p, e))""")
    return ",".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op1_warc_zip_records": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, CAST(1 + 5 * i AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT)) % 32 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keeper = p.page_id THEN NULL ELSE k.keeper END AS refers_to
FROM p JOIN k USING (html)
""",
    "op5_benchmark_decontamination": rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM place p JOIN win v ON p.win = v.win AND p.size = v.size),
word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(word.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(word.n_hit, 0) > 0 AND 20 * coalesce(word.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_ngram_jaccard_classes": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM doc JOIN reach ON reach.a = doc.doc_id LEFT JOIN n ON n.doc_id = doc.doc_id GROUP BY doc.doc_id
""",
    "op12_segment_bound_codes": f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS pos, len(embedding) // 8 AS m
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, pos, p, x[p * m + 1:p * m + m] AS y FROM (SELECT *, unnest(range(0, 8)) AS p FROM kept)),
book0 AS (SELECT p, pos AS e, y AS c FROM part WHERE pos < 16),{_code_rounds()},
code AS (SELECT vec_id, string_agg(printf('%02x', CAST(v % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(v // 16) AS BIGINT) AS error FROM near6 GROUP BY vec_id),
word AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), word
""",
}
