"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, langid, licences, linededup, media, neighbours, quality, secrets, sharding, simhash, whitening, yinyang
from plumbline.llm.common import table

#: Shards of op10.
SHARDS = [f"shard-{k:02d}" for k in range(32)]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "units_removed", "words_removed")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"), secrets.vocabulary())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op4_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate.matches(documents.select("doc_id", "text"), benchmark, keep_text=False)
    return decontaminate.digest(found)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH b AS (SELECT row_number() OVER () AS it, CAST(item_id AS VARCHAR) AS item,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
           FROM benchmark),
bp AS (SELECT it, item, k, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) t(k)),
bw AS (SELECT DISTINCT item, n, win FROM bp),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
      FROM documents),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(1, len(w) - n + 2)) t(p)),
o AS (SELECT r, p, n, item FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM o, unnest(range(0, n)) t(j) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r),
e AS (SELECT r, it, p - k AS diagonal, n, p - row_number() OVER (PARTITION BY r, it, p - k ORDER BY p) AS run FROM dw JOIN bp USING (n, win)),
x AS (SELECT r, max(words) AS n_longest FROM (SELECT r, n - 1 + count(*) AS words FROM e GROUP BY r, it, diagonal, n, run) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_longest, 0) AS BIGINT) AS n_longest
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN x USING (r)"""


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), bpe.tokenizer_file(), ids=False)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard", F.length("text").cast("long").alias("n_text"))


def op10_sql() -> str:
    """The table is computed by the rule and given as a list; the placement is plain SQL."""
    slots = ", ".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""
    WITH s AS (SELECT doc_id, text, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {sharding.SLOTS} AS INTEGER) AS slot
               FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(CAST(([{slots}])[slot + 1] AS VARCHAR), 2, '0') AS shard,
           CAST(length(text) AS BIGINT) AS n_text
    FROM s"""


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered(table(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_line_dedup, op2_simhash_near_dedup, op3_secret_scan, op4_benchmark_decontamination, op5_licence_scan, op6_bpe, op7_media_columns,
             op8_quality_classifier, op9_language_id, op10_sharding, op11_centroid_clustering, op12_nearest_neighbours, op13_embedding_whitening, pipeline)
    return {f.__name__: f for f in found}


def oracles() -> dict:
    return {"op1_line_dedup": linededup.sql(), "op4_benchmark_decontamination": OP4_SQL, "op5_licence_scan": licences.sql(), "op10_sharding": op10_sql(), "op11_centroid_clustering": yinyang.sql()}
