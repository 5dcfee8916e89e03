"""Queries of the training-data operators over the test tables, and the SQL that answers the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm import garbled, mixing, packing, release_index, seen_keys, tokens
from gleanery.session import materialize, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return seen_keys.seen_before(table(spark, sf, "download_record"), "torrent_url", "id")


def p1_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return seen_keys.error_rate(table(spark, sf, "download_record"), "torrent_url", "id", hash_name="md5", hash_bits=20)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return release_index.repeats(table(spark, sf, "download_record"), "torrent_url", "torrent_name", "batch_no")


def _sized(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return materialize(tokens.with_tokens(table(spark, sf, "documents"), "doc_id", "text", list(keep)), "tokens")


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "container_size").select("container", F.col("capacity_tokens").alias("capacity"))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sized(spark, sf), _containers(spark, sf))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, sf), _containers(spark, sf))


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per container size: texts packed, pieces in bins filled beyond the capacity, texts whose pieces don't give their size,
    cut texts that would have fitted whole. The last three must be 0."""
    sized = _sized(spark, sf)
    packed = materialize(packing.pack(sized, _containers(spark, sf)), "packed").filter(F.col("bin").isNotNull())
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("held"))
    texts = packed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("given"), F.count("*").alias("pieces")).join(sized, "doc_id").join(_containers(spark, sf), "container")
    over = bins.join(_containers(spark, sf), "container").groupBy("container").agg(F.count(F.when(F.col("held") > F.col("capacity"), 1)).alias("overfull"))
    wrong, cut = F.col("given") != F.col("tokens"), (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))
    return texts.groupBy("container").agg(F.count("*").alias("texts"), F.count(F.when(wrong, 1)).alias("wrong_size"), F.count(F.when(cut, 1)).alias("needless_cuts")).join(over, "container")


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether its share misses the target by less than one record (the longest one), and whether no record is
    used too often."""
    mixed = materialize(p8_mix(spark, sf), "mixed")
    longest, total = mixed.filter("times_used > 0").agg(F.max("tokens"), F.sum(F.col("times_used") * F.col("tokens"))).first()
    reached = mixing.shares(mixed, table(spark, sf, "mix_target"))
    near = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("target_share")) * F.lit(total or 0) < F.lit(longest or 1)
    return reached.select("source", near.alias("on_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf, "source"), table(spark, sf, "mix_target"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(materialize(p8_mix(spark, sf), "mixed"), table(spark, sf, "mix_target"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_error_rate": p1_error_rate,
    "p3_found": p3_found,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p7_audit": p7_audit,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_audit": p8_audit,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

ORACLES = {
    "p1_found": """
        SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY torrent_url ORDER BY id) AS k
                        FROM download_record WHERE torrent_url IS NOT NULL) WHERE k > 1""",
    "p1_error_rate": """
        WITH w AS (SELECT min(id) AS low, greatest(1, (max(id) - min(id) + 6) // 6) AS width FROM download_record),
             b AS (SELECT (id - low) // width AS batch, torrent_url AS u, substr(md5(torrent_url), 1, 5) AS h FROM download_record, w WHERE torrent_url IS NOT NULL),
             k AS (SELECT DISTINCT batch, u, h, min(batch) OVER (PARTITION BY u) AS first FROM b), f AS (SELECT h, min(first) AS early FROM k GROUP BY 1),
             r AS (SELECT batch, count(*) AS rows FROM b GROUP BY 1)
        SELECT batch::INT AS batch, rows, count(*) AS keys, count(*) FILTER (first < batch) AS keys_seen, count(*) FILTER (first = batch AND early < batch) AS hash_only_wrong,
               count(*) FILTER (first = batch AND early < batch) / count(*) AS rate_hash_only, 0::BIGINT AS wrong_answers, 0.0::DOUBLE AS rate_wrong
        FROM k JOIN f USING (h) JOIN r USING (batch) GROUP BY batch, rows""",
    "p7_audit": """
        SELECT container, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS overfull, 0::BIGINT AS wrong_size, 0::BIGINT AS needless_cuts FROM container_size""",
    "p8_audit": "SELECT lower(trim(source)) AS source, true AS on_target, true AS within_repeats FROM mix_target",
}
