"""Queries of the operators for training data (p3, p4, p6, p7, p8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import hash_forest, ivfpq, leakage, packing, pii
from attesta.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch checked against the stored history when it comes in."""
    return hash_forest.not_new_by_batches(table(spark, sf_dir, "assets"), table(spark, sf_dir, "known"))


def p3_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p3_found, all batches appended first and searched for in one pass."""
    return hash_forest.not_new(table(spark, sf_dir, "assets"), table(spark, sf_dir, "known"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.similar_pictures(table(spark, sf_dir, "assets"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p6_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of container: texts placed, texts cut though they fit, containers overfilled, and whether the tokens fill as few containers as 98 % of the room would take."""
    containers = table(spark, sf_dir, "containers").where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    pieces = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")).join(F.broadcast(containers), "container_kind")
    per_container = pieces.groupBy("container_kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("piece_no") == 0).alias("texts"), F.count_if((F.col("piece_no") > 0) & (F.col("start_token") != F.col("piece_no") * F.col("capacity"))).alias("cut"))
    full = F.count(F.lit(1)) <= F.ceil(F.sum("used") / F.first("capacity") / 0.98) + 1
    return per_container.groupBy("container_kind").agg(F.sum("texts").alias("texts"), F.sum("cut").alias("cut"), F.count_if(F.col("used") > F.col("capacity")).alias("overfilled"), full.alias("well_filled"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "members")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "members"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_at_once, p4_found, p6_containers, p6_filling, p7_found, p8_found, p8_redacted)}

#: Every asset against every earlier one.
_NOT_NEW = r"""WITH a AS (SELECT DISTINCT asset_id, coalesce(batch_no, 2147483647) AS b, lower(trim(sha256)) AS sha, CASE WHEN pdq_quality >= 50 AND regexp_full_match(pdq, '[0-9a-fA-F]{64}') THEN lower(pdq) END AS pdq, pdq_mirrors FROM assets WHERE asset_id IS NOT NULL),
h AS (SELECT DISTINCT asset_id, b, h FROM (SELECT asset_id, b, pdq AS h FROM a WHERE pdq IS NOT NULL UNION ALL SELECT asset_id, b, lower(unnest(pdq_mirrors)) FROM a WHERE pdq IS NOT NULL) WHERE regexp_full_match(h, '[0-9a-f]{64}')),
w AS (SELECT asset_id, b, ('0x' || h[1:16])::UBIGINT AS w1, ('0x' || h[17:32])::UBIGINT AS w2, ('0x' || h[33:48])::UBIGINT AS w3, ('0x' || h[49:64])::UBIGINT AS w4 FROM h),
q AS (SELECT DISTINCT asset_id, b, ('0x' || pdq[1:16])::UBIGINT AS w1, ('0x' || pdq[17:32])::UBIGINT AS w2, ('0x' || pdq[33:48])::UBIGINT AS w3, ('0x' || pdq[49:64])::UBIGINT AS w4 FROM a WHERE pdq IS NOT NULL),
first AS (SELECT sha, min((b, asset_id)) AS f FROM a WHERE sha <> '' GROUP BY 1)
SELECT DISTINCT a.asset_id FROM a JOIN first ON a.sha = first.sha WHERE first.f < (a.b, a.asset_id) OR a.sha IN (SELECT lower(trim(sha256)) FROM known WHERE sha256 IS NOT NULL)
UNION SELECT DISTINCT q.asset_id FROM q JOIN w ON (w.b < q.b OR (w.b = q.b AND w.asset_id < q.asset_id)) AND bit_count(xor(q.w1, w.w1)::BIT) + bit_count(xor(q.w2, w.w2)::BIT) + bit_count(xor(q.w3, w.w3)::BIT) + bit_count(xor(q.w4, w.w4)::BIT) <= 31"""

ORACLES: dict[str, str] = {
    "p3_found": _NOT_NEW,
    "p3_at_once": _NOT_NEW,
    "p6_filling": "SELECT container_kind, (SELECT count(*) FROM documents) AS texts, 0::bigint AS cut, 0::bigint AS overfilled, true AS well_filled FROM containers WHERE container_kind IS NOT NULL AND capacity_tokens > 0 GROUP BY 1",
}
