"""Queries of problem 2: timestamps in mixed formats and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timestamps as T
from tidemark.session import table


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_id, plain, utc_ms of every event, session record and store message.

    Plain values are taken by one cast; only the others go through the formats.
    """
    return _instants(spark, sf_dir, found=False)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that denote an instant but are not in plain form."""
    return _instants(spark, sf_dir, found=True)


def _instants(spark: SparkSession, sf_dir: str, found: bool) -> DataFrame:
    events, upserts, messages = (table(spark, sf_dir, n) for n in ("session_events", "session_upserts", "messages"))
    clocks = T.session_clocks(upserts, table(spark, sf_dir, "device_clocks"))
    texts = events.select(F.lit("ts").alias("field_name"), F.col("event_id").alias("rec_id"), "session_id", F.col("ts").alias("v")).unionByName(
        upserts.select(F.lit("started_at").alias("field_name"), F.col("upsert_id").cast("string").alias("rec_id"), "session_id", F.col("started_at").alias("v"))
    )
    if found:
        texts = texts.where(F.col("v").isNotNull() & ~F.col("v").rlike(T.PLAIN))
    numbers = T.number_instants(messages.select(F.lit("timestamp").alias("field_name"), F.col("id").cast("string").alias("rec_id"), F.col("timestamp").alias("v")), "v")
    texts = T.with_instants(texts, "v", "rec_id", clocks)
    if found:
        return texts.where("utc_ms is not null").select("field_name", "rec_id", "utc_ms").unionByName(numbers.where("utc_ms is not null and v >= 1e11").select("field_name", "rec_id", "utc_ms"))
    plain = T.is_plain(F.col("v"))
    return texts.select("field_name", "rec_id", plain.alias("plain"), "utc_ms").unionByName(
        numbers.select("field_name", "rec_id", F.coalesce(F.col("v").between(1e8, 1e11), F.lit(False)).alias("plain"), "utc_ms")
    )


def p2_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device's zoneless wall times say about its zone, beside the declared one."""
    return T.zone_estimates(table(spark, sf_dir, "session_events"), table(spark, sf_dir, "session_upserts"), table(spark, sf_dir, "device_clocks"))


QUERIES = {"p2_found": p2_found, "p2_normalized": p2_normalized, "p2_zone_estimates": p2_zone_estimates}
ORACLES: dict[str, str] = {}
