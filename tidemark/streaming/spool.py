"""The outbound spool as a table: what is next, what was delivered, what may go, and how far behind it is.

outbound: id, session_id, seq, created_at, delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, KEPT = 200, 500


def next_batch(outbound: DataFrame, limit: int = BATCH) -> DataFrame:
    """The oldest rows that are not delivered."""
    return outbound.where("not delivered").orderBy("id").limit(limit)


def acknowledge(outbound: DataFrame, delivered: DataFrame) -> DataFrame:
    """outbound with the rows of delivered (id) marked; ids it does not have, and repeated ones, change nothing."""
    done = delivered.select("id").distinct().withColumn("_done", F.lit(True))
    return outbound.join(done, "id", "left").withColumn("delivered", F.col("delivered") | F.coalesce("_done", F.lit(False))).drop("_done").select(*outbound.columns)


def prune(outbound: DataFrame, keep: int = KEPT) -> DataFrame:
    """outbound without delivered rows, but for the newest `keep` of them. Ids are unique, so one bound tells them apart and
    no row is joined."""
    newest = outbound.where("delivered").orderBy(F.desc("id")).limit(keep).agg(F.min("id").alias("_from"))  # one row
    return outbound.join(F.broadcast(newest), F.lit(True)).where("not delivered or id >= _from").drop("_from")


def backlog(outbound: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row: pending, oldest_pending, pending_sessions, last_progress. checkpoints: updated_at. An empty spool has none
    pending."""
    waiting = outbound.where("not delivered").agg(F.count("*").alias("pending"), F.min("created_at").alias("oldest_pending"), F.countDistinct("session_id").alias("pending_sessions"))
    return waiting.join(checkpoints.agg(F.max("updated_at").alias("last_progress")), F.lit(True))
