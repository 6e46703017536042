"""Summaries of sessions: a model's answers over the extractive ones, how they are kept, and what the index gets of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import views as V
from tidemark.operators.model import latest_row

LISTED, FILES = 12, 40
_ANSWER = "summary variant, decisions variant, open_threads variant"


def strip_reasoning(text: Column) -> Column:
    """An answer without what a model thinks aloud first: blocks of it, then a block whose beginning is missing; the answer
    as it is where nothing else would be left."""
    rest = F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)^.*?</think>", "")
    return F.when(T.strip(rest) != "", T.strip(rest)).otherwise(T.strip(text))


def model_json(text: Column) -> Column:
    """The JSON object within an answer, as text: within its first fence if there is one, from the first brace to the last.
    Null where there is none, or it is no valid object."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```.*?```"), fenced).otherwise(text)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def _texts(json: Column, path: str) -> Column:
    """Texts of a JSON list that are not blank, the first LISTED."""
    return F.slice(F.filter(F.coalesce(F.from_json(F.get_json_object(json, path), "array<string>"), F.array().cast("array<string>")), lambda x: T.strip(F.coalesce(x, F.lit(""))) != ""), 1, LISTED)


def generate(sessions: DataFrame, facts: DataFrame, answer: Column | None = None, model: str = "model") -> DataFrame:
    """session_id, summary, decisions, open_threads, files, model: what each session with events is summed up as.

    answer: a model's raw answer as a column of sessions, null where it gave none; any function or Pandas UDF of the
    transcript will do. One that is no JSON object with a summary that is not blank leaves the extractive summary.
    """
    base = V.extractive_summary(sessions, facts).withColumnRenamed("summary", "extract")
    given = sessions.select("session_id", model_json(strip_reasoning(answer if answer is not None else F.lit(None).cast("string"))).alias("json"))
    files = facts.select("session_id", F.slice("files", 1, FILES).alias("files"))
    told = base.join(given, "session_id").join(files, "session_id", "left").withColumn("said", T.strip(F.get_json_object("json", "$.summary")))
    good = F.coalesce(F.col("said") != "", F.lit(False))
    none = F.array().cast("array<string>")
    return told.select(
        "session_id", F.when(good, F.col("said")).otherwise(F.col("extract")).alias("summary"), F.when(good, _texts(F.col("json"), "$.decisions")).otherwise(none).alias("decisions"),
        F.when(good, _texts(F.col("json"), "$.open_threads")).otherwise(none).alias("open_threads"), F.coalesce("files", none).alias("files"), F.when(good, F.lit(model)).otherwise(F.lit("extractive")).alias("model"),
    )


def merge(summaries: DataFrame) -> DataFrame:
    """One row for each (session_id, tier): the one generated last, whole. Ties go to the greater row."""
    return latest_row(summaries, ["session_id", "tier"], "generated_at")


def after_summary(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions with what a summary settles: session_id, event_count, summarized_event_count, summary_dirty."""
    covered = summaries.groupBy("session_id").agg(F.max("event_count").alias("covered"))
    n = F.coalesce("covered", F.lit(0)).cast("bigint")
    return sessions.join(covered, "session_id", "left").select("session_id", "event_count", n.alias("summarized_event_count"), (F.col("event_count") > n).alias("summary_dirty"))


def index_rows(summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """memory_chunks rows of summaries: session_id, tier, summary, decisions, open_threads, files, one chunk each, under the
    session's project and time; blank ones are not indexed."""
    about = sessions.select("session_id", "project_key", "agent_id", "ai_title", "tool", "is_sidechain", "last_event_at")
    content = V.summary_index_text(F.col("summary"), F.col("decisions"), F.col("open_threads"), F.col("files"))
    rows = summaries.select("session_id", "tier", content.alias("content")).where(T.strip(F.col("content")) != "").join(about, "session_id")
    return rows.select(
        F.concat_ws(":", F.lit("sum"), "session_id", "tier").alias("chunk_id"), F.lit("session_summary").alias("source_type"), F.concat_ws(":", "session_id", "tier").alias("source_ref"), F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)).alias("project_key"),
        F.lit("default").alias("namespace"), "agent_id", "session_id", F.lit("session_summary").alias("kind"), T.session_title(F.col("ai_title"), F.col("session_id"), "Session ").alias("title"), "content", F.concat_ws(" ", "tool", "tier").alias("tags"),
        F.lit("shared").alias("visibility"), F.lit(None).cast("string").alias("recipient_id"), "is_sidechain", F.lit(0).alias("chunk_index"), F.col("last_event_at").alias("ts"),
    )


def session_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """session_id, chunk_id, embedding: of each session the summary chunk the map shows it by, the final one before others
    (then the lesser id), with its vector; sessions whose chunk has none yet drop out. One join for all sessions."""
    best = chunks.where("source_type = 'session_summary' and session_id is not null").groupBy("session_id").agg(F.min_by("chunk_id", F.struct(~F.endswith("source_ref", F.lit(":final")), F.col("chunk_id"))).alias("chunk_id"))
    return best.join(vectors.select("chunk_id", "embedding").where("embedding is not null"), "chunk_id").select("session_id", "chunk_id", "embedding")
