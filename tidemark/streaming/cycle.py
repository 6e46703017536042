"""The background cycle: summaries that are due, then embeddings, then retention, each from the tables as they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indexing as I
from tidemark.operators import model as M
from tidemark.operators import summaries as U
from tidemark.operators import views as V
from tidemark.streaming import ingest as G


@dataclass(frozen=True)
class Store:
    """The tables a cycle reads and replaces; all are plans until the caller writes them."""

    sessions: DataFrame
    events: DataFrame
    summaries: DataFrame
    chunks: DataFrame
    queue: DataFrame
    vectors: DataFrame


def due_summaries(sessions: DataFrame, summaries: DataFrame, every: int = G.SUMMARY_EVERY) -> DataFrame:
    """session_id, tier: a final one for resting sessions without it, a rolling one for active ones with `every` events or
    more since their last."""
    covered = summaries.groupBy("session_id").agg(F.max("event_count").alias("covered"), F.max(F.col("tier") == "final").alias("has_final"))
    s = sessions.where("event_count > 0").join(covered, "session_id", "left")
    resting = F.col("status").isin("idle", "closed") & ~F.coalesce("has_final", F.lit(False))
    rolling = (F.col("status") == "active") & (F.col("event_count") - F.coalesce("covered", F.lit(0)) >= every)
    return s.select("session_id", F.when(resting, "final").when(rolling, "rolling").alias("tier")).where("tier is not null")


def run_cycle(store: Store, as_of: Column, embed: Callable[[Column], Column], answer: Column | None = None, keep_days: int | None = None) -> Store:
    """One cycle at as_of. Sessions at rest turn idle first, so that they get their final summary in the same cycle."""
    sessions = G.idle(store.sessions, as_of)
    due = due_summaries(sessions, store.summaries)
    told = U.generate(sessions.join(due, "session_id", "left_semi"), V.session_facts(store.events), answer).join(due, "session_id").join(sessions.select("session_id", "event_count"), "session_id")
    fresh = told.select("session_id", "tier", "summary", "decisions", "open_threads", "files", "model", "event_count", as_of.alias("generated_at"))
    summaries = U.merge(store.summaries.unionByName(fresh))
    rows = U.index_rows(fresh, sessions)
    chunks = I.reindex(store.chunks, rows)
    queue = G.enqueue(store.queue, rows, as_of)
    vectors, queue = G.drain(queue, chunks, embed, as_of, batch=None)
    kept = store.vectors.join(vectors.select("chunk_id"), "chunk_id", "left_anti").unionByName(vectors)
    events = store.events if keep_days is None else M.sweep(store.events, as_of - F.make_interval(days=F.lit(keep_days)))
    return replace(store, sessions=sessions, events=events, summaries=summaries, chunks=chunks, queue=queue, vectors=kept)
