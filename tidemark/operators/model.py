"""How stored records follow from what arrives: idempotent inserts, merging upserts, links, retention, deletes.

Plain Parquet knows no MERGE, so a table is what its arrivals add up to: an aggregate over the key that partial
aggregation shrinks before the shuffle, and that gives the same however often a record is delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import redaction as R
from tidemark.functions import text as T

PROMPT_CHARS = 4_000

SESSION_FILLED = ("agent_id", "device_name", "cwd", "git_branch", "ai_title", "last_prompt")  # the last that is not null
PLAIN_TS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"


def event_time(ts: Column, received_at: Column) -> Column:
    """When something happened: a plain ISO instant, else when it arrived."""
    return F.when(ts.rlike(PLAIN_TS), F.try_to_timestamp(ts)).otherwise(received_at)


def latest(column: Column, order: Column) -> Column:
    """The value that arrived last and is not null."""
    return F.max_by(column, F.when(column.isNotNull(), order))


def latest_row(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that came last, whole, nulls of it too; among equals the greatest row. Rows whose key has a null
    are kept apart by the other parts of it."""
    others = [c for c in rows.columns if c not in keys]
    at = F.struct(order, F.xxhash64(*others))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_e"))
    return last.select(*keys, *(F.col(f"_e.{c}").alias(c) for c in others)).select(*rows.columns)


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row for each (session_id, seq), the one that arrived first; later ones are ignored.

    Arrival is (received_at, event_id). Rows without session_id or seq are no events and drop out.
    """
    others = [c for c in events.columns if c not in ("session_id", "seq")]
    order = F.struct("received_at", "event_id")
    kept = events.where("session_id is not null and seq is not null").groupBy("session_id", "seq").agg(F.min_by(F.struct(*others), order).alias("e"))
    return kept.select("session_id", "seq", *(F.col(f"e.{c}").alias(c) for c in others)).select(*events.columns)


def new_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch that are not stored yet, each (session_id, seq) once."""
    return first_arrivals(batch).join(stored.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_anti")


def merge_sessions(upserts: DataFrame) -> DataFrame:
    """Sessions as their records leave them: one row for each session_id.

    Arrival is (received_at, upsert_id). The project is that of the last record, most fields the last that was given,
    the tool the last other than unknown, the status the last record's or active where that names none, started_at and
    is_sidechain those of the first record. Records without session_id drop out.
    """
    order = F.struct("received_at", "upsert_id")
    tool = F.coalesce("tool", F.lit("unknown"))
    return upserts.where("session_id is not null").groupBy("session_id").agg(
        F.max_by(F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)), order).alias("project_key"),
        *(latest(F.col(c), order).alias(c) for c in SESSION_FILLED),
        F.coalesce(F.max_by(tool, F.when(tool != "unknown", order)), F.lit("unknown")).alias("tool"),
        F.max_by(F.coalesce("status", F.lit("active")), order).alias("status"),
        F.min_by(F.coalesce("is_sidechain", F.lit(False)), order).alias("is_sidechain"),
        F.min_by("started_at", order).alias("started_at"),
        F.max("received_at").alias("last_ingest_at"), F.count("*").alias("records"),
    )


def session_rollup(events: DataFrame) -> DataFrame:
    """session_id, event_count, token_estimate, last_event_at over stored events."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("event_count"), F.sum(T.estimate_tokens(F.col("content")).cast("bigint")).alias("token_estimate"), F.max(event_time(F.col("ts"), F.col("received_at"))).alias("last_event_at")
    )


def merge_projects(upserts: DataFrame) -> DataFrame:
    """Projects as session records leave them; the name is always the last record's or the key's last part."""
    order = F.struct("received_at", "upsert_id")
    return upserts.where("project_key is not null").groupBy("project_key").agg(
        F.max_by(F.coalesce(F.nullif("display_name", F.lit("")), T.display_name(F.col("project_key"))), order).alias("display_name"),
        latest(F.col("repo_root"), order).alias("repo_root"), latest(F.col("git_remote"), order).alias("git_remote"), F.min("received_at").alias("created_at"), F.max("received_at").alias("updated_at"),
    )


def merge_entries(entries: DataFrame, agents: DataFrame) -> DataFrame:
    """Entries by (agent_id, namespace, source_id): the last published, under the first's id and creation.

    Entries of agents that are not registered are refused. A null source_id never meets another. Publication is
    (created_at, entry_id).
    """
    order = F.struct("created_at", "entry_id")
    others = [c for c in entries.columns if c not in ("agent_id", "namespace", "source_id", "entry_id", "created_at")]
    known = entries.join(agents.select("agent_id").distinct(), "agent_id", "left_semi").withColumn("_own", F.when(F.col("source_id").isNull(), F.col("entry_id")))
    merged = known.groupBy("agent_id", "namespace", "source_id", "_own").agg(
        F.min_by("entry_id", order).alias("entry_id"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.max_by(F.struct(*others), order).alias("e"), F.count("*").alias("published")
    )
    return merged.select("entry_id", "agent_id", "namespace", "source_id", *(F.col(f"e.{c}").alias(c) for c in others), "created_at", "updated_at", "published")


def refused_entries(entries: DataFrame, agents: DataFrame) -> DataFrame:
    return entries.join(agents.select("agent_id").distinct(), "agent_id", "left_anti")


def link(pairs: DataFrame) -> DataFrame:
    """project_key, linked_project_key, note: links in both directions where asked for, each once with its last note.

    pairs: project_key, linked_project_key, note, bidirectional (null means yes), at (order of arrival).
    """
    back = pairs.where("coalesce(bidirectional, true)").select(F.col("linked_project_key").alias("project_key"), F.col("project_key").alias("linked_project_key"), "note", "at")
    both = pairs.select("project_key", "linked_project_key", "note", "at").unionByName(back)
    return both.where("project_key is not null and linked_project_key is not null").groupBy("project_key", "linked_project_key").agg(F.max_by("note", F.struct("at", "note")).alias("note"))


def scope_keys(key: str | None, scope: str, links: DataFrame) -> DataFrame | None:
    """The projects a request may read as a table; None for all."""
    if scope == "global" or not key:
        return None
    own = links.sparkSession.range(1).select(F.lit(key).alias("project_key"))
    return own if scope == "project" else own.union(links.where(F.col("project_key") == key).select("linked_project_key")).distinct()


def merge_agents(registrations: DataFrame) -> DataFrame:
    """Agents as their last registration leaves them, whole: what it does not name is gone. Registrations without agent_id
    drop out."""
    return latest_row(registrations.where("agent_id is not null"), ["agent_id"], "last_seen_at")


def session_payload(sessions: DataFrame, most: int = PROMPT_CHARS) -> DataFrame:
    """What a device sends of a session: its project by remote, root or directory, its last prompt redacted and then cut to
    `most` characters (blank ones are null), so that one long message cannot hold up the rest."""
    prompt = F.when(F.coalesce("last_prompt", F.lit("")) != "", F.substring(R.redact(F.col("last_prompt")), 1, most))
    return sessions.withColumns({"project_key": T.derive_project(F.col("cwd"), F.col("repo_root"), F.col("git_remote")), "last_prompt": prompt})


def with_cwd(metadata: Column, cwd: Column) -> Column:
    """Metadata (a map, null counts as empty) that names the directory unless it does already, or none is known."""
    own = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    known = F.coalesce(F.map_contains_key(own, F.lit("cwd")), F.lit(False)) | F.coalesce(cwd == "", F.lit(True))
    return F.when(known, own).otherwise(F.map_concat(own, F.create_map(F.lit("cwd"), F.coalesce(cwd, F.lit("")))))


def read_entries(entries: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """entry_id, requester, status, chunks: what each request (entry_id, requester) gets: 200 with the entry's chunks in
    order, 403 where it may not read it, 404 where there is none. Shared and broadcast entries are for all, others for
    their author and recipient."""
    parts = chunks.groupBy(F.col("source_ref").alias("entry_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))), lambda c: c["content"]).alias("parts"))  # of one entry
    known = entries.select("entry_id", "agent_id", "recipient_id", "visibility", F.lit(True).alias("_known")).join(parts, "entry_id", "left")
    open_ = F.col("visibility").isin("shared", "broadcast") | (F.col("requester") == F.col("agent_id")) | (F.col("requester") == F.col("recipient_id"))
    status = F.when(F.col("_known").isNull(), 404).when(F.coalesce(open_, F.lit(False)), 200).otherwise(403)
    none = F.array().cast("array<string>")
    return asked.join(known, "entry_id", "left").withColumn("status", status).select("entry_id", "requester", "status", F.when(F.col("status") == 200, F.coalesce("parts", none)).otherwise(none).alias("chunks"))


def sync(source: DataFrame, target: DataFrame, since: Column | None = None, project_key: str | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to append, statistics) of sending a hub's events to another: statistics are sessions, events_sent, inserted and
    skipped in one row. Only sessions with an event since then, of one project, if so asked; a dry run appends nothing.

    source: session_id, seq, project_key, at and whatever else target has. A second run finds everything known.
    """
    if project_key is not None:
        source = source.where(F.col("project_key") == project_key)
    if since is not None:
        source = source.join(source.where(F.col("at") >= since).select("session_id").distinct(), "session_id", "left_semi")
    have = target.select("session_id", "seq").distinct().withColumn("_have", F.lit(True))
    met = source.join(have, ["session_id", "seq"], "left").withColumn("_new", F.col("_have").isNull() & F.lit(not dry_run))
    stats = met.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("events_sent"), F.count_if("_new").alias("inserted"), F.count_if(F.col("_have")).alias("skipped"))
    if dry_run:
        stats = stats.withColumn("skipped", F.lit(0).cast("bigint"))
    return met.where("_new").select(*target.columns), stats


def sweep(events: DataFrame, cutoff: Column) -> DataFrame:
    """Events from the cutoff on; summaries and chunks are not touched."""
    return events.where(event_time(F.col("ts"), F.col("received_at")) >= cutoff)


def cascade(tables: dict[str, tuple[DataFrame, str]], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that refer to removed ids. tables: name -> (rows, referring column); removed: id."""
    gone = removed.select("id").distinct()
    return {n: rows.join(gone, rows[c] == gone["id"], "left_anti") for n, (rows, c) in tables.items()}


def sync_difference(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of the source whether the target already has it."""
    have = target.select(*keys).distinct().withColumn("_have", F.lit(True))
    return source.select(*keys).distinct().join(have, keys, "left").withColumn("known", F.coalesce("_have", F.lit(False))).drop("_have")
