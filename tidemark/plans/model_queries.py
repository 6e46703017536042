"""Queries of writes: idempotent ingest, upserts, links, retention, deletes, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import indexing as I
from tidemark.operators import model as M
from tidemark.plans import corpus as C
from tidemark.plans import scalar_queries as K
from tidemark.plans import stored as D
from tidemark.session import table

us = lambda c: F.unix_micros(c).alias(f"{c}_us")


def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: rows delivered, inserted and skipped as replays."""
    raw = table(spark, sf_dir, "session_events").groupBy("session_id").agg(F.count("*").alias("delivered"))
    kept = D.events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("inserted"))
    return raw.join(kept, "session_id").select("session_id", "delivered", "inserted", (F.col("delivered") - F.col("inserted")).alias("skipped"))


def ingest_late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of the rows that arrived since the cutoff adds to what was stored before it."""
    raw = table(spark, sf_dir, "session_events")
    added = M.new_events(raw.where(F.col("received_at") < D.as_of()), raw.where(F.col("received_at") >= D.as_of()))
    return added.groupBy("session_id").agg(F.count("*").alias("added"), F.max("seq").alias("highest"))


def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_sessions(table(spark, sf_dir, "session_upserts")).select(
        "session_id", "project_key", "agent_id", "device_name", "cwd", "git_branch", "ai_title", "last_prompt", "tool", "status", "is_sidechain", "started_at", us("last_ingest_at"), "records"
    )


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.session_rollup(D.events(spark, sf_dir)).select("session_id", "event_count", "token_estimate", us("last_event_at"))


def project_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_projects(table(spark, sf_dir, "session_upserts")).select("project_key", "display_name", "repo_root", "git_remote", us("created_at"), us("updated_at"))


def entry_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entries(spark, sf_dir).select("entry_id", "agent_id", "namespace", "source_id", "kind", "title", F.length("content").alias("chars"), us("created_at"), us("updated_at"), "published")


def entries_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of agents that are not registered: as if those without a device were not."""
    return M.refused_entries(table(spark, sf_dir, "entries"), table(spark, sf_dir, "agents").where("device_name is not null")).select("entry_id", "agent_id")


def entry_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks the index gets of the stored entries."""
    return I.chunk_entries(D.entries(spark, sf_dir)).select("chunk_id", "source_ref", "project_key", "chunk_index", "content", "tags", "visibility")


def link_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.link(C.links(spark, sf_dir).select("project_key", "linked_project_key", F.concat(F.lit("note "), "linked_project_key").alias("note"), (F.length("project_key") % 3 > 0).alias("bidirectional"), F.lit(0).alias("at")))


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events left per session when those before the cutoff are gone; estimates of tokens are not reduced."""
    ev = D.events(spark, sf_dir)
    left = M.sweep(ev, D.as_of()).groupBy("session_id").agg(F.count("*").alias("event_count"))
    return M.session_rollup(ev).select("session_id", "token_estimate").join(left, "session_id", "left").select("session_id", F.coalesce("event_count", F.lit(0)).alias("event_count"), "token_estimate")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table before the entries of one kind are deleted, and those left."""
    ent = D.entries(spark, sf_dir)
    chunks = I.chunk_entries(ent)
    removed = ent.where("kind = 'artifact'").select(F.col("entry_id").alias("id"))
    before = {"entries": (ent.select("entry_id"), "entry_id"), "memory_chunks": (chunks.select("source_ref"), "source_ref"), "embedding_queue": (chunks.where("chunk_index > 0").select("chunk_id", "source_ref"), "source_ref")}
    after = M.cascade(before, removed)
    out = None
    for n in before:
        one = before[n][0].agg(F.count("*").alias("before")).join(after[n].agg(F.count("*").alias("after")), F.lit(True)).select(F.lit(n).alias("name"), "before", "after")
        out = one if out is None else out.unionByName(one)
    return out


def entry_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left when those of one kind are deleted."""
    ent = D.entries(spark, sf_dir)
    return M.cascade({"entries": (ent, "entry_id")}, ent.where("kind = 'artifact'").select(F.col("entry_id").alias("id")))["entries"].select("entry_id", "kind")


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session what a hub that holds the events received before the cutoff still lacks."""
    ev = table(spark, sf_dir, "session_events").where("session_id is not null and seq is not null")
    diff = M.sync_difference(ev, ev.where(F.col("received_at") < D.as_of()), ["session_id", "seq"])
    return diff.groupBy("session_id").agg(F.count_if(~F.col("known")).alias("to_send"), F.count_if("known").alias("known"))


def last_event_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.events(spark, sf_dir)
    top = ev.groupBy("session_id").agg(F.max(M.event_time(F.col("ts"), F.col("received_at"))).alias("last_event_at"))
    return table(spark, sf_dir, "session_upserts").select("session_id").distinct().join(top, "session_id").select("session_id", us("last_event_at"))


def index_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries the index lacks, with their tags as text: those published since the cutoff."""
    ent = D.entries(spark, sf_dir)
    have = ent.where(F.col("updated_at") < D.as_of()).select("entry_id")
    return ent.join(have, "entry_id", "left_anti").select("entry_id", F.array_join(T.normalize_tags(F.col("tags")), " ").alias("tag_text"))


QUERIES = {f.__name__: f for f in (
    ingest_idempotent, ingest_late_batch, session_upsert, session_rollup, project_upsert, entry_upsert_latest, entries_refused, entry_chunks, link_bidirectional, retention_sweep, delete_cascade, entry_delete, sync_diff, last_event_backfill, index_backfill,
)}
_CHUNKS = f"""{D.ENTRIES_SQL}, newest as (select *, max(case when o = 1 then entry_id end) over (partition by agent_id, namespace, source_id, case when source_id is null then entry_id end) as eid from pub qualify back = 1),
    folded as (select * exclude (overlap), {K.CHUNKS_OF.format('content')} as f from (select * replace (coalesce(chunk_size, 900) as chunk_size, coalesce(overlap, 120) as overlap), coalesce(chunk_size, 900) as size from newest)),
    parts as (select *, case when f.open = '' then f.done else list_append(f.done, f.open) end as c from folded),
    chunked as (select eid, kind, tags, visibility, recipient_id, project_key, unnest(c) as chunk, generate_subscripts(c, 1) - 1 as chunk_index from parts)"""
ORACLES = {
    "entry_chunks": f"""with {_CHUNKS}, t as (select eid, lower(trim(x, ' \t\n\r')) as tag, min(i) as i from (select eid, unnest(tags) as x, generate_subscripts(tags, 1) as i from newest) where trim(x, ' \t\n\r') <> '' group by 1, 2)
        select eid || ':' || chunk_index as chunk_id, eid as source_ref, coalesce(project_key, '__global__') as project_key, chunk_index::int as chunk_index, chunk as content, coalesce((select string_agg(tag, ' ' order by i) from t where t.eid = c.eid), '') as tags,
        case when kind = 'message' then case when recipient_id is not null then 'direct' else 'broadcast' end else coalesce(visibility, 'shared') end as visibility from chunked c where trim(chunk) <> ''""",
    "delete_cascade": f"""with {_CHUNKS}, c as (select * from chunked where trim(chunk) <> ''), gone as (select eid as id from newest where kind = 'artifact')
        select 'entries' as name, count(*) as before, count(*) filter (eid not in (select id from gone)) as after from newest union all select 'memory_chunks', count(*), count(*) filter (eid not in (select id from gone)) from c
        union all select 'embedding_queue', count(*), count(*) filter (eid not in (select id from gone)) from c where chunk_index > 0""",
    "ingest_idempotent": f"with {D.EV_SQL} select session_id, delivered, inserted, delivered - inserted as skipped from (select session_id, count(*) as delivered from session_events group by 1) join (select session_id, count(*) as inserted from ev group by 1) using (session_id)",
    "ingest_late_batch": f"""select session_id, count(distinct seq) as added, max(seq) as highest from session_events e where received_at >= {D.AS_OF_SQL} and session_id is not null and seq is not null
        and not exists (select 1 from session_events o where o.session_id = e.session_id and o.seq = e.seq and o.received_at < {D.AS_OF_SQL}) group by 1""",
    "session_upsert": f"with {D.EV_SQL}, {D.SESS_SQL} select session_id, project_key, agent_id, device_name, cwd, git_branch, ai_title, last_prompt, tool, status, is_sidechain, started_at, epoch_us(last_ingest_at) as last_ingest_at_us, records from merged",
    "session_rollup": f"with {D.EV_SQL}, {D.SESS_SQL} select session_id, event_count, token_estimate, epoch_us(last_event_at) as last_event_at_us from roll",
    "project_upsert": """with u as (select *, row_number() over (partition by project_key order by received_at, upsert_id) as o from session_upserts where project_key is not null)
        select project_key, arg_max(coalesce(nullif(display_name, ''), split_part(project_key, '/', -1)), o) as display_name, arg_max(repo_root, o) as repo_root, arg_max(git_remote, o) as git_remote, epoch_us(min(received_at)) as created_at_us, epoch_us(max(received_at)) as updated_at_us from u group by 1""",
    "entry_upsert_latest": f"with {D.ENTRIES_SQL} select entry_id, agent_id, namespace, source_id, kind, title, length(content)::int as chars, epoch_us(created_at) as created_at_us, epoch_us(updated_at) as updated_at_us, published from ent",
    "entries_refused": "select entry_id, agent_id from entries where agent_id not in (select agent_id from agents where device_name is not null)",
    "link_bidirectional": f"""with {C.LINKS_SQL}, b as (select *, 'note ' || linked_project_key as note, length(project_key) % 3 > 0 as both_ways from links)
        select project_key, linked_project_key, max(note) as note from (select project_key, linked_project_key, note from b union all select linked_project_key, project_key, note from b where both_ways) group by 1, 2""",
    "retention_sweep": f"with {D.EV_SQL}, {D.SESS_SQL} select session_id, count(*) filter (happened >= {D.AS_OF_SQL}) as event_count, any_value(token_estimate) as token_estimate from ev join roll using (session_id) group by 1",
    "entry_delete": f"with {D.ENTRIES_SQL} select entry_id, kind from ent where kind <> 'artifact' or kind is null",
    "sync_diff": f"""with k as (select session_id, seq, min(received_at) < {D.AS_OF_SQL} as known from session_events where session_id is not null and seq is not null group by 1, 2)
        select session_id, count(*) filter (not known) as to_send, count(*) filter (known) as known from k group by 1""",
    "last_event_backfill": f"with {D.EV_SQL} select session_id, epoch_us(max(happened)) as last_event_at_us from ev where session_id in (select session_id from session_upserts) group by 1",
    "index_backfill": f"""with {D.ENTRIES_SQL}, t as (select entry_id, lower(trim(x, ' \t\n\r')) as tag, min(i) as i from (select entry_id, unnest(tags) as x, generate_subscripts(tags, 1) as i from ent) where trim(x, ' \t\n\r') <> '' group by 1, 2)
        select entry_id, coalesce((select string_agg(tag, ' ' order by i) from t where t.entry_id = ent.entry_id), '') as tag_text from ent where updated_at >= {D.AS_OF_SQL}""",
}
