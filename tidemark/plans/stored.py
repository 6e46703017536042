"""The engine's stored tables as they follow from what the clients delivered, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import model as M
from tidemark.operators import views as V
from tidemark.session import table

AS_OF = "2026-06-01 00:00:00"
AS_OF_SQL = f"timestamptz '{AS_OF}+00'"
PLAIN_SQL = r"'\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)'"
THREAD = r"[^\s.?!:][^.?!:\n]*\?"  # a question
DECISION = r"(?i)\b(?:decided|agreed|decision)\b[^.?!\n]*\."
LISTED = 12


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_arrivals(table(spark, sf_dir, "session_events"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sessions with what their events add up to."""
    merged = M.merge_sessions(table(spark, sf_dir, "session_upserts"))
    roll = M.session_rollup(events(spark, sf_dir))
    full = merged.join(roll, "session_id", "left")
    return full.withColumns({
        "event_count": F.coalesce("event_count", F.lit(0)), "token_estimate": F.coalesce("token_estimate", F.lit(0)),
        "last_event_at": F.coalesce("last_event_at", M.event_time(F.col("started_at"), F.col("last_ingest_at"))),
    })


def _listed(spark: SparkSession, sf_dir: str, pattern: str, name: str) -> DataFrame:
    said = events(spark, sf_dir).where("kind = 'reply' and not coalesce(is_sidechain, false)").select("session_id", "seq", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("i", name))
    few = V.first_distinct(said, "session_id", name, ["seq", "i"], LISTED)
    return few.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", name))), lambda x: x[name]).alias(name + "s"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, tier, summary, decisions, open_threads: a rolling one for each session with events, a final one for those that rest."""
    s = sessions(spark, sf_dir).where("event_count > 0").select("session_id", "status", F.concat(F.coalesce("ai_title", F.lit("Untitled")), F.lit(" ("), F.col("event_count").cast("string"), F.lit(" events)")).alias("summary"))
    none = F.array().cast("array<string>")
    full = s.join(_listed(spark, sf_dir, DECISION, "decision"), "session_id", "left").join(_listed(spark, sf_dir, THREAD, "open_thread"), "session_id", "left")
    tiers = F.when(F.col("status").isin("idle", "closed"), F.array(F.lit("rolling"), F.lit("final"))).otherwise(F.array(F.lit("rolling")))
    return full.select(
        "session_id", F.explode(tiers).alias("tier"), "summary", F.coalesce("decisions", none).alias("decisions"), F.coalesce("open_threads", none).alias("open_threads")
    ).withColumn("summary", F.concat("tier", F.lit(": "), "summary"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_entries(table(spark, sf_dir, "entries"), table(spark, sf_dir, "agents"))


EV_SQL = f"""ev as (select *, case when regexp_full_match(ts, {PLAIN_SQL}) then try_cast(ts as timestamptz) else received_at end as happened from session_events where session_id is not null and seq is not null
    qualify row_number() over (partition by session_id, seq order by received_at, event_id) = 1)"""
SESS_SQL = f"""ordered as (select *, row_number() over (partition by session_id order by received_at, upsert_id) as o from session_upserts where session_id is not null),
    merged as (select session_id, arg_max(coalesce(project_key, '__global__'), o) as project_key, arg_max(agent_id, o) as agent_id, arg_max(device_name, o) as device_name, arg_max(cwd, o) as cwd, arg_max(git_branch, o) as git_branch,
        arg_max(ai_title, o) as ai_title, arg_max(last_prompt, o) as last_prompt, coalesce(arg_max(case when tool <> 'unknown' then tool end, o), 'unknown') as tool, arg_max(coalesce(status, 'active'), o) as status,
        bool_or(o = 1 and coalesce(is_sidechain, false)) as is_sidechain, max(case when o = 1 then started_at end) as started_at, max(received_at) as last_ingest_at, count(*) as records from ordered group by 1),
    roll as (select session_id, count(*) as event_count, sum(case when content is null or content = '' then 0 else greatest(1, length(content) // 4) end)::bigint as token_estimate, max(happened) as last_event_at from ev group by 1),
    sess as (select m.*, coalesce(r.event_count, 0) as event_count, coalesce(r.token_estimate, 0) as token_estimate,
        coalesce(r.last_event_at, case when regexp_full_match(m.started_at, {PLAIN_SQL}) then try_cast(m.started_at as timestamptz) else m.last_ingest_at end) as last_event_at from merged m left join roll r using (session_id))"""


def _listed_sql(pattern: str, name: str) -> str:
    return f"""{name}_all as (select session_id, x, min(row(seq, i)) as first_at from (select session_id, seq, unnest(regexp_extract_all(content, '{pattern}')) as x, generate_subscripts(regexp_extract_all(content, '{pattern}'), 1) as i
        from ev where kind = 'reply' and not coalesce(is_sidechain, false)) group by 1, 2),
    {name}_l as (select session_id, list(x order by first_at) as {name}s from (select * from {name}_all qualify row_number() over (partition by session_id order by first_at) <= {LISTED}) group by 1)"""


SUMS_SQL = f"""{_listed_sql(DECISION, "decision")}, {_listed_sql(THREAD, "open_thread")},
    sums as (select s.session_id, t.tier, t.tier || ': ' || coalesce(s.ai_title, 'Untitled') || ' (' || s.event_count || ' events)' as summary, coalesce(d.decisions, []) as decisions, coalesce(o.open_threads, []) as open_threads
        from sess s join (values ('rolling'), ('final')) t(tier) on t.tier = 'rolling' or s.status in ('idle', 'closed') left join decision_l d using (session_id) left join open_thread_l o using (session_id) where s.event_count > 0),
    best as (select * from sums qualify row_number() over (partition by session_id order by case tier when 'final' then 0 else 1 end) = 1)"""
ENTRIES_SQL = """pub as (select *, row_number() over (partition by agent_id, namespace, source_id, case when source_id is null then entry_id end order by created_at, entry_id) as o,
        row_number() over (partition by agent_id, namespace, source_id, case when source_id is null then entry_id end order by created_at desc, entry_id desc) as back from entries where agent_id in (select agent_id from agents)),
    ent as (select max(case when o = 1 then entry_id end) as entry_id, agent_id, namespace, source_id, max(case when back = 1 then kind end) as kind, max(case when back = 1 then title end) as title, max(case when back = 1 then content end) as content,
        max(case when back = 1 then tags end) as tags, max(case when back = 1 then recipient_id end) as recipient_id, max(case when back = 1 then visibility end) as visibility, max(case when back = 1 then project_key end) as project_key,
        min(created_at) as created_at, max(created_at) as updated_at, count(*) as published from pub group by agent_id, namespace, source_id, case when source_id is null then entry_id end)"""
