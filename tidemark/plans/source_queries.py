"""Queries of the message store and of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import indexing as I
from tidemark.operators import model as M
from tidemark.plans import corpus as C
from tidemark.plans import stored as D
from tidemark.session import scratch_dir, table
from tidemark.sources import store
from tidemark.streaming import ingest as G


def store_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and replies of the store, credentials scrubbed."""
    return store.store_events(table(spark, sf_dir, "messages")).where("kind in ('prompt', 'reply')").select("session_id", "seq", "role", "kind", "content")


def store_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of the store as what they touched."""
    e = store.store_events(table(spark, sf_dir, "messages")).where("kind = 'tool_use'")
    return e.select("session_id", "seq", "content", F.array_join("files", "|").alias("files"), F.array_join("commands", "|").alias("commands"))


def store_newest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_message(table(spark, sf_dir, "messages"))


def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the store that had no record among the sessions yet at the cutoff."""
    known = table(spark, sf_dir, "session_upserts").where(F.col("received_at") < D.as_of()).select("session_id").distinct()
    mine = table(spark, sf_dir, "messages").select(F.concat(F.lit(store.PREFIX), "session_id").alias("session_id")).distinct()
    return mine.join(known, "session_id", "left_anti")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per session after the whole table came through the stream in small batches, replays and all."""
    run = scratch_dir(spark, "stream")
    path = f"{sf_dir.rstrip('/')}/session_event[s].parquet"  # a pattern, as a stream takes no single file
    schema = table(spark, sf_dir, "session_events").schema
    G.ingest(G.event_stream(spark, path, schema, 4), f"{run}/events", f"{run}/state").awaitTermination()
    return M.session_rollup(G.event_log(spark, f"{run}/events", schema)).select("session_id", "event_count", F.unix_micros("last_event_at").alias("last_event_at_us"))


def embedding_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the embedding queue over the chunks of all documents: the first batch that is due, in order of arrival."""
    c = C.chunks(spark, sf_dir).select("chunk_id", "project_key", "content", "ts")
    queue = c.select("chunk_id", F.col("ts").alias("enqueued_at"), F.pmod(F.length("chunk_id") + F.length("content"), F.lit(8)).alias("attempts"), F.col("ts").alias("next_attempt_at"))
    vectors, _ = G.drain(queue, c, lambda t: G.hash_embedding(t), D.as_of())
    return vectors.select("chunk_id", "project_key", F.size("embedding").alias("width"))


def embedding_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the contents of all entries' chunks, after the queue was drained until none was due."""
    chunks = I.chunk_entries(D.entries(spark, sf_dir))
    at = F.coalesce("ts", D.as_of())
    queue = chunks.select("chunk_id", at.alias("enqueued_at"), F.lit(0).alias("attempts"), at.alias("next_attempt_at"))
    vectors, _ = G.drain(queue, chunks, lambda c: G.hash_embedding(c), D.as_of(), batch=None)
    return vectors


QUERIES = {f.__name__: f for f in (store_texts, store_tools, store_newest_message, store_history, stream_ingest, embedding_round, embedding_drained)}
_WS = "' \t\n\r\x0b\x0c'"
_SCRUB = f"trim(array_to_string(list_filter(regexp_split_to_array(coalesce({{0}}, ''), '\r\n|\n|\r'), lambda x: not regexp_matches(x, '{T.CREDENTIAL_LINE}')), chr(10)), {_WS})"
ORACLES = {
    "store_texts": f"""with m as (select *, {_SCRUB.format(f"trim(content, {_WS})")} as said from messages where coalesce(_compressed_summary, 0) = 0 and role in ('user', 'assistant'))
        select 'hermes-' || session_id as session_id, id * 10 as seq, role, case role when 'user' then 'prompt' else 'reply' end as kind, said as content from m where said <> ''""",
    "store_tools": f"""with m as (select id, session_id, from_json(tool_calls, '["json"]') as calls from messages where coalesce(_compressed_summary, 0) = 0 and role = 'assistant' and json_valid(tool_calls)),
        c as (select id, session_id, unnest(calls) as call, generate_subscripts(calls, 1) as k from m),
        a as (select id, session_id, k, coalesce(json_extract_string(call, '$.function.name'), '') as name, case when json_valid(json_extract_string(call, '$.function.arguments')) then json_extract_string(call, '$.function.arguments')::json end as args from c where k <= 9),
        f as (select *, nullif(json_extract_string(args, '$.path'), '') as path, trim(regexp_replace({_SCRUB.format("json_extract_string(args, '$.command')")}, '\\s+', ' ', 'g'), ' ')[1:400] as command,
            coalesce(nullif(json_extract_string(args, '$.query'), ''), nullif(json_extract_string(args, '$.urls'), '')) as target, {_SCRUB.format("coalesce(nullif(json_extract_string(args, '$.goal'), ''), nullif(json_extract_string(args, '$.task'), ''))")} as goal from a),
        e as (select *, case when name in ('read_file', 'write_file', 'patch') then name || ' ' || path when name = 'terminal' then case when command <> '' then '$ ' || command end when name in ('web_search', 'web_extract') then name || ': ' || target[1:200]
            when name = 'delegate_task' then 'Delegated to sub-agent' || case when goal <> '' then ': ' || goal[1:200] else '' end when name <> '' then name || ' called' end as content from f)
        select 'hermes-' || session_id as session_id, id * 10 + k as seq, content, case when name in ('read_file', 'write_file', 'patch') then path else '' end as files, case when name = 'terminal' then command else '' end as commands from e where content is not null""",
    "store_newest_message": "select session_id, coalesce(max(id), 0) as last_id from messages group by 1",
    "store_history": f"select distinct 'hermes-' || session_id as session_id from messages where 'hermes-' || session_id not in (select session_id from session_upserts where received_at < {D.AS_OF_SQL})",
    "embedding_round": f"""with {C.CHUNKS_SQL} select chunk_id, project_key, 64 as width from chunks where ts <= {D.AS_OF_SQL} and (length(chunk_id) + length(content)) % 8 < {G.EMBED_ATTEMPTS} order by ts, chunk_id limit {G.EMBED_BATCH}""",
    "stream_ingest": f"with {D.EV_SQL}, {D.SESS_SQL} select session_id, event_count, epoch_us(last_event_at) as last_event_at_us from roll",
}
