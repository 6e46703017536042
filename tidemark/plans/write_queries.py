"""Queries of further writes, reads and views: registrations, summaries, reindexing, spool, sync, briefs, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import indexing as I
from tidemark.operators import model as M
from tidemark.operators import search as S
from tidemark.operators import summaries as U
from tidemark.operators import views as V
from tidemark.plans import corpus as C
from tidemark.plans import scalar_queries as K
from tidemark.plans import search_queries as Q
from tidemark.plans import stored as D
from tidemark.plans import view_queries as W
from tidemark.session import table
from tidemark.streaming import ingest as G
from tidemark.streaming import spool as P

us = lambda c: F.unix_micros(c).alias(f"{c}_us")
BRANCH, REQUESTER = "main", "agent-anchor-28"


def agent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents after each session record registered its agent again, by its device alone."""
    first = table(spark, sf_dir, "agents").select("agent_id", "display_name", "device_name", F.array_join("capabilities", ",").alias("capabilities"), "last_seen_at", F.lit(0).cast("bigint").alias("n"))
    again = table(spark, sf_dir, "session_upserts").select("agent_id", F.col("agent_id").alias("display_name"), "device_name", F.lit(None).cast("string").alias("capabilities"), F.col("received_at").alias("last_seen_at"), F.col("upsert_id").alias("n"))
    both = first.unionByName(again).where("last_seen_at is not null").withColumn("at", F.struct("last_seen_at", "n"))
    return M.latest_row(both.where("agent_id is not null"), ["agent_id"], "at").select("agent_id", "display_name", "device_name", "capabilities", us("last_seen_at"))


def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as each session record writes one of its tier; the last stays."""
    u = table(spark, sf_dir, "session_upserts").where("session_id is not null")
    rows = u.select("session_id", F.when(F.col("status").isin("idle", "closed"), "final").otherwise("rolling").alias("tier"), F.coalesce("ai_title", F.lit("Untitled")).alias("summary"), "tool", F.struct("received_at", "upsert_id").alias("generated_at"))
    return U.merge(rows).select("session_id", "tier", "summary", "tool", F.unix_micros("generated_at.received_at").alias("generated_us"))


def _answer():
    """Answers in place of a model's: thought aloud, fenced, broken, or none."""
    n = F.col("event_count")
    return F.when(n % 4 == 0, F.lit('<think>{"summary": "no"}</think>Here:\n```json\n{"summary": " Told by a model. ", "decisions": ["Keep it", " ", "Drop it"], "open_threads": []}\n```')).when(n % 4 == 1, F.lit('left over </think> {"summary": "Short.", "open_threads": ["Why?"]} and more')).when(n % 4 == 2, F.lit('{"summary": "cut off'))


def summary_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sessions(spark, sf_dir)
    g = U.generate(s, V.session_facts(D.events(spark, sf_dir)), _answer(), "stand-in")
    return g.select("session_id", "summary", F.array_join("decisions", "|").alias("decisions"), F.array_join("open_threads", "|").alias("open_threads"), F.size("files").alias("files"), "model")


def summary_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to sum up of each session, as if summaries had covered the events received before the cutoff."""
    old = D.events(spark, sf_dir).where(F.col("received_at") < D.as_of()).groupBy("session_id").agg(F.count("*").alias("event_count"))
    return U.after_summary(D.sessions(spark, sf_dir), old)


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' kinds and languages within answers of several shapes, as the parser reads them."""
    said = F.format_string('{"summary": "%s", "n": %d}', F.coalesce("doc_kind", F.lit("?")), "n_chars")
    n = F.col("doc_id") % 6
    raw = F.when(n == 0, said).when(n == 1, F.concat(F.lit("<THINK>a {b}\nc</THINK>\n"), said)).when(n == 2, F.concat(F.lit("Sure!\n```json\n"), said, F.lit("\n```\nDone {x}"))).when(n == 3, F.concat(F.lit("b </think>"), said, F.lit(" ok"))).when(n == 4, F.lit("no object")).otherwise(F.lit("{broken"))
    return table(spark, sf_dir, "documents").select("doc_id", U.strip_reasoning(raw).alias("answer"), U.model_json(U.strip_reasoning(raw)).alias("json"))


def summary_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = D.events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.transform(F.sequence(F.lit(1), F.least(F.lit(25), F.col("n")).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("files"))
    return U.index_rows(D.summaries(spark, sf_dir).join(files, "session_id"), D.sessions(spark, sf_dir)).select("chunk_id", "source_ref", "project_key", "title", "content", "tags", us("ts"))


def session_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as those of summaries: three to a session, of which one is final, some not embedded yet."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), F.expr("concat('s', vec_id div 3)").alias("session_id"), F.when(F.col("vec_id") % 3 == 1, "final").otherwise("rolling").alias("tier"), F.when(F.col("vec_id") % 5 > 0, F.col("embedding")).alias("embedding"))
    chunks = e.where("length(chunk_id) + cast(substr(chunk_id, 2) as bigint) % 7 > 3").select("chunk_id", "session_id", F.lit("session_summary").alias("source_type"), F.concat_ws(":", "session_id", "tier").alias("source_ref"))
    return U.session_vectors(chunks, e).select("session_id", "chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def reindex_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source after every tenth document was indexed anew as one chunk."""
    old = C.chunks(spark, sf_dir).select("source_type", "source_ref", "chunk_id", F.length("content").alias("chars"))
    fresh = old.where("cast(substr(chunk_id, 2) as bigint) % 10 = 0").select("source_type", "source_ref", F.concat(F.lit("new-"), "chunk_id").alias("chunk_id"), F.lit(1).alias("chars"))
    return I.reindex(old, fresh).groupBy("source_ref").agg(F.count("*").alias("chunks"), F.sum("chars").alias("chars"), F.min("chunk_id").alias("first_chunk"))


def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding queue of all entries after those changed since the cutoff were put in anew."""
    e = D.entries(spark, sf_dir).withColumn("chunk_id", F.col("entry_id"))
    queue = e.select("chunk_id", F.col("created_at").alias("enqueued_at"), (F.length("chunk_id") % 6).alias("attempts"), F.col("created_at").alias("next_attempt_at"))
    return G.enqueue(queue, e.where(F.col("updated_at") >= D.as_of()), D.as_of()).select("chunk_id", us("enqueued_at"), "attempts", us("next_attempt_at"))


def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.session_payload(table(spark, sf_dir, "session_upserts"), 200).select("upsert_id", "session_id", "project_key", "last_prompt", "tool", "git_branch")


def entry_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one agent gets of every published id, those merged away included."""
    e = D.entries(spark, sf_dir)
    chunks = e.select(F.col("entry_id").alias("source_ref"), F.posexplode(F.filter(F.split("content", "\n"), lambda x: x != "")).alias("chunk_index", "content")).withColumn("chunk_id", F.concat_ws(":", "source_ref", "chunk_index"))
    asked = table(spark, sf_dir, "entries").select("entry_id", F.lit(REQUESTER).alias("requester"))
    return M.read_entries(e.withColumn("visibility", F.coalesce("visibility", F.lit("shared"))), chunks, asked).select("entry_id", "status", F.size("chunks").alias("chunks"), F.md5(F.array_join("chunks", "\n")).alias("text"))


def entry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.with_cwd(F.col("metadata"), F.col("cwd"))
    return table(spark, sf_dir, "entries").select("entry_id", F.element_at(m, "cwd").alias("cwd"), F.size(m).alias("keys"))


def payload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "projects").select("project_key", T.json_or(F.col("metadata"), "{}").alias("metadata")).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("project_key"), T.json_or(F.col("lang"), "[]").alias("metadata")))


def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times for people: whole ISO texts of the documents, and what is none."""
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).otherwise(iso)
    return table(spark, sf_dir, "documents").select("doc_id", T.format_ts(text).alias("shown"))


def brief_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.brief_sessions(D.sessions(spark, sf_dir), D.summaries(spark, sf_dir), 200, branch=BRANCH).select("project_key", "place", "session_id", "used")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "query_key string, project_key string, score double")
    return V.merge_related(W.related_lexical(spark, sf_dir), none, W._counts(spark, sf_dir))


def related_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related projects of each project by name, most sessions first."""
    return _related(spark, sf_dir).select("query_key", "place", "project_key", "session_count", "why")


def project_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project's brief of sessions since the cutoff, in one."""
    s = D.sessions(spark, sf_dir).where(F.col("last_event_at") >= D.as_of())
    blocks = V.brief_sessions(s, D.summaries(spark, sf_dir), 300)
    e = D.entries(spark, sf_dir).where("kind = 'decision' and project_key is not null").select("project_key", F.struct(F.negative(F.unix_micros("updated_at")), F.col("entry_id")).alias("place"), F.concat_ws(": ", F.coalesce("title", F.lit("")), "content").alias("decision"))
    recorded = V.first_distinct(e, "project_key", "decision", ["place"], 10)
    b = V.compose_brief(table(spark, sf_dir, "projects"), blocks, recorded, _related(spark, sf_dir))
    return b.select("project_key", "session_count", "estimated_tokens", F.array_join("sessions", "|").alias("sessions"), F.md5(F.array_join("decisions", "|")).alias("decisions"), F.md5(F.array_join("open_threads", "|")).alias("open_threads"), F.array_join("related", "|").alias("related"), "message")


def nearby_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects near the folder above where each project was worked in, by key or by the directory they are kept in."""
    p = table(spark, sf_dir, "projects").where("project_key is not null")
    at = table(spark, sf_dir, "session_upserts").where("project_key is not null").groupBy(F.col("project_key").alias("query_key")).agg(F.regexp_replace(F.max("cwd"), "/[^/]*$", "").alias("path")).where("path is not null")
    return V.related_by_name(p, W._counts(spark, sf_dir), at, roots=True)


def projects_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "projects").where("project_key is not null").select("project_key").distinct()
    muted, alone = [Q.PROJECT, "path:/home/dev/export"], "path:/home/dev/export"
    return V.visible(p, muted).withColumnRenamed("visible", "visible_muted").join(V.visible(p, muted, alone).withColumnRenamed("visible", "visible_solo"), "project_key")


def projects_by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by the time their last session record says it began, where that is plain."""
    u = table(spark, sf_dir, "session_upserts").groupBy("project_key").agg(F.max_by("started_at", F.struct("received_at", "upsert_id")).alias("said"))
    p = table(spark, sf_dir, "projects").where("project_key is not null").select("project_key").distinct().join(u, "project_key", "left")
    return V.by_activity(p, F.when(F.col("said").rlike(M.PLAIN_TS), F.col("said")), 60)


def _outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("id", "session_id", F.col("id").alias("seq"), (F.col("id") * 1000).alias("created_at"), (F.col("id") % 3 > 0).alias("delivered"))


def spool_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "session_upserts").select(F.unix_micros("received_at").alias("updated_at"))
    return P.backlog(_outbound(spark, sf_dir), marks)


def spool_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_batch(_outbound(spark, sf_dir)).select("id", "session_id", "seq")


def spool_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spool after its next batch was delivered and old rows went."""
    out = _outbound(spark, sf_dir)
    return P.prune(P.acknowledge(out, P.next_batch(out)), 300).select("id", "delivered")


def sync_append(spark: SparkSession, sf_dir: str, dry_run: bool = False) -> DataFrame:
    """Statistics of sending what one project got since the cutoff to a hub that holds every other event, and how many
    sessions that hub has then."""
    ev = D.events(spark, sf_dir).join(D.sessions(spark, sf_dir).select("session_id", "project_key"), "session_id").select("session_id", "seq", "project_key", F.col("received_at").alias("at"))
    target = ev.where("seq % 2 = 0")
    fresh, stats = M.sync(ev, target, D.as_of(), Q.PROJECT, dry_run)
    return stats.join(target.unionByName(fresh).agg(F.count("*").alias("events_then")), F.lit(True))


def sync_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_append(spark, sf_dir, True)


def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each way brought for each query of the batch, and how many together."""
    _, r, _ = Q.SEARCHES["hybrid_rrf"]
    f = S.candidates(C.chunks(spark, sf_dir), C.batch(spark, sf_dir), r, vectors=C.vectors(spark, sf_dir), query_vectors=C.query_vectors(spark, sf_dir))
    return S.diagnostics(f, C.batch(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    agent_upsert, summary_upsert, summary_generated, summary_settled, model_answers, summary_indexed, session_vectors, reindex_source, queue_upsert, payload_projection, entry_reads, entry_metadata, payload_defaults, shown_times, brief_branch, related_ranked, project_brief,
    nearby_by_root, projects_visible, projects_by_activity, spool_backlog, spool_next, spool_pruned, sync_append, sync_dry_run, retrieval_diagnostics,
)}

_BASE, _SUMS = W._BASE, W._SUMS
_PLACED = W._BRIEF.replace("not is_sidechain qualify", f"not is_sidechain and (git_branch = '{BRANCH}' or git_branch is null) qualify")
_RANKED = f"""{W._RELATED}, ranked as (select query_key, row_number() over (partition by query_key order by session_count desc, project_key) as place, project_key, session_count, 'name/path match' as why from lexical qualify place <= {V.RELATED_MOST})"""
_SAID = """'{"summary": "' || coalesce(doc_kind, '?') || '", "n": ' || n_chars || '}'"""
_SYNC = f"""{_BASE}, e as (select ev.session_id, seq, project_key, ev.received_at as got from ev join sess using (session_id)),
    sent as (select * from e where project_key = {Q._quoted(Q.PROJECT)} and session_id in (select session_id from e where project_key = {Q._quoted(Q.PROJECT)} and got >= {D.AS_OF_SQL}))"""
ORACLES = {
    "agent_upsert": """with r as (select agent_id, display_name, device_name, array_to_string(capabilities, ',') as capabilities, last_seen_at, 0 as n from agents union all select agent_id, agent_id, device_name, null, received_at, upsert_id from session_upserts)
        select agent_id, display_name, device_name, capabilities, epoch_us(last_seen_at) as last_seen_at_us from r where agent_id is not null and last_seen_at is not null qualify row_number() over (partition by agent_id order by last_seen_at desc, n desc) = 1""",
    "summary_upsert": """with r as (select *, case when status in ('idle', 'closed') then 'final' else 'rolling' end as tier from session_upserts where session_id is not null)
        select session_id, tier, coalesce(ai_title, 'Untitled') as summary, tool, epoch_us(received_at) as generated_us from r qualify row_number() over (partition by session_id, tier order by received_at desc, upsert_id desc) = 1""",
    "summary_generated": f"""with ext as ({W.ORACLES['extractive_summary']}), more as ({_BASE}, {W._FACTS} select session_id, event_count % 4 as n, len(files[1:40])::int as files from sess join facts using (session_id))
        select session_id, case n when 0 then 'Told by a model.' when 1 then 'Short.' else summary end as summary, case n when 0 then 'Keep it|Drop it' else '' end as decisions, case n when 1 then 'Why?' else '' end as open_threads, files, case when n < 2 then 'stand-in' else 'extractive' end as model
        from ext join more using (session_id)""",
    "summary_settled": f"""{_BASE}, old as (select session_id, count(*) as covered from ev where received_at < {D.AS_OF_SQL} group by 1)
        select session_id, event_count, coalesce(covered, 0) as summarized_event_count, event_count > coalesce(covered, 0) as summary_dirty from sess left join old using (session_id)""",
    "model_answers": f"""select doc_id, case when doc_id % 6 < 2 then {_SAID} when doc_id % 6 = 2 then 'Sure!' || chr(10) || '```json' || chr(10) || {_SAID} || chr(10) || '```' || chr(10) || 'Done {{x}}' when doc_id % 6 = 3 then {_SAID} || ' ok' when doc_id % 6 = 4 then 'no object' else '{{broken' end as answer,
        case when doc_id % 6 < 4 then {_SAID} end as json from documents""",
    "summary_indexed": f"""{_SUMS} select 'sum:' || session_id || ':' || tier as chunk_id, session_id || ':' || tier as source_ref, project_key, coalesce(nullif(ai_title, ''), 'Session ' || session_id[1:8]) as title,
        summary || case when len(decisions) > 0 then chr(10) || 'Decisions: ' || array_to_string(decisions, '; ') else '' end || case when len(open_threads) > 0 then chr(10) || 'Open threads: ' || array_to_string(open_threads, '; ') else '' end
        || chr(10) || 'Files: ' || array_to_string(list_transform(generate_series(1, least(20, event_count)), lambda i: 'f' || i), ', ') as content, tool || ' ' || tier as tags, epoch_us(last_event_at) as ts_us from sums join sess using (session_id)""",
    "session_vectors": """select session_id, chunk_id, round(embedding[1]::double, 6) as first from (select * from (select 'd' || vec_id as chunk_id, 's' || (vec_id // 3) as session_id, vec_id % 3 = 1 as final, case when vec_id % 5 > 0 then embedding end as embedding from embeddings)
        where length(chunk_id) + substr(chunk_id, 2)::bigint % 7 > 3 qualify row_number() over (partition by session_id order by not final, chunk_id) = 1) where embedding is not null""",
    "reindex_source": """with old as (select 's' || (doc_id // 2) as source_ref, 'd' || doc_id as chunk_id, length(coalesce(text, '')) as chars, doc_id from documents), fresh as (select source_ref, 'new-' || chunk_id as chunk_id, 1 as chars from old where doc_id % 10 = 0)
        select source_ref, count(*) as chunks, sum(chars)::bigint as chars, min(chunk_id) as first_chunk from (select source_ref, chunk_id, chars from old where source_ref not in (select source_ref from fresh) union all select * from fresh) group by 1""",
    "queue_upsert": f"""with {D.ENTRIES_SQL} select entry_id as chunk_id, epoch_us(case when fresh then {D.AS_OF_SQL} else created_at end) as enqueued_at_us, (case when fresh then 0 else length(entry_id) % 6 end)::int as attempts,
        epoch_us(case when fresh then {D.AS_OF_SQL} else created_at end) as next_attempt_at_us from (select *, updated_at >= {D.AS_OF_SQL} as fresh from ent)""",
    "payload_projection": f"""with k as ({K.ORACLES['project_keys']}) select upsert_id, u.session_id, k.derived as project_key, case when coalesce(last_prompt, '') <> '' then ({K._redact_sql('last_prompt')})[1:200] end as last_prompt, tool, git_branch from session_upserts u join k using (upsert_id)""",
    "entry_reads": f"""with {D.ENTRIES_SQL}, l as (select entry_id, agent_id, recipient_id, coalesce(visibility, 'shared') as v, list_filter(string_split(content, chr(10)), lambda x: x <> '') as parts from ent),
        s as (select e.entry_id, case when l.entry_id is null then 404 when v in ('shared', 'broadcast') or l.agent_id = '{REQUESTER}' or l.recipient_id = '{REQUESTER}' then 200 else 403 end as status, parts from entries e left join l using (entry_id))
        select entry_id, status, (case when status = 200 then coalesce(len(parts), 0) else 0 end)::int as chunks, md5(case when status = 200 then coalesce(array_to_string(parts, chr(10)), '') else '' end) as text from s""",
    "entry_metadata": "select entry_id, coalesce(metadata['cwd'], nullif(cwd, '')) as cwd, (coalesce(len(map_keys(metadata)), 0) + case when not coalesce(list_contains(map_keys(metadata), 'cwd'), false) and coalesce(cwd, '') <> '' then 1 else 0 end)::int as keys from entries",
    "payload_defaults": "select project_key, case when metadata <> '' and json_valid(metadata) then metadata else '{}' end as metadata from projects union all select 'd' || doc_id, case when lang <> '' and json_valid(lang) then lang else '[]' end from documents",
    "shown_times": "select doc_id, case when doc_id % 5 = 0 or doc_id % 5 > 1 and created_at is null then '-' when doc_id % 5 = 1 then 'about ' || doc_id else strftime(created_at, '%Y-%m-%d %H:%M:%S UTC') end as shown from documents",
    "brief_branch": f"{_SUMS}, {_PLACED} select project_key, place::int as place, session_id, used::bigint as used from costs where used <= 200 or r = 1",
    "related_ranked": f"{_BASE}, {_RANKED} select query_key, place::int as place, project_key, session_count, why from ranked",
    "project_brief": f"""{_SUMS}, {D.ENTRIES_SQL}, {W._BRIEF.replace("where not is_sidechain qualify", f"where not is_sidechain and last_event_at >= {D.AS_OF_SQL} qualify").replace("b.decisions from", "b.decisions, b.open_threads from")}, {_RANKED},
        blocks as (select * from costs where used <= 300 or r = 1),
        base as (select project_key, count(*) as n, max(used) as used, string_agg(session_id, '|' order by place) as sessions from blocks group by 1),
        rec as (select project_key, 0 as way, 0 as place, 0 as i, -epoch_us(updated_at) as t, entry_id, concat_ws(': ', coalesce(title, ''), content) as x from ent where kind = 'decision' and project_key is not null),
        rec10 as (select project_key, 0 as way, row_number() over (partition by project_key order by min(row(t, entry_id))) as place, 0 as i, x from rec where trim(x) <> '' group by project_key, x qualify row_number() over (partition by project_key order by min(row(t, entry_id))) <= 10),
        every as (select * from rec10 union all select project_key, 1, place, unnest(generate_series(0, len(decisions) - 1)), unnest(decisions) from blocks where len(decisions) > 0),
        dec as (select project_key, string_agg(x, '|' order by pos) as x from (select project_key, x, min(row(way, place, i)) as pos from every where trim(x) <> '' group by 1, 2 qualify row_number() over (partition by project_key order by min(row(way, place, i))) <= 10) group by 1),
        thr as (select project_key, string_agg(x, '|' order by pos) as x from (select project_key, x, min(row(place, i)) as pos from (select project_key, place, unnest(generate_series(0, len(open_threads) - 1)) as i, unnest(open_threads) as x from blocks where len(open_threads) > 0)
            where trim(x) <> '' group by 1, 2 qualify row_number() over (partition by project_key order by min(row(place, i))) <= 10) group by 1),
        rel as (select query_key as project_key, string_agg(project_key || ' (' || session_count || ' sessions, ' || why || ')', '|' order by place) as x from ranked group by 1),
        j as (select p.project_key, coalesce(n, 0) as n, coalesce(used, 0)::bigint as used, coalesce(sessions, '') as sessions, coalesce(dec.x, '') as d, coalesce(thr.x, '') as t, case when coalesce(n, 0) < 3 then coalesce(rel.x, '') else '' end as related
            from (select distinct project_key from projects) p left join base on base.project_key = p.project_key left join dec on dec.project_key = p.project_key left join thr on thr.project_key = p.project_key left join rel on rel.project_key = p.project_key)
        select project_key, n as session_count, used as estimated_tokens, sessions, md5(d) as decisions, md5(t) as open_threads, related, case when n = 0 and related = '' then 'Nothing is recorded for this project; start without assuming any history.'
            when n = 0 then 'Nothing is recorded under this key; the same work may be under another one listed here.' when related <> '' then 'Little is recorded under this key; more may be under another one listed here.' end as message from j""",
    "nearby_by_root": f"""{_BASE}, counts as (select project_key, count(*) as session_count from merged group by 1), p as (select project_key, max(repo_root) as root from projects where project_key is not null group by 1),
        k as (select project_key as query_key, lower(regexp_replace(max(cwd), '/[^/]*$', '')) as here, lower(split_part(regexp_replace(max(cwd), '/[^/]*$', ''), '/', -1)) as base from session_upserts where project_key is not null and cwd is not null group by 1)
        select query_key, project_key, session_count from k join (select p.project_key, lower(coalesce(root, '')) as r, lower(p.project_key) as key, session_count from p join counts using (project_key)) c on c.project_key <> k.query_key
        and (base <> '' and (contains(key, base) or contains(r, base)) or r <> '' and (starts_with(r, here) or starts_with(here, r)))""",
    "projects_visible": f"select distinct project_key, project_key not in ({Q._quoted(Q.PROJECT)}, 'path:/home/dev/export') as visible_muted, project_key = 'path:/home/dev/export' as visible_solo from projects where project_key is not null",
    "projects_by_activity": f"""with l as (select project_key, started_at as said from session_upserts qualify row_number() over (partition by project_key order by received_at desc, upsert_id desc) = 1),
        a as (select p.project_key, case when regexp_full_match(said, {D.PLAIN_SQL}) then try_cast(said as timestamptz) end as began from (select distinct project_key from projects where project_key is not null) p left join l using (project_key))
        select project_key, row_number() over (order by began desc nulls last, project_key)::int as place from a qualify place <= 60""",
    "spool_backlog": "select count(*) as pending, min(id * 1000) as oldest_pending, count(distinct session_id) as pending_sessions, (select epoch_us(max(received_at)) from session_upserts) as last_progress from messages where id % 3 = 0",
    "spool_next": "select id, session_id, id as seq from messages where id % 3 = 0 order by id limit 200",
    "spool_pruned": """with n as (select id from messages where id % 3 = 0 order by id limit 200), a as (select id, id % 3 > 0 or id in (select id from n) as delivered from messages)
        select id, delivered from a where not delivered or id in (select id from a where delivered order by id desc limit 300)""",
    "sync_append": f"""{_SYNC} select count(distinct session_id) as sessions, count(*) as events_sent, count(*) filter (seq % 2 <> 0) as inserted, count(*) filter (seq % 2 = 0) as skipped, (select count(*) from e where seq % 2 = 0) + count(*) filter (seq % 2 <> 0) as events_then from sent""",
    "sync_dry_run": f"""{_SYNC} select count(distinct session_id) as sessions, count(*) as events_sent, 0::bigint as inserted, 0::bigint as skipped, (select count(*) from e where seq % 2 = 0) as events_then from sent""",
    "retrieval_diagnostics": Q.search_sql("hybrid_rrf").split("    covered as (")[0].rstrip().rstrip(",") + """
        select query_id, count(k_rank) as keyword_candidates, count(v_rank) as vector_candidates, count(v_rank) > 0 as vector_used, count(*) as fused_candidates from keyword full join vec using (query_id, chunk_id) group by 1""",
}
