"""Queries of what is shown: listings, exports, status, threads, work lists, facts, briefs, related projects, graph."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import indexing as I
from tidemark.operators import model as M
from tidemark.operators import search as S
from tidemark.operators import views as V
from tidemark.plans import corpus as C
from tidemark.plans import scalar_queries as K
from tidemark.plans import search_queries as Q
from tidemark.plans import stored as D
from tidemark.session import table

us = lambda c: F.unix_micros(c).alias(f"{c}_us")
INBOX_AGENT = "agent-anchor-28"
BIGGEST = "hermes-gateway-main"
DAYS = 30


def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest main-line sessions that are not closed, with their best summary."""
    s = D.sessions(spark, sf_dir).where("not is_sidechain and status <> 'closed'").orderBy(F.desc_nulls_last("last_event_at"), "session_id").limit(50)
    best = V.best_summaries(D.summaries(spark, sf_dir))
    return s.join(best, "session_id", "left").select("session_id", "project_key", "status", "tool", T.session_title(F.col("ai_title"), F.col("session_id")).alias("title"), "event_count", us("last_event_at"), "tier", "summary")


def list_projects_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sessions(spark, sf_dir).groupBy("project_key").agg(F.count("*").alias("session_count"), F.max("last_event_at").alias("last_active"))
    p = table(spark, sf_dir, "projects").join(s, "project_key", "left").orderBy(F.desc_nulls_last("last_active"), "project_key").limit(40)
    return p.select("project_key", "display_name", F.coalesce("session_count", F.lit(0)).alias("session_count"), F.coalesce(F.unix_micros("last_active"), F.lit(-1)).alias("last_active_us"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, s = D.events(spark, sf_dir), M.merge_sessions(table(spark, sf_dir, "session_upserts"))
    tables = {"agents": table(spark, sf_dir, "agents"), "entries": D.entries(spark, sf_dir), "projects": table(spark, sf_dir, "projects"), "sessions": s, "session_events": ev, "chunks": table(spark, sf_dir, "documents"), "embedded_chunks": table(spark, sf_dir, "embeddings")}
    out = None
    for n, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = C.vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("done"))
    return C.chunks(spark, sf_dir).join(done, "chunk_id", "left").groupBy("project_key").agg(F.count("*").alias("chunks"), F.count("done").alias("embedded"), F.round(F.coalesce(F.try_divide(F.count("done"), F.count("*")), F.lit(0.0)), 4).alias("coverage"))


def last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of three latest times, whichever there are."""
    a = table(spark, sf_dir, "entries").agg(F.max("created_at").alias("a"))
    b = table(spark, sf_dir, "session_events").agg(F.max("received_at").alias("b"))
    c = table(spark, sf_dir, "projects").agg(F.max("updated_at").alias("c"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).select(F.unix_micros(F.greatest("a", "b", "c")).alias("last_updated_us"))


def export_sessions_page(spark: SparkSession, sf_dir: str, offset: int = 20, limit: int = 50) -> DataFrame:
    """A page of sessions, oldest first, with what their project is called and whether more follow."""
    s = D.sessions(spark, sf_dir).where(F.col("last_event_at") >= "2025-10-01")
    page = s.orderBy("last_event_at", "session_id").offset(offset).limit(limit + 1)
    n = page.withColumn("r", F.row_number().over(Window.orderBy("last_event_at", "session_id"))).withColumn("has_more", F.max("r").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("r") <= limit)
    p = table(spark, sf_dir, "projects").select("project_key", "display_name")
    return n.join(p, "project_key", "left").select("session_id", "project_key", "display_name", "tool", "status", "event_count", us("last_event_at"), "has_more")


def export_events_keyset(spark: SparkSession, sf_dir: str, after: int = 40, limit: int = 200) -> DataFrame:
    return D.events(spark, sf_dir).where((F.col("session_id") == BIGGEST) & (F.col("seq") > after)).orderBy("seq").limit(limit).select("seq", "role", "kind", "content", F.size("commands").alias("commands"))


def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of stored entries with their agent and project."""
    e = D.entries(spark, sf_dir).orderBy("updated_at", "entry_id").offset(10).limit(100)
    a = table(spark, sf_dir, "agents").select("agent_id", F.col("display_name").alias("agent_name"), F.col("device_name").alias("agent_device"))
    return e.join(a, "agent_id", "left").select("entry_id", "agent_id", F.coalesce("agent_name", "agent_id").alias("agent_name"), "agent_device", "kind", "title", F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)).alias("project_key"), us("updated_at"))


def entry_project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored entry's project by way of its chunks."""
    e = D.entries(spark, sf_dir)
    keys = I.chunk_entries(e).groupBy(F.col("source_ref").alias("entry_id")).agg(F.min("project_key").alias("project_key"))
    return e.select("entry_id").join(keys, "entry_id", "left").select("entry_id", F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)).alias("project_key"))


def latest_n_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 events of every session, counted upwards."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    last = D.events(spark, sf_dir).withColumn("back", F.row_number().over(w)).where("back <= 30")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).select("session_id", "place", "seq", "kind")


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.entries(spark, sf_dir).where("kind = 'message'").withColumn("shown", T.default_visibility(F.col("kind"), F.col("visibility"), F.col("recipient_id")))
    mine = e.where((F.col("recipient_id") == INBOX_AGENT) | (F.col("shown") == "broadcast"))
    return mine.orderBy(F.desc("updated_at"), "entry_id").limit(20).select("entry_id", "agent_id", "recipient_id", "shown", "title", us("updated_at"))


def open_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project's open threads of its 20 newest summaries that have any, each once at its newest."""
    s = D.sessions(spark, sf_dir).select("session_id", "project_key", "last_event_at")
    w = Window.partitionBy("project_key").orderBy(F.desc_nulls_last("last_event_at"), "session_id", "tier")
    rows = s.join(D.summaries(spark, sf_dir).where("size(open_threads) > 0"), "session_id").withColumn("r", F.row_number().over(w)).where("r <= 20")
    each = rows.select("project_key", "session_id", "r", F.posexplode("open_threads").alias("i", "thread"))
    return each.groupBy("project_key", "thread").agg(F.min_by("session_id", F.struct("r", "i")).alias("session_id"), F.min("r").alias("newest"))


def final_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting sessions with events and no final summary yet: as if those that ended since the cutoff had none."""
    s = D.sessions(spark, sf_dir).where("status in ('idle', 'closed') and event_count > 0")
    done = D.summaries(spark, sf_dir).where("tier = 'final'").join(s.where(F.col("last_event_at") < D.as_of()).select("session_id"), "session_id", "left_semi")
    return s.join(done, "session_id", "left_anti").orderBy(F.desc_nulls_last("last_event_at"), "session_id").limit(30).select("session_id", "status", "event_count", us("last_event_at"))


def rolling_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sessions with 25 events or more since their last summary: as if it had covered those before the cutoff."""
    s = D.sessions(spark, sf_dir).where("status = 'active'")
    old = D.events(spark, sf_dir).where(F.col("received_at") < D.as_of()).groupBy("session_id").agg(F.count("*").alias("covered"))
    due = s.join(old, "session_id", "left").withColumn("fresh", F.col("event_count") - F.coalesce("covered", F.lit(0))).where("fresh >= 25")
    return due.orderBy(F.desc_nulls_last("last_event_at"), "session_id").limit(30).select("session_id", "event_count", "fresh")


def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sessions without an event for half an hour before the cutoff."""
    s = D.sessions(spark, sf_dir).where("status = 'active'").where(F.col("last_event_at") < D.as_of() - F.expr("interval 30 minutes"))
    return s.select("session_id", us("last_event_at"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of activity of each user: events no more than half an hour apart."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return w.select("user_id", F.unix_micros("session_window.start").alias("start_us"), (F.unix_micros("session_window.end") - 30 * 60 * 1000000).alias("last_us"), "events", "value")


def activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "events")


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.session_facts(D.events(spark, sf_dir))
    return f.select("session_id", "prompts", "replies", "first_prompt", "last_prompt", F.array_join("files", "|").alias("files"), F.col("n_files").cast("bigint").alias("n_files"), F.array_join("commands", "|").alias("commands"), F.col("n_commands").cast("bigint").alias("n_commands"))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extractive_summary(D.sessions(spark, sf_dir), V.session_facts(D.events(spark, sf_dir)))


def transcript_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transcript(D.events(spark, sf_dir), 3000)


def brief_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.brief_sessions(D.sessions(spark, sf_dir), D.summaries(spark, sf_dir), 200).select("project_key", "place", "session_id", "summary", "used")


def brief_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten decisions of each project's brief: recorded ones, newest first, then those of its sessions."""
    e = D.entries(spark, sf_dir).where("kind = 'decision'").withColumn("project_key", F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)))
    w = Window.partitionBy("project_key").orderBy(F.desc("updated_at"), "entry_id")
    recorded = e.withColumn("place", F.row_number().over(w)).where("place <= 10").select("project_key", F.lit(0).alias("way"), "place", F.lit(0).alias("i"), F.concat_ws(": ", F.coalesce("title", F.lit("")), "content").alias("decision"))
    told = V.brief_sessions(D.sessions(spark, sf_dir), D.summaries(spark, sf_dir)).select("project_key", F.lit(1).alias("way"), "place", F.posexplode("decisions").alias("i", "decision"))
    return V.first_distinct(recorded.unionByName(told), "project_key", "decision", ["way", "place", "i"]).select("project_key", "place", F.md5("decision").alias("decision"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_sessions(table(spark, sf_dir, "session_upserts")).groupBy("project_key").agg(F.count("*").alias("session_count"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "projects").select(F.col("project_key").alias("query_key")).where("query_key is not null").distinct()


def related_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.related_by_name(table(spark, sf_dir, "projects"), _counts(spark, sf_dir), _requests(spark, sf_dir))


def related_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related projects by name and by a search for what each key is called."""
    seeds = _requests(spark, sf_dir).select(F.col("query_key").alias("query_id"), T.search_seed(F.col("query_key")).alias("query"))
    found = S.search(C.chunks(spark, sf_dir), seeds, NEARBY, Q.as_of())
    meaning = found.select(F.col("query_id").alias("query_key"), "project_key", F.col("relevance").alias("score"))
    return V.merge_related(related_lexical(spark, sf_dir), meaning, _counts(spark, sf_dir))


NEARBY = S.Request(scope="global", limit=20, min_score=V.RELATED_FLOOR)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "projects").select("project_key", "display_name")
    return V.graph(D.sessions(spark, sf_dir).join(p, "project_key", "left"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _graph(spark, sf_dir)[0]
    return n.select("id", "type", "label", "project_key", "color_index", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x", "y", "z", "size")))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def project_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the first three components, count and latest of the vectors of each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(*((F.round(F.avg(F.col("embedding")[i].cast("double")), 6) + F.lit(0.0)).alias(c) for i, c in enumerate("xyz")), F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


def fibonacci_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "agents").agg(F.count("*").alias("n"))
    a = table(spark, sf_dir, "agents").withColumn("i", F.row_number().over(Window.orderBy("agent_id")) - 1).join(n, F.lit(True))
    return V.normalized(a.select("agent_id", *(e.alias(c) for c, e in V.sphere(F.col("i"), F.col("n")).items()))).select("agent_id", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in "xyz"))


def graph_layout_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalized(V.principal_axes(C.vectors(spark, sf_dir), "chunk_id", "embedding")).select("chunk_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def agents_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agents").orderBy(F.desc_nulls_last("last_seen_at"), "agent_id").limit(20).select("agent_id", "display_name", F.size("capabilities").alias("capabilities"), us("last_seen_at"))


QUERIES = {f.__name__: f for f in (
    list_sessions, list_projects_nulls_last, status_counts, embedding_coverage, last_updated, export_sessions_page, export_events_keyset, export_entries, entry_project_lookup, latest_n_ascending, inbox, open_threads, final_work_list, rolling_work_list,
    idle_sessions, session_windows, activity_by_hour, session_facts, extractive_summary, transcript_head_tail, brief_budget, brief_decisions, related_lexical, related_merged, graph_nodes, graph_edges, project_centroids, fibonacci_sphere, graph_layout_pca, agents_recent,
)}

_BASE = f"with {D.EV_SQL}, {D.SESS_SQL}"
_SUMS = f"{_BASE}, {D.SUMS_SQL}"
_TOKENS = "greatest(1, length({0}) // 4)"
_CUT = "case when length({0}) <= 160 then {0} else rtrim({0}[1:157], ' ') || '...' end"
_WS = "' \t\n\r\x0b\x0c'"
_FACTS = f"""main as (select * from ev where not coalesce(is_sidechain, false)),
    said as (select session_id, count(*) filter (kind = 'prompt' and trim(content, {_WS}) <> '') as prompts, count(*) filter (kind = 'reply' and trim(content, {_WS}) <> '') as replies,
        arg_min(trim(content, {_WS}), seq) filter (kind = 'prompt' and trim(content, {_WS}) <> '') as first_prompt, arg_max(trim(content, {_WS}), seq) filter (kind = 'prompt' and trim(content, {_WS}) <> '') as last_prompt from main group by 1),
    f1 as (select session_id, x, min(row(seq, i)) as first_at from (select session_id, seq, unnest(files) as x, generate_subscripts(files, 1) as i from main) where x is not null group by 1, 2),
    fl as (select session_id, list(x order by first_at) as files, count(*) as n_files from f1 group by 1),
    c1 as (select session_id, x, min(row(seq, i)) as first_at from (select session_id, seq, unnest(commands) as x, generate_subscripts(commands, 1) as i from main) where x is not null group by 1, 2),
    cl as (select session_id, list(x order by first_at) as commands, count(*) as n_commands from c1 group by 1),
    facts as (select s.*, coalesce(files, []) as files, coalesce(n_files, 0) as n_files, coalesce(commands, []) as commands, coalesce(n_commands, 0) as n_commands from said s left join fl using (session_id) left join cl using (session_id))"""
_BRIEF = """top as (select * from sess where not is_sidechain qualify row_number() over (partition by project_key order by last_event_at desc nulls last, session_id) <= 5),
    placed as (select *, row_number() over (partition by project_key order by last_event_at desc nulls last, session_id) as place from top),
    told as (select p.project_key, p.place, p.session_id, coalesce(nullif(b.summary, ''), trim(p.ai_title)) as summary, b.decisions from placed p left join best b using (session_id)),
    costs as (select *, sum(greatest(1, length(summary) // 4) + 20) over (partition by project_key order by place) as used, row_number() over (partition by project_key order by place) as r from told where coalesce(summary, '') <> '')"""
_BARE = "lower(rtrim(replace(regexp_replace({0}, '^path:', ''), '\\', '/'), '/'))"
_RELATED = f"""counts as (select project_key, count(*) as session_count from merged group by 1),
    lexical as (select k.query_key, c.project_key, c.session_count from (select distinct project_key as query_key from projects where project_key is not null) k join counts c on c.project_key in (select project_key from projects) and c.project_key <> k.query_key
        and (starts_with({_BARE.format('c.project_key')}, {_BARE.format('k.query_key')} || '/') or starts_with({_BARE.format('k.query_key')}, {_BARE.format('c.project_key')} || '/')
             or contains({_BARE.format('c.project_key')}, split_part({_BARE.format('k.query_key')}, '/', -1))))"""
_SPHERE = """select *, case when n > 1 then 1 - i / (n - 1)::double * 2 else 0.0 end as y0, pi() * (3 - sqrt(5)) * i as theta from ({0})"""
_XYZ = "select *, cos(theta) * sqrt(greatest(0.0, 1 - y0 * y0)) * (n > 1)::int as x, y0 as y, sin(theta) * sqrt(greatest(0.0, 1 - y0 * y0)) * (n > 1)::int as z from ({0})"
_SCALED = "select * replace (x * f as x, y * f as y, z * f as z) from (select *, {1} / max(greatest(abs(x), abs(y), abs(z))) over () as f from ({0}))"
_PLACED = _SCALED.format(_XYZ.format(_SPHERE.format("""select s.*, p.display_name as pname, row_number() over (order by last_event_at desc nulls last, session_id) - 1 as i, count(*) over () as n
        from (select * from sess where not is_sidechain order by last_event_at desc nulls last, session_id limit 400) s left join projects p using (project_key)""")), "100.0")
ORACLES = {
    "list_sessions": f"""{_SUMS}, s as (select * from sess where not is_sidechain and status <> 'closed' order by last_event_at desc nulls last, session_id limit 50)
        select session_id, project_key, status, tool, coalesce(nullif(ai_title, ''), session_id[1:8]) as title, event_count, epoch_us(last_event_at) as last_event_at_us, tier, summary from s left join best using (session_id)""",
    "list_projects_nulls_last": f"""{_BASE}, a as (select project_key, count(*) as session_count, max(last_event_at) as last_active from sess group by 1)
        select project_key, display_name, coalesce(session_count, 0) as session_count, coalesce(epoch_us(last_active), -1) as last_active_us from projects left join a using (project_key) order by last_active desc nulls last, project_key limit 40""",
    "status_counts": f"""{_BASE}, {D.ENTRIES_SQL} select 'agents' as name, count(*) as rows from agents union all select 'entries', count(*) from ent union all select 'projects', count(*) from projects union all select 'sessions', count(*) from merged
        union all select 'session_events', count(*) from ev union all select 'chunks', count(*) from documents union all select 'embedded_chunks', count(*) from embeddings""",
    "embedding_coverage": f"with {C.CHUNKS_SQL}, {C.VECTORS_SQL} select c.project_key, count(*) as chunks, count(v.chunk_id) as embedded, round(count(v.chunk_id) / count(*)::double, 4) as coverage from chunks c left join vectors v using (chunk_id) group by 1",
    "last_updated": "select epoch_us(greatest((select max(created_at) from entries), (select max(received_at) from session_events), (select max(updated_at) from projects))) as last_updated_us",
    "export_sessions_page": f"""{_BASE}, page as (select * from sess where last_event_at >= timestamptz '2025-10-01 00:00:00+00' order by last_event_at, session_id limit 51 offset 20),
        n as (select *, row_number() over (order by last_event_at, session_id) as r, count(*) over () > 50 as has_more from page)
        select session_id, n.project_key, p.display_name, tool, status, event_count, epoch_us(last_event_at) as last_event_at_us, has_more from n left join projects p using (project_key) where r <= 50""",
    "export_events_keyset": f"with {D.EV_SQL} select seq, role, kind, content, len(commands)::int as commands from ev where session_id = '{BIGGEST}' and seq > 40 order by seq limit 200",
    "export_entries": f"""with {D.ENTRIES_SQL}, e as (select * from ent order by updated_at, entry_id limit 100 offset 10)
        select entry_id, agent_id, coalesce(a.display_name, agent_id) as agent_name, a.device_name as agent_device, kind, title, coalesce(project_key, '__global__') as project_key, epoch_us(updated_at) as updated_at_us from e left join agents a using (agent_id)""",
    "entry_project_lookup": f"with {D.ENTRIES_SQL} select entry_id, case when trim(content, {_WS}) <> '' then coalesce(project_key, '__global__') else '__global__' end as project_key from ent",
    "latest_n_ascending": f"""with {D.EV_SQL}, l as (select * from ev qualify row_number() over (partition by session_id order by seq desc) <= 30)
        select session_id, row_number() over (partition by session_id order by seq)::int as place, seq, kind from l""",
    "inbox": f"""with {D.ENTRIES_SQL}, m as (select *, case when recipient_id is not null then 'direct' else 'broadcast' end as shown from ent where kind = 'message')
        select entry_id, agent_id, recipient_id, shown, title, epoch_us(updated_at) as updated_at_us from m where recipient_id = '{INBOX_AGENT}' or shown = 'broadcast' order by updated_at desc, entry_id limit 20""",
    "open_threads": f"""{_SUMS}, r as (select s.project_key, session_id, open_threads, row_number() over (partition by s.project_key order by last_event_at desc nulls last, session_id, tier) as r from sess s join sums using (session_id) where len(open_threads) > 0),
        t as (select project_key, session_id, r, unnest(open_threads) as thread, generate_subscripts(open_threads, 1) as i from r where r <= 20)
        select project_key, thread, arg_min(session_id, r * 1000 + i) as session_id, min(r)::int as newest from t group by 1, 2""",
    "final_work_list": f"""{_BASE} select session_id, status, event_count, epoch_us(last_event_at) as last_event_at_us from sess where status in ('idle', 'closed') and event_count > 0 and not last_event_at < {D.AS_OF_SQL}
        order by last_event_at desc nulls last, session_id limit 30""",
    "rolling_work_list": f"""{_BASE}, old as (select session_id, count(*) as covered from ev where received_at < {D.AS_OF_SQL} group by 1)
        select session_id, event_count, event_count - coalesce(covered, 0) as fresh from sess left join old using (session_id) where status = 'active' and event_count - coalesce(covered, 0) >= 25 order by last_event_at desc nulls last, session_id limit 30""",
    "idle_sessions": f"{_BASE} select session_id, epoch_us(last_event_at) as last_event_at_us from sess where status = 'active' and last_event_at < {D.AS_OF_SQL} - interval 30 minutes",
    "session_windows": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as fresh from events),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as spell from g)
        select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as last_us, count(*) as events, round(sum(value), 2) as value from s group by user_id, spell""",
    "activity_by_hour": "select epoch_us(date_trunc('hour', ts)) as start_us, event_type, count(*) as events from events group by 1, 2",
    "session_facts": f"""with {D.EV_SQL}, {_FACTS} select session_id, prompts, replies, first_prompt, last_prompt, array_to_string(files[1:40], '|') as files, n_files, array_to_string(commands[1:5], '|') as commands, n_commands from facts""",
    "extractive_summary": f"""{_BASE}, {_FACTS} select session_id, concat_ws(' ', rtrim(coalesce(nullif(ai_title, ''), first_prompt[1:120], 'Untitled session'), '.') || '.',
        case when prompts > 0 then 'Opened with: ' || {_CUT.format('first_prompt')} end, case when prompts > 1 then 'Most recent request: ' || {_CUT.format('f.last_prompt')} end,
        case when n_files > 0 then 'Files touched: ' || array_to_string(files[1:8], ', ') || case when n_files > 8 then ' (+' || (n_files - 8) || ' more)' else '' end || '.' end, case when n_commands > 0 then 'Commands run: ' || array_to_string(commands[1:5], '; ') || '.' end,
        event_count || ' events on ' || tool || case when coalesce(git_branch, '') <> '' then ', branch ' || git_branch else '' end || '.') as summary from sess s join facts f using (session_id)""",
    "transcript_head_tail": f"""with {D.EV_SQL}, l as (select session_id, seq, '[' || case kind when 'prompt' then 'USER' when 'reply' then 'ASSISTANT' when 'tool_use' then 'TOOL' else upper(kind) end || '] ' || trim(content, {_WS}) as line
            from ev where not coalesce(is_sidechain, false) and trim(content, {_WS}) <> ''),
        t as (select *, sum(length(line) + 1) over (partition by session_id) - 1 as chars, sum(length(line) + 1) over (partition by session_id order by seq) - 1 as front, sum(length(line) + 1) over (partition by session_id order by seq desc) - 1 as back from l)
        select session_id, 'all' as part, seq, line from t where chars <= 3000 union all select session_id, 'head', seq, line from t where chars > 3000 and front <= 1000 union all select session_id, 'tail', seq, line from t where chars > 3000 and back <= 2000""",
    "brief_budget": f"{_SUMS}, {_BRIEF} select project_key, place::int as place, session_id, summary, used::bigint as used from costs where used <= 200 or r = 1",
    "brief_decisions": f"""{_SUMS}, {D.ENTRIES_SQL}, {_BRIEF},
        rec as (select coalesce(project_key, '__global__') as project_key, 0 as way, row_number() over (partition by coalesce(project_key, '__global__') order by updated_at desc, entry_id) as place, 0 as i, concat_ws(': ', coalesce(title, ''), content) as decision from ent where kind = 'decision'),
        every as (select * from rec where place <= 10 union all select project_key, 1, place, unnest(generate_series(0, len(decisions) - 1)), unnest(decisions) from costs where (used <= 500 or r = 1) and len(decisions) > 0),
        once as (select project_key, decision, min(row(way, place, i)) as first_at from every where trim(decision) <> '' group by 1, 2)
        select project_key, row_number() over (partition by project_key order by first_at)::int as place, md5(decision) as decision from once qualify place <= 10""",
    "related_lexical": f"with {D.EV_SQL}, {D.SESS_SQL}, {_RELATED} select query_key, project_key, session_count from lexical",
    "related_merged": f"""{_BASE}, {_RELATED}, found as ({Q.request_sql(None, NEARBY, False, f"queries as (select distinct project_key as query_id, seed as query from ({K.ORACLES['search_seed']}) where project_key is not null)")}),
        ways as (select query_key, project_key, 0 as way, session_count::double as score from lexical union all select query_id, f.project_key, 1, relevance from found f join counts c on c.project_key = f.project_key where relevance >= {V.RELATED_FLOOR} and f.project_key <> query_id),
        one as (select query_key, project_key, way, score from ways qualify row_number() over (partition by query_key, project_key order by way, score desc) = 1),
        placed as (select *, row_number() over (partition by query_key order by way, score desc, project_key) as place from one qualify place <= {V.RELATED_MOST})
        select query_key, place::int as place, project_key, session_count, case way when 0 then 'name/path match' else printf('semantic match %.2f', score) end as why from placed join counts using (project_key)""",
    "graph_edges": f"{_BASE}, placed as ({_PLACED}) select 'project:' || project_key as source, 'session:' || session_id as target from placed",
    "graph_nodes": f"""{_BASE}, placed as ({_PLACED}), colour as (select project_key, row_number() over (order by project_key) - 1 as color_index from (select distinct project_key from placed)),
        nodes as (select 'project:' || project_key as id, 'project' as type, coalesce(max(pname), split_part(project_key, '/', -1)) as label, project_key, avg(x) * 0.72 as x, avg(y) * 0.72 as y, avg(z) * 0.72 as z, 6.0::double as size from placed group by project_key
        union all select 'session:' || session_id, 'session', coalesce(nullif(ai_title, ''), session_id[1:8]), project_key, x, y, z, 2.0 + least(4.0, event_count / 200.0::double) from placed)
        select id, type, label, project_key, color_index::int as color_index, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(z, 4) + 0.0 as z, round(size, 4) as size from nodes join colour using (project_key)""",
    "project_centroids": "select label, round(avg(embedding[1]::double), 6) + 0.0 as x, round(avg(embedding[2]::double), 6) + 0.0 as y, round(avg(embedding[3]::double), 6) + 0.0 as z, count(*) as n, max(vec_id) as last_id from embeddings group by 1",
    "fibonacci_sphere": "select agent_id, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(z, 4) + 0.0 as z from (" + _SCALED.format(_XYZ.format(_SPHERE.format("select agent_id, row_number() over (order by agent_id) - 1 as i, count(*) over () as n from agents")), "100.0") + ")",
    "agents_recent": "select agent_id, display_name, len(capabilities)::int as capabilities, epoch_us(last_seen_at) as last_seen_at_us from agents order by last_seen_at desc nulls last, agent_id limit 20",
}
