"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import redaction as R
from tidemark.functions import text as T
from tidemark.operators import indexing as I
from tidemark.session import table

EXTRA = r"hub_live_[A-Za-z0-9]{8,};;[unclosed"


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_events").select("event_id", T.estimate_tokens(F.col("content")).alias("tokens"))


def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_tokens(F.col("text"), 20).alias("text"))


def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("entry_id", F.posexplode(T.normalize_tags(F.col("tags"))).alias("place", "tag"))


def redact_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub's redaction chain, with a pattern of the operator's own, over all event contents."""
    c = F.col("content")
    return table(spark, sf_dir, "session_events").where(c.isNotNull()).select("event_id", R.redact(c, EXTRA).alias("content"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_events").select("event_id", R.redaction_count(F.col("content")).alias("redactions"))


def redact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a device sends them: contents and commands redacted, files as they are."""
    return table(spark, sf_dir, "session_events").select("event_id", R.redact(F.col("content")).alias("content"), F.array_join(F.transform("commands", lambda c: R.redact(c)), "\n").alias("commands"), F.array_join("files", "\n").alias("files"))


def scrub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("id", T.scrub(F.col("content")).alias("content"))


def project_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "session_upserts")
    return u.select("upsert_id", T.normalize_remote(F.col("git_remote")).alias("remote"), T.derive_project(F.col("cwd"), F.col("repo_root"), F.col("git_remote")).alias("derived"), T.display_name(F.col("project_key")).alias("name"))


def search_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "projects").select("project_key", T.search_seed(F.col("project_key")).alias("seed"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agents").select("agent_id", T.slugify(F.col("display_name")).alias("slug"), T.slugify(F.col("device_name")).alias("device"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.backoff_seconds(F.col("o_orderkey") % 12 + 1).alias("seconds"), ((F.col("o_orderkey") % 12 + 1) < 6).alias("due_again"))


def epoch_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message; null where the value is neither seconds nor milliseconds after 1970 (0 and less, 1e14 and more)."""
    t = F.col("timestamp")
    scaled = F.floor(F.unix_millis(T.epoch_autoscale(F.when((t > 0) & (t < 1e14), t))) / 1000).cast("double")
    return table(spark, sf_dir, "messages").select("id", scaled.alias("seconds"))


def collapse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_events").select("event_id", F.posexplode("commands").alias("i", "command")).select("event_id", "i", T.collapse(F.col("command"), 60).alias("command"))


def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entries").where("kind = 'decision'")
    return e.select("entry_id", T.decision_source_id(F.col("title")).alias("source_id"), F.md5(T.decision_content(F.col("content"), F.col("source_uri"), F.col("namespace"))).alias("content"))


def entry_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("entry_id", T.default_visibility(F.col("kind"), F.col("visibility"), F.col("recipient_id")).alias("shown"))


def prompt_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contents are machinery rather than prose."""
    c = F.col("content")
    return table(spark, sf_dir, "session_events").select("event_id", T.is_history_noise(c).alias("noise"), T.is_command_wrapper(c).alias("wrapper"))


def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("entry_id", T.html_escape(F.col("title")).alias("title"))


def denied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_upserts").select("upsert_id", T.path_denied(F.col("cwd"), ["/home/dev/export", "/SRV/work/anchor-ledger-2/"]).alias("denied"))


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each entry's content makes at its own sizes, and how long the longest is."""
    e = table(spark, sf_dir, "entries")
    c = I.paragraph_chunks(F.col("content"), F.coalesce("chunk_size", F.lit(900)).cast("int"), F.coalesce("overlap", F.lit(120)).cast("int"))
    return e.select("entry_id", c.alias("c")).select("entry_id", F.size("c").alias("chunks"), F.array_max(F.transform("c", F.length)).alias("longest"))


QUERIES = {f.__name__: f for f in (
    token_estimate, truncate_tokens, normalize_tags, redact_extra, redact_counts, redact_events, scrub_lines, project_keys, search_seed, slugs, backoff_schedule, epoch_autoscale, collapse_commands, decision_records, entry_visibility, prompt_noise,
    html_escaped, denied_paths, paragraph_chunks,
)}

# Patterns in the oracle's dialect, which has no look-around but needs none here. \b and \s are ASCII in both.
_q = lambda s: "'" + s.replace("'", "''") + "'"


def _redact_sql(expr: str, extra: str = "") -> str:
    out = expr
    for label, pattern in R.RULES:
        out = f"regexp_replace({out}, {_q(pattern)}, '[REDACTED:{label}]', 'g')"
    out = f"regexp_replace({out}, {_q(R.ASSIGNMENT)}, '\\1[REDACTED:credential]\\3', 'g')"
    for label, pattern in R.extra_rules(extra):
        out = f"regexp_replace({out}, {_q(pattern)}, '[REDACTED:{label}]', 'g')"
    return out


def _count_sql(expr: str) -> str:
    terms, out = [], expr
    for label, pattern in R.RULES:
        terms.append(f"len(regexp_extract_all({out}, {_q(pattern)}))")
        out = f"regexp_replace({out}, {_q(pattern)}, '[REDACTED:{label}]', 'g')"
    terms.append(f"len(regexp_extract_all({out}, {_q(R.ASSIGNMENT)}))")
    return " + ".join(terms)


_WS = "' \t\n\r\x0b\x0c'"
_GENERIC = ", ".join(_q(w) for w in T.GENERIC_NAME_PARTS)
_SCHEME = "regexp_matches(r, '^[A-Za-z][\\w+.-]*://.')"
_REST = f"regexp_replace(case when {_SCHEME} then regexp_replace(r, '^[^:]*://', '') else r end, '^[^@/]*[^@/]@', '')"
_MARK = f"case when {_SCHEME} then instr({_REST}, '/') else length(regexp_extract({_REST}, '^[^:/]*[:/]')) end"
_HOST = f"regexp_replace(substr({_REST}, 1, {_MARK} - 1), ':\\d*$', '')"
_PATH = f"trim(regexp_replace(rtrim(substr({_REST}, {_MARK} + 1), '/'), '\\.git$', ''), '/')"
_REMOTE = f"case when {_MARK} > 1 and {_HOST} <> '' and {_PATH} <> '' and not contains({_HOST}, ':') then lower({_HOST} || '/' || {_PATH}) end"
_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'device')"
_STRIPPED = "trim({0}, " + _WS + ")"
# Chunks of a text: paragraphs folded into {done, open}, long ones cut by windows. size and overlap are columns.
CHUNKS_OF = (
    "list_reduce(list_prepend({{'done': []::varchar[], 'open': ''}}, list_transform(list_filter(list_transform(regexp_split_to_array(" + _STRIPPED.format("coalesce({0}, '')") + ", '\\n\\s*\\n'), lambda q: " + _STRIPPED.format("q") + "), lambda q: q <> ''), "
    "lambda q: {{'done': []::varchar[], 'open': q}})), lambda a, b: case when length(case when a.open = '' then b.open else a.open || chr(10) || chr(10) || b.open end) <= size then {{'done': a.done, 'open': case when a.open = '' then b.open else a.open || chr(10) || chr(10) || b.open end}} "
    "when length(b.open) <= size then {{'done': case when a.open = '' then a.done else list_append(a.done, a.open) end, 'open': b.open}} "
    "else {{'done': list_concat(case when a.open = '' then a.done else list_append(a.done, a.open) end, list_transform(generate_series(0, greatest(0, ceil((length(b.open) - size) / greatest(size - overlap, 1)::double)::int)), lambda i: " + _STRIPPED.format("substr(b.open, (i * greatest(size - overlap, 1) + 1)::int, size)") + ")), 'open': ''}} end)"
)
ORACLES = {
    "token_estimate": "select event_id, (case when content is null or content = '' then 0 else greatest(1, length(content) // 4) end)::int as tokens from session_events",
    "truncate_tokens": "select doc_id, case when length(text) <= 80 then text else rtrim(text[1:77], ' ') || '...' end as text from documents",
    "normalize_tags": f"""with t as (select entry_id, lower(trim(x, {_WS})) as tag, min(i) as i from (select entry_id, unnest(tags) as x, generate_subscripts(tags, 1) as i from entries) where trim(x, {_WS}) <> '' group by 1, 2)
        select entry_id, (row_number() over (partition by entry_id order by i) - 1)::int as place, tag from t""",
    "redact_extra": f"select event_id, {_redact_sql('content', EXTRA)} as content from session_events where content is not null",
    "redact_counts": f"select event_id, coalesce({_count_sql('content')}, 0)::int as redactions from session_events",
    "redact_events": f"""select event_id, {_redact_sql('content')} as content, array_to_string(list_transform(commands, lambda c: {_redact_sql('c')}), chr(10)) as commands, array_to_string(files, chr(10)) as files from session_events""",
    "scrub_lines": f"""select id, trim(array_to_string(list_filter(regexp_split_to_array(coalesce(content, ''), '\r\n|\n|\r'), lambda x: not regexp_matches(x, {_q(T.CREDENTIAL_LINE)})), chr(10)), {_WS}) as content from messages""",
    "project_keys": f"""with u as (select *, trim(git_remote, {_WS}) as r from session_upserts)
        select upsert_id, {_REMOTE} as remote, coalesce(case when nullif(repo_root, '') is not null then coalesce({_REMOTE}, 'path:' || repo_root) end, 'path:' || nullif(cwd, ''), '__global__') as derived, split_part(project_key, '/', -1) as name from u""",
    "search_seed": f"""with b as (select project_key, list_filter(regexp_split_to_array(split_part(rtrim(replace(regexp_replace(project_key, '^path:', ''), '\\', '/'), '/'), '/', -1), '[-_.\\s]+'), lambda p: p <> '') as parts from projects)
        select project_key, array_to_string(case when len(list_filter(parts, lambda p: lower(p) not in ({_GENERIC}))) > 0 then list_filter(parts, lambda p: lower(p) not in ({_GENERIC})) else parts end, ' ') as seed from b""",
    "slugs": f"select agent_id, {_SLUG.format('display_name')} as slug, {_SLUG.format('device_name')} as device from agents",
    "backoff_schedule": "select o_orderkey, least(3600, 30 * pow(2, o_orderkey % 12))::bigint as seconds, o_orderkey % 12 + 1 < 6 as due_again from orders",
    "epoch_autoscale": "select id, case when timestamp > 0 and timestamp < 1e14 then floor(case when timestamp > 1e11 then floor(timestamp) / 1000 else timestamp end)::double end as seconds from messages",
    "collapse_commands": "select event_id, (i - 1)::int as i, trim(regexp_replace(c, '\\s+', ' ', 'g'), ' ')[1:60] as command from (select event_id, unnest(commands) as c, generate_subscripts(commands, 1) as i from session_events)",
    "decision_records": """select entry_id, 'decision:' || replace(lower(title), ' ', '-')[1:80] as source_id, md5(concat_ws(chr(10) || chr(10), content, case when source_uri <> '' then 'Rationale: ' || source_uri end, case when namespace <> '' then 'Supersedes: ' || namespace end)) as content
        from entries where kind = 'decision'""",
    "entry_visibility": "select entry_id, case when kind = 'message' then case when recipient_id is not null then 'direct' else 'broadcast' end else coalesce(visibility, 'shared') end as shown from entries",
    "prompt_noise": f"""with t as (select event_id, trim(coalesce(content, ''), {_WS}) as t, ltrim(coalesce(content, ''), ' ') as h from session_events)
        select event_id, t = '' or contains(t, 'password for ') or len(regexp_extract_all(t, '\\$ ')) > 3 or {" or ".join(f"starts_with(t, {_q(p)})" for p in T.HISTORY_PREFIXES)} as noise,
        {" or ".join(f"starts_with(h, {_q(p)})" for p in T.COMMAND_WRAPPERS)} as wrapper from t""",
    "html_escaped": """select entry_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as title from entries""",
    "denied_paths": """select upsert_id, coalesce(p = '/home/dev/export' or starts_with(p, '/home/dev/export/') or p = '/srv/work/anchor-ledger-2' or starts_with(p, '/srv/work/anchor-ledger-2/'), false) as denied
        from (select upsert_id, rtrim(replace(lower(cwd), '\\', '/'), '/') as p from session_upserts)""",
    "paragraph_chunks": f"""with f as (select entry_id, {CHUNKS_OF.format('content')} as f from (select entry_id, content, coalesce(chunk_size, 900) as size, coalesce(overlap, 120) as overlap from entries)),
        c as (select entry_id, case when f.open = '' then f.done else list_append(f.done, f.open) end as c from f) select entry_id, len(c)::int as chunks, list_max(list_transform(c, lambda x: length(x)))::int as longest from c""",
}
