"""Client transcripts (JSON lines) as sessions and events, parsed with VARIANT in the JVM.

Every parser gives sessions (session_id, tool, cwd, git_branch, ai_title, last_prompt, started_at, is_sidechain, file) and
events (session_id, seq, ts, role, kind, content, files, commands, is_sidechain, file). Lines that are blank or no JSON
object are skipped, bad bytes replaced, missing folders give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Record types without anything to keep, and tools by what they touch.
DROPPED = ("attachment", "file-history-snapshot", "mode", "permission-mode", "atis-latch", "bridge-session", "queue-operation", "ai-title-changed")
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit", "MultiEdit")
COMMAND_TOOLS = ("Bash", "BashOutput")
OPENING = ("user", "assistant", "system", "summary")
TEXT_BLOCKS = ("text", "Text", "input_text", "output_text")
COMMAND_CHARS, TARGET_CHARS = 400, 200
EVENT = "struct<role:string,kind:string,content:string,files:array<string>,commands:array<string>>"
_NONE = "array<string>"


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def given(v: Column | str, path: str) -> Column:
    """A text that is neither missing nor empty."""
    return F.nullif(get(v, path), F.lit(""))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """file, line (order within its file), record: the JSON objects of all files found."""
    try:
        raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path)
    except Exception as e:  # a folder that is not there has no transcripts
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, line bigint, record variant")
    # A file may be read in several splits; within one, rows come in order.
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value"))
    parsed = raw.where("trim(value) <> ''").withColumn("record", F.try_parse_json("value")).where(F.schema_of_variant("record").startswith("OBJECT"))
    return parsed.select("file", F.row_number().over(Window.partitionBy("file").orderBy("block", "id")).cast("bigint").alias("line"), "record")


def stem(file: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.url_decode(file), "/", -1), r"\.[^.]*$", "")


def event(role: str, kind: str, content: Column, files: Column | None = None, commands: Column | None = None) -> Column:
    none = F.array().cast(_NONE)
    return F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), content.alias("content"), F.coalesce(files, none).alias("files") if files is not None else none.alias("files"), F.coalesce(commands, none).alias("commands") if commands is not None else none.alias("commands"))


def no_event() -> Column:
    return F.lit(None).cast(EVENT)


def command_event(command: Column) -> Column:
    c = T.collapse(command, COMMAND_CHARS)
    return F.when(F.coalesce(c, F.lit("")) != "", event("assistant", "tool_use", F.concat(F.lit("$ "), c), commands=F.array(c))).otherwise(no_event())


def tool_event(name: Column, input_: Column) -> Column:
    """What is kept of a tool call: files touched, commands run, or a line that names it; null if nothing is."""
    path, command = F.coalesce(given(input_, "$.file_path"), given(input_, "$.notebook_path")), given(input_, "$.command")
    target, task = F.coalesce(given(input_, "$.url"), given(input_, "$.query")), F.coalesce(given(input_, "$.description"), given(input_, "$.subagent_type"))
    fact = lambda test, content, files=None: F.when(test, event("assistant", "tool_use", content, files)).otherwise(no_event())
    return (
        F.when(name.isin(*FILE_TOOLS), fact(path.isNotNull(), F.concat(name, F.lit(" "), path), F.array(path)))
        .when(name.isin(*COMMAND_TOOLS), command_event(command))
        .when(name.isin("WebFetch", "WebSearch"), fact(target.isNotNull(), F.concat(name, F.lit(": "), F.substring(target, 1, TARGET_CHARS))))
        .when(name == "Agent", fact(task.isNotNull(), F.concat(F.lit("Delegated to sub-agent: "), F.substring(task, 1, TARGET_CHARS))))
        .otherwise(event("assistant", "tool_use", F.concat(name, F.lit(" called"))))
    )


def block_text(blocks: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """The text blocks of an array of content blocks, trimmed, one a line."""
    texts = F.transform(F.filter(blocks, lambda b: get(b, "$.type").isin(*kinds)), lambda b: T.strip(F.coalesce(get(b, "$.text"), F.lit(""))))
    return T.strip(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))


def content_text(record: Column | str, path: str, kinds: tuple[str, ...] = ("text",)) -> Column:
    """A content that is a text or an array of blocks, as text."""
    blocks = get(record, path, "array<variant>")
    return F.when(blocks.isNotNull(), block_text(blocks, kinds)).otherwise(T.strip(F.coalesce(get(record, path), F.lit(""))))


def _numbered(events: DataFrame) -> DataFrame:
    """Kept events counted from 0 in each file."""
    each = events.select("file", "line", "ts", "side", F.posexplode("events").alias("i", "e"))
    seq = F.row_number().over(Window.partitionBy("file").orderBy("line", "i")) - 1
    return each.select("file", "line", seq.cast("bigint").alias("seq"), "ts", "e.*", F.col("side").alias("is_sidechain"))


def session_transcripts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts with one record a line, whose messages hold blocks of text and tool calls."""
    r = lines.withColumn("type", get("record", "$.type")).where(~F.coalesce(F.col("type").isin(*DROPPED), F.lit(False)))
    r = r.withColumns({"side": F.coalesce(get("record", "$.isSidechain", "boolean"), F.lit(False)), "ts": get("record", "$.timestamp")})
    prompt = content_text("record", "$.message.content")
    is_prompt = (F.col("type") == "user") & ~F.coalesce(get("record", "$.isMeta", "boolean"), F.lit(False)) & (prompt != "") & ~T.is_command_wrapper(prompt)
    blocks = F.coalesce(get("record", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    tools = F.filter(F.transform(F.filter(blocks, lambda b: get(b, "$.type") == "tool_use"), lambda b: tool_event(F.coalesce(get(b, "$.name"), F.lit("tool")), get(b, "$.input", "variant"))), lambda e: e.isNotNull())
    reply = F.when(prompt != "", F.array(event("assistant", "reply", prompt))).otherwise(F.array().cast(f"array<{EVENT}>"))
    r = r.withColumn("events", F.when(is_prompt, F.array(event("user", "prompt", prompt))).when(F.col("type") == "assistant", F.concat(reply, tools)))
    r = r.withColumn("prompt", F.when(is_prompt & ~F.col("side"), prompt))
    opened = F.min(F.when(F.col("type").isin(*OPENING), F.col("line"))).over(Window.partitionBy("file"))
    r = r.withColumn("opened", opened)
    since = r.where("line >= opened")
    first = lambda c, order="line": F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    at_open = lambda c: F.max(F.when(F.col("line") == F.col("opened"), c))
    asked = F.coalesce(F.when(F.col("type") == "last-prompt", given("record", "$.lastPrompt")), F.col("prompt"))
    sessions = since.groupBy("file").agg(
        F.coalesce(at_open(given("record", "$.sessionId")), stem(F.col("file"))).alias("session_id"), F.lit("claude-code").alias("tool"), first(given("record", "$.cwd")).alias("cwd"), first(given("record", "$.gitBranch")).alias("git_branch"),
        last(F.when(F.col("type") == "ai-title", given("record", "$.aiTitle"))).alias("ai_title"), last(asked).alias("last_prompt"), at_open(F.col("ts")).alias("started_at"), F.coalesce(at_open(F.col("side")), F.lit(False)).alias("is_sidechain"),
    )
    events = _numbered(r.where("events is not null")).join(sessions.select("file", "session_id"), "file")
    return sessions, events.drop("line")


def rollout_transcripts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollouts, whose event messages are flat or wrapped in completed items."""
    r = lines.withColumns({"type": get("record", "$.type"), "p": get("record", "$.payload", "variant"), "ts": get("record", "$.timestamp")}).where(F.col("p").isNotNull())
    kind = get("p", "$.type")
    wrapped = kind == "item_completed"
    item = F.when(wrapped, get("p", "$.item", "variant")).otherwise(F.col("p"))
    name = get(item, "$.type")
    said = F.when(wrapped, content_text(item, "$.content", TEXT_BLOCKS)).otherwise(T.strip(F.coalesce(get(item, "$.message"), F.lit(""))))
    parts = get(item, "$.command", "array<string>")
    command = F.when(parts.isNotNull(), F.array_join(parts, " ")).otherwise(get(item, "$.command"))
    files = F.map_keys(get(item, "$.changes", "map<string,variant>"))
    query = F.coalesce(given(item, "$.query"), given(item, "$.action.query"))
    server = F.when(wrapped, get(item, "$.server")).otherwise(get(item, "$.invocation.server"))
    call = F.when(wrapped, get(item, "$.tool")).otherwise(get(item, "$.invocation.tool"))
    is_ = lambda flat, item_: F.coalesce((~wrapped & (name == flat)) | (wrapped & (name == item_)), F.lit(False))
    e = (
        F.when(is_("user_message", "UserMessage") & (said != "") & ~T.is_rollout_wrapper(said), event("user", "prompt", said))
        .when(is_("agent_message", "AgentMessage") & (said != ""), event("assistant", "reply", said))
        .when(is_("exec_command_end", "CommandExecution"), command_event(command))
        .when(is_("patch_apply_end", "FileChange") & (F.size(files) > 0), event("assistant", "tool_use", F.concat(F.lit("Edited: "), F.array_join(F.slice(files, 1, 8), ", ")), files))
        .when(is_("web_search_end", "Extension") & query.isNotNull(), event("assistant", "tool_use", F.concat(F.lit("web.search: "), F.substring(query, 1, TARGET_CHARS))))
        .when(is_("mcp_tool_call_end", "McpToolCall"), event("assistant", "tool_use", F.concat(F.lit("MCP "), F.coalesce(server, F.lit("mcp")), F.lit("."), F.coalesce(call, F.lit("call")))))
    )
    r = r.withColumn("e", F.when(F.col("type") == "event_msg", e)).withColumn("side", F.lit(False))
    meta = F.when(F.col("type") == "session_meta", F.col("line"))
    opened = F.min(meta).over(Window.partitionBy("file"))
    r = r.withColumn("opened", opened)
    here = F.col("type") == "session_meta"
    cwd = T.strip_file_uri(F.when(here | ((F.col("type") == "turn_context") & (F.col("line") > F.col("opened"))), given("p", "$.cwd")))
    asked = F.when((F.col("e.kind") == "prompt") & (F.col("line") > F.col("opened")), F.col("e.content"))
    sessions = r.groupBy("file").agg(
        F.coalesce(F.max_by(F.coalesce(given("p", "$.id"), given("p", "$.session_id")), meta), stem(F.col("file"))).alias("session_id"), F.lit("codex").alias("tool"), F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line"))).alias("cwd"), F.lit(None).cast("string").alias("git_branch"),
        F.lit(None).cast("string").alias("ai_title"), F.max_by(asked, F.when(asked.isNotNull(), F.col("line"))).alias("last_prompt"), F.max_by(F.coalesce(given("p", "$.timestamp"), F.col("ts")), meta).alias("started_at"), F.lit(False).alias("is_sidechain"),
    )
    events = _numbered(r.where("e is not null").withColumn("events", F.array("e"))).join(sessions.select("file", "session_id"), "file")
    return sessions, events.drop("line")


def fold_subagents(events: DataFrame) -> DataFrame:
    """Events of sub-agent files as side chain of the session their folder belongs to, each file in a million numbers of its own.

    Where a file's numbers begin follows from its name alone, so files that appear later renumber none. Of a session's n
    files two begin at one number with a chance of n * n / 2^41.
    """
    parts = F.split(F.url_decode("file"), "/")
    parent = F.element_at(parts, -3)
    named = events.withColumn("parent", parent).withColumn("leaf", F.element_at(parts, -1)).withColumn("base", (F.pmod(F.xxhash64("leaf"), F.lit(1 << 40)) + 1) * 1_000_000)
    return named.select(*[F.col("parent").alias("session_id") if c == "session_id" else (F.col("seq") + F.col("base")).alias("seq") if c == "seq" else F.lit(True).alias(c) if c == "is_sidechain" else F.col(c) for c in events.columns])


def prompt_history(lines: DataFrame, tool: str) -> tuple[DataFrame, DataFrame]:
    """Sessions known from a log of prompts only. tool: claude-code (display, project, milliseconds) or codex (text, seconds)."""
    id_, text = ("$.sessionId", "$.display") if tool == "claude-code" else ("$.session_id", "$.text")
    stamp = F.coalesce(get("record", "$.timestamp", "double"), get("record", "$.ts", "double"))
    r = lines.select("file", "line", given("record", id_).alias("session_id"), get("record", text).alias("text"), given("record", "$.project").alias("project"), F.date_format(T.epoch_autoscale(stamp), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"))
    r = r.where(F.col("session_id").isNotNull() & F.col("text").isNotNull() & ~T.is_history_noise(F.col("text"))).withColumn("content", T.strip(F.col("text")))
    at = F.struct("file", "line")
    sessions = r.groupBy("session_id").agg(
        F.lit(tool).alias("tool"), F.max_by("project", F.when(F.col("project").isNotNull(), at)).alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.substring(F.min_by("content", at), 1, 80).alias("ai_title"),
        F.max_by("content", at).alias("last_prompt"), F.min_by("ts", F.when(F.col("ts").isNotNull(), at)).alias("started_at"), F.lit(False).alias("is_sidechain"),
    )
    none = F.array().cast(_NONE)
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("file", "line")) - 1
    events = r.select("session_id", seq.cast("bigint").alias("seq"), "ts", F.lit("user").alias("role"), F.lit("prompt").alias("kind"), "content", none.alias("files"), none.alias("commands"), F.lit(False).alias("is_sidechain"))
    return sessions, events


def orphans(sessions: DataFrame, events: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and events of a history whose transcript is gone."""
    have = on_disk.select("session_id").distinct()
    return sessions.join(have, "session_id", "left_anti"), events.join(have, "session_id", "left_anti")


def past_checkpoint(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Events beyond what was sent of their session. checkpoints: session_id, last_seq."""
    return events.join(checkpoints.groupBy("session_id").agg(F.max("last_seq").alias("last_seq")), "session_id", "left").where("seq > coalesce(last_seq, -1)").drop("last_seq")
