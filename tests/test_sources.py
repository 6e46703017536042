import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store, tail, transcripts
from tidemark.streaming import ingest


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def rows(df):
    return [r.asDict() for r in df.orderBy("session_id", "seq").collect()]


def test_session_transcript(spark, tmp_path):
    write(tmp_path / "proj" / "abc.jsonl", [
        {"type": "mode", "sessionId": "no"}, "", "{broken", "[1]",
        {"type": "user", "sessionId": "abc", "timestamp": "t1", "gitBranch": "main", "message": {"content": "fix it"}},
        {"type": "ai-title", "aiTitle": "Fixing"},
        {"type": "assistant", "cwd": "/w", "timestamp": "t2", "message": {"content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": " sure "}, {"type": "text", "text": "now"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/a.py"}},
            {"type": "tool_use", "name": "Bash", "input": {"command": "ls   -la\n"}}, {"type": "tool_use", "name": "Read", "input": {}}, {"type": "tool_use", "name": "Odd", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "big"}]}},
        {"type": "user", "message": {"content": "<command-name>/x</command-name>"}}, {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "isSidechain": True, "message": {"content": [{"type": "text", "text": "side"}]}},
    ])
    sessions, events = transcripts.session_transcripts(transcripts.read_lines(spark, str(tmp_path)))
    s = sessions.first()
    assert (s.session_id, s.cwd, s.git_branch, s.ai_title, s.last_prompt, s.started_at) == ("abc", "/w", "main", "Fixing", "fix it", "t1")
    got = rows(events)
    assert [(r["seq"], r["kind"], r["content"], r["is_sidechain"]) for r in got] == [
        (0, "prompt", "fix it", False), (1, "reply", "sure\nnow", False), (2, "tool_use", "Edit /w/a.py", False), (3, "tool_use", "$ ls -la", False), (4, "tool_use", "Odd called", False), (5, "prompt", "side", True),
    ]
    assert got[2]["files"] == ["/w/a.py"] and got[3]["commands"] == ["ls -la"]
    left = transcripts.past_checkpoint(events, spark.createDataFrame([("abc", 3)], "session_id string, last_seq bigint"))
    assert sorted(r.seq for r in left.collect()) == [4, 5]


def test_rollouts_in_both_schemas(spark, tmp_path):
    flat = [
        {"type": "session_meta", "timestamp": "t0", "payload": {"id": "r1", "cwd": "file:///w"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "<environment_context> x"}},
        {"type": "event_msg", "timestamp": "t1", "payload": {"type": "user_message", "message": "go"}}, {"type": "event_msg", "payload": {"type": "exec_command_end", "command": ["git", "status"]}},
        {"type": "event_msg", "payload": {"type": "patch_apply_end", "changes": {"a.py": {}, "b.py": {}}}}, {"type": "event_msg", "payload": {"type": "mcp_tool_call_end", "invocation": {"server": "hub", "tool": "find"}}}, {"type": "event_msg", "payload": {"type": "token_count"}},
    ]
    item = lambda **k: {"type": "event_msg", "payload": {"type": "item_completed", "item": k}}
    wrapped = [item(type="UserMessage", content=[{"type": "text", "text": "hello"}]), item(type="AgentMessage", content="hi"), item(type="CommandExecution", command="ls"), item(type="Extension", action={"query": "q"}), item(type="McpToolCall", server="s")]
    write(tmp_path / "d" / "rollout-1.jsonl", flat)
    write(tmp_path / "d" / "e" / "rollout-2.jsonl", wrapped)
    write(tmp_path / "d" / "other.jsonl", wrapped)
    sessions, events = transcripts.rollout_transcripts(transcripts.read_lines(spark, str(tmp_path), "rollout-*.jsonl"))
    assert {(s.session_id, s.cwd, s.last_prompt) for s in sessions.collect()} == {("r1", "/w", "go"), ("rollout-2", None, None)}
    by = {k: [r["content"] for r in rows(events) if r["session_id"] == k] for k in ("r1", "rollout-2")}
    assert by == {"r1": ["go", "$ git status", "Edited: a.py, b.py", "MCP hub.find"], "rollout-2": ["hello", "hi", "$ ls", "web.search: q", "MCP s.call"]}


def test_subagents_fold_into_their_session(spark, tmp_path):
    for n in ("agent-b", "agent-a"):
        write(tmp_path / "p" / "parent" / "subagents" / f"{n}.jsonl", [{"type": "user", "sessionId": n, "message": {"content": n}}, {"type": "assistant", "message": {"content": "ok"}}])
    _, events = transcripts.session_transcripts(transcripts.read_lines(spark, str(tmp_path)))
    got = rows(transcripts.fold_subagents(events))
    first = {r["content"]: r["seq"] for r in got if r["content"] != "ok"}
    assert {(r["session_id"], r["content"], r["is_sidechain"]) for r in got} == {("parent", "agent-a", True), ("parent", "agent-b", True), ("parent", "ok", True)}
    assert len({n // 1_000_000 for n in first.values()}) == 2 and {r["seq"] for r in got if r["content"] == "ok"} == {n + 1 for n in first.values()} and min(first.values()) >= 1_000_000
    # A file that sorts before the others and comes later renumbers none of them.
    write(tmp_path / "p" / "parent" / "subagents" / "agent-0.jsonl", [{"type": "user", "sessionId": "agent-0", "message": {"content": "agent-0"}}])
    _, events = transcripts.session_transcripts(transcripts.read_lines(spark, str(tmp_path)))
    assert first.items() <= {r["content"]: r["seq"] for r in rows(transcripts.fold_subagents(events))}.items()


def test_history_recovers_orphans(spark, tmp_path):
    write(tmp_path / "history.jsonl", [
        {"sessionId": "gone", "project": "/w", "timestamp": 1751371200000, "display": "first"}, {"sessionId": "gone", "timestamp": 1751371260000, "display": "/clear"}, {"sessionId": "gone", "display": " second "},
        {"sessionId": "here", "display": "kept"}, {"sessionId": "x", "display": "[Pasted text]"}, {"display": "no id"},
    ])
    sessions, events = transcripts.prompt_history(transcripts.read_lines(spark, str(tmp_path), "history.jsonl"), "claude-code")
    s, e = transcripts.orphans(sessions, events, spark.createDataFrame([("here",)], "session_id string"))
    assert [(r.session_id, r.cwd, r.ai_title, r.last_prompt) for r in s.collect()] == [("gone", "/w", "first", "second")]
    assert [r["content"] for r in rows(e)] == ["first", "second"]


def test_missing_folder(spark, tmp_path):
    assert transcripts.read_lines(spark, str(tmp_path / "none")).count() == 0


CALLS = json.dumps([{"function": {"name": "write_file", "arguments": json.dumps({"path": "C:/Users/me/code/app/x.py"})}}, {"function": {"name": "terminal", "arguments": {"command": "cd C:\\Users\\me\\code\\app && make"}}}, {"function": {"name": "", "arguments": "oops"}}])
MESSAGES = [
    (1, "s", "user", "do it", None, 1751371200.0, 0), (2, "s", "assistant", "ok\nAPI_TOKEN=abc", CALLS, 1751371201.0, None), (3, "s", "tool", "output", None, None, 0), (4, "s", "user", "recap", None, None, 1),
    (5, "s", "assistant", "MY_SECRET = x", None, None, 0), (6, "s", "assistant", '[{"type": "text", "text": "blocks"}]', "not json", None, 0), (7, "s", None, None, None, None, None),
]
COLUMNS = "id bigint, session_id string, role string, content string, tool_calls string, timestamp double, _compressed_summary int"


def test_store_events(spark):
    got = rows(store.store_events(spark.createDataFrame(MESSAGES, COLUMNS)))
    assert [(r["session_id"], r["seq"], r["content"]) for r in got] == [("hermes-s", 10, "do it"), ("hermes-s", 20, "ok"), ("hermes-s", 21, "write_file C:/Users/me/code/app/x.py"), ("hermes-s", 22, "$ cd C:\\Users\\me\\code\\app && make"), ("hermes-s", 60, "blocks")]
    roots = spark.createDataFrame([("C:/Users/me/code/app",), ("C:/Users/me/other",)], "repo_root string")
    assert [tuple(r) for r in store.repository_votes(spark.createDataFrame(MESSAGES, COLUMNS), roots).collect()] == [("s", "C:/Users/me/code/app")]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "state.db")
    with sqlite3.connect(path) as db:
        db.execute("create table messages (id integer primary key, session_id text, role text, content text, tool_calls text, timestamp real, _compressed_summary int)")
        db.executemany("insert into messages values (?, ?, ?, ?, ?, ?, ?)", MESSAGES)
    df = store.read_sqlite(spark, path, "messages", COLUMNS)
    assert df.count() == len(MESSAGES) and store.newest_message(df).first().last_id == 7
    with pytest.raises(Exception):
        store.read_sqlite(spark, path, "messages; drop table messages", COLUMNS).count()


def test_store_events_of_the_test_tables(spark, data):
    events = store.store_events(spark.read.parquet(f"{data}/messages.parquet"))
    assert events.count() > 0 and events.where(F.col("content").isNull() | (F.col("content") == "")).count() == 0
    assert events.groupBy("session_id", "seq").count().where("count > 1").count() == 0


def test_transcripts_are_tailed_as_they_grow(spark, tmp_path):
    """Files that did not grow are not parsed again, a longer one is parsed whole, and each event is stored once."""
    folder, log = tmp_path / "in", str(tmp_path / "log")
    line = lambda s, t: {"type": "user", "sessionId": s, "timestamp": "2026-01-01T00:00:00Z", "message": {"content": t}}
    parsed = []

    def sink(sessions, events):
        parsed.append(sorted({r.session_id for r in events.select("session_id").distinct().collect()}))
        rows = events.withColumns({"event_id": F.concat_ws("-", "session_id", "seq"), "received_at": F.to_timestamp(F.lit("2026-01-02"))})
        ingest.append_new(rows.select("event_id", "session_id", "seq", "ts", "role", "kind", "content", "files", "commands", "is_sidechain", "received_at"), log)

    def follow():
        tail.tail_transcripts(tail.grown_files(spark, str(folder)), str(folder), transcripts.session_transcripts, sink, str(tmp_path / "cp")).awaitTermination()

    write(folder / "a.jsonl", [line("a", "one")])
    write(folder / "b.jsonl", [line("b", "two")])
    follow()
    write(folder / "a.jsonl", [line("a", "one"), line("a", "three")])
    follow()
    follow()
    assert parsed == [["a", "b"], ["a"]]
    assert sorted((r.session_id, r.content) for r in spark.read.parquet(log).collect()) == [("a", "one"), ("a", "three"), ("b", "two")]


def test_the_store_is_tailed_by_its_newest_row(spark, tmp_path):
    path = str(tmp_path / "s.db")
    db = sqlite3.connect(path)
    db.execute("create table messages (id integer primary key, content text)")
    seen = []

    def follow():
        stream = tail.grown_store(spark, path, "messages", "id bigint, content string")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: seen.append(sorted(r.content for r in df.collect()))).trigger(availableNow=True).start().awaitTermination()

    for batch in (["x", "y"], ["z"]):
        db.executemany("insert into messages (content) values (?)", [(c,) for c in batch])
        db.commit()
        follow()
    assert [b for b in seen if b] == [["x", "y"], ["z"]]
