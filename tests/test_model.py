import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import model as M
from tidemark.operators import views as V

T0 = dt.datetime(2026, 1, 1)
EVENT = "event_id string, session_id string, seq bigint, ts string, role string, kind string, content string, files array<string>, commands array<string>, is_sidechain boolean, received_at timestamp"
UPSERT = "upsert_id bigint, session_id string, project_key string, display_name string, repo_root string, git_remote string, agent_id string, device_name string, tool string, cwd string, git_branch string, ai_title string, last_prompt string, status string, is_sidechain boolean, started_at string, received_at timestamp"


def event(i, session="s", seq=0, kind="prompt", content="x", minute=0, files=(), commands=(), side=False, ts=None):
    return (i, session, seq, ts, "user", kind, content, list(files), list(commands), side, T0 + dt.timedelta(minutes=minute))


def upsert(i, minute=0, **k):
    base = {c.split()[0]: None for c in UPSERT.split(", ")} | {"upsert_id": i, "session_id": "s", "project_key": "p", "received_at": T0 + dt.timedelta(minutes=minute)}
    return tuple((base | k).values())


def test_events_insert_once(spark):
    rows = [event("a", seq=0, content="first"), event("b", seq=0, content="replay", minute=1), event("c", seq=1), event("d", session=None), event("e", seq=None)]
    df = spark.createDataFrame(rows, EVENT)
    kept = M.first_arrivals(df)
    assert {(r.seq, r.content) for r in kept.collect()} == {(0, "first"), (1, "x")} and kept.columns == df.columns
    assert M.new_events(kept, df).count() == 0  # applying twice adds nothing
    assert M.first_arrivals(kept).count() == kept.count()


def test_sessions_merge(spark):
    rows = [
        upsert(1, 0, tool="codex", status="closed", started_at="first", ai_title="A", is_sidechain=True), upsert(2, 1, tool="unknown", started_at="second", cwd="/w", project_key="q"), upsert(3, 2, ai_title="C", status=None, is_sidechain=False),
    ]
    s = M.merge_sessions(spark.createDataFrame(rows, UPSERT)).first()
    assert (s.tool, s.status, s.started_at, s.ai_title, s.cwd, s.is_sidechain, s.project_key) == ("codex", "active", "first", "C", "/w", True, "p")
    assert M.merge_sessions(spark.createDataFrame([], UPSERT)).count() == 0
    assert M.merge_sessions(spark.createDataFrame(rows + rows, UPSERT)).drop("records").first() == M.merge_sessions(spark.createDataFrame(rows, UPSERT)).drop("records").first()


def test_links_go_both_ways(spark):
    pairs = spark.createDataFrame([("a", "b", "n1", None, 1), ("a", "c", "n2", False, 2), ("b", "a", "n3", True, 3)], "project_key string, linked_project_key string, note string, bidirectional boolean, at int")
    assert {tuple(r) for r in M.link(pairs).collect()} == {("a", "b", "n3"), ("b", "a", "n3"), ("a", "c", "n2")}


def test_cascade_leaves_nothing_behind(spark):
    e = spark.createDataFrame([("1",), ("2",)], "entry_id string")
    c = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "ref string")
    left = M.cascade({"e": (e, "entry_id"), "c": (c, "ref")}, spark.createDataFrame([("1",)], "id string"))
    assert left["e"].count() == 1 and {r.ref for r in left["c"].collect()} == {"2", None}


def test_facts_and_summary(spark):
    rows = [event("a", seq=0, content=" do it "), event("b", seq=1, kind="tool_use", content="", files=["x", "y"], commands=["ls"]), event("c", seq=2, kind="reply", content="done"), event("d", seq=3, content="again", files=["y", "z"]), event("e", seq=4, content="side", side=True)]
    ev = spark.createDataFrame(rows, EVENT)
    f = V.session_facts(ev)
    r = f.first()
    assert (r.prompts, r.replies, r.first_prompt, r.last_prompt, r.files, r.commands) == (2, 1, "do it", "again", ["x", "y", "z"], ["ls"])
    s = spark.createDataFrame([("s", None, "codex", "main", 5)], "session_id string, ai_title string, tool string, git_branch string, event_count bigint")
    assert V.extractive_summary(s, f).first().summary == "do it. Opened with: do it Most recent request: again Files touched: x, y, z. Commands run: ls. 5 events on codex, branch main."


def test_transcript_drops_the_middle(spark):
    ev = spark.createDataFrame([event(str(i), seq=i, content="w" * 12) for i in range(40)], EVENT)
    parts = {p: sorted(r.seq for r in V.transcript(ev, 120).where(F.col("part") == p).collect()) for p in ("head", "tail", "all")}
    assert parts == {"head": [0, 1], "tail": [36, 37, 38, 39], "all": []}
    assert V.transcript(ev, 14000).where("part = 'all'").count() == 40


def test_brief_keeps_to_its_budget(spark):
    s = spark.createDataFrame([(f"s{i}", "p", "t", False, T0 + dt.timedelta(days=i)) for i in range(8)], "session_id string, project_key string, ai_title string, is_sidechain boolean, last_event_at timestamp")
    none = []
    sums = spark.createDataFrame([(f"s{i}", t, "word " * 100, none, none) for i in range(8) for t in ("rolling", "final")], "session_id string, tier string, summary string, decisions array<string>, open_threads array<string>")
    assert [r.session_id for r in V.brief_sessions(s, sums, 300).orderBy("place").collect()] == ["s7", "s6"]
    assert V.brief_sessions(s, sums, 100).count() == 1  # the first always


def test_related_projects(spark):
    p = spark.createDataFrame([("path:/w/tool",), ("path:/w/tool/sub",), ("git.example/x/tool-next",), ("path:/w/other",), ("path:/w/empty/tool",)], "project_key string")
    counts = spark.createDataFrame([("path:/w/tool/sub", 2), ("git.example/x/tool-next", 5), ("path:/w/other", 1), ("path:/w/tool", 1)], "project_key string, session_count bigint")
    by_name = V.related_by_name(p, counts, ["path:/w/tool"])
    assert {r.project_key for r in by_name.collect()} == {"path:/w/tool/sub", "git.example/x/tool-next"}
    meaning = spark.createDataFrame([("path:/w/tool", "path:/w/other", 0.8), ("path:/w/tool", "path:/w/tool/sub", 0.9), ("path:/w/tool", "path:/w/empty/tool", 0.9)], "query_key string, project_key string, score double")
    assert [(r.project_key, r.why) for r in V.merge_related(by_name, meaning, counts).orderBy("place").collect()] == [("git.example/x/tool-next", "name/path match"), ("path:/w/tool/sub", "name/path match"), ("path:/w/other", "semantic match 0.80")]


def test_graph(spark):
    s = spark.createDataFrame([(f"s{i}", "pq"[i % 2], None, None, i == 4, T0 + dt.timedelta(days=i), 100 * i) for i in range(5)], "session_id string, project_key string, display_name string, ai_title string, is_sidechain boolean, last_event_at timestamp, event_count bigint")
    nodes, edges = V.graph(s)
    assert nodes.count() == 6 and edges.count() == 4 and nodes.where("type = 'project'").count() == 2
    pos = spark.createDataFrame([(f"s{i}", float(i), 0.0, 1.0) for i in range(3)], "session_id string, x double, y double, z double")
    far = V.graph(s, pos)[0].where("id = 'session:s2'").first()
    assert far.x == 100.0


def test_principal_axes_match_a_direct_decomposition(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 2, 0.1, 0.1]
    got = V.principal_axes(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>"), "i", "v").orderBy("i").toPandas()[["x", "y", "z"]].to_numpy()
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
