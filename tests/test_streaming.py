import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_model import EVENT, event
from tidemark.operators import model as M
from tidemark.streaming import ingest as G
from tidemark.streaming import spool as P


def files(spark, path, batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, EVENT).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [event(f"a{i}", seq=i, minute=i) for i in range(5)]
    files(spark, src, [first, [event(f"b{i}", seq=i, minute=90 + i) for i in range(3, 8)]])
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        q = G.ingest(G.event_stream(spark, src, schema, 1), out, str(tmp_path / "cp"))
        q.awaitTermination()
    stored = spark.read.parquet(out)
    assert {(r.seq, r.event_id[0]) for r in stored.collect()} == {(i, "a") for i in range(5)} | {(i, "b") for i in range(5, 8)}
    assert {(r.session_id, r.seq) for r in M.first_arrivals(spark.read.parquet(src)).collect()} == {(r.session_id, r.seq) for r in stored.collect()}
    G.append_new(spark.read.parquet(src), out)
    assert spark.read.parquet(out).count() == 8
    # A row months late is taken, and the newest time does not go back.
    before = M.session_rollup(spark.read.parquet(out)).first().last_event_at
    G.append_new(spark.createDataFrame([event("late", seq=99, minute=-200000)], EVENT), out)
    after = M.session_rollup(spark.read.parquet(out)).first()
    assert after.event_count == 9 and after.last_event_at == before


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_log_is_found_by_its_file_system(spark, tmp_path, scheme):
    out = f"{scheme}{tmp_path}/log"
    rows = spark.createDataFrame([event(f"a{i}", session=f"s{i % 7}", seq=i) for i in range(40)], EVENT)
    assert G.event_log(spark, out, rows.schema).count() == 0
    for _ in range(2):
        G.append_new(rows, out)
    G.append_new(spark.createDataFrame([event("new", session="s0", seq=99), event("old", session="s1", seq=1)], EVENT), out)
    stored = G.event_log(spark, out, rows.schema)
    assert stored.columns == rows.columns and sorted(r.event_id for r in stored.collect()) == sorted([f"a{i}" for i in range(40)] + ["new"])


class State:
    """What a session's state is to its step, without a stream."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_states_rest_and_reopen():
    import pandas as pd

    state = State()
    step = lambda *seqs: next(G.next_state(("s",), iter([pd.DataFrame({"seq": list(seqs), "at_us": [10 * n for n in seqs]})] if seqs else []), state, 4)).iloc[0]
    r = step(0, 1, 1)
    assert (r.status, r.event_count, r.rolling_due, r.reopened) == ("active", 2, False, False) and state.timeout == G.IDLE_MS
    assert step(2, 3).rolling_due and state.get[1] == 0
    state.hasTimedOut = True
    r = step()
    assert (r.status, r.final_due, r.event_count) == ("idle", True, 4)
    state.hasTimedOut = False
    r = step(4)
    assert (r.status, r.reopened, r.final_due, r.event_count, r.last_event_us) == ("active", True, False, 5, 40)


def test_spool(spark):
    out = spark.createDataFrame([(i, f"s{i % 2}", i, 100 + i, i < 6) for i in range(10)], "id bigint, session_id string, seq bigint, created_at bigint, delivered boolean")
    marks = spark.createDataFrame([(5,), (None,), (9,)], "updated_at bigint")
    assert tuple(P.backlog(out, marks).first()) == (4, 106, 2, 9) and tuple(P.backlog(out.limit(0), marks.limit(0)).first()) == (0, None, 0, None)
    assert [r.id for r in P.next_batch(out, 2).collect()] == [6, 7]
    done = P.acknowledge(out, spark.createDataFrame([(6,), (6,), (77,)], "id bigint"))
    assert sorted(r.id for r in done.where("delivered").collect()) == list(range(7)) and done.count() == 10
    assert sorted(r.id for r in P.prune(done, 2).collect()) == [5, 6, 7, 8, 9]
    assert P.prune(out.where("not delivered"), 2).count() == 4


def test_a_cycle_summarises_embeds_and_sweeps(spark, data):
    from tidemark.operators import indexing as I
    from tidemark.plans import stored as D
    from tidemark.streaming import cycle as Y

    sessions, events = D.sessions(spark, data), D.events(spark, data)
    empty = lambda ddl: spark.createDataFrame([], ddl)
    entries = I.chunk_entries(D.entries(spark, data)).limit(3)
    store = Y.Store(
        sessions, events, empty("session_id string, tier string, summary string, decisions array<string>, open_threads array<string>, files array<string>, model string, event_count bigint, generated_at timestamp"),
        entries, empty("chunk_id string, enqueued_at timestamp, attempts int, next_attempt_at timestamp"), empty("chunk_id string, project_key string, embedding array<float>"),
    )
    after = Y.run_cycle(store, D.as_of(), lambda c: G.hash_embedding(c), keep_days=100)
    rest = {r.session_id: r for r in G.idle(sessions, D.as_of()).collect() if r.event_count}
    due = {s for s, r in rest.items() if r.status in ("idle", "closed") or r.event_count >= G.SUMMARY_EVERY}
    told = {r.session_id: r.tier for r in after.summaries.collect()}
    assert told.keys() == due and all((t == "final") == (rest[s].status != "active") for s, t in told.items())
    assert after.chunks.count() == 3 + len(due) and after.queue.count() == 0 and after.vectors.count() == len(due)
    assert after.events.count() < events.count()
    assert Y.due_summaries(after.sessions, after.summaries).count() == 0


def test_settings_fall_back():
    from tidemark.config import settings

    s = settings({"TIDEMARK_BRIEF_TOKENS": "900", "TIDEMARK_SUMMARY_EVERY": "many", "TIDEMARK_MIN_SCORE": " ", "TIDEMARK_HALF_LIFE_DAYS": "7", "TIDEMARK_REDACT": "off", "TIDEMARK_EMBEDDER_OPTIONS": "[1]", "TIDEMARK_SUMMARY_MODEL": "m"})
    assert (s.brief_tokens, s.summary_every, s.min_score, s.half_life_days, s.redact, s.embedder_options, s.summary_model) == (900, 25, 0.12, 7.0, False, None, "m")
    assert settings({"TIDEMARK_EMBEDDER_OPTIONS": '{"a": 1}'}).embedder_options == {"a": 1}


def test_rollup_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    files(spark, src, [[event(f"a{i}", session=f"s{i % 2}", seq=i) for i in range(6)]])
    schema = spark.read.parquet(src).schema
    q = G.rollup_stream(G.event_stream(spark, src, schema)).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, M.session_rollup(spark.read.parquet(src)).collect()))


def test_states_tell_when_a_summary_is_due(spark, tmp_path):
    src = str(tmp_path / "in")
    files(spark, src, [[event(f"a{i}", seq=i) for i in range(3)]])
    files(spark, src, [[event(f"b{i}", seq=i) for i in range(3, 6)]])
    schema = spark.read.parquet(src).schema
    seen = []
    q = G.session_states(G.event_stream(spark, src, schema, 1), every=4, timer=False).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r.event_count, r.rolling_due) for r in sorted(seen, key=lambda r: r.event_count)] == [(3, False), (6, True)]


def test_idle(spark):
    now = dt.datetime(2026, 1, 1, 12)
    s = spark.createDataFrame([("a", "active", now - dt.timedelta(minutes=31)), ("b", "active", now - dt.timedelta(minutes=30)), ("c", "closed", now - dt.timedelta(days=1)), ("d", "active", None)], "session_id string, status string, last_event_at timestamp")
    assert {r.session_id: r.status for r in G.idle(s, F.lit(now)).collect()} == {"a": "idle", "b": "active", "c": "closed", "d": "active"}


def test_delivery(spark, tmp_path):
    box = str(tmp_path)
    rows = spark.createDataFrame([event(str(i), session=f"s{i % 3}", seq=i) for i in range(25)], EVENT)

    def send(session, events):
        import uuid

        with open(f"{box}/{uuid.uuid4()}", "w") as f:
            f.write(f"{session} {len(events)}")

    assert G.deliver(rows, send, 4)["delivered"] == 25
    sent = [p.read_text().split() for p in tmp_path.iterdir()]
    assert sum(int(n) for _, n in sent) == 25 and max(int(n) for _, n in sent) <= 4


def test_queue(spark):
    now = dt.datetime(2026, 1, 1)
    queue = spark.createDataFrame([("ok", now, 0, now), ("bad", now, 1, now), ("wide", now, 0, now), ("later", now, 0, now + dt.timedelta(hours=1)), ("spent", now, 6, now)], "chunk_id string, enqueued_at timestamp, attempts int, next_attempt_at timestamp")
    chunks = spark.createDataFrame([(c, "p", c) for c in ("ok", "bad", "wide", "later", "spent")], "chunk_id string, project_key string, content string")
    embed = lambda c: F.when(c == "ok", G.hash_embedding(c, 4)).when(c == "wide", G.hash_embedding(c, 5))
    vectors, rest = G.drain(queue, chunks, embed, F.lit(now), width=4)
    assert [r.chunk_id for r in vectors.collect()] == ["ok"]
    left = {r.chunk_id: (r.attempts, r.next_attempt_at) for r in rest.collect()}
    assert left.keys() == {"bad", "wide", "later", "spent"} and left["bad"] == (2, now + dt.timedelta(seconds=60)) and left["wide"][0] == 6 and left["later"][0] == 0


def test_one_round_without_a_batch_is_all_rounds(spark):
    now = dt.datetime(2026, 1, 1)
    queue = spark.createDataFrame([(f"c{i}", now - dt.timedelta(minutes=i % 3), i % 7, now) for i in range(14)] + [("late", now, 0, now + dt.timedelta(seconds=1))], "chunk_id string, enqueued_at timestamp, attempts int, next_attempt_at timestamp")
    chunks = queue.select("chunk_id", F.lit("p").alias("project_key"), F.col("chunk_id").alias("content"))
    embed = lambda c: F.when(c == "c1", F.lit(None)).when(c == "c2", G.hash_embedding(c, 5)).otherwise(G.hash_embedding(c, 4))
    vectors, rest = G.drain(queue, chunks, embed, F.lit(now), 4, None)
    kept, left = set(), spark.createDataFrame(queue.collect(), queue.schema)
    while G.due(left, F.lit(now)).count():
        v, left = G.drain(left, chunks, embed, F.lit(now), 4, 5)
        kept |= {r.chunk_id for r in v.collect()}
        left = spark.createDataFrame(left.collect(), queue.schema)
    assert {r.chunk_id for r in vectors.collect()} == kept and len(kept) == 10
    assert sorted(map(tuple, rest.select(queue.columns).collect())) == sorted(map(tuple, left.collect()))


def test_drained_vectors_by_brute_force(spark, data):
    from collections import Counter

    from tidemark.functions import text as T
    from tidemark.operators import indexing as I
    from tidemark.plans import source_queries as Q
    from tidemark.plans import stored as D

    chunks = I.chunk_entries(D.entries(spark, data)).select("chunk_id", T.index_tokens(F.col("content")).alias("t"), (F.coalesce("ts", D.as_of()) <= D.as_of()).alias("due")).collect()
    words = sorted({w for r in chunks for w in r.t})
    slot = {r.w: r.h % 64 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.chunk_id: r.embedding for r in Q.embedding_drained(spark, data).collect()}
    assert got.keys() == {r.chunk_id for r in chunks if r.due} and len(got) > 40
    for r in chunks:
        if r.due:
            n = Counter(slot[w] for w in r.t)
            norm = sum(v * v for v in n.values()) ** 0.5 or 1
            assert got[r.chunk_id] == pytest.approx([n[i] / norm for i in range(64)], abs=1e-6)
