import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import abuse, conversations, mixing, packing, tokens


# ---- conversations --------------------------------------------------------------------------------------------------
def sound(rows, hermes):
    """By the definition, one session at a time. rows: seq, role, kind, content, side."""
    by = {}
    for seq, _, _, content, _ in rows:
        by.setdefault(seq, set()).add(content or "")
    if any(len(c) > 1 for c in by.values()) or not hermes and sorted(by) != list(range(max(by) + 1)):
        return False
    turns = sorted({(s, k) for s, _, k, c, side in rows if k in ("prompt", "reply") and not side and c and c.strip()})
    for s, role, k, c, side in rows:
        if k in ("prompt", "reply") and not side and c and c.strip() and role is not None and conversations_speaker(role) != ("user" if k == "prompt" else "assistant"):
            return False
    kinds = [k for _, k in turns]
    return bool(kinds) and kinds[0] == "prompt" and kinds[-1] == "reply" and not any(a == b == "prompt" for a, b in zip(kinds, kinds[1:]))


def conversations_speaker(role):
    r = role.strip().lower()
    return "user" if r in conversations.USER else "assistant" if r in conversations.ASSISTANT else r


ROW = st.tuples(st.integers(0, 5), st.sampled_from(["user", "Human", "assistant", "AI", None, None]), st.sampled_from(["prompt", "reply", "reply", "meta"]), st.sampled_from(["a", "a", "a", " ", None]), st.sampled_from([False, False, False, True, None]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(ROW, min_size=1, max_size=9), min_size=20, max_size=60))
def test_soundness_against_the_definition(spark, sessions):
    names = [f"{'hermes-' if i % 3 == 0 else ''}{i}" for i in range(len(sessions))]
    df = spark.createDataFrame([(n, *r) for n, rows in zip(names, sessions) for r in rows], "session_id string, seq bigint, role string, kind string, content string, is_sidechain boolean")
    got = {r.session_id: r.sound for r in conversations.session_soundness(df).collect()}
    assert got == {n: sound(rows, n.startswith("hermes-")) for n, rows in zip(names, sessions)}


def test_sessions_over_many_blocks(spark):
    n = conversations.BLOCK * 3 + 7
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("role"), F.when(F.col("id") % 2 == 0, "prompt").otherwise("reply").alias("kind"), F.lit("x").alias("content"), F.lit(False).alias("is_sidechain"))
    assert conversations.session_soundness(df.where(f"seq < {n - n % 2}")).first().sound
    assert conversations.session_soundness(df.where("seq < 2049")).first().reason == "unanswered"
    turns = conversations.conversations(df.where(f"seq < {n - n % 2}"))
    assert turns.where("turn_no <> seq").count() == 0 and turns.count() == n - n % 2
    assert conversations.session_soundness(df.limit(0)).count() == 0


# ---- packing --------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 50)), max_size=60), st.integers(50, 80))
def test_packing_places_each_item_once(items, capacity):
    rows = [(i, s, n) for i, (s, n) in enumerate(items)]
    total = sum(n for _, n in items) or 1
    containers, fills = packing.pack(rows, capacity, {}, {s: sum(n for t, n in items if t == s) / total for s in "abc"})
    assert sorted(i for c in containers for i in c) == list(range(len(items)))
    assert all(sum(rows[i][2] for i in c) == f <= capacity for c, f in zip(containers, fills))


def test_packing_mixes_sources():
    items = [(i, "ab"[i % 4 == 0], 10) for i in range(400)]
    containers, _ = packing.pack(items, 80, {}, {"a": 0.75, "b": 0.25})
    assert all(sum(items[i][1] == "b" for i in c) == 2 for c in containers)


def test_pack_documents(spark):
    rng = np.random.default_rng(1)
    sized = spark.createDataFrame([(i, "ab"[i % 3 == 0], int(n)) for i, n in enumerate(rng.integers(1, 300, 500))] + [(900, None, 1000), (901, "a", 0), (902, "b", 200)], "doc_id bigint, source string, tokens int")
    specs = spark.createDataFrame([("s", 200), ("l", 1000), ("none", None)], "spec_name string, capacity_tokens int")
    out = packing.pack_documents(sized, specs).toPandas()
    want = sized.where("tokens > 0").toPandas()
    for spec, cap in (("s", 200), ("l", 1000)):
        p = out[out.spec_name == spec]
        assert p.groupby("doc_id").tokens.sum().to_dict() == dict(zip(want.doc_id, want.tokens))
        fill = p.groupby("container").tokens.sum()
        assert fill.max() <= cap and fill.sum() / (len(fill) * cap) > 0.95
        whole = dict(zip(want.doc_id, want.tokens))
        assert all(len(g) == 1 or whole[d] > cap for d, g in p.groupby("doc_id"))
    assert packing.pack_documents(sized.limit(0), specs).count() == 0


def test_deficits_of_shards_are_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rng = np.random.default_rng(5)
    rows = [(int(sh), s, int(sh) // 3, int(rng.integers(1, 99))) for sh in range(11) for s in "ab" if (sh + ord(s)) % 4]
    got = {(r.shard, r.s): r.before for r in packing._before(spark.createDataFrame(rows, "shard bigint, s string, group bigint, own bigint"), "own", "before", ["s"]).collect()}
    assert got == {(sh, s): sum(n for t, u, _, n in rows if u == s and t < sh) for sh, s, _, _ in rows}


# ---- mixing ---------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    p, sizes = [a for a, _ in units], [float(n) for _, n in units]
    out = mixing.flight(p, sizes, np.random.default_rng(seed))
    assert sum(1 for x in out if x not in (0.0, 1.0)) <= 2
    assert sum(out) == pytest.approx(sum(p), abs=1e-4) and np.dot(out, sizes) == pytest.approx(np.dot(p, sizes), abs=1e-2)


def test_flight_keeps_expectations():
    p, sizes = [0.2, 0.5, 0.7, 0.3], [5.0, 80.0, 20.0, 10.0]
    mean = np.mean([mixing.draw(np.array(p), np.array(sizes), np.random.default_rng(s), True) for s in range(3000)], axis=0)
    assert np.allclose(mean, p, atol=0.05)


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, s, int(n)) for i, (s, n) in enumerate(zip(rng.choice(["big", "mid", "few"], 4000, p=[0.6, 0.39, 0.01]), rng.integers(10, 400, 4000)))] + [(9000, "big", 20000), (9001, None, 5), (9002, "other", 5), (9003, "mid", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("few", 0.1, 5), ("absent", 0.1, 9), ("null", None, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(sized, targets).toPandas()
    used = out.assign(t=out.tokens * out.copies).groupby("source").t.sum()
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("few", 0.1, 5)):
        assert used[s] / used.sum() == pytest.approx(share / 0.9, abs=0.01) and out[out.source == s].copies.between(1, cap).all()
    assert out.doc_id.is_unique and set(out.source) == {"big", "mid", "few"}
    pd.testing.assert_frame_equal(out.sort_values("doc_id", ignore_index=True), mixing.mix(sized.repartition(3), targets).toPandas().sort_values("doc_id", ignore_index=True))
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_mixture_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    monkeypatch.setattr(mixing, "BALLAST", 10)
    rng = np.random.default_rng(3)
    sized = spark.createDataFrame([(i, "ab"[i % 3 == 0], int(n)) for i, n in enumerate(rng.integers(10, 400, 900))], "doc_id bigint, source string, tokens int")
    out = mixing.mix(sized, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")).toPandas()
    used = out.groupby("source").tokens.sum()
    assert used["a"] / used.sum() == pytest.approx(0.5, abs=0.01) and (out.copies == 1).all() and out.doc_id.is_unique


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, None, ""), (4, "a", "x" * 200000)], "doc_id bigint, source string, text string")
    assert [r.tokens for r in tokens.with_token_counts(docs).orderBy("doc_id").collect()][:3] == [2, 0, 0]


# ---- abuse ----------------------------------------------------------------------------------------------------------
def words_of(text):
    return [abuse.plain(t) for c in abuse.chunks(text) for t in abuse.tokens(c) if t[0].isalnum() or t[0] in "$@*"]


def worst(m, texts):
    words = abuse.Words(m.starred)
    row, feature, of = abuse.features([words.of(x) for x in texts], m.known)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, of, m.raw(row, feature, len(of)))
    return top >= m.threshold


def test_disguises_are_undone():
    for t in ("you st\u200bupid", "you stupiiiid", "you ѕtupіd", "you STUPID", "you s-t-u-p-i-d", "you s t u p i d", "you $tupid", "you stup1d"):
        assert "stupid" in words_of(t), t
    assert words_of("build v2 of utf8 at 10") == ["build", "v2", "of", "utf8", "at", "9"]


def test_starred_words_are_read_as_a_learned_word():
    m = abuse.fit(["You are an idiot."] * 30 + ["Kill the process."] * 60, [True] * 30 + [False] * 60)
    assert worst(m, ["You are an id*ot.", "Kill the pr*cess.", "You are an *diot.", "", "*"]).tolist() == [True, False, True, False, False]


def test_pairs_tell_what_single_words_do_not():
    """Either word alone stands as often in fine texts; only the two together are abusive, wherever in the sentence."""
    rng = np.random.default_rng(1)
    some = lambda: " ".join(rng.choice(["cache", "index", "window", "branch", "route", "batch"], 3))
    abusive = [f"{some()} rotten {some()} greenlings {some()}." for _ in range(300)]
    fine = [f"{some()} {w} {some()}." for w in ("rotten", "greenlings") for _ in range(300)]
    m = abuse.fit(abusive + fine, [True] * 300 + [False] * 600)
    assert worst(m, ["index greenlings the batch rotten window.", "index rotten the batch.", "index greenlings window."]).tolist() == [True, False, False]


def test_held_out_accuracy(spark, data):
    """Fitted on the labels of one scale, held against those of another; raters err in some 4 of 100."""
    texts, labels = abuse.labelled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = abuse.labelled(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    seen = set(texts)
    fresh = [(t, y) for t, y in zip(*held) if t not in seen]
    assert len(fresh) > 50
    assert np.mean(worst(abuse.fit(texts, labels), [t for t, _ in fresh]) == np.array([y for _, y in fresh])) > 0.9


def test_labelled_texts_stay_within_their_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab" * 10) for i in range(20)] + [(20, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "r", "abusive" if i % 2 else "fine") for i in range(21)] + [(0, "q", "abusive")], "doc_id bigint, rater string, verdict string")
    assert len(abuse.labelled(docs, labels)[0]) == 19
    monkeypatch.setattr(abuse, "MAX_LABELLED_CHARS", 100)
    assert len(abuse.labelled(docs, labels)[0]) == 5


def test_abuse_needs_both_kinds_of_labels():
    assert not worst(abuse.fit(["a b"], [True]), ["a b"]).any() and not worst(abuse.fit([], []), ["a b"]).any()


def test_a_very_long_text_is_scored_whole(spark):
    m = abuse.fit(["You are an idiot."] * 30 + ["Kill the process."] * 60, [True] * 30 + [False] * 60)
    docs = spark.createDataFrame([(1, "s", "Kill the process. " * 60_000 + "You are an idiot."), (2, "s", "Kill the process. " * 60_000)], "doc_id bigint, source string, text string")
    assert [r.abusive for r in abuse.score_documents(docs, m).orderBy("doc_id").collect()] == [True, False]


def test_scores_of_all_documents(spark):
    m = abuse.fit(["You are an idiot."] * 30 + ["Kill the process."] * 60, [True] * 30 + [False] * 60)
    docs = spark.createDataFrame([(1, "s", "Fine text.\nYou are an idiot."), (2, "s", None), (3, None, ""), (4, "s", "Kill the process."), (4, "s", "Kill the process.")], "doc_id bigint, source string, text string")
    assert [(r.doc_id, r.abusive) for r in abuse.score_documents(docs, m).orderBy("doc_id").collect()] == [(1, True), (2, False), (3, False), (4, False), (4, False)]
