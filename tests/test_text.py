import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import redaction as R
from tidemark.functions import text as T
from tidemark.operators import indexing as I


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first().x


@pytest.mark.parametrize("value, expected", [
    ("git@git.example.org:Team/Repo.git", "git.example.org/team/repo"), ("https://user@git.example.org:8443/team/repo/", "git.example.org/team/repo"), ("ssh://git@git.example.org/team/repo.git", "git.example.org/team/repo"), ("", None), ("nonsense", None), (None, None),
])
def test_remotes(spark, value, expected):
    assert one(spark, T.normalize_remote(F.col("v")), value) == expected


@pytest.mark.parametrize("value, expected", [("path:/srv/work/Anchor-build", "Anchor"), ("git.example.org/team/build", "build"), (r"path:C:\work\my_tool-test", "my tool"), ("path:/", "")])
def test_seeds(spark, value, expected):
    assert one(spark, T.search_seed(F.col("v")), value) == expected


def test_terms(spark):
    assert one(spark, T.query_terms(F.col("v")), "Why does the Cache/Entry: fail in v2.1? a cache/entry") == ["cache/entry", "fail", "v2.1"]
    assert one(spark, T.match_terms(F.col("v")), "what is it") == ["what", "is", "it"]
    assert one(spark, T.query_terms(F.col("v")), None) == []
    assert one(spark, T.index_tokens(F.col("v")), "Crème-brûlée 3ß") == ["creme", "brulee", "3ß"]


def test_coverage_counts_substrings(spark):
    assert one(spark, T.term_coverage(F.array(F.lit("cat"), F.lit("dog")), F.col("v")), "Concatenate") == 0.5
    assert one(spark, T.term_coverage(F.array().cast("array<string>"), F.col("v")), "x") == 0


def test_redaction_masks_again_under_the_general_label(spark):
    text = "API_KEY=sk-abcdefghijklmnopqrstuvwx and db_password: hunter22; plain words"
    assert one(spark, R.redact(F.col("v")), text) == "API_KEY=[REDACTED:credential] and db_password: [REDACTED:credential]; plain words"
    assert one(spark, R.redaction_count(F.col("v")), text) == 3
    assert one(spark, R.redact(F.col("v"), r"ticket-\d+;;[bad"), "ticket-12 stays") == "[REDACTED:custom] stays"
    assert one(spark, R.redaction_count(F.col("v")), None) == 0


def test_redaction_is_idempotent(spark, data):
    c = spark.read.parquet(f"{data}/session_events.parquet").select(R.redact(F.col("content")).alias("a")).select("a", R.redact(F.col("a")).alias("b"))
    assert c.where("a <> b").count() == 0


def chunks_by_hand(text, size, overlap):
    import re

    out, open_ = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", (text or "").strip())):
        if not p:
            continue
        if len(f"{open_}\n\n{p}" if open_ else p) <= size:
            open_ = f"{open_}\n\n{p}" if open_ else p
            continue
        out += [open_] if open_ else []
        open_ = p if len(p) <= size else ""
        if not open_:
            at = 0
            while True:
                out.append(p[at : at + size].strip())
                if at + size >= len(p):
                    break
                at += max(size - overlap, 1)
    return out + ([open_] if open_ else [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab c\n", max_size=80), st.integers(3, 30), st.integers(0, 35)), min_size=1, max_size=20))
def test_paragraph_chunks(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, s int, o int")
    got = {r.i: list(r.c) for r in df.select("i", I.paragraph_chunks(F.col("v"), F.col("s"), F.col("o")).alias("c")).collect()}
    assert got == {i: chunks_by_hand(*c) for i, c in enumerate(cases)}


def test_small_functions(spark):
    assert one(spark, T.estimate_tokens(F.col("v")), "") == 0 and one(spark, T.estimate_tokens(F.col("v")), "ab") == 1
    assert one(spark, T.truncate_tokens(F.col("v"), 2), "abcdefghij") == "abcde..."
    assert one(spark, T.scrub(F.col("v")), "keep\nMY_TOKEN = x\nthis") == "keep\nthis"
    assert one(spark, T.slugify(F.col("v")), "--") == "device"
    assert one(spark, T.path_denied(F.col("v"), ["/a/b"]), "/A/b/c") and not one(spark, T.path_denied(F.col("v"), ["/a/b"]), "/a/bc")
    assert one(spark, T.normalize_tags(F.col("v")), [" B", "b", None, "", "a"], "array<string>") == ["b", "a"]


def test_epoch_of_every_message(spark, tmp_path):
    from tidemark.plans import scalar_queries as Q

    spark.createDataFrame([(1, 1.7e9), (2, 1.7e12), (3, 1.7e15), (4, 0.0), (5, -3.0), (6, None), (7, 1e14)], "id bigint, timestamp double").coalesce(1).write.parquet(str(tmp_path / "messages.parquet"))
    assert {r.id: r.seconds for r in Q.epoch_autoscale(spark, str(tmp_path)).collect()} == {1: 1_700_000_000, 2: 1_700_000_000, 3: None, 4: None, 5: None, 6: None, 7: None}
