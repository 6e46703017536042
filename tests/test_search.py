import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings as P
from tidemark.operators import search as S

ROW = "chunk_id string, source_type string, source_ref string, project_key string, namespace string, agent_id string, session_id string, kind string, title string, content string, tags string, visibility string, recipient_id string, is_sidechain boolean, ts timestamp"


def chunk(i, content="", title="", tags="", project="p", ref=None, visibility="shared", agent="a", to=None, side=False):
    return (i, "entry", ref or i, project, "n", agent, None, "note", title, content, tags, visibility, to, side, None)


def table(spark, rows):
    return spark.createDataFrame(rows, ROW)


def ask(spark, rows, query, request, **more):
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    return S.search(table(spark, rows), q, request, F.current_timestamp(), **more).orderBy("position").collect()


CORPUS = [
    chunk("1", "the cache entry expires", "Cache notes", "perf"), chunk("2", "retention sweep removes old rows of the cache"), chunk("3", "claude-sonnet-4-6 answers", "model list"),
    chunk("4", "sonnet claude 4 6"), chunk("5", "nothing to see", "Retention", "cache sweep"),
]


@pytest.mark.parametrize("query", ["cache", "retention sweep", "claude-sonnet-4-6", "nothing old rows"])
def test_scores_equal_the_full_text_index_of_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(chunk_id unindexed, title, tags, content)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    db.executemany("insert into f values (?, ?, ?, ?)", [(r[0], r[8], r[10], r[9]) for r in CORPUS])
    match = " OR ".join(f'"{t}"' for t in query.split())
    want = {i: s for i, s in db.execute("select chunk_id, bm25(f, 0, 3, 2, 1) from f where f match ?", (match,))}
    got = {r.chunk_id: r.bm25 for r in S.bm25(table(spark, CORPUS), spark.createDataFrame([(0, query)], "query_id int, query string")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_title_outranks_body_and_chunks_of_a_source_collapse(spark):
    rows = [chunk("a", "about cursors"), chunk("b", "x", "cursors"), *(chunk(f"c{i}", "cursors cursors", ref="c") for i in range(4)), chunk("z", "filler text")]
    found = ask(spark, rows, "cursors", S.Request(limit=3))
    assert {r.source_ref for r in found} == {"a", "b", "c"} and found[0].source_ref == "b"
    assert next(r.additional_chunks for r in found if r.source_ref == "c") >= 1


def test_scope_visibility_and_floor(spark):
    rows = [chunk("1", "vector table", project="p"), chunk("2", "vector table", project="q"), chunk("3", "vector table", project="r"), chunk("4", "vector secret", visibility="private", agent="me"), chunk("5", "vector", visibility="direct", to="you"), chunk("6", "vector", side=True)]
    links = spark.createDataFrame([("p", "q")], "project_key string, linked_project_key string")
    ids = lambda r, **m: {x.chunk_id for x in ask(spark, rows, "vector table", r, links=links, **m)}
    assert ids(S.Request(project_key="p")) == {"1"}
    assert ids(S.Request(project_key="p", scope="linked")) == {"1", "2"}
    assert ids(S.Request()) == {"1", "2", "3"}  # without a key every scope is global
    assert ids(S.Request(requester="me")) == {"1", "2", "3", "4"} and ids(S.Request(requester="you")) == {"1", "2", "3", "5"}
    assert "6" in ids(S.Request(include_sidechain=True)) and ids(S.Request(min_score=0.99, requester="me")) == {"1", "2", "3"}
    assert ask(spark, rows, "unheard of", S.Request()) == [] and ask(spark, [], "vector", S.Request()) == []


def test_stopwords_alone_find_only_below_the_floor(spark):
    rows = [chunk("1", "what is this"), chunk("2", "other")]
    assert ask(spark, rows, "what is", S.Request()) == [] and [r.chunk_id for r in ask(spark, rows, "what is", S.Request(min_score=0.0))] == ["1"]


def test_hybrid_finds_by_meaning(spark):
    rows = [chunk("1", "alpha"), chunk("2", "beta"), chunk("3", "gamma")]
    vec = spark.createDataFrame([("1", "p", [1.0, 0.0]), ("2", "p", [0.9, 0.1]), ("3", "p", [0.0, 1.0]), ("4", "p", [1.0]), ("5", "p", None)], "chunk_id string, project_key string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    found = ask(spark, rows, "alpha", S.Request(project_key="p"), vectors=vec, query_vectors=q)
    assert [r.chunk_id for r in found] == ["1", "2"] and found[1].similarity > 0.9 and found[0].score > found[1].score
    assert S.knn(vec, q.limit(0), 3).count() == 0


def test_request_bounds():
    for bad in ({"limit": 0}, {"limit": 51}, {"scope": "all"}, {"min_score": 2.0}):
        with pytest.raises(ValueError):
            S.Request(**bad)


def test_kept_index_gives_the_same_scores_and_reads_few_buckets(spark, tmp_path):
    chunks, q = table(spark, CORPUS), spark.createDataFrame([(0, "claude-sonnet-4-6 cache"), (1, "sweep"), (2, "no such thing")], "query_id int, query string")
    P.write(P.build(chunks, 8), str(tmp_path))
    index = P.load(spark, str(tmp_path), 8)
    assert sorted(map(tuple, P.bm25(index, q).collect())) == sorted(map(tuple, S.bm25(chunks, q).collect()))
    plan = P.bm25(index, q.where("query_id = 1"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_whole_batch_takes_terms_beyond_the_beginning(spark, data):
    from tidemark.functions import text as T
    from tidemark.plans import corpus as C

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 100 = 0 and text is not null").collect()}
    got = {r.query_id: r.query for r in C.batch(spark, data).collect()}
    assert got == docs
    late = spark.createDataFrame([(0, "the " * 40 + "cursor")], "query_id int, query string")
    assert late.select(T.query_terms(F.col("query"))).first()[0] == ["cursor"]


def test_a_long_term_is_met_as_a_whole(spark):
    path = "/".join(f"part{i}" for i in range(11))
    rows = [chunk("1", f"see {path}/end"), chunk("2", f"see {path}/other"), chunk("3", "nothing")]
    q = spark.createDataFrame([(0, f"{path}/end")], "query_id int, query string")
    assert [r.chunk_id for r in S.bm25(table(spark, rows), q).collect()] == ["1"]
    assert [r.chunk_id for r in P.bm25(P.build(table(spark, rows)), q).collect()] == ["1"]


def test_small_and_large_batches_rank_alike(spark, data, monkeypatch):
    """Scored in the tasks or joined by shuffle: the same candidates; either way a task sorts only a query's best."""
    from tidemark.plans import corpus as C

    chunks, queries = S.with_scope(C.chunks(spark, data), S.Request(scope="global")), C.batch(spark, data)
    few = S.best_bm25(chunks, queries, 7)
    monkeypatch.setattr(S, "FEW_PHRASES", 0)
    many = S.best_bm25(chunks, queries, 7)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 0
    assert all("WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() for df in (few, many))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_of_a_batch_are_not_shuffled(spark, data, monkeypatch):
    """Pairs grow with the square of the tables, so they are no shuffle's to keep; a batch beyond the bound gives the same."""
    from tidemark.plans import corpus as C

    chunks, queries = C.chunks(spark, data), C.batch(spark, data)
    few = S.bm25(chunks, queries)
    monkeypatch.setattr(S, "FEW_QUERIES", 0)
    many = S.bm25(chunks, queries)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 0
    assert _exchanges(few) == 0


def test_an_index_that_was_just_built_shuffles_nothing(spark, data, monkeypatch):
    from tidemark.plans import corpus as C

    chunks, queries = C.chunks(spark, data).coalesce(1), C.batch(spark, data)
    index = P.build(chunks)
    few = P.bm25(index, queries)
    monkeypatch.setattr(S, "FEW_QUERIES", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, P.bm25(index, queries).collect())) and few.count() > 0
    assert _exchanges(few) == 0 and "HashAggregate" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_linked_scope_is_a_column(spark):
    chunks = spark.createDataFrame([(str(i), p, "shared", None, None, None, None) for i, p in enumerate(["a", "b", "c", None])], "chunk_id string, project_key string, visibility string, is_sidechain boolean, source_type string, agent_id string, recipient_id string")
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a")], "project_key string, linked_project_key string")
    found = lambda r: sorted(x.chunk_id for x in S.with_scope(chunks, r, links).where("in_request").collect())
    assert found(S.Request(project_key="a", scope="linked")) == ["0", "1"] and found(S.Request(project_key="a")) == ["0"] and found(S.Request(scope="global")) == ["0", "1", "2", "3"]
