"""Search queries and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import postings as P
from tidemark.operators import search as S
from tidemark.plans import corpus as C
from tidemark.session import table

PROJECT = "git.example.net/ops/bundle-tracer-0"
QUESTION = "why does the stale cache entry slow the retention sweep under load?"

def as_of():
    return F.to_timestamp(F.lit(C.AS_OF))


# name -> (query or None for the batch, request, hybrid)
SEARCHES = {
    "search_keyword": (QUESTION, S.Request(scope="global"), False),
    "search_scoped": (QUESTION, S.Request(project_key=PROJECT), False),
    "search_linked": ("summary of the feature switch", S.Request(project_key="git.example.net/web/anchor-ledger-2", scope="linked", min_score=0.3), False),
    "search_visibility": ("vector table checksum", S.Request(scope="global", requester="agent-3", include_sidechain=True, limit=20), False),
    "search_filters": ("vector table checksum", S.Request(scope="global", namespace="wiki-pages", kind="note", tag="en", limit=10), False),
    "search_floor_zero": ("the ranker and zzzunknownterm qqqother wwwthird", S.Request(scope="global", min_score=0.0), False),
    "search_floor_high": ("the ranker and zzzunknownterm", S.Request(scope="global", min_score=0.99), False),
    "search_stopwords": ("what is it and how", S.Request(scope="global", min_score=0.0, limit=5), False),
    "search_phrase": ("vault_index off-by-one", S.Request(scope="global", limit=10), False),
    "search_batched": (None, S.Request(scope="global"), False),
    "hybrid_rrf": (None, S.Request(scope="global", limit=10), True),
}


def run_search(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    query, request, hybrid = SEARCHES[name]
    queries = C.batch(spark, sf_dir) if query is None else C.one(spark, query)
    more = {"vectors": C.vectors(spark, sf_dir), "query_vectors": C.query_vectors(spark, sf_dir)} if hybrid else {}
    found = S.search(C.chunks(spark, sf_dir), queries, request, as_of(), links=C.links(spark, sf_dir), **more)
    return found.select("query_id", "position", "chunk_id", "project_key", "score", "relevance", "coverage", "additional_chunks")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_SQL = ", ".join(_quoted(w) for w in T.STOPWORDS)
TERMS_SQL = f"""
    raw as (select query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_./:@-]+')) as t, generate_subscripts(regexp_extract_all(query, '[A-Za-z0-9_./:@-]+'), 1) as i from queries),
    kept as (select query_id, lower(trim(t, '.:/-')) as term, min(i) as i from raw where length(trim(t, '.:/-')) >= 2 and lower(trim(t, '.:/-')) not in ({STOP_SQL}) group by 1, 2),
    terms as (select query_id, term from (select *, row_number() over (partition by query_id order by i) as r from kept) where r <= 16),
    matched as (select query_id, term from terms union all
                select query_id, lower(t) from (select *, row_number() over (partition by query_id order by i) as r from raw where query_id not in (select query_id from terms)) where r <= 16)"""
BM25_SQL = r"""
    wanted as (select query_id, array_to_string(p, ' ') as phrase, len(p) as n, count(*) as times
               from (select distinct query_id, term, regexp_extract_all(lower(strip_accents(term)), '[\p{L}\p{N}]+') as p from matched) where len(p) > 0 group by 1, 2, 3),
    toks as (select chunk_id, w, regexp_extract_all(lower(strip_accents(x)), '[\p{L}\p{N}]+') as t from (
        select chunk_id, 3.0 as w, title as x from chunks union all select chunk_id, 2.0, tags from chunks union all select chunk_id, 1.0, content from chunks)),
    sizes as (select chunk_id, sum(len(t)) as d from toks group by 1),
    corpus as (select count(*) as docs, avg(d) as avg_d from sizes),
    places as (select chunk_id, w, t, unnest(t) as tok, generate_subscripts(t, 1) as i from toks),
    hits as (select q.phrase, p.chunk_id, sum(p.w) as f from (select distinct phrase, n, split_part(phrase, ' ', 1) as first from wanted) q join places p on p.tok = q.first
             where q.n = 1 or array_to_string(p.t[p.i : p.i + q.n - 1], ' ') = q.phrase group by 1, 2),
    dfs as (select phrase, count(*) as n_docs from hits group by 1),
    scores as (select w.query_id, h.chunk_id, round(-sum(w.times * greatest(case when ln((docs - n_docs + 0.5) / (n_docs + 0.5)) > 0 then ln((docs - n_docs + 0.5) / (n_docs + 0.5)) else 1e-6 end, 0)
                   * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * s.d / avg_d))), 9) + 0.0 as bm25
               from wanted w join hits h using (phrase) join dfs using (phrase) join sizes s using (chunk_id), corpus group by 1, 2)"""


GUIDANCE = S.Request(scope="global", min_score=1.0, kind="decision", limit=3)


def search_sql(name: str) -> str:
    return request_sql(*SEARCHES[name])


def request_sql(query: str | None, r: S.Request, hybrid: bool, queries: str | None = None) -> str:
    """SQL of a search; queries: SQL of its table of queries in place of the query or the batch."""
    queries = queries or (C.BATCH_SQL if query is None else f"queries as (select 0::bigint as query_id, {_quoted(query)} as query)")
    keep = ["visibility in ('shared', 'broadcast')" if r.requester is None else f"(visibility in ('shared', 'broadcast') or agent_id = {_quoted(r.requester)} or recipient_id = {_quoted(r.requester)})"]
    keep += [f"{c} = {_quoted(getattr(r, c))}" for c in ("namespace", "kind") if getattr(r, c)]
    if r.tag:
        keep.append(f"' ' || tags || ' ' like '% {r.tag} %'")
    if not r.include_sidechain:
        keep.append("not is_sidechain")
    if r.project_key and r.scope == "project":
        keep.append(f"project_key = {_quoted(r.project_key)}")
    if r.project_key and r.scope == "linked":
        keep.append(f"(project_key = {_quoted(r.project_key)} or project_key in (select linked_project_key from links where project_key = {_quoted(r.project_key)}))")
    vector = ""
    if hybrid:
        vector = f"""{C.VECTORS_SQL}, {C.QUERY_VECTORS_SQL},
    sims as (select q.query_id, v.chunk_id, round(list_cosine_similarity(q.embedding, v.embedding), 12) as sim from query_vectors q, vectors v),
    near as (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as r from sims qualify r <= {r.candidates}),
    vec as (select query_id, chunk_id, row_number() over (partition by query_id order by r) - 1 as v_rank, least(1.0, greatest(0.0, sim)) as similarity from near where chunk_id in (select chunk_id from scoped) and query_id in (select query_id from queries)),"""
    else:
        vector = "vec as (select query_id, chunk_id, 0 as v_rank, 0.0 as similarity from keyword where false),"
    return f"""with {queries}, {C.CHUNKS_SQL}, {C.LINKS_SQL}, {TERMS_SQL}, {BM25_SQL},
    scoped as (select * from chunks where {" and ".join(keep)}),
    keyword as (select query_id, chunk_id, row_number() over (partition by query_id order by bm25, chunk_id) - 1 as k_rank from scores where chunk_id in (select chunk_id from scoped) qualify k_rank < {r.candidates}),
    {vector}
    fused as (select query_id, chunk_id, (coalesce(1 / (61.0 + k_rank), 0) + coalesce(1 / (61.0 + v_rank), 0)) / (case when bool_or(v_rank is not null) over (partition by query_id) then 2.0 else 1.0 end / 61) as rrf, similarity
              from keyword full join vec using (query_id, chunk_id)),
    covered as (select f.*, c.* exclude (chunk_id), coalesce((select avg(case when contains(lower(c.title || ' ' || c.tags || ' ' || c.content), t.term) then 1.0 else 0.0 end) from terms t where t.query_id = f.query_id), 0) as coverage,
                       case when c.ts is null or c.ts >= timestamptz '{C.AS_OF}+00' then 1.0 else pow(0.5, epoch(timestamptz '{C.AS_OF}+00' - c.ts) / 86400 / 14) end as recency
                from fused f join scoped c using (chunk_id)),
    scored as (select *, greatest(coverage, coalesce(similarity, 0)) as relevance, rrf * (0.4 + 0.6 * recency) as score from covered),
    placed as (select *, row_number() over (partition by query_id order by score desc, relevance desc, chunk_id) as place from scored where relevance >= {r.floor}),
    firsts as (select *, min(place) over (partition by query_id, source_type, source_ref) = place as first from placed),
    positions as (select *, sum(first::int) over (partition by query_id order by place) as position from firsts),
    bounded as (select *, min(case when position = {r.limit} then place end) over (partition by query_id) as until from positions),
    counted as (select *, count(*) over (partition by query_id, source_type, source_ref) - 1 as additional_chunks from bounded where until is null or place <= until)
    select query_id, position::bigint as position, chunk_id, project_key, round(score, 6) as score, round(relevance, 4) as relevance, round(coverage, 4) as coverage, additional_chunks from counted where first"""


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(C.chunks(spark, sf_dir), C.batch(spark, sf_dir)).select("query_id", "chunk_id", (F.round("bm25", 6) + F.lit(0.0)).alias("bm25"))


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_scores by way of postings."""
    return P.bm25(P.build(C.chunks(spark, sf_dir)), C.batch(spark, sf_dir)).select("query_id", "chunk_id", (F.round("bm25", 6) + F.lit(0.0)).alias("bm25"))


def vector_knn(spark: SparkSession, sf_dir: str, per_project: bool = False) -> DataFrame:
    return S.knn(C.vectors(spark, sf_dir), C.query_vectors(spark, sf_dir), 10 if not per_project else 3, per_project).select("query_id", "project_key", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def _knn_sql(k: int, by: str) -> str:
    return f"""with {C.VECTORS_SQL}, {C.QUERY_VECTORS_SQL},
        s as (select q.query_id, v.project_key, v.chunk_id, round(list_cosine_similarity(q.embedding, v.embedding), 12) as sim from query_vectors q, vectors v)
        select query_id, project_key, chunk_id, round(sim, 6) as similarity, (row_number() over (partition by query_id{by} order by sim desc, chunk_id) - 1)::int as rank from s qualify rank < {k}"""


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(T.query_terms(F.col("text"))).alias("ord", "term"))


def search_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's queries that find nothing at a floor of one and an impossible filter."""
    queries = C.batch(spark, sf_dir)
    found = S.search(C.chunks(spark, sf_dir), queries, GUIDANCE, as_of())
    return S.guidance(found, queries).select("query_id", "message")


def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.query_terms(F.lit(QUESTION))
    return C.chunks(spark, sf_dir).select("chunk_id", F.round(T.term_coverage(terms, F.concat_ws(" ", "title", "tags", "content")), 4).alias("coverage"))


def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(spark, sf_dir).select("chunk_id", F.round(T.recency(F.col("ts"), as_of()), 6).alias("recency"))


def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, docs, occurrences of the index over all documents."""
    toks = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.index_tokens(F.col("text"))).alias("token"))
    per = toks.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"))


QUERIES = {n: partial(run_search, name=n) for n in SEARCHES} | {
    "bm25_scores": bm25_scores, "bm25_indexed": bm25_indexed, "vector_knn": vector_knn, "vector_knn_per_project": partial(vector_knn, per_project=True), "query_terms": query_terms, "search_guidance": search_guidance,
    "term_coverage": term_coverage, "recency_decay": recency_decay, "index_vocabulary": index_vocabulary,
}
ORACLES = {n: search_sql(n) for n in SEARCHES} | {
    "bm25_scores": f"with {C.BATCH_SQL}, {C.CHUNKS_SQL}, {TERMS_SQL}, {BM25_SQL} select query_id, chunk_id, round(bm25, 6) + 0.0 as bm25 from scores",
    "bm25_indexed": f"with {C.BATCH_SQL}, {C.CHUNKS_SQL}, {TERMS_SQL}, {BM25_SQL} select query_id, chunk_id, round(bm25, 6) + 0.0 as bm25 from scores",
    "search_guidance": f"with r as ({request_sql(None, GUIDANCE, False)}) select doc_id as query_id, {_quoted(S.NO_CONTEXT)} as message from documents where doc_id % 100 = 0 and text is not null and doc_id not in (select query_id from r)",
    "vector_knn": _knn_sql(10, ""),
    "vector_knn_per_project": _knn_sql(3, ", project_key"),
    "query_terms": f"""with queries as (select doc_id as query_id, text as query from documents where text is not null), {TERMS_SQL}
        select query_id as doc_id, (r - 1)::int as ord, term from (select *, row_number() over (partition by query_id order by i) as r from kept) where r <= 16""",
    "term_coverage": f"""with queries as (select 0::bigint as query_id, {_quoted(QUESTION)} as query), {TERMS_SQL}, {C.CHUNKS_SQL}
        select chunk_id, round((select avg(case when contains(lower(title || ' ' || tags || ' ' || content), term) then 1.0 else 0.0 end) from terms), 4) as coverage from chunks""",
    "recency_decay": f"""with {C.CHUNKS_SQL} select chunk_id, round(case when ts is null or ts >= timestamptz '{C.AS_OF}+00' then 1.0 else pow(0.5, epoch(timestamptz '{C.AS_OF}+00' - ts) / 86400 / 14) end, 6) as recency from chunks""",
    "index_vocabulary": r"""with t as (select doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) as token from documents where text is not null)
        select token, count(distinct doc_id) as docs, count(*) as occurrences from t group by 1""",
}
