"""Keyword, vector and hybrid search over chunks, for one query or a whole table of them in one plan.

chunks: chunk_id, source_type, source_ref, project_key, namespace, agent_id, session_id, kind, title, content, tags,
visibility, recipient_id, is_sidechain, ts. queries: query_id, query. Scores depend on the whole corpus, whatever scope
a query has, so statistics are taken before scoping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.session import ensure_checkpoint_dir

WEIGHTS = {"title": 3.0, "tags": 2.0, "content": 1.0}  # of a hit in each column
K1, B = 1.2, 0.75
RRF_K = 60
MIN_SCORE = 0.12
HALF_LIFE_DAYS = 14.0
FEW_PHRASES = 16_000  # up to so many distinct phrases are literals of the plan; more are joined by shuffle
FEW_QUERIES = 20_000  # up to so many queries are held by every task; more are joined by shuffle
FEW_CANDIDATES = 400_000  # rows of candidates sent to all tasks at most, some 40 MB


@dataclass(frozen=True)
class Request:
    """What a search asks for besides its text. None leaves a filter out."""

    project_key: str | None = None
    scope: str = "project"  # project, linked, global; without a key every scope is global
    namespace: str | None = None
    agent_id: str | None = None
    kind: str | None = None
    session_id: str | None = None
    tag: str | None = None
    source_types: tuple[str, ...] | None = None
    include_sidechain: bool = False
    requester: str | None = None
    limit: int = 8
    min_score: float | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 50:
            raise ValueError("limit is between 1 and 50")
        if self.scope not in ("project", "linked", "global"):
            raise ValueError("scope is project, linked or global")
        if self.min_score is not None and not 0 <= self.min_score <= 1:
            raise ValueError("min_score is between 0 and 1")

    @property
    def candidates(self) -> int:
        return max(60, 12 * self.limit)

    @property
    def floor(self) -> float:
        return MIN_SCORE if self.min_score is None else self.min_score


def visible_to(requester: str | None) -> Column:
    """Shared and broadcast rows, and the requester's own and those addressed to them."""
    open_ = F.col("visibility").isin("shared", "broadcast")
    if requester is None:
        return F.coalesce(open_, F.lit(False))
    return F.coalesce(open_, F.lit(False)) | F.coalesce(F.col("agent_id") == requester, F.lit(False)) | F.coalesce(F.col("recipient_id") == requester, F.lit(False))


def request_filter(r: Request) -> Column:
    """All of a request's filters but its scope."""
    keep = visible_to(r.requester)
    for name in ("namespace", "agent_id", "kind", "session_id"):
        if getattr(r, name):
            keep = keep & (F.col(name) == getattr(r, name))
    if r.tag:
        keep = keep & F.concat(F.lit(" "), F.lower("tags"), F.lit(" ")).like(f"% {r.tag.strip().lower()} %")
    if r.source_types:
        keep = keep & F.col("source_type").isin(*r.source_types)
    if not r.include_sidechain:
        keep = keep & ~F.coalesce("is_sidechain", F.lit(False))
    return keep


def with_scope(chunks: DataFrame, r: Request, links: DataFrame | None = None) -> DataFrame:
    """The chunks with a column in_request: whether the request may find them."""
    keep = request_filter(r)
    if r.scope == "linked" and r.project_key and links is not None:
        keys = links.where(F.col("project_key") == r.project_key).select(F.col("linked_project_key").alias("project_key")).distinct()
        return chunks.join(keys.withColumn("_linked", F.lit(True)), "project_key", "left").withColumn("in_request", keep & (F.coalesce("_linked", F.lit(False)) | F.coalesce(F.col("project_key") == r.project_key, F.lit(False)))).drop("_linked")
    if r.scope != "global" and r.project_key:
        keep = keep & F.coalesce(F.col("project_key") == r.project_key, F.lit(False))
    return chunks.withColumn("in_request", keep)


def in_scope(chunks: DataFrame, r: Request, links: DataFrame | None = None) -> DataFrame:
    """The chunks of the projects a request may read."""
    if r.scope == "global" or not r.project_key:
        return chunks
    if r.scope == "project" or links is None:
        return chunks.where(F.col("project_key") == r.project_key)
    own = chunks.sparkSession.range(1).select(F.lit(r.project_key).alias("project_key"))
    keys = own.union(links.where(F.col("project_key") == r.project_key).select("linked_project_key")).distinct()
    return chunks.join(keys, "project_key", "left_semi")


def _grams(tokens: Column, phrases: dict[int, list[str]] | None, sizes: list[int]) -> Column:
    """The runs of each of the sizes in a token array, joined by blanks; with phrases, only those that are among them."""

    def of(n: int) -> Column:
        known = None if phrases is None else phrases[n]
        if n == 1:
            return tokens if known is None else F.filter(tokens, lambda t: t.isin(known))
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        if known is not None:  # only where a phrase's first token stands is a run put together
            first = sorted({p.split(" ", 1)[0] for p in known})
            starts = F.filter(starts, lambda i: F.get(tokens, i).isin(first))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
        return runs if known is None else F.filter(runs, lambda r: r.isin(known))

    runs = [of(n) for n in sizes]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def _weighted(runs: Column, weight: float) -> Column:
    return F.transform(runs, lambda g: F.struct(g.alias("phrase"), F.lit(weight).alias("w")))


def phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, n: what each query looks up; a term that the index splits is a phrase of its tokens."""
    tokens = lambda t: F.regexp_extract_all(T.fold(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = queries.select("query_id", F.explode(F.array_distinct(T.match_terms(F.col("query")))).alias("term")).select("query_id", "term", tokens(F.col("term")).alias("t"))
    # Two terms may come down to one phrase; it counts for each of them.
    return each.where("size(t) > 0").groupBy("query_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("n")).agg(F.count("*").alias("times"))


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, bm25 (negative, lower is better) of every chunk that holds a phrase of the query.

    Rounded to nine places, so that equal scores tie whatever the order of adding up. The pairs grow with the square of the
    tables and are never shuffled: a chunk's phrases stay in one row, from which a task scores it for all queries of a batch
    of up to FEW_QUERIES. Larger batches are joined by shuffle.
    """
    wanted = phrases(queries)
    if (batch := wanted_rows(wanted)) is not None:
        tokens = chunks.select("chunk_id", *(T.index_tokens(F.col(c)).alias(c) for c in WEIGHTS))
        held = hold(tokens, _phrase_finder([r.phrase for r in batch])).checkpoint()
        docs, avg_d = held.agg(F.count("*"), F.avg("d")).first()
        return scored_in_tasks(held, batch, dict(queries.dtypes)["query_id"], docs, avg_d)
    distinct = wanted.select("phrase", "n").distinct()
    rows = distinct.limit(FEW_PHRASES + 1).collect()  # bounded by FEW_PHRASES, whatever the corpus
    few = len(rows) <= FEW_PHRASES
    sizes = sorted({r.n for r in rows}) if few else sorted(r[0] for r in distinct.select("n").distinct().collect())
    sizes = sizes or [1]
    known = {n: sorted(r.phrase for r in rows if r.n == n) for n in sizes} if few else None
    tokens = chunks.select("chunk_id", *(T.index_tokens(F.col(c)).alias(c) for c in WEIGHTS))
    length = sum((F.size(c) for c in WEIGHTS), F.lit(0))
    corpus = tokens.select(length.alias("d")).agg(F.count("*").alias("docs"), F.avg("d").alias("avg_d"))
    hits = tokens.select("chunk_id", length.alias("d"), F.explode(F.concat(*(_weighted(_grams(F.col(c), known, sizes), w) for c, w in WEIGHTS.items()))).alias("h")).select("chunk_id", "d", "h.phrase", "h.w")
    if not few:
        hits = hits.join(distinct.select("phrase"), "phrase", "left_semi")
    hits = hits.groupBy("phrase", "chunk_id", "d").agg(F.sum("w").alias("f"))
    return scored(hits, wanted, corpus, few)


def wanted_rows(wanted: DataFrame) -> list | None:
    """The rows of phrases(), or None if they are more than every task may hold."""
    rows = wanted.limit(FEW_QUERIES * T.MAX_TERMS + 1).collect()  # bounded by the queries a task may hold
    return None if len(rows) > FEW_QUERIES * T.MAX_TERMS or len({r.query_id for r in rows}) > FEW_QUERIES else rows


def numbered(names: list[str]) -> dict[str, int]:
    return {p: i for i, p in enumerate(sorted(set(names)))}


def hold(rows: DataFrame, run) -> DataFrame:
    """chunk_id, d, found (numbers of phrases), f (their weighted hits), a row for each chunk, made by run over Arrow batches."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.mapInArrow(run, f"chunk_id {dict(rows.dtypes)['chunk_id']}, d int, found array<int>, f array<double>")


def held_batch(keys, d: list[int], hits: list[dict[int, float]]):
    import pyarrow as pa

    found = pa.array([list(h) for h in hits], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([keys, pa.array(d, pa.int32()), found, pa.array([list(h.values()) for h in hits], pa.list_(pa.float64()))], names=["chunk_id", "d", "found", "f"])


def _phrase_finder(names: list[str]):
    number, weights = numbered(names), list(WEIGHTS.values())
    longer: dict[str, list[int]] = {}  # by a phrase's first token, the lengths to try
    for p in number:
        if (n := p.count(" ") + 1) > 1 and n not in longer.setdefault(p.split(" ", 1)[0], []):
            longer[p.split(" ", 1)[0]].append(n)

    def run(batches):
        for batch in batches:
            keys, *fields = batch.columns
            sizes, hits = [0] * len(keys), [{} for _ in range(len(keys))]
            for column, weight in zip(fields, weights):
                for at, tokens in enumerate(column.to_pylist()):
                    into = hits[at]
                    sizes[at] += len(tokens)
                    for i, token in enumerate(tokens):
                        if (k := number.get(token)) is not None:
                            into[k] = into.get(k, 0.0) + weight
                        for n in longer.get(token, ()):
                            if i + n <= len(tokens) and (k := number.get(" ".join(tokens[i : i + n]))) is not None:
                                into[k] = into.get(k, 0.0) + weight
            yield held_batch(keys, sizes, hits)

    return run


def scored_in_tasks(held: DataFrame, rows: list, kind: str, docs: int, avg_d: float | None) -> DataFrame:
    """query_id, chunk_id, bm25. held: see hold, kept, as it is read twice; rows: of phrases(); kind: the type of query_id."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"query_id {kind}, chunk_id {dict(held.dtypes)['chunk_id']}, bm25 double"
    number = numbered([r.phrase for r in rows])
    n_docs = dict(held.select(F.explode("found").alias("k")).groupBy("k").agg(F.count("*")).collect())  # as many rows as phrases
    ids = list(dict.fromkeys(r.query_id for r in rows))
    place = {q: i for i, q in enumerate(ids)}
    asked: dict[int, list] = {}
    for r in rows:
        if (n := n_docs.get(k := number[r.phrase])) is not None:
            idf = math.log((docs - n + 0.5) / (n + 0.5))
            asked.setdefault(k, []).append((place[r.query_id], r.times * (idf if idf > 0 else 1e-6)))
    spark = held.sparkSession
    shipped = spark.sparkContext.broadcast((ids, {k: (np.array([q for q, _ in v]), np.array([w for _, w in v])) for k, v in asked.items()}, float(avg_d or 1.0)))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        ids, asked, avg = shipped.value
        ids = pa.array(ids, arrow.field(0).type)
        for batch in batches:
            offsets, found = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            f, d = batch.column(3).values.to_numpy(), batch.column(1).to_numpy()
            f_offsets = batch.column(3).offsets.to_numpy()
            some: list = []
            count = 0

            def out():
                q, at, s = (np.concatenate(x) for x in zip(*some))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(at)), pa.array(0.0 - np.round(s, 9))], schema=arrow)  # noqa: B023

            for at in range(batch.num_rows):
                a, b = offsets[at], offsets[at + 1]
                if a == b:
                    continue
                each = [asked[k] for k in found[a:b].tolist()]
                hits = f[f_offsets[at] : f_offsets[at + 1]]
                tf = hits * (K1 + 1) / (hits + K1 * (1 - B + B * d[at] / avg))
                s = np.bincount(np.concatenate([q for q, _ in each]), np.concatenate([w for _, w in each]) * np.repeat(tf, [len(q) for q, _ in each]), len(ids))
                q = np.flatnonzero(s)  # every weight is above 0
                some.append((q, np.full(len(q), at), s[q]))
                count += len(q)
                if count > 400_000:  # bounds a task's memory
                    yield out()
                    some, count = [], 0
            if some:
                yield out()

    return held.where("size(found) > 0").mapInArrow(run, schema)


def scored(hits: DataFrame, wanted: DataFrame, corpus: DataFrame, few: bool) -> DataFrame:
    """query_id, chunk_id, bm25. hits: phrase, chunk_id, d, f; wanted: see phrases; corpus: one row with docs and avg_d."""
    # Counted over f, so that both uses of the hits need the same columns and share one exchange.
    df = hits.groupBy("phrase").agg(F.count_if(F.col("f") > 0).alias("n_docs"))
    idf = F.log((F.col("docs") - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    per = wanted.select("query_id", "phrase", "times").join(df, "phrase").join(F.broadcast(corpus), F.lit(True))  # one row
    per = per.select("query_id", "phrase", "times", "avg_d", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    one = F.col("times") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    return hits.join(F.broadcast(per) if few else per, "phrase").groupBy("query_id", "chunk_id").agg((F.round(-F.sum(one), 9) + F.lit(0.0)).alias("bm25"))


def best_bm25(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id, k_rank (from 0): of each query the n best chunks that have in_request, by bm25 and then chunk_id.

    Counts are taken over all chunks. A batch of up to FEW_QUERIES queries with up to FEW_PHRASES phrases is sent to all
    tasks: the chunks are tokenized once, what they have of the phrases goes to the checkpoint folder, from where counts
    and scores come, and a task hands on only its own n best of each query. Larger batches are joined by shuffle.
    """
    rows = phrases(queries).limit(FEW_QUERIES * T.MAX_TERMS + 1).collect()  # bounded by the queries a task may hold
    ids, names = {r.query_id for r in rows}, {(r.phrase, r.n) for r in rows}
    if len(rows) > FEW_QUERIES * T.MAX_TERMS or len(ids) > FEW_QUERIES or len(names) > FEW_PHRASES:
        scores = bm25(chunks, queries).join(chunks.where("in_request").select("chunk_id"), "chunk_id", "left_semi")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("bm25", "chunk_id"))
        return scores.withColumn("place", place).where(F.col("place") <= n).select("query_id", "chunk_id", (F.col("place") - 1).alias("k_rank"))
    kind = dict(queries.dtypes)["query_id"]
    spark = chunks.sparkSession
    if not rows:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, k_rank int")
    sizes = sorted({m for _, m in names})
    known = {m: sorted(p for p, k in names if k == m) for m in sizes}
    ensure_checkpoint_dir(spark)
    tokens = chunks.select("chunk_id", "in_request", *(T.index_tokens(F.col(c)).alias(c) for c in WEIGHTS))
    length = sum((F.size(c) for c in WEIGHTS), F.lit(0))
    held = tokens.select("chunk_id", "in_request", length.alias("d"), *(_grams(F.col(c), known, sizes).alias(c) for c in WEIGHTS)).checkpoint()
    docs, avg_d = held.agg(F.count("*"), F.avg("d")).first()
    n_docs = {r[0]: r[1] for r in held.select(F.explode(F.array_distinct(F.concat(*WEIGHTS))).alias("phrase")).groupBy("phrase").count().collect()}  # as many rows as phrases
    column = {p: i for i, p in enumerate(sorted(n_docs))}
    by_query: dict = {}
    for r in rows:
        if r.phrase in column:
            idf = math.log((docs - n_docs[r.phrase] + 0.5) / (n_docs[r.phrase] + 0.5))
            by_query.setdefault(r.query_id, []).append((column[r.phrase], r.times * (idf if idf > 0 else 1e-6)))
    shipped = spark.sparkContext.broadcast((column, list(WEIGHTS.values()), float(avg_d or 1.0), {q: tuple(zip(*v)) for q, v in by_query.items()}))

    def run(batches):
        import numpy as np

        column, weights, avg, by_query = shipped.value
        wanted = [(q, np.array(c), np.array(w)[:, None]) for q, (c, w) in by_query.items()]
        best: dict = {q: (np.empty(0), np.empty(0, object)) for q in by_query}
        step = max(64, 4_000_000 // max(1, len(column)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                f = np.zeros((len(column), part.num_rows))
                for field, weight in zip(part.columns[2:], weights):
                    offsets, found = field.offsets.to_numpy(), field.flatten().to_pylist()
                    of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                    np.add.at(f, (np.fromiter((column[p] for p in found), np.int64, len(found)), of), weight)
                d = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                keys = np.array(part.column(0).to_pylist(), object)
                tf = f * (K1 + 1) / (f + K1 * (1 - B + B * d / avg))
                for q, columns, weight in wanted:
                    score = np.round((tf[columns] * weight).sum(0), 9)
                    scores, names = best[q]
                    take = np.flatnonzero((score >= (scores[-1] if len(scores) == n else 0.0)) & (score > 0))
                    if len(take):
                        scores, names = np.concatenate([scores, score[take]]), np.concatenate([names, keys[take]])
                        order = np.lexsort((names.astype(str), -scores))[:n]
                        best[q] = scores[order], names[order]
        for q, (scores, names) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_pydict({"query_id": [q] * len(scores), "chunk_id": names.tolist(), "bm25": (-scores).tolist()}, schema=arrow)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"query_id {kind}, chunk_id string, bm25 double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    found = held.where("in_request").select(F.col("chunk_id").cast("string"), "d", *WEIGHTS).mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("bm25", "chunk_id"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("query_id", "chunk_id", (F.col("place") - 1).alias("k_rank"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


MAX_QUERY_VECTORS = 10_000  # held by every task of a vector search; a larger batch is searched in several


def knn(vectors: DataFrame, query_vectors: DataFrame, k: int, per_project: bool = False) -> DataFrame:
    """query_id, chunk_id, similarity, rank (from 0): the k nearest vectors by cosine, for each project with per_project.

    vectors: chunk_id, project_key, embedding. query_vectors: query_id, embedding; at most MAX_QUERY_VECTORS. The stated
    queries are sent to all tasks; each batch of vectors is multiplied with them, and only a batch's own k best of each
    query go on, so nothing like all pairs is ever shuffled. Vectors of another width, null or zero are left out. Ties
    go to the lesser chunk_id.
    """
    import numpy as np
    import pyarrow as pa

    rows = query_vectors.select("query_id", "embedding").where("embedding is not null").limit(MAX_QUERY_VECTORS + 1).collect()
    if len(rows) > MAX_QUERY_VECTORS:
        raise ValueError("more query vectors than one search holds; search in several batches")
    ids = [r[0] for r in rows]
    kind = dict(query_vectors.dtypes)["query_id"]
    schema = f"query_id {kind}, chunk_id string, project_key string, similarity double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    width = len(rows[0][1])
    q = np.array([r[1] for r in rows if len(r[1]) == width], float)
    ids = [r[0] for r in rows if len(r[1]) == width]
    norms = np.linalg.norm(q, axis=1)
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, q / np.where(norms > 0, norms, 1)[:, None]))

    def run(batches):
        qids, unit = shipped.value
        for batch in batches:
            keys, projects, emb = (c.to_pylist() for c in batch.columns)
            good = [i for i, e in enumerate(emb) if e is not None and len(e) == unit.shape[1] and any(e)]
            if not good:
                continue
            m = np.array([emb[i] for i in good], float)
            sims = unit @ (m / np.linalg.norm(m, axis=1)[:, None]).T
            groups: dict = {}
            for j, i in enumerate(good):
                groups.setdefault(projects[i] if per_project else None, []).append(j)
            out: list[tuple] = []
            for cols in groups.values():
                names = np.array([keys[good[j]] for j in cols])
                for a, qid in enumerate(qids):
                    s = np.round(sims[a, cols], 12)
                    best = np.lexsort((names, -s))[:k]
                    out += [(qid, names[b], projects[good[cols[b]]], float(s[b])) for b in best]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "chunk_id", "project_key", "similarity"), r)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    found = vectors.select(F.col("chunk_id").cast("string"), "project_key", "embedding").mapInArrow(run, schema)
    by = Window.partitionBy("query_id", *(["project_key"] if per_project else [])).orderBy(F.desc("similarity"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def candidates(chunks: DataFrame, queries: DataFrame, request: Request, *, links: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, k_rank, v_rank, similarity: the chunks either way brings for each query, with their ranks."""
    flagged = with_scope(chunks, request, links)
    keyword = best_bm25(flagged, queries, request.candidates)
    if vectors is None or query_vectors is None:
        return keyword.withColumns({"v_rank": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double")})
    near = knn(in_scope(vectors, request, links), query_vectors, request.candidates).join(flagged.where("in_request").select("chunk_id"), "chunk_id", "left_semi")
    near = near.withColumn("v_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    near = near.select("query_id", "chunk_id", "v_rank", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity"))).alias("similarity"))
    return keyword.join(near, ["query_id", "chunk_id"], "full_outer")


def diagnostics(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, keyword_candidates, vector_candidates, vector_used, fused_candidates of the candidates of queries."""
    return found.join(queries.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.count("k_rank").alias("keyword_candidates"), F.count("v_rank").alias("vector_candidates"), (F.count("v_rank") > 0).alias("vector_used"), F.count("*").alias("fused_candidates"))


def search(
    chunks: DataFrame, queries: DataFrame, request: Request, as_of: Column, *, links: DataFrame | None = None,
    vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """The best sources for each query: query_id, position, chunk_id, source_type, source_ref, project_key, title, score,
    relevance, coverage, similarity, recency, additional_chunks.

    Keyword candidates are filtered before they are cut to the request's number, vector candidates after, as their
    neighbours are looked up first. The two rankings are fused by reciprocal rank, weighted by recency, floored by
    absolute relevance; of several chunks of a source the best stays, with how many others came before the last result.
    Queries without terms, empty tables and blank texts give no rows. Ties go to higher relevance, then lesser chunk_id.
    """
    scoped = with_scope(chunks, request, links).where("in_request")
    fused = candidates(chunks, queries, request, links=links, vectors=vectors, query_vectors=query_vectors)
    best = F.when(F.max(F.col("v_rank").isNotNull()).over(Window.partitionBy("query_id")), F.lit(2.0)).otherwise(F.lit(1.0)) / (RRF_K + 1)
    term = lambda c: F.coalesce(1 / (F.lit(RRF_K + 1) + F.col(c)), F.lit(0.0))
    fused = fused.withColumn("rrf", (term("k_rank") + term("v_rank")) / best)
    # Late materialisation: only candidates are joined with their rows.
    many = queries.limit(FEW_CANDIDATES + 1).count() * 2 * request.candidates > FEW_CANDIDATES
    fused = fused.join(queries.select("query_id", T.query_terms(F.col("query")).alias("terms")), "query_id")
    fused = fused if many else F.broadcast(fused)  # at most FEW_CANDIDATES rows
    rows = fused.join(scoped.select("chunk_id", "source_type", "source_ref", "project_key", "title", "tags", "content", "ts"), "chunk_id")
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("tags", F.lit("")), F.coalesce("content", F.lit("")))
    rows = rows.withColumn("coverage", T.term_coverage(F.col("terms"), hay)).withColumn("recency", T.recency(F.col("ts"), as_of, half_life_days))
    rows = rows.withColumn("relevance", F.greatest("coverage", F.coalesce("similarity", F.lit(0.0)))).withColumn("score", F.col("rrf") * (0.4 + 0.6 * F.col("recency"))).where(F.col("relevance") >= request.floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("relevance"), "chunk_id")
    source = Window.partitionBy("query_id", "source_type", "source_ref")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("first", F.min("place").over(source) == F.col("place"))
    rows = rows.withColumn("position", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Others of a source count up to the place of the last result.
    rows = rows.withColumn("until", F.min(F.when(F.col("position") == request.limit, F.col("place"))).over(Window.partitionBy("query_id")))
    counted = rows.where("until is null or place <= until").withColumn("additional_chunks", F.count("*").over(source) - 1).where("first")
    return counted.select(
        "query_id", "position", "chunk_id", "source_type", "source_ref", "project_key", "title", F.round("score", 6).alias("score"), F.round("relevance", 4).alias("relevance"), F.round("coverage", 4).alias("coverage"),
        F.round("similarity", 4).alias("similarity"), F.round("recency", 6).alias("recency"), "additional_chunks",
    )


NO_CONTEXT = "No prior context in scope is relevant to this query; go on without it."


def guidance(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, message: for queries without any result."""
    return queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(NO_CONTEXT).alias("message"))
