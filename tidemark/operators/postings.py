"""A materialised index: where each token stands, in folders by the token's hash, so that a search reads few of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import search as S

BUCKETS = 256


@dataclass(frozen=True)
class Index:
    """postings: bucket, token, chunk_id, field, places (array of positions). lengths: chunk_id, d (tokens)."""

    postings: DataFrame
    lengths: DataFrame
    buckets: int
    together: bool = False  # all postings of a chunk stand one after another in one partition


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, buckets: int = BUCKETS) -> Index:
    """The index of all chunks as plans; see write and load for one that is kept.

    A chunk's postings are made from its row, so nothing is shuffled.
    """
    tokens = chunks.select("chunk_id", *(T.index_tokens(F.col(c)).alias(c) for c in S.WEIGHTS))
    names = list(S.WEIGHTS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, *fields = batch.columns
            columns = [c.to_pylist() for c in fields]
            at, rows = [], []
            for i in range(len(keys)):
                for name, column in zip(names, columns):
                    places: dict[str, list[int]] = {}
                    for place, token in enumerate(column[i]):
                        places.setdefault(token, []).append(place)
                    rows += [(t, name, p) for t, p in places.items()]
                    at += [i] * len(places)
            token, field, places = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), keys.take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["token", "chunk_id", "field", "places"])

    each = tokens.mapInArrow(run, f"token string, chunk_id {dict(chunks.dtypes)['chunk_id']}, field string, places array<int>")
    postings = each.select(_bucket(F.col("token"), buckets).alias("bucket"), "token", "chunk_id", "field", "places")
    return Index(postings, tokens.select("chunk_id", sum((F.size(c) for c in S.WEIGHTS), F.lit(0)).alias("d")), buckets, True)


def write(index: Index, path: str) -> None:
    """Keeps an index: postings in a folder for each bucket, sorted by token so that row groups can be skipped; a bucket that
    a stop word makes large is written by several tasks."""
    index.postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def load(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), buckets)


def _phrase_finder(names: list[str]):
    """As search's, from the postings of one chunk after another."""
    number = S.numbered(names)
    longer: dict[str, list[tuple[int, list[str]]]] = {}
    for p, k in number.items():
        if " " in p:
            longer.setdefault(p.split(" ", 1)[0], []).append((k, p.split(" ")))

    def hits(of: list[tuple[str, str, list[int]]]) -> tuple[int, dict[int, float]]:
        into: dict[int, float] = {}
        by = {(field, token): places for token, field, places in of}
        for token, field, places in of:
            weight = S.WEIGHTS[field]
            if (k := number.get(token)) is not None:
                into[k] = into.get(k, 0.0) + weight * len(places)
            for k, parts in longer.get(token, ()):
                starts = set(places)
                for i, part in enumerate(parts):
                    if not starts:
                        break
                    starts &= {p - i for p in by.get((field, part), ())}
                if starts:
                    into[k] = into.get(k, 0.0) + weight * len(starts)
        return sum(len(p) for _, _, p in of), into

    def run(batches):
        import pyarrow as pa

        last, of, kind = None, [], None
        for batch in batches:
            done = []
            kind = batch.schema.field(0).type
            for key, *posting in zip(*(c.to_pylist() for c in batch.columns)):
                if of and key != last:
                    done.append((last, *hits(of)))
                    of = []
                last = key
                of.append(posting)
            if done:
                yield S.held_batch(pa.array([x[0] for x in done], kind), [x[1] for x in done], [x[2] for x in done])
        if of:
            d, found = hits(of)
            yield S.held_batch(pa.array([last], kind), [d], [found])

    return run


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """As search.bm25, from an index: only buckets and row groups with tokens of the queries are read.

    A phrase's places in a field are those of its first token that each other token has at its distance.
    """
    wanted = S.phrases(queries)
    if index.together and (batch := S.wanted_rows(wanted)) is not None:
        held = S.hold(index.postings.select("chunk_id", "token", "field", "places"), _phrase_finder([r.phrase for r in batch])).checkpoint()
        docs, avg_d = index.lengths.agg(F.count("*"), F.avg("d")).first()  # chunks without tokens too
        return S.scored_in_tasks(held, batch, dict(queries.dtypes)["query_id"], docs, avg_d)
    rows = wanted.select("phrase").distinct().limit(S.FEW_PHRASES + 1).collect()  # bounded by the queries
    postings = index.postings
    parts = wanted.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("i", "token"))
    if len(rows) <= S.FEW_PHRASES:
        tokens = sorted({t for r in rows for t in r.phrase.split(" ")})
        buckets = sorted({r[0] for r in queries.sparkSession.createDataFrame([(t,) for t in tokens], "token string").select(_bucket(F.col("token"), index.buckets)).collect()})
        postings = postings.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))
        parts = F.broadcast(parts)
    found = postings.join(parts, "token").select("phrase", "chunk_id", "field", "i", F.transform("places", lambda p: p - F.col("i")).alias("starts"))
    size = F.size(F.split("phrase", " "))
    met = found.groupBy("phrase", "chunk_id", "field").agg(F.count("*").alias("n"), F.collect_list("starts").alias("starts")).where(F.col("n") == size)  # as many arrays as the phrase has tokens
    times = F.size(F.aggregate(F.slice("starts", F.lit(2), size), F.col("starts")[0], F.array_intersect))
    weight = F.coalesce(*(F.when(F.col("field") == c, F.lit(w)) for c, w in S.WEIGHTS.items()))
    hits = met.withColumn("times", times).where("times > 0").groupBy("phrase", "chunk_id").agg(F.sum(weight * F.col("times")).alias("f")).join(index.lengths, "chunk_id")
    corpus = index.lengths.agg(F.count("*").alias("docs"), F.avg("d").alias("avg_d"))
    return S.scored(hits, wanted, corpus, len(rows) <= S.FEW_PHRASES)
