"""Events as streams: idempotent ingest, session rollups and states, delivery in batches, the embedding queue.

Devices may be offline for months, so no watermark ever drops a late row: repeats are kept out at the sink, by the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions import text as T
from tidemark.operators import model as M

IDLE = "30 minutes"
SUMMARY_EVERY = 25
DELIVERY_ROWS = 200
EMBED_BATCH, EMBED_ATTEMPTS = 32, 6


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


BUCKETS = 256  # folders of the event log, by session


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system it names or is the default."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def event_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The event log as append_new keeps it; an empty one where there is none yet. schema: that of its rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path).drop("bucket")


def append_new(batch: DataFrame, out: str) -> None:
    """Appends the rows of a batch whose (session_id, seq) is not stored; a batch that is run again adds nothing.

    The log has a folder for each of BUCKETS hashes of session_id. Only the keys in the folders that the batch falls into
    are read, and only within those are rows compared. Large folders are written by several tasks.
    """
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
    fresh = M.first_arrivals(batch).withColumn("bucket", bucket)
    if _exists(spark, out):
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
        keys = ("session_id", "seq", "bucket")
        stored = spark.read.schema(", ".join(f"{c} {'int' if c == 'bucket' else dict(batch.dtypes)[c]}" for c in keys)).parquet(out).where(F.col("bucket").isin(touched))
        fresh = fresh.join(stored, list(keys), "left_anti").select(*fresh.columns)
    fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(out)


def ingest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Writes a stream of event rows to the event log, each event once. Returns the query."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df, out))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")).start()


def rollup_stream(stream: DataFrame) -> DataFrame:
    """session_id, event_count, token_estimate, last_event_at, kept up to date (update or complete mode)."""
    return M.session_rollup(stream)


_STATES = "session_id string, status string, event_count bigint, unsummarized bigint, last_event_us bigint, rolling_due boolean, final_due boolean, reopened boolean"
_STATE = "count bigint, fresh bigint, newest bigint, status string"
IDLE_MS = 30 * 60 * 1000


def next_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, every: int = SUMMARY_EVERY, timer: bool = True) -> Iterator[pd.DataFrame]:
    """One step of a session's state machine: events make it active again whatever it was and set the timer anew; when the
    timer runs out an active session turns idle and its final summary is due."""
    count, fresh, newest, status = state.get if state.exists else (0, 0, -(2**62), "new")
    due = final = reopened = False
    if state.hasTimedOut:
        status, final = "idle", True
    else:
        for pdf in frames:
            n = pdf.seq.nunique()
            count, fresh, newest = count + n, fresh + n, max(newest, int(pdf.at_us.max()))
        due, reopened, status = fresh >= every, status in ("idle", "closed"), "active"
        if timer:
            state.setTimeoutDuration(IDLE_MS)
    state.update((count, 0 if due or final else fresh, newest, status))
    yield pd.DataFrame({"session_id": [key[0]], "status": [status], "event_count": [count], "unsummarized": [fresh], "last_event_us": [newest], "rolling_due": [due], "final_due": [final], "reopened": [reopened]})


def session_states(stream: DataFrame, every: int = SUMMARY_EVERY, timer: bool = True) -> DataFrame:
    """A row for each session a batch touches or whose half hour without events ran out: its count, newest event, whether a
    rolling or the final summary is due, and whether it was at rest before.

    Replayed numbers within a batch count once; across batches the ingest has kept them out. The timer runs on arrival,
    as devices send months late; for rest at a given time see idle. A stream that is to end (availableNow) runs without
    the timer, as Spark keeps a timed one going.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from next_state(key, frames, state, every, timer)

    at = F.unix_micros(M.event_time(F.col("ts"), F.col("received_at")))
    rows = stream.where("session_id is not null and seq is not null").select("session_id", "seq", at.alias("at_us"))
    return rows.groupBy("session_id").applyInPandasWithState(step, _STATES, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def idle(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions with active ones that rested for half an hour turned idle."""
    rested = (F.col("status") == "active") & (F.col("last_event_at") < as_of - F.expr(f"interval {IDLE}"))
    return sessions.withColumn("status", F.when(rested, "idle").otherwise(F.col("status")))


RUN = 10_000  # numbers of one session delivered by one task


def deliver(batch: DataFrame, send: Callable[[str, list], None], size: int = DELIVERY_ROWS) -> dict[str, int]:
    """Sends a micro-batch in parcels of at most `size` rows, a session's rows together in each; for foreachBatch.

    Runs where the partitions are, over Arrow batches; a long session is dealt to several tasks by runs of RUN numbers.
    At least once: an error stops the partition, and the batch comes again.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sent = parcels = 0
        parcel: list = []

        def flush() -> None:
            by: dict[str, list] = {}
            for r in parcel:
                by.setdefault(r["session_id"], []).append(r)
            for session, events in by.items():
                send(session, events)
            parcel.clear()

        for arrow in batches:
            for row in arrow.to_pylist():
                parcel.append(row)
                if len(parcel) == size:
                    sent, parcels = sent + len(parcel), parcels + 1
                    flush()
        if parcel:
            sent, parcels = sent + len(parcel), parcels + 1
            flush()
        yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64()), "parcels": pa.array([parcels], pa.int64())})

    dealt = batch.repartition("session_id", F.floor(F.col("seq") / RUN)).sortWithinPartitions("session_id", "seq")
    done = dealt.mapInArrow(run, "sent long, parcels long").agg(F.sum("sent"), F.sum("parcels")).first()
    return {"delivered": done[0] or 0, "batches": done[1] or 0}


# ---- embedding queue ------------------------------------------------------------------------------------------------
def hash_embedding(text: Column, width: int = 64) -> Column:
    """A vector of hashed tokens of length one, in place of a model: the default embedder."""
    slots = F.transform(T.index_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    counts = T.bind(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    return T.bind(counts, lambda c: T.bind(norm(c), lambda n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)).cast("float"))))


def enqueue(queue: DataFrame, chunks: DataFrame, at: Column) -> DataFrame:
    """The queue with chunks (chunk_id) put in anew: one that waits already starts again, without failed attempts."""
    fresh = chunks.select("chunk_id").distinct().select("chunk_id", at.alias("enqueued_at"), F.lit(0).alias("attempts"), at.alias("next_attempt_at"))
    return queue.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "enqueued_at", "attempts", "next_attempt_at").unionByName(fresh)


def due(queue: DataFrame, as_of: Column, batch: int | None = EMBED_BATCH) -> DataFrame:
    """The next chunks to embed, first come first served; None: all that are due."""
    ready = queue.where((F.col("next_attempt_at") <= as_of) & (F.col("attempts") < EMBED_ATTEMPTS))
    return ready if batch is None else ready.orderBy("enqueued_at", "chunk_id").limit(batch)


def drain(queue: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], as_of: Column, width: int = 64, batch: int | None = EMBED_BATCH) -> tuple[DataFrame, DataFrame]:
    """(vectors, queue) after one round: embedded chunks leave the queue, failed ones wait twice as long each time, and
    vectors of another width are parked for good. embed: text column -> array column, null where it failed. Without a
    batch the round is all rounds at as_of in one: what failed waits beyond as_of, so nothing comes twice."""
    work = due(queue, as_of, batch).join(chunks.select("chunk_id", "project_key", "content"), "chunk_id").withColumn("embedding", embed(F.col("content")))
    vectors = work.where(F.size("embedding") == width).select("chunk_id", "project_key", "embedding")
    failed = work.where(F.col("embedding").isNull() | (F.size("embedding") != width)).select("chunk_id", F.col("embedding").isNotNull().alias("parked"))
    rest = queue.join(vectors.select("chunk_id"), "chunk_id", "left_anti").join(failed, "chunk_id", "left")
    tries = F.when(F.col("parked"), F.lit(EMBED_ATTEMPTS)).when(~F.col("parked"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    later = F.when(F.col("parked").isNull(), F.col("next_attempt_at")).otherwise(F.timestamp_seconds(F.unix_timestamp(as_of) + T.backoff_seconds(tries)))
    return vectors, rest.withColumns({"attempts": tries, "next_attempt_at": later}).drop("parked")
