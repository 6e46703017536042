"""From texts to index rows: paragraph chunks and what the index keeps of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def _windows(p: Column, size: Column, overlap: Column) -> Column:
    """A paragraph longer than size as windows of size, each repeating overlap characters; a step is one at least."""
    step = F.greatest(size - overlap, F.lit(1))
    last = F.ceil((F.length(p) - size) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: T.strip(F.substr(p, i * step + 1, size)))


def paragraph_chunks(text: Column, size: Column | int = 900, overlap: Column | int = 120) -> Column:
    """Paragraphs packed into chunks of at most `size` characters; longer ones cut by a sliding window.

    Null and blank texts give an empty array. A fold in the JVM: what is done, and the chunk being filled.
    """
    size, overlap = (F.lit(x) if isinstance(x, int) else x for x in (size, overlap))
    parts = F.filter(F.transform(F.split(T.strip(F.coalesce(text, F.lit(""))), r"\n\s*\n"), T.strip), lambda p: p != "")
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        done, open_ = acc["done"], acc["open"]
        joined = F.when(open_ == "", p).otherwise(F.concat(open_, F.lit("\n\n"), p))
        flushed = F.when(open_ == "", done).otherwise(F.array_append(done, open_))
        return (
            F.when(F.length(joined) <= size, F.struct(done.alias("done"), joined.alias("open")))
            .when(F.length(p) <= size, F.struct(flushed.alias("done"), p.alias("open")))
            .otherwise(F.struct(F.concat(flushed, _windows(p, size, overlap)).alias("done"), F.lit("").alias("open")))
        )

    return F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("open")), step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def reindex(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after sources were indexed anew: whatever it had of a (source_type, source_ref) that fresh has is gone."""
    return index.join(fresh.select("source_type", "source_ref").distinct(), ["source_type", "source_ref"], "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def chunk_entries(entries: DataFrame) -> DataFrame:
    """memory_chunks rows of entries: one for each chunk that is not blank; repeated rows give repeated chunks."""
    size, overlap = F.coalesce("chunk_size", F.lit(900)).cast("int"), F.coalesce("overlap", F.lit(120)).cast("int")
    return entries.select("*", F.posexplode(paragraph_chunks(F.col("content"), size, overlap)).alias("chunk_index", "chunk")).where("trim(chunk) <> ''").select(
        F.concat_ws(":", "entry_id", "chunk_index").alias("chunk_id"), F.lit("entry").alias("source_type"), F.col("entry_id").alias("source_ref"), F.coalesce("project_key", F.lit(T.GLOBAL_PROJECT)).alias("project_key"),
        "namespace", "agent_id", F.lit(None).cast("string").alias("session_id"), "kind", "title", F.col("chunk").alias("content"), F.array_join(T.normalize_tags(F.col("tags")), " ").alias("tags"),
        T.default_visibility(F.col("kind"), F.col("visibility"), F.col("recipient_id")).alias("visibility"), "recipient_id", F.lit(False).alias("is_sidechain"), "chunk_index", F.col("created_at").alias("ts"),
    )
