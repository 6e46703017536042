"""The tables of this project seen as the engine's model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread, table

AS_OF = "2026-12-01 00:00:00"

CHUNKS_SQL = """chunks as (
    select 'd' || doc_id as chunk_id, 'entry' as source_type, 's' || (doc_id // 2) as source_ref, coalesce(project_key, '__global__') as project_key, source as namespace,
           'agent-' || (doc_id % 7) as agent_id, doc_kind as kind, substr(coalesce(text, ''), 1, 60) as title, coalesce(text, '') as content, concat_ws(' ', lower(lang), source) as tags,
           case doc_id % 4 when 1 then 'private' when 2 then 'broadcast' else 'shared' end as visibility, 'agent-' || (doc_id % 5) as recipient_id, doc_id % 11 = 0 as is_sidechain, created_at as ts
    from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    mod = lambda n: F.col("doc_id") % n
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.lit("entry").alias("source_type"), F.concat(F.lit("s"), F.expr("doc_id div 2")).alias("source_ref"), F.coalesce("project_key", F.lit("__global__")).alias("project_key"),
        F.col("source").alias("namespace"), F.concat(F.lit("agent-"), mod(7)).alias("agent_id"), F.lit(None).cast("string").alias("session_id"), F.col("doc_kind").alias("kind"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"), F.concat_ws(" ", F.lower("lang"), "source").alias("tags"), F.when(mod(4) == 1, "private").when(mod(4) == 2, "broadcast").otherwise("shared").alias("visibility"),
        F.concat(F.lit("agent-"), mod(5)).alias("recipient_id"), (mod(11) == 0).alias("is_sidechain"), F.col("created_at").alias("ts"),
    )


BATCH_SQL = "queries as (select doc_id as query_id, text as query from documents where doc_id % 100 = 0 and text is not null)"


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every hundredth document's whole text; only the limit on a query's terms bounds it."""
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def one(spark: SparkSession, query: str) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))


LINKS_SQL = """links as (
    select a.project_key, b.project_key as linked_project_key from projects a join projects b on a.repo_root is not null and b.repo_root is not null and a.git_remote is not null and b.git_remote is null
    and split_part(a.display_name, '-', 1) = split_part(b.display_name, '-', 1) and a.project_key <> b.project_key)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links between projects that share the first word of their names."""
    p = table(spark, sf_dir, "projects").where("repo_root is not null").select("project_key", F.col("git_remote").isNotNull().alias("remote"), F.split_part("display_name", F.lit("-"), F.lit(1)).alias("word"))
    a, b = p.where("remote").drop("remote"), p.where("not remote").select(F.col("project_key").alias("linked_project_key"), "word")
    return a.join(b, "word").where("project_key <> linked_project_key").select("project_key", "linked_project_key")


VECTORS_SQL = "vectors as (select 'd' || vec_id as chunk_id, 'p' || label as project_key, embedding::double[] as embedding from embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), F.concat(F.lit("p"), "label").alias("project_key"), "embedding")


QUERY_VECTORS_SQL = "query_vectors as (select vec_id as query_id, embedding::double[] as embedding from embeddings where vec_id % 100 = 0)"


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
