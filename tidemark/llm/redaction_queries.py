"""Queries of problems 1 (personal information) and 6 (credentials)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import credentials, names, pii
from tidemark.llm.arrow import explode_texts
from tidemark.session import table

MAX_GIVEN_NAMES = 1_000_000  # names shipped to every task; a hub's list is far below


def given_names(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    found = [r[0] for r in table(spark, sf_dir, "given_names").select("given_name").where("given_name is not null").distinct().limit(MAX_GIVEN_NAMES + 1).collect()]
    if len(found) > MAX_GIVEN_NAMES:
        raise ValueError("given_names is larger than the list every task may hold")
    return tuple(sorted(found))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_id, text of event and entry contents."""
    events = table(spark, sf_dir, "session_events").select(F.lit("event_content").alias("field_name"), F.col("event_id").alias("rec_id"), F.col("content").alias("text"))
    entries = table(spark, sf_dir, "entries").select(F.lit("entry_content").alias("field_name"), F.col("entry_id").alias("rec_id"), F.col("content").alias("text"))
    return events.unionByName(entries)


def find_pii(texts: DataFrame, given: tuple[str, ...], surnames: names.Surnames = names.Surnames()) -> DataFrame:
    """field_name, rec_id, pii_kind, n: how often each kind occurs in each text. Null and empty texts give no row."""

    def make():
        finder = pii.Finder(given, surnames.endings, surnames.ordinary)

        def rows(field: str, rec: str, text: str | None) -> list[tuple]:
            counts: dict[str, int] = {}
            for _, _, kind in finder.spans(text):
                counts[kind] = counts.get(kind, 0) + 1
            return [(field, rec, kind, n) for kind, n in counts.items()]

        return rows

    return explode_texts(texts.select("field_name", "rec_id", "text").where("text is not null"), make, "field_name string, rec_id string, pii_kind string, n int")


def redact_pii(texts: DataFrame, given: tuple[str, ...], surnames: names.Surnames = names.Surnames()) -> DataFrame:
    """field_name, rec_id, text, n_redacted: every text, each span replaced by its kind in brackets. Null stays null."""

    def make():
        finder = pii.Finder(given, surnames.endings, surnames.ordinary)

        def rows(field: str, rec: str, text: str | None) -> list[tuple]:
            spans = finder.spans(text)
            return [(field, rec, pii.redact(text, spans), len(spans))]

        return rows

    return explode_texts(texts.select("field_name", "rec_id", "text"), make, "field_name string, rec_id string, text string, n_redacted int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, given = _contents(spark, sf_dir), given_names(spark, sf_dir)
    return find_pii(texts, given, names.learn(texts, given)).select("field_name", "rec_id", "pii_kind")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, given = _contents(spark, sf_dir), given_names(spark, sf_dir)
    return redact_pii(texts, given, names.learn(texts, given))


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, rec_id, texts: event content and last prompt as arrays of one, commands as they are."""
    events, upserts = table(spark, sf_dir, "session_events"), table(spark, sf_dir, "session_upserts")
    return (
        events.select(F.col("event_id").alias("rec_id"), F.map_from_arrays(F.array(F.lit("content"), F.lit("commands")), F.array(F.array("content"), "commands")).alias("fields"))
        .unionByName(upserts.select(F.col("upsert_id").cast("string").alias("rec_id"), F.create_map(F.lit("last_prompt"), F.array("last_prompt")).alias("fields")))
        .select("rec_id", F.explode("fields").alias("field_name", "texts"))
        .select("field_name", "rec_id", "texts")
    )


def find_secrets(texts: DataFrame) -> DataFrame:
    """field_name, rec_id, item_no, n: the number of secrets in each text that has any. texts: array of strings."""

    def make():
        finder = credentials.Finder()

        def rows(field: str, rec: str, items: list[str | None] | None) -> list[tuple]:
            return [(field, rec, i, n) for i, text in enumerate(items or ()) if (n := len(finder.spans(text)))]

        return rows

    return explode_texts(texts.where("size(texts) > 0"), make, "field_name string, rec_id string, item_no bigint, n int")


def redact_secrets(texts: DataFrame) -> DataFrame:
    """field_name, rec_id, texts, n_redacted: every array with the secret values replaced, nulls and order kept."""

    def make():
        finder = credentials.Finder()

        def rows(field: str, rec: str, items: list[str | None] | None) -> list[tuple]:
            if items is None:
                return [(field, rec, None, 0)]
            spans = [finder.spans(x) for x in items]
            return [(field, rec, [credentials.redact(x, s) for x, s in zip(items, spans)], sum(map(len, spans)))]

        return rows

    return explode_texts(texts, make, "field_name string, rec_id string, texts array<string>, n_redacted int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_secret_texts(spark, sf_dir)).select("field_name", "rec_id", "item_no")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_secrets(_secret_texts(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p6_found": p6_found, "p6_redacted": p6_redacted}
