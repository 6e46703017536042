"""Event rows reassembled into conversations, and the sessions that give none.

A session may hold a third of all rows, so no task ever sees a session whole. Rows first meet by (session, seq), where
replays collapse and conflicts show. The automaton that validates turns then runs over blocks of BLOCK numbers: its run
over a block is summed up as (first turn, last turn, fault inside), and such summaries compose. Blocks of blocks are
folded the same way until one summary a session is left; every array folded has at most BLOCK elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

BLOCK = 1024
LEVELS = 3  # covers BLOCK ** LEVELS numbers a session, a thousand million; beyond, the last array only grows longer
# Spellings of the two speakers.
USER, ASSISTANT = ("user", "human"), ("assistant", "ai", "model")
WHITE = r"^\s*$"


def speaker(role: Column, kind: Column) -> Column:
    """user or assistant by role; by kind where role is null; any other role comes back in lower case."""
    r = F.lower(F.btrim(role, F.lit(" \t\r\n")))
    return F.when(role.isNull(), F.when(kind == "prompt", "user").when(kind == "reply", "assistant")).when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant").otherwise(r)


def is_turn(kind: Column, content: Column, sidechain: Column) -> Column:
    """Prompts and replies outside side chains whose content is not blank; a null flag counts as no side chain."""
    return F.coalesce(kind.isin("prompt", "reply") & ~F.coalesce(sidechain, F.lit(False)) & content.isNotNull() & ~content.rlike("(?U)" + WHITE), F.lit(False))


def _numbers(events: DataFrame) -> DataFrame:
    """One row for each (session_id, seq): whether contents differ, whether it holds a prompt or reply, whether a turn's role contradicts its kind."""
    turn = is_turn(F.col("kind"), F.col("content"), F.col("is_sidechain"))
    said = F.coalesce(F.sha2("content", 256), F.lit(""))
    return events.where("session_id is not null").groupBy("session_id", "seq").agg(
        (F.min(said) != F.max(said)).alias("conflict"),
        F.max(turn & (F.col("kind") == "prompt")).alias("asks"),
        F.max(turn & (F.col("kind") == "reply")).alias("answers"),
        F.max(turn & (speaker(F.col("role"), F.col("kind")) != F.when(F.col("kind") == "prompt", "user").otherwise("assistant"))).alias("clash"),
    )


def _fold(items: Column) -> Column:
    """Composes summaries (first, last, fault) in order. first and last: p, r or null for a block without turns.

    Sound is (prompt reply+)+: after a prompt comes a reply; what comes first and last is judged at the end.
    """
    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            F.coalesce(acc["first"], x["first"]).alias("first"),
            F.coalesce(x["last"], acc["last"]).alias("last"),
            (acc["fault"] | x["fault"] | F.coalesce((acc["last"] == "p") & (x["first"] == "p"), F.lit(False))).alias("fault"),
        )

    start = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("fault"))
    return F.aggregate(items, start, step)


def session_soundness(events: DataFrame) -> DataFrame:
    """session_id, sound, reason, turns: one row for each session that has event rows.

    reason is the first that holds of: conflict, gap, role, start, unanswered, empty; null for sound sessions. Rows
    without session_id are left out; a null seq is a number of its own, which cannot be missing. Hermes sessions skip
    numbers. Exact copies and replays count once.
    """
    n = _numbers(events)
    one = F.struct(
        F.coalesce("seq", F.lit(-1)).alias("at"),
        F.when(F.col("asks"), "p").when(F.col("answers"), "r").alias("first"),
        F.when(F.col("answers"), "r").when(F.col("asks"), "p").alias("last"),
        F.lit(False).alias("fault"),
    )
    sums = (
        F.max("conflict").alias("conflict"), F.max("clash").alias("clash"), F.count("seq").alias("numbers"), F.max("seq").alias("highest"), F.min("seq").alias("lowest"),
        F.sum(F.col("asks").cast("bigint") + F.col("answers").cast("bigint")).alias("turns"),
    )
    level = n.groupBy("session_id", F.floor(F.coalesce("seq", F.lit(-1)) / F.lit(BLOCK)).alias("block")).agg(*sums, F.sort_array(F.collect_list(one)).alias("items")).withColumn("run", _fold(F.col("items"))).drop("items")
    for i in range(LEVELS - 1):
        last = i == LEVELS - 2
        item = F.struct(F.col("block").alias("at"), F.col("run.first").alias("first"), F.col("run.last").alias("last"), F.col("run.fault").alias("fault"))
        keys = ["session_id"] if last else ["session_id", F.floor(F.col("block") / F.lit(BLOCK)).alias("block")]
        level = level.groupBy(*keys).agg(
            F.max("conflict").alias("conflict"), F.max("clash").alias("clash"), F.sum("numbers").alias("numbers"), F.max("highest").alias("highest"), F.min("lowest").alias("lowest"), F.sum("turns").alias("turns"),
            F.sort_array(F.collect_list(item)).alias("items"),
        ).withColumn("run", _fold(F.col("items"))).drop("items")
    gap = ~F.col("session_id").startswith("hermes-") & F.coalesce((F.col("numbers") != F.col("highest") + 1) | (F.col("lowest") != 0), F.lit(False))
    reason = (
        F.when(F.col("conflict"), "conflict").when(gap, "gap").when(F.col("clash"), "role").when(F.col("turns") == 0, "empty").when(F.col("run.first") == "r", "start").when(F.col("run.fault") | (F.col("run.last") == "p"), "unanswered")
    )
    return level.select("session_id", reason.isNull().alias("sound"), reason.alias("reason"), "turns")


def conversations(events: DataFrame) -> DataFrame:
    """session_id, turn_no, seq, speaker, content: the turns of sound sessions in order, counted from 0.

    Numbered without sorting a session in one task: within blocks by seq, plus what the blocks before hold.
    """
    turns = events.where(is_turn(F.col("kind"), F.col("content"), F.col("is_sidechain"))).select("session_id", "seq", F.when(F.col("kind") == "prompt", "user").otherwise("assistant").alias("speaker"), "content", F.floor(F.col("seq") / F.lit(BLOCK)).alias("block"))
    turns = turns.dropDuplicates(["session_id", "seq", "speaker"])
    within = Window.partitionBy("session_id", "block").orderBy("seq", F.desc("speaker"))
    counted = turns.withColumn("i", F.row_number().over(within) - 1)
    blocks = turns.groupBy("session_id", "block").agg(F.count("*").alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("session_id").orderBy("block")) - F.col("n")).drop("n")
    sound = session_soundness(events).where("sound").select("session_id")
    return counted.join(before.join(sound, "session_id", "left_semi"), ["session_id", "block"]).select("session_id", (F.col("before") + F.col("i")).alias("turn_no"), "seq", "speaker", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = session_soundness(table(spark, sf_dir, "session_events").select("session_id", "seq", "role", "kind", "content", "is_sidechain")).where("sound").select("session_id")
    known = table(spark, sf_dir, "session_upserts").where("session_id is not null").select("session_id").distinct()
    return known.join(sound, "session_id", "left_anti")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "session_events").select("session_id", "seq", "role", "kind", "content", "is_sidechain"))


_TURNS_SQL = """
    ev as (select session_id, seq, kind, content,
                  case when role is null then case kind when 'prompt' then 'user' when 'reply' then 'assistant' end
                       when lower(trim(role)) in ('user', 'human') then 'user' when lower(trim(role)) in ('assistant', 'ai', 'model') then 'assistant' else lower(trim(role)) end as who,
                  kind in ('prompt', 'reply') and not coalesce(is_sidechain, false) and content is not null and not regexp_full_match(content, '\\s*') as turn
           from session_events where session_id is not null),
    turns as (select distinct session_id, seq, kind from ev where turn),
    steps as (select *, lead(kind) over (partition by session_id order by seq, kind) as nxt, row_number() over (partition by session_id order by seq, kind) as i from turns),
    bad as (
        select session_id from (select session_id, seq from ev group by 1, 2 having count(distinct coalesce(content, '')) > 1)
        union select session_id from (select session_id, max(seq) as m, count(distinct seq) as c from ev group by 1) where not starts_with(session_id, 'hermes-') and c <> m + 1
        union select session_id from ev where turn and who <> case kind when 'prompt' then 'user' else 'assistant' end
        union select session_id from steps where (i = 1 and kind = 'reply') or (kind = 'prompt' and (nxt is null or nxt = 'prompt')))"""
ORACLES = {
    "p5_found": f"with {_TURNS_SQL} select distinct session_id from session_upserts where session_id in (select session_id from bad) or session_id not in (select session_id from turns)",
    "p5_conversations": f"""with {_TURNS_SQL},
        said as (select session_id, seq, kind, min(content) as content from ev where turn group by 1, 2, 3)
        select session_id, cast(row_number() over (partition by session_id order by seq, kind) - 1 as bigint) as turn_no, seq, case kind when 'prompt' then 'user' else 'assistant' end as speaker, content
        from said where session_id not in (select session_id from bad)""",
}
QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations}
