"""What is shown of sessions and projects: facts, extractive summaries, transcripts, briefs, related projects, graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

SHOWN_FILES, SHOWN_COMMANDS, KEPT_FILES = 8, 5, 40
BRIEF_SESSIONS, BRIEF_TOKENS, LISTED = 5, 500, 10
RELATED_FLOOR, RELATED_MOST = 0.4, 6
TRANSCRIPT_CHARS = 14000
OMITTED = "[... middle of session omitted ...]"


def _first_mentions(events: DataFrame, column: str, most: int) -> DataFrame:
    """session_id, <column>, place, total: the first `most` distinct values of an array column in order of mention.

    Distinct values are counted by partial aggregates; only the first few of a session are ranked.
    """
    each = events.select("session_id", "seq", F.posexplode(column).alias("i", column)).where(F.col(column).isNotNull()).groupBy("session_id", column).agg(F.min(F.struct("seq", "i")).alias("at"))
    total = each.groupBy("session_id").agg(F.count("*").alias("total"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("at"))).where(F.col("place") <= most).join(total, "session_id").select("session_id", column, "place", "total")


def session_facts(events: DataFrame) -> DataFrame:
    """session_id, prompts, replies, first_prompt, last_prompt, files, n_files, commands, n_commands of main-line events.

    events: stored events. files and commands hold the first KEPT_FILES and SHOWN_COMMANDS distinct ones in order. Side
    chains do not count; sessions without main-line events have no row.
    """
    main = events.where(~F.coalesce("is_sidechain", F.lit(False)))
    body = T.strip(F.col("content"))
    asked = (F.col("kind") == "prompt") & (body != "")
    said = main.groupBy("session_id").agg(
        F.count_if(asked).alias("prompts"), F.count_if((F.col("kind") == "reply") & (body != "")).alias("replies"),
        F.min_by(body, F.when(asked, F.col("seq"))).alias("first_prompt"), F.max_by(body, F.when(asked, F.col("seq"))).alias("last_prompt"),
    )
    listed = lambda c, most: _first_mentions(main, c, most).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c]).alias(c), F.max("total").alias(f"n_{c}"))
    none = F.array().cast("array<string>")
    return said.join(listed("files", KEPT_FILES), "session_id", "left").join(listed("commands", SHOWN_COMMANDS), "session_id", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("files", "commands")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_files", "n_commands")}
    )


def extractive_summary(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """session_id, summary: a few sentences put together from a session's facts, without any model.

    sessions: session_id, ai_title, tool, git_branch, event_count. Sessions without events have no row.
    """
    s = sessions.select("session_id", "ai_title", "tool", "git_branch", "event_count").join(facts, "session_id")
    title = F.coalesce(F.nullif("ai_title", F.lit("")), F.substring("first_prompt", 1, 120), F.lit("Untitled session"))
    some = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    more = F.when(F.col("n_files") > SHOWN_FILES, F.concat(F.lit(" (+"), (F.col("n_files") - SHOWN_FILES).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    text = F.concat_ws(
        " ", F.concat(F.rtrim(title, F.lit(".")), F.lit(".")),
        some(F.col("prompts") > 0, "Opened with: ", T.truncate_tokens(F.col("first_prompt"), 40)), some(F.col("prompts") > 1, "Most recent request: ", T.truncate_tokens(F.col("last_prompt"), 40)),
        some(F.col("n_files") > 0, "Files touched: ", F.array_join(F.slice("files", 1, SHOWN_FILES), ", "), more, "."), some(F.col("n_commands") > 0, "Commands run: ", F.array_join("commands", "; "), "."),
        F.concat(F.col("event_count").cast("string"), F.lit(" events on "), "tool", F.when(F.coalesce("git_branch", F.lit("")) != "", F.concat(F.lit(", branch "), "git_branch")).otherwise(F.lit("")), F.lit(".")),
    )
    return s.select("session_id", text.alias("summary"))


def summary_index_text(summary: Column, decisions: Column, threads: Column, files: Column) -> Column:
    """What the index holds of a summary: it, and its decisions, open threads and first twenty files on lines of their own."""
    line = lambda label, items, by: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, by)))
    return F.concat_ws("\n", summary, line("Decisions: ", decisions, "; "), line("Open threads: ", threads, "; "), line("Files: ", F.slice(files, 1, 20), ", "))


def transcript(events: DataFrame, most: int = TRANSCRIPT_CHARS) -> DataFrame:
    """session_id, part (head, tail or all), seq, line: a session's lines, the middle left out of long ones.

    A third of the characters goes to the head, the rest to the tail; a line that does not fit ends its part. As every
    line has five characters at least, only so many lines at either end are ranked, however long a session is.
    """
    body = T.strip(F.col("content"))
    label = F.when(F.col("kind") == "prompt", "USER").when(F.col("kind") == "reply", "ASSISTANT").when(F.col("kind") == "tool_use", "TOOL").otherwise(F.upper("kind"))
    lines = events.where(~F.coalesce("is_sidechain", F.lit(False)) & (body != "")).select("session_id", "seq", F.concat(F.lit("["), label, F.lit("] "), body).alias("line")).withColumn("size", F.length("line") + 1)
    total = lines.groupBy("session_id").agg((F.sum("size") - 1).alias("chars"))
    whole = lines.join(total.where(F.col("chars") <= most), "session_id").select("session_id", F.lit("all").alias("part"), "seq", "line")
    long_ = lines.join(total.where(F.col("chars") > most).select("session_id"), "session_id", "left_semi")
    head, tail = most // 3, most - most // 3

    def part(name: str, budget: int, order: Column) -> DataFrame:
        by = Window.partitionBy("session_id").orderBy(order)
        near = long_.withColumn("r", F.row_number().over(by)).where(F.col("r") <= budget // 5 + 1)
        used = near.withColumn("used", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        return used.where(F.col("used") <= budget).select("session_id", F.lit(name).alias("part"), "seq", "line")

    return whole.unionByName(part("head", head, F.col("seq").asc())).unionByName(part("tail", tail, F.col("seq").desc()))


def best_summaries(summaries: DataFrame) -> DataFrame:
    """One summary for each session, the final before the rolling one."""
    return summaries.groupBy("session_id").agg(F.min_by(F.struct(*[c for c in summaries.columns if c != "session_id"]), F.when(F.col("tier") == "final", 0).otherwise(1)).alias("s")).select("session_id", "s.*")


def brief_sessions(sessions: DataFrame, summaries: DataFrame, budget: int = BRIEF_TOKENS, most: int = BRIEF_SESSIONS, branch: str | None = None) -> DataFrame:
    """project_key, place, session_id, summary, decisions, open_threads, used: the sessions of every project's brief.

    The newest `most` main-line sessions of a project with anything to tell, as far as the budget goes, the first always;
    with a branch only those on it or on none that is known.
    sessions: session_id, project_key, ai_title, is_sidechain, last_event_at.
    """
    if not 100 <= budget <= 4000 or not 1 <= most <= 20:
        raise ValueError("a brief has 100 to 4000 tokens and 1 to 20 sessions")
    if branch is not None:
        sessions = sessions.where((F.col("git_branch") == branch) | F.col("git_branch").isNull())
    newest = Window.partitionBy("project_key").orderBy(F.desc_nulls_last("last_event_at"), "session_id")
    top = sessions.where(~F.coalesce("is_sidechain", F.lit(False))).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    told = top.join(best_summaries(summaries), "session_id", "left").withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), T.strip("ai_title"))).where("coalesce(summary, '') <> ''")
    by = Window.partitionBy("project_key").orderBy("place")
    told = told.withColumn("used", F.sum(T.estimate_tokens(F.col("summary")) + 20).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(by))
    return told.where((F.col("used") <= budget) | (F.col("r") == 1)).select("project_key", "place", "session_id", "summary", "decisions", "open_threads", "used")


def first_distinct(rows: DataFrame, key: str, value: str, order: list[str], most: int = LISTED) -> DataFrame:
    """key, place, value: the first `most` distinct values of each key in order; blank ones do not count."""
    once = rows.where(F.trim(value) != "").groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= most).select(key, "place", value)


MAX_REQUESTS = 10_000  # project keys asked for at once


def related_by_name(projects: DataFrame, counts: DataFrame, requests: DataFrame | list[str], roots: bool = False) -> DataFrame:
    """query_key, project_key, session_count: projects whose path is above or below a key's, or whose path has its last
    part; with roots also by the directories they are kept in. Projects without sessions do not count.

    requests: query_key (with roots also path, the directory one works in), or a list of keys; at most MAX_REQUESTS: a
    stated set that every task holds, against all projects.
    """
    if isinstance(requests, list):
        requests = projects.sparkSession.createDataFrame([(k,) for k in requests], "query_key string")
    if requests.limit(MAX_REQUESTS + 1).count() > MAX_REQUESTS:
        raise ValueError("more project keys than one request holds; ask in several")
    raw = lambda c: F.lower(T.bare_key(F.col(c)))
    known = projects.groupBy("project_key").agg(*([F.max("repo_root").alias("repo_root")] if roots else [])) if roots else projects.select("project_key").distinct()
    known = known.join(counts.where("session_count > 0"), "project_key")
    if roots:
        root, at, base = F.lower(F.coalesce("repo_root", F.lit(""))), F.lower("path"), F.lower(F.substring_index("path", "/", -1))
        near = (base != "") & (F.contains(F.lower("project_key"), base) | F.contains(root, base)) | (root != "") & (F.startswith(root, at) | F.startswith(at, root))
    else:
        n, k = raw("project_key"), raw("query_key")
        base = F.substring_index(k, "/", -1)
        near = F.startswith(n, F.concat(k, F.lit("/"))) | F.startswith(k, F.concat(n, F.lit("/"))) | ((base != "") & F.contains(n, base))
    return known.join(F.broadcast(requests), (F.col("project_key") != F.col("query_key")) & near).select("query_key", "project_key", "session_count")


def merge_related(by_name: DataFrame, by_meaning: DataFrame, counts: DataFrame) -> DataFrame:
    """query_key, place, project_key, session_count, why: by name first, most sessions first, then by meaning.

    by_meaning: query_key, project_key, score. A project found both ways counts as found by name.
    """
    a = by_name.select("query_key", "project_key", F.lit(0).alias("way"), F.col("session_count").cast("double").alias("score"))
    b = by_meaning.where((F.col("score") >= RELATED_FLOOR) & (F.col("project_key") != F.col("query_key"))).join(counts.where("session_count > 0").select("project_key"), "project_key", "left_semi").select("query_key", "project_key", F.lit(1).alias("way"), "score")
    best = a.unionByName(b).groupBy("query_key", "project_key").agg(F.min_by(F.struct("way", "score"), F.struct("way", -F.col("score"))).alias("f"))
    order = Window.partitionBy("query_key").orderBy("f.way", F.desc("f.score"), "project_key")
    top = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RELATED_MOST).join(counts, "project_key")
    why = F.when(F.col("f.way") == 0, "name/path match").otherwise(F.format_string("semantic match %.2f", F.col("f.score")))
    return top.select("query_key", "place", "project_key", "session_count", why.alias("why"))


RELATED_BELOW = 3  # sessions in a brief below which related projects are named


def compose_brief(projects: DataFrame, blocks: DataFrame, recorded: DataFrame, related: DataFrame) -> DataFrame:
    """The brief of each project: project_key, session_count, estimated_tokens, sessions, decisions, open_threads, related,
    message.

    blocks: see brief_sessions. recorded: project_key, place, decision, newest first. related: query_key, place,
    project_key, session_count, why; named only while there are fewer than RELATED_BELOW sessions. The lists are short:
    20 sessions, 10 decisions, 10 threads and RELATED_MOST projects at most.
    """
    text = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("place", name))), lambda x: x[name])
    base = blocks.groupBy("project_key").agg(F.count("*").alias("session_count"), F.max("used").alias("estimated_tokens"), text("session_id").alias("sessions"))
    told = blocks.select("project_key", F.lit(1).alias("way"), "place", F.posexplode("decisions").alias("i", "decision"))
    all_ = recorded.select("project_key", F.lit(0).alias("way"), "place", F.lit(0).alias("i"), "decision").unionByName(told)
    decisions = first_distinct(all_, "project_key", "decision", ["way", "place", "i"], 10).groupBy("project_key").agg(text("decision").alias("decisions"))
    threads = first_distinct(blocks.select("project_key", "place", F.posexplode("open_threads").alias("i", "thread")), "project_key", "thread", ["place", "i"], 10).groupBy("project_key").agg(text("thread").alias("open_threads"))
    line = F.format_string("%s (%d sessions, %s)", "project_key", "session_count", "why")
    others = related.withColumn("line", line).groupBy(F.col("query_key").alias("project_key")).agg(text("line").alias("related"))
    none = F.array().cast("array<string>")
    full = projects.select("project_key").distinct().join(base, "project_key", "left").join(decisions, "project_key", "left").join(threads, "project_key", "left").join(others, "project_key", "left")
    n = F.coalesce("session_count", F.lit(0)).cast("bigint")
    few = F.when(n < RELATED_BELOW, F.coalesce("related", none)).otherwise(none)
    message = F.when((n == 0) & (F.size("related") == 0), "Nothing is recorded for this project; start without assuming any history.").when(n == 0, "Nothing is recorded under this key; the same work may be under another one listed here.").when(F.size("related") > 0, "Little is recorded under this key; more may be under another one listed here.")
    return full.select("project_key", n.alias("session_count"), F.coalesce("estimated_tokens", F.lit(0)).cast("bigint").alias("estimated_tokens"), *(F.coalesce(c, none).alias(c) for c in ("sessions", "decisions", "open_threads")), few.alias("related")).withColumn("message", message)


def visible(projects: DataFrame, muted: list[str], solo: str | None = None) -> DataFrame:
    """Projects with a column visible: the one shown alone if there is one, muted or not; else those that are not muted."""
    key = F.col("project_key")
    return projects.withColumn("visible", key == solo if solo is not None else ~key.isin(muted) if muted else F.lit(True))


def by_activity(projects: DataFrame, last_active: Column, most: int) -> DataFrame:
    """project_key, place: the most recently active projects first; what is no timestamp comes last, and ties go by key."""
    top = projects.select("project_key", T.parse_ts(last_active).alias("at")).orderBy(F.desc_nulls_last("at"), "project_key").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("at"), "project_key"))).select("project_key", "place")  # of `most` rows


# ---- graph ----------------------------------------------------------------------------------------------------------
GRAPH_NODES, ROOT_PULL = 400, 0.72


def sphere(i: Column, n: Column, radius: float = 1.0) -> dict[str, Column]:
    """Coordinates of point i of n spread evenly over a sphere; the origin for a single one."""
    y = F.when(n > 1, 1 - i / (n - 1) * 2).otherwise(F.lit(0.0))
    r = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))).otherwise(F.lit(0.0))
    theta = F.lit(math.pi * (3 - math.sqrt(5))) * i
    return {"x": F.cos(theta) * r * radius, "y": y * radius, "z": F.sin(theta) * r * radius}


def normalized(df: DataFrame, span: float = 100.0) -> DataFrame:
    """x, y, z scaled so that the greatest of them is span."""
    top = df.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.max(F.abs("z"))).alias("_top"))
    f = F.when(F.col("_top") > 0, span / F.col("_top")).otherwise(F.lit(span))
    return df.join(F.broadcast(top), F.lit(True)).withColumns({c: F.col(c) * f for c in ("x", "y", "z")}).drop("_top")  # one row


def principal_axes(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, x, y, z: the vectors on their three principal axes, signs fixed by the largest component.

    Only sums and products of components are gathered, width by width numbers however many vectors there are.
    """
    import numpy as np
    import pandas as pd

    width = vectors.select(F.size(column)).first()
    if width is None:
        return vectors.select(key, *(F.lit(0.0).alias(c) for c in "xyz"))
    d = int(width[0])

    def moments(batches):
        n, s, m = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            x = np.array([v for v in pdf[column] if v is not None and len(v) == d], float)
            if len(x):
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    total = vectors.select(column).mapInPandas(moments, "n bigint, s array<double>, m array<double>")
    sums = total.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d))).first()
    cells = total.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
    n, mean = sums["n"], np.array([sums[f"s{i}"] for i in range(d)]) / sums["n"]
    values, axes = np.linalg.eigh(cells.reshape(d, d) / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:3]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    out = {}
    for c, j in zip("xyz", range(3)):
        a, shift = axes[:, j].tolist(), float(mean @ axes[:, j])
        out[c] = F.aggregate(F.zip_with(F.col(column), F.lit(a), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v) - shift
    return vectors.where(F.size(column) == d).select(key, *(e.alias(c) for c, e in out.items()))


def graph(sessions: DataFrame, positions: DataFrame | None = None, most: int = GRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest main-line sessions under their projects.

    sessions: session_id, project_key, display_name, ai_title, is_sidechain, last_event_at, event_count. positions:
    session_id, x, y, z of embedded sessions; with fewer than three of them all sessions go on a sphere, others go on an
    outer one.
    """
    newest = Window.orderBy(F.desc_nulls_last("last_event_at"), "session_id")
    top = sessions.where(~F.coalesce("is_sidechain", F.lit(False))).orderBy(F.desc_nulls_last("last_event_at"), "session_id").limit(most)

    def on_sphere(df: DataFrame, span: float) -> DataFrame:
        n = df.agg(F.count("*").alias("_n"))
        placed = df.withColumn("_i", F.row_number().over(newest) - 1).join(F.broadcast(n), F.lit(True))
        return normalized(placed.withColumns(sphere(F.col("_i"), F.col("_n"))).drop("_i", "_n"), span)

    if positions is not None and positions.join(top.select("session_id"), "session_id", "left_semi").limit(3).count() >= 3:
        inner = normalized(top.join(positions, "session_id"))
        placed = inner.unionByName(on_sphere(top.join(positions, "session_id", "left_anti"), 120.0))
    else:
        placed = on_sphere(top, 100.0)
    colour = placed.select("project_key").distinct().withColumn("color_index", F.row_number().over(Window.orderBy("project_key")) - 1)
    leaves = placed.join(colour, "project_key").select(
        F.concat(F.lit("session:"), "session_id").alias("id"), F.lit("session").alias("type"), F.coalesce(F.nullif("ai_title", F.lit("")), F.substring("session_id", 1, 8)).alias("label"), "project_key", "color_index", "x", "y", "z",
        (2.0 + F.least(F.lit(4.0), F.coalesce("event_count", F.lit(0)) / 200.0)).alias("size"),
    )
    roots = placed.groupBy("project_key").agg(F.coalesce(F.max("display_name"), T.display_name(F.col("project_key"))).alias("label"), *((F.avg(c) * ROOT_PULL).alias(c) for c in "xyz")).join(colour, "project_key").select(
        F.concat(F.lit("project:"), "project_key").alias("id"), F.lit("project").alias("type"), "label", "project_key", "color_index", "x", "y", "z", F.lit(6.0).alias("size")
    )
    edges = placed.select(F.concat(F.lit("project:"), "project_key").alias("source"), F.concat(F.lit("session:"), "session_id").alias("target"))
    return roots.unionByName(leaves), edges
