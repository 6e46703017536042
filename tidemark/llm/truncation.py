"""Texts that lost their end: a stack automaton for structure, and how sentences of the source end.

1. The automaton reads a text once: quotes, brackets, code fences, here-documents, loops, key blocks, a broken last
   character, an escape or an operator with nothing after it. What is left open decides; so do closing marks.
2. The rest ends without a terminator, as complete texts may. The baseline counts, for each source and over all of them,
   how often each word sequence was followed by a terminator and how often by more words, keyed by the sentence's opening
   and last two words and backing off to fewer. At each step the source's own counts are asked first, and those of all
   sources where the source's do not tell. A text whose tail goes on elsewhere but never ends there, or whose last word is
   only the beginning of words seen there, is cut. Rates decide: a tail tells that a text was cut if, with 95 %
   confidence, the rate at which it ends is below the stated one, however many texts there are.
3. What even the baseline cannot say is cut only if it has one of the lengths at which texts of its source pile up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import ensure_checkpoint_dir, table

# ---- fixed values ---------------------------------------------------------------------------------------------------
CUT_MARKS = re.compile(r"\s*(?:\[(?:truncated|cut|snip|clipped|\.\.\.|…)\]|\((?:truncated|cut|snip|clipped)\)|<(?:truncated|snip)>|\[\d+ (?:more )?(?:chars|characters|bytes)[^\]]*\])\s*$", re.I)
DOTS = re.compile(r"\s*(?:…|\.{3,})\s*$")
OPTIONS = (
    "output-format output no-cache exclude include recursive verbose quiet dry-run force all-targets release target-version features config configuration help version format filter limit message "
    "no-verify no-edit interactive delete archive progress header request data-raw data-binary data output-dir target target-dir directory file follow lines since until oneline graph stat "
    "ignore-case line-number count max-count context before-context after-context jobs parallel timeout retry retries password-stdin username namespace all-namespaces selector watch tail "
    "maxfail exitfirst durations capture extend-select select ignore fix unsafe-fixes show-fixes statistics no-fix preview show-source show-settings isolated build no-build detach remove-orphans volumes"
).split()
# The highest rates at which a tail may end elsewhere (upper end of the 95 % interval) for its text to count as cut.
SEQUENCE_ENDS, WORD_ENDS, BEGINNING_ENDS, COMMAND_BEGINNING_ENDS = 0.57, 0.17, 0.66, 0.44
PILE_SHARE = 0.45  # of the texts within ten characters, at the lower end of its 95 % interval
_OPENER, _CLOSER = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_END = re.compile(r"[.?!。！？]+[\"'”’»)\]]*(?=\s|$)|\n+")
_TERMINATED = re.compile(r"[.?!。！？][\"'”’»)\]*_]*$")
_OPERATORS = re.compile(r"(?:\|\||&&|(?<![|])\||;(?!;)|(?<!\\)\\|[0-9]*>>?|<<?|--?)$")
_SEGMENT = re.compile(r"\s+(?:&&|\|\||\||;)\s+|;\s+")
_PATH_EXT = re.compile(r"^[\"'(]*[\w.@~:+=$*-]*/[\w./@:+=*~-]*?(\.[A-Za-z]\w*)?[\"'),;:]*$")


def open_structure(text: str, command: bool) -> bool:
    """Whether quotes, brackets, fences, blocks or a last character are left open at the end."""
    if text[-1] == "�" or "\ud800" <= text[-1] <= "\udfff":
        return True
    if command:
        return _open_command(text)
    if len(re.findall(r"^\s*```|(?<=\s)```", text, re.M)) % 2 or "-----BEGIN " in text and text.rfind("-----BEGIN ") > text.rfind("-----END "):
        return True
    if re.search(r"(?<!\\)\\$", text):
        return True
    stack: list[str] = []
    quoted = False
    for line in text.split("\n"):
        if not line:  # brackets go on over a blank line, quotes do not
            quoted = False
        for i, c in enumerate(line):
            if c == '"' and (not i or line[i - 1] != "\\"):
                quoted = not quoted
            elif quoted:
                continue
            elif c in _OPENER:
                stack.append(_OPENER[c])
            elif c in _CLOSER and c in stack:
                while stack.pop() != c:
                    pass
    return quoted or bool(stack)


def _open_command(text: str) -> bool:
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        top = stack[-1] if stack else ""
        if top == "'":
            if c == "'":
                stack.pop()
        elif c == "\\":
            if i + 1 == n:
                return True
            i += 1
        elif top == '"':
            if c == '"':
                stack.pop()
            elif text.startswith("$(", i):
                stack.append(")")
                i += 1
        elif c in "'\"":
            stack.append(c)
        elif c == "(":
            stack.append(")")
        elif c == "{" and (i + 1 < n and (text[i + 1] == " " or i and text[i - 1] == "$")):
            stack.append("}")
        elif c in ")}" and top == c:
            stack.pop()
        i += 1
    if stack:
        return True
    if m := re.search(r"<<-?\s*['\"]?(\w+)['\"]?", text):
        if not re.search(rf"\b{m[1]}\b", text[m.end() :]):
            return True
    words = text.split()
    if words[0] in ("for", "while", "until") and "done" not in words[1:] and not any(w.rstrip(";") == "done" for w in words) or words[0] == "if" and not any(w.rstrip(";") == "fi" for w in words):
        return True
    if _OPERATORS.search(text.rstrip()):
        return True
    last = words[-1]
    if last.startswith("--") and "=" not in last:
        name = last[2:]
        return name not in OPTIONS and any(o.startswith(name) for o in OPTIONS)
    return False


def shape(token: str) -> str:
    """A word with what varies masked: digits, and of paths and options all but their kind."""
    token = re.sub(r"\d+", "9", token)
    if token.startswith("--") and "=" in token:
        return token.split("=", 1)[0].lower() + "="
    if re.match(r"[\"']?/?[\w.$~-]*/[\w./-]*:/", token):
        return "/:/"
    if "/" in token and (m := _PATH_EXT.match(token)):
        return "/" + (m[1] or "").lower()
    return token.lower().strip("\"'`,;:()[]{}") or token


def _sentences(text: str, command: bool) -> Iterator[tuple[list[str], bool]]:
    """(words, whether a terminator follows) of each sentence, or of each part of a command line."""
    at, piped = 0, []
    for m in (_SEGMENT if command else _END).finditer(text):
        if m.start() > at:
            yield piped + text[at : m.start()].split(), True
        at = m.end()
        piped = ["|"] if command and m[0].strip() == "|" else []  # what reads a pipe needs no file
    if at < len(text):
        yield piped + text[at:].split(), False


def _keys(words: list[str], i: int) -> tuple[str, str, str, str]:
    """Opening, the word before, the word at i, and its last run of letters."""
    last = shape(words[i])
    prev = shape(words[i - 1]) if i else "^"
    opening = " ".join(shape(w) for w in words[: min(2 + (words[0] == "|"), i + 1)])
    runs = re.findall(r"[^\W\d_]+", words[i])
    return opening, prev, last, (runs[-1].lower() if runs and words[i][-1].isalpha() else "")


def analyse(text: str | None, command: bool) -> tuple[str, str, str, str, str, int, int] | None:
    """verdict (cut, whole or ask), opening, prev, last, piece, length in code points and bytes; None for blank texts."""
    if text is None or not text.strip():
        return None
    sizes = len(text), len(text.encode("utf-8", "surrogatepass"))
    if not command and CUT_MARKS.search(text) or open_structure(text, command):
        return "cut", "", "", "", "", *sizes
    bare = text.rstrip()
    dotted = None if command else DOTS.search(bare)
    if dotted:
        bare = bare[: dotted.start()].rstrip()
    elif not command:
        if _TERMINATED.search(bare) or re.search(r"[`)\]};>\"'*]$", bare):
            return "whole", "", "", "", "", *sizes
        if re.search(r"[,(/=+&<\[{-]$", bare):
            return "cut", "", "", "", "", *sizes
    if command and bare[-1] in "\"')}`":  # what was open is closed
        return "whole", "", "", "", "", *sizes
    words: list[str] = []
    for words, _ in _sentences(bare, command):
        pass
    if not words:
        return "whole", "", "", "", "", *sizes
    if command and any(w != words[-1] and w.startswith(words[-1]) and len(w) > len(words[-1]) + 2 for w in words[1:-1]) and not words[-1].isdigit():
        return "cut", "", "", "", "", *sizes  # the beginning of another argument
    return "ask", *_keys(words, len(words) - 1), *sizes


_READ = (
    "field_name string, rec_id string, item_no bigint, source string, verdict string, opening string, prev string, last string, piece string, chars int, bytes int, "
    "counted string, level string, k1 string, k2 string, k3 string, ends bigint, goes_on bigint"
)


def _count(text: str, source: str, command: bool, ends: Counter, goes: Counter) -> None:
    """Adds the word sequences of a text of a source, each with what followed it. Dots at the end of a prompt end nothing:
    texts that were cut have them too, and would count as ends of their own tails."""
    if not command:
        text = DOTS.sub("", text)
    for words, terminated in _sentences(text, command):
        shapes = [shape(w) for w in words]
        n = len(shapes)
        opening = ""
        for i, last in enumerate(shapes):
            if i < 2 + (words[0] == "|"):
                opening = " ".join(shapes[: i + 1])
            final = i + 1 == n
            if final and not terminated and not command:
                break
            prev = shapes[i - 1] if i else "^"
            into = ends if final else goes
            into[source, "3", opening, prev, last] += 1
            into[source, "2", "", prev, last] += 1
            into[source, "1", "", "", last] += 1
            if words[i][-1].isalpha():
                into["", "p", "", "", re.findall(r"[^\W\d_]+", words[i])[-1].lower()] += 1


def _read(texts: DataFrame, command: bool) -> DataFrame:
    """One pass over the texts: a row for each that is not blank, and the task's counts of word sequences."""
    fields = StructType.fromDDL(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        ends: Counter = Counter()
        goes: Counter = Counter()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        def counted() -> pa.RecordBatch:
            rows = [(None,) * 11 + (*k, ends[k], goes[k]) for k in ends | goes]
            ends.clear()
            goes.clear()
            return out(rows)

        for batch in batches:
            rows = []
            for field, rec, item, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a := analyse(text, command)) is not None:
                    rows.append((field, rec, item, source, *a) + (None,) * 7)
                    _count(text, source or "", command, ends, goes)
            yield out(rows)
            if len(ends) + len(goes) > 200_000:  # bounds a task's memory; the shuffle adds up what is flushed twice
                yield counted()
        yield counted()

    return texts.select("field_name", "rec_id", "item_no", "source", "text").where("text is not null").mapInArrow(run, fields)


def judge(texts: DataFrame, command: bool) -> DataFrame:
    """field_name, rec_id, item_no, source, cut: a verdict on every text that is neither null nor blank.

    texts: field_name, rec_id, item_no, source, text. Repeated rows each get theirs. Works on whole texts.
    The texts are read once; what was read is small and goes to the shared checkpoint folder, as it is used three times.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    both = _read(texts, command).checkpoint()
    read = both.where("level is null").select("field_name", "rec_id", "item_no", "source", "verdict", "opening", "prev", "last", "piece", "chars")
    # Word sequences count for their source and, under *, for all; what is known of single words counts for all only.
    counts = both.where("level is not null").groupBy("counted", "level", "k1", "k2", "k3").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    counts = counts.withColumn("counted", F.explode(F.expr("if(level = 'p', array('*'), array(counted, '*'))")))
    # Beside each sequence, the proper beginnings of its last word (level b), and of its last run of letters (level q).
    begins = F.expr("""filter(array_append(
        case when level in ('2', 'p') and counted = '*' and length(k3) > 1 then transform(sequence(1, length(k3) - 1), i -> named_struct('level', if(level = '2', 'b', 'q'), 'k2', k2, 'k3', left(k3, i), 'ends', 0L, 'goes_on', ends + goes_on))
             else array() end, named_struct('level', level, 'k2', k2, 'k3', k3, 'ends', ends, 'goes_on', goes_on)), x -> x is not null)""")
    stats = counts.select("counted", "k1", F.explode(begins).alias("x")).groupBy("counted", F.col("x.level").alias("level"), "k1", F.col("x.k2").alias("k2"), F.col("x.k3").alias("k3")).agg(F.sum("x.ends").alias("ends"), F.sum("x.goes_on").alias("goes_on"))

    # Only the distinct tails of a source ask the baseline, so a tail that a third of all texts share costs one row.
    ask, decided = read.where("verdict = 'ask'").withColumn("source", F.coalesce("source", F.lit(""))), read.where("verdict <> 'ask'")
    tail_key = ["source", "opening", "prev", "last", "piece"]
    tails = ask.select(*tail_key).distinct()
    none, own, every = F.lit(""), F.col("source"), F.lit("*")
    keys = [(of, lv, k1, k2, F.col("last")) for of in (own, every) for lv, k1, k2 in (("3", F.col("opening"), F.col("prev")), ("2", none, F.col("prev")), ("1", none, none))]
    keys += [(every, "b", none, F.col("prev"), F.col("last")), (every, "p", none, none, F.col("piece")), (every, "q", none, none, F.col("piece"))]
    asked = tails.select("*", F.explode(F.array(*(F.struct(of.alias("counted"), F.lit(lv).alias("level"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3")) for of, lv, k1, k2, k3 in keys))).alias("k")).select(*tail_key, "k.*")
    of = lambda level, col, all_: F.coalesce(F.max(F.when((F.col("level") == level) & ((F.col("counted") == "*") == all_), F.col(col))), F.lit(0))
    known = asked.join(stats, ["counted", "level", "k1", "k2", "k3"], "left").groupBy(*tail_key).agg(
        *(of(lv, c, a == "").alias(f"{n}{lv}{a}") for lv in "321" for a in ("s", "") for c, n in (("ends", "e"), ("goes_on", "c"))), of("b", "goes_on", True).alias("b2"), (of("p", "ends", True) + of("p", "goes_on", True)).alias("p1"), of("q", "goes_on", True).alias("q1")
    )
    known = known.select(*tail_key, F.expr(_tail_rule(command)).alias("tail"))
    judged = ask.join(known, tail_key, "left").withColumn("verdict", F.coalesce("tail", F.lit("ask"))).select(*decided.columns).unionByName(decided)
    # Lengths at which the texts of a source pile up: far more than of the lengths around.
    around = Window.partitionBy("source").orderBy("chars").rangeBetween(-10, 10)
    piles = read.where("chars >= 100").groupBy("source", "chars").agg(F.count("*").alias("n")).withColumn("near", F.sum("n").over(around)).where(F.expr(f"{_least('n', 'near')} >= {PILE_SHARE}")).select("source", "chars", F.lit(True).alias("full"))
    full = F.coalesce("full", F.lit(False))
    cut = (F.col("verdict") == "cut") | full & F.col("verdict").isin("ask", "weak")
    return judged.join(piles, ["source", "chars"], "left").select("field_name", "rec_id", "item_no", "source", cut.alias("cut"))


def _interval(k: str, n: str, sign: str) -> str:
    """SQL of an end of Wilson's 95 % interval of a rate of k in n."""
    return f"((({k}) / ({n}) + 1.9208 / ({n}) {sign} 1.96 * sqrt(({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + 0.9604 / (({n}) * ({n})))) / (1 + 3.8416 / ({n})))"


def _least(k: str, n: str) -> str:
    return _interval(k, n, "-")


def _below(ends: str, goes_on: str, rate: float) -> str:
    """SQL: a sequence was seen, and ends at less than the rate."""
    return f"coalesce({_interval(ends, f'nullif({ends} + {goes_on}, 0)', '+')} < {rate}, false)"


def _tail_rule(command: bool) -> str:
    """SQL of what a tail says: cut, whole, weak (only a full field cuts it) or ask. e, c: how often a sequence of three, two
    or one words ends and goes on, s in its source; p1: how often the last run of letters stands by itself; b2, q1: how often
    the last word or run only begins another one. Nothing asks for a count of 0, which no tail has in enough texts."""
    begins_run = f"piece <> '' and p1 * 20 < q1 and {_below('p1', 'q1', SEQUENCE_ENDS)}"
    steps = []
    if command:
        steps.append(f"when b2 > 0 and e2 * 20 < b2 and {_below('e2', 'b2', COMMAND_BEGINNING_ENDS)} or last rlike '^(/|--.*=$)' and {begins_run} then 'cut'")
    else:
        steps.append(f"when b2 > 0 and (e2 + c2) * 20 < b2 and {_below('e2 + c2', 'b2', BEGINNING_ENDS)} then 'cut'")
    for own in ("s", ""):
        e, c = f"e3{own}", f"c3{own}"
        if command:
            steps += [f"when {e} > 0 and {e} * 10 < {c} and {e} * 50 >= {c} then 'weak'", f"when {e} > 0 and {e} * 50 >= {c} then 'whole'"]
        else:
            steps.append(f"when {e} > 0 and {e} * 100 >= {c} then 'whole'")
    # A source in which a sequence has not ended yet does not outweigh others in which it does.
    steps.append(f"when {_below('e3', 'c3', SEQUENCE_ENDS)} then 'cut'")
    steps += [f"when e2{own} > 0 and e2{own} * 50 >= c2{own} then 'whole'" for own in ("s", "")]
    steps.append(f"when {_below('e2', 'c2', SEQUENCE_ENDS)} then 'cut'")
    steps.append(f"when e3 + e2 = 0 and {_below('0', 'b2', BEGINNING_ENDS)} then 'cut'")
    # The letters after the last digit of a key or an id say nothing.
    steps.append(f"when (e1 + c1) * 20 < q1 and not contains(last, '9') and {begins_run} then 'cut'")
    steps.append("when e1s > 0 or e1 > 0 then 'whole'")
    steps.append(f"when {_below('e1', 'c1', WORD_ENDS)} then 'cut'")
    return "case " + " ".join(steps) + " else 'ask' end"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_upserts").select(F.lit("last_prompt").alias("field_name"), F.col("upsert_id").cast("string").alias("rec_id"), F.lit(0).cast("bigint").alias("item_no"), F.coalesce("tool", F.lit("unknown")).alias("source"), F.col("last_prompt").alias("text"))


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, tool: the last a session named other than unknown; one row a session."""
    return table(spark, sf_dir, "session_upserts").where("session_id is not null").groupBy("session_id").agg(F.coalesce(F.max_by("tool", F.when(F.col("tool") != "unknown", F.struct("received_at", "upsert_id"))), F.lit("unknown")).alias("source"))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with the tool of their session. The tools of all sessions are broadcast only if Spark finds them small; else
    the join is by shuffle, where AQE splits a session that holds many of the rows."""
    rows = table(spark, sf_dir, "session_events").where("size(commands) > 0").select("event_id", "session_id", "commands").join(_tools(spark, sf_dir), "session_id", "left")
    return rows.select(F.lit("commands").alias("field_name"), F.col("event_id").alias("rec_id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.posexplode("commands").alias("item_no", "text")).withColumn("item_no", F.col("item_no").cast("bigint"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_prompts(spark, sf_dir), False).unionByName(judge(_commands(spark, sf_dir), True)).where("cut").select("field_name", "rec_id", "item_no")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool, field_name, texts, cut_texts, cut_share. A session's tool is the last it named other than unknown."""
    prompts = table(spark, sf_dir, "session_upserts").select(F.col("upsert_id").cast("string").alias("rec_id"), "session_id")
    judged = judge(_prompts(spark, sf_dir), False).join(prompts, "rec_id").join(_tools(spark, sf_dir).withColumnRenamed("source", "tool"), "session_id", "left")
    both = judged.select(F.coalesce("tool", F.lit("unknown")).alias("tool"), "field_name", "cut").unionByName(judge(_commands(spark, sf_dir), True).select(F.col("source").alias("tool"), "field_name", "cut"))
    return both.groupBy("tool", "field_name").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_share"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
