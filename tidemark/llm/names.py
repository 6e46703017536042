"""What surnames end with, learned from the texts themselves.

Where a known given name, a title or a phrase that introduces people stands, the word beside it is a surname. One pass
counts, of each word, how often it stands so, and how often it stands elsewhere, capitalised or not. An ending whose
words are mostly surnames marks a surname that stands alone. Counts are added up by Spark; what comes back to the driver
is bounded: MAX_ENDINGS endings and a bitmap of BITMAP bytes. Rates decide, so ten times the texts give the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.session import ensure_checkpoint_dir

MAX_ENDINGS = 5_000  # endings that are shipped, those of most surnames; a language has a few hundred
BITMAP = 1 << 18  # bytes of the bitmap of ordinary words that end as surnames do
LENGTHS = (3, 4, 5)
LEAST_RATE = 0.5  # the least rate of surnames among the words of an ending, at the lower end of its 95 % interval
HELD = 200_000  # words a task counts before it hands them on
_WORD = re.compile(rf"(?<![\w@/.\\+-])[^\W\d_]{{{pii.LEAST_SURNAME},}}(?![\w@/\\(]|\.\w)")


@dataclass(frozen=True)
class Surnames:
    endings: tuple[str, ...] = ()
    ordinary: bytes = b""


def _counted(texts: DataFrame, given_names: tuple[str, ...]) -> DataFrame:
    """word, as_name, upper, lower: how often each word stands as a surname, capitalised at all, and in lower case."""
    schema = pa.schema([("word", pa.string()), ("as_name", pa.int64()), ("upper", pa.int64()), ("lower", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = pii.Finder(given_names)
        names: Counter = Counter()
        words: Counter = Counter()

        def counted() -> pa.RecordBatch:
            rows: dict[str, list[int]] = {}
            for w, n in words.items():
                rows.setdefault(w.lower(), [0, 0, 0])[1 if w[0].isupper() else 2] += n
            for w, n in names.items():
                rows.setdefault(w, [0, 0, 0])[0] += n
            names.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(3))], schema=schema)

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                words.update(_WORD.findall(text))
                for s, e, k in finder.spans(text, parts=False):
                    if k == "name":
                        names.update(w.lower() for w in _WORD.findall(text[s:e]) if w[0].isupper() and w.lower() not in finder.given and w.lower() not in pii.TITLES)
                if len(words) > HELD:
                    yield counted()
        yield counted()

    return texts.select("text").where("text is not null").mapInArrow(run, "word string, as_name long, upper long, lower long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("as_name", "upper", "lower")))


def learn(texts: DataFrame, given_names: tuple[str, ...]) -> Surnames:
    """The endings of surnames in all texts (a column text; nulls and empty ones say nothing), and the ordinary words that
    end so too. Texts without any name give none."""
    ensure_checkpoint_dir(texts.sparkSession)
    words = _counted(texts, given_names).checkpoint()
    surname = (F.col("as_name") > 0) & (F.col("as_name") * 4 >= F.col("upper")) & (F.col("lower") <= F.col("as_name"))
    ends = words.select(surname.alias("surname"), F.explode(F.array(*(F.when(F.length("word") > n, F.right("word", F.lit(n))) for n in LENGTHS))).alias("ending")).where("ending is not null")
    n, k, z = F.col("n"), F.col("k"), 1.96
    p = k / n
    least = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    best = ends.groupBy("ending").agg(F.count("*").alias("n"), F.count_if("surname").alias("k")).where("k > 0").where(least >= LEAST_RATE).orderBy(F.desc("k"), "ending").limit(MAX_ENDINGS)
    found = {r.ending for r in best.select("ending").collect()}
    endings = tuple(sorted(e for e in found if not any(e[-m:] in found for m in LENGTHS if m < len(e))))
    if not endings:
        return Surnames()
    # As ordinary counts what stands in lower case, or capitalised so often without being a name that it hardly is one.
    rate, upper = F.col("as_name") / F.col("upper"), F.col("upper")
    most = (rate + z * z / (2 * upper) + z * F.sqrt(rate * (1 - rate) / upper + z * z / (4 * upper * upper))) / (1 + z * z / upper)
    ordinary = words.where(~surname & ((F.col("lower") > F.col("as_name")) | (upper > 0) & (most < LEAST_RATE))).where(F.col("word").rlike("(?:" + "|".join(map(re.escape, endings)) + ")$"))
    bits = ordinary.select((F.crc32("word") % (8 * BITMAP)).alias("bit")).groupBy(F.expr("int(bit div 32)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("bits")).collect()
    bitmap = bytearray(BITMAP)
    for r in bits:
        bitmap[4 * r.at : 4 * r.at + 4] = int(r.bits).to_bytes(4, "little")
    return Surnames(endings, bytes(bitmap))
