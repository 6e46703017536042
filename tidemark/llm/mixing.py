"""Mixing sources to target shares of all tokens by balanced sampling (the cube method).

The mixture is as large as the caps on repeats allow. A document of source s is expected share_s * T / tokens_s times in
it: the whole part of that is given to all, the fraction is drawn. The draw moves the vector of fractions through the
null space of the constraints (number of documents, number of tokens), so both totals stay as expected, until at most
as many fractions as constraints are left in a block. Those tend to be the largest texts, whose rounding would show, so
each block also leaves some middling texts undecided as ballast. Both go on to blocks of blocks; at the last the
large ones are rounded, the ballast's fractions make up for the tokens that changes, and the ballast is drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import with_token_counts
from tidemark.session import ensure_checkpoint_dir, table

BLOCK = 1024  # documents of one source balanced together in one call
FAN_IN = 256  # blocks whose undecided documents meet at the next level
BALLAST = 128  # middling texts that each block leaves undecided, at most; of a small block half the texts
SEED = 20240229
EPS = 1e-9


def flight(p: list[float], sizes: list[float], rng: np.random.Generator, tokens_only: bool = False) -> list[float]:
    """Moves p until at most two (one with tokens_only) entries are neither 0 nor 1.

    The sum of p * sizes stays as it is, and without tokens_only the sum of p too.
    """
    p = list(p)
    live: list[int] = []
    need = 2 if tokens_only else 3
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(live) == need:
            if tokens_only:
                a, b = (sizes[j] for j in live)
                u = [b, -a]
            else:
                a, b, c = (sizes[j] for j in live)
                u = [c - b, a - c, b - a]  # orthogonal to (1, 1, 1) and to the sizes
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            up = min((1 - p[j]) / x if x > 0 else p[j] / -x for j, x in zip(live, u) if x)
            down = min(p[j] / x if x > 0 else (1 - p[j]) / -x for j, x in zip(live, u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for j, x in zip(live, u):
                p[j] = min(1.0, max(0.0, p[j] + step * x))
            live = [j for j in live if EPS < p[j] < 1 - EPS]
    return [float(round(x)) if x <= EPS or x >= 1 - EPS else x for x in p]


def draw(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, landing: bool) -> np.ndarray:
    """One block: p after the flight, ballast and at most two others undecided; with landing, all decided."""
    p = p.astype(float).copy()
    middle = np.argsort(np.abs(sizes - np.median(sizes)), kind="stable")
    n = min(BALLAST, len(p) // 2)
    ballast, rest = middle[:n], middle[n:][::-1]
    p[rest] = flight(p[rest].tolist(), sizes[rest].tolist(), rng)
    if landing:
        last = rest[(p[rest] > EPS) & (p[rest] < 1 - EPS)]
        rounded = (rng.random(len(last)) < p[last]).astype(float)
        owed = float(np.dot(sizes[last], p[last] - rounded))  # tokens that rounding took, for the ballast to give; 0 on average
        # The ballast gives them in proportion, and as far as it could whichever way the rounding went: so no text's
        # expectation changes.
        most, least = float(np.dot(sizes[last], p[last])), float(np.dot(sizes[last], 1 - p[last]))
        p[last] = rounded
        gives = p[ballast] * (1 - p[ballast])
        room = float(np.dot(sizes[ballast], gives))
        if room and owed:
            p[ballast] += owed * gives / room * min(1.0, room / max(most * p[ballast].max(), least * (1 - p[ballast]).max()))
            p[ballast] = p[ballast].clip(0, 1)
        order = ballast[np.argsort(-sizes[ballast], kind="stable")]
        p[order] = flight(p[order].tolist(), sizes[order].tolist(), rng)
        order = order[(p[order] > EPS) & (p[order] < 1 - EPS)]
        p[order] = flight(p[order].tolist(), sizes[order].tolist(), rng, tokens_only=True)
        p = np.where((p > EPS) & (p < 1 - EPS), rng.random(len(p)) < p, np.round(p)).astype(float)
    return p


_DRAW = "source string, doc_id bigint, tokens int, base int, p double, block bigint"


def _fly(landing: bool, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([SEED, level, int(key[1]) & 0x7FFFFFFF, len(pdf)])
        return pdf.assign(p=draw(pdf.p.to_numpy(), pdf.tokens.to_numpy(), rng, landing))[["source", "doc_id", "tokens", "base", "p", "block"]]

    return run


def plan_mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, share, docs, source_tokens, rate: how often a document of each source is expected.

    Sources that occur in no document (or have no tokens) drop out and their share is spread over the others in
    proportion. Null and non-positive shares and caps count as no target.
    """
    have = sized.where("tokens > 0").groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("source_tokens"))
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_ = Window.partitionBy(F.lit(1))  # one row a target source
    both = wanted.join(have, "source").withColumn("share", F.col("target_share") / F.sum("target_share").over(all_))
    size = F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("share")).over(all_)
    return both.withColumn("rate", F.least(F.col("max_repeats").cast("double"), F.col("share") * size / F.col("source_tokens")))


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, doc_id, tokens, copies: every document used, with how often.

    sized: doc_id, source, tokens; documents without tokens are not used. Deterministic: the same documents give the
    same mixture. A source's documents are balanced in blocks, so a huge source is as many tasks as it has blocks.
    """
    ensure_checkpoint_dir(sized.sparkSession)
    plan = plan_mixture(sized, targets)
    expected = sized.where("tokens > 0").join(F.broadcast(plan.select("source", "docs", "rate")), "source")  # as many rows as targets
    base = F.floor(F.col("rate") + EPS).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BLOCK)))
    drawn = expected.select("source", "doc_id", "tokens", base.alias("base"), F.greatest(F.lit(0.0), F.col("rate") - base).alias("p"), F.pmod(F.xxhash64("doc_id", "source"), blocks).alias("block"))
    whole = drawn.where(f"p <= {EPS}")
    decided = [whole.select("source", "doc_id", "tokens", F.col("base").alias("copies"))]
    rest = drawn.where(f"p > {EPS}")
    left, level = int(plan.agg(F.max(blocks)).first()[0] or 1), 0
    while left:  # as many levels as it takes until each source is one block, and that is decided whole
        flown = rest.groupBy("source", "block").applyInPandas(_fly(left == 1, level), _DRAW).checkpoint()
        done = flown.where("p in (0.0, 1.0)")
        decided.append(done.select("source", "doc_id", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")))
        rest = flown.where("p not in (0.0, 1.0)").withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)))
        left, level = 0 if left == 1 else -(-left // FAN_IN), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.where("copies > 0")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return with_token_counts(table(spark, sf_dir, "documents")).checkpoint()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target_share, actual_share, docs_used, tokens_used, most_copies, max_repeats: for every source with a target."""
    sized = _sized(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    used = mix(sized, targets).groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return targets.join(used, "source", "left").select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens_used"), F.lit(0)) / F.sum("tokens_used").over(Window.partitionBy(F.lit(1))), 6).alias("actual_share"), zero("docs_used"), zero("tokens_used"), zero("most_copies"), "max_repeats"
    )


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
