"""Filling containers of fixed capacity under control of the mixture: deficit round-robin over source queues.

Opening a container gives every source a quantum, its target share of the capacity. The source with the largest deficit
gives its largest item that still fits and pays for it; what a source could not spend stays its deficit for the next
container. The target is each source's share of all tokens, since every text has to be placed. Documents are dealt to
shards of bounded size that are packed on their own; a shard starts with the deficits the shards before it leave, which
prefix sums over shard totals, in two levels, tell without packing. What a shard leaves in poorly filled containers is taken out and
packed again with that of other shards.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import with_token_counts
from tidemark.session import ensure_checkpoint_dir, table

SHARD_TOKENS = 1_500_000  # tokens dealt to one shard, and so to one task
GROUP = 1_024  # shards whose totals one task sums up; the groups' totals are summed up on their own
FAN_IN = 32  # shards whose leftovers are packed together
WELL_FILLED = 0.98


def pack(items: list[tuple[int, str, int]], capacity: int, deficits: dict[str, float], shares: dict[str, float]) -> tuple[list[list[int]], list[int]]:
    """Containers (lists of positions in items) and their fills. items: (key, source, size), 0 < size <= capacity."""
    queues: dict[str, list[tuple[int, int]]] = {}
    for i, (_, source, size) in sorted(enumerate(items), key=lambda x: (x[1][2], x[1][0]), reverse=True):
        queues.setdefault(source, []).append((size, i))
    for q in queues.values():
        q.reverse()  # ascending: the largest that fits is found by bisection
    deficit = {s: deficits.get(s, 0.0) for s in queues}
    containers, fills = [], []
    while queues:
        room, content = capacity, []
        for s in queues:
            deficit[s] += shares.get(s, 0.0) * capacity
        while room and queues:
            for s in sorted(queues, key=lambda s: (-deficit[s], s)):
                q = queues[s]
                if q[0][0] <= room:
                    size, i = q.pop(bisect_right(q, (room, len(items))) - 1)
                    content.append(i)
                    room -= size
                    deficit[s] -= size
                    if not q:
                        del queues[s]
                    break
            else:
                break
        containers.append(content)
        fills.append(capacity - room)
    return containers, fills


_SLOT = "spec_name string, capacity int, shard bigint, source string, doc_id bigint, part_no int, start_token int, tokens int, container string, open boolean"


def _pack_group(level: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no"], kind="stable").reset_index(drop=True)
        capacity = int(pdf.capacity.iloc[0])
        first = pdf.drop_duplicates("source").fillna({"source": ""})
        source = pdf.source.fillna("")
        deficits, shares = dict(zip(first.source, first.deficit)), dict(zip(first.source, first.share))
        items = list(zip(pdf.index.tolist(), source.tolist(), pdf.tokens.tolist()))
        containers, fills = pack(items, capacity, deficits, shares)
        name, is_open = [""] * len(pdf), [False] * len(pdf)
        for c, (content, fill) in enumerate(zip(containers, fills)):
            for i in content:
                name[i] = f"{level}{key[1]}-{c}"
                is_open[i] = fill < WELL_FILLED * capacity
        return pdf.assign(container=name, open=is_open)[["spec_name", "capacity", "shard", "source", "doc_id", "part_no", "start_token", "tokens", "container", "open"]]

    return run


def _before(totals: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """totals (shard, group, keys, value) with the sum of the value over all shards before, in two levels: within a group
    of shards, and over the groups before it."""
    within = Window.partitionBy(*keys, "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy(*keys, "group").agg(F.sum(value).alias("sum"))
    over = Window.partitionBy(*keys).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a thousandth of the shards
    groups = groups.select(*keys, "group", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("earlier"))
    both = totals.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0))).join(groups, [*keys, "group"])
    return both.withColumn(name, F.col("inside") + F.col("earlier")).drop("inside", "earlier", "group")


def pack_documents(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, capacity, container, source, doc_id, part_no, start_token, tokens: where every text went, for each spec.

    sized: doc_id, source, tokens. specs: spec_name, capacity_tokens. A text over the capacity is cut into full parts and
    a rest, its part_no and start_token counted from 0; all others are whole. Texts without tokens (null or empty) need
    no place and get no row; a null source is a source of its own; specs without a positive capacity are left out.
    """
    ensure_checkpoint_dir(sized.sparkSession)
    sized = sized.where("tokens > 0")
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_TOKENS))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    fixed = specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("int").alias("capacity"))
    # Specs are a fixed table of a few rows: each document meets each spec once.
    parts = dealt.join(F.broadcast(fixed.agg(F.collect_list(F.struct("spec_name", "capacity")).alias("specs"))), F.lit(True)).select("doc_id", "source", "tokens", "shard", F.explode("specs").alias("spec"))
    parts = parts.select(
        "spec.spec_name", "spec.capacity", "shard", "source", "doc_id",
        F.explode(F.expr("transform(sequence(0, int((tokens - 1) div spec.capacity)), i -> named_struct('part_no', i, 'start_token', i * spec.capacity, 'tokens', int(least(tokens - i * spec.capacity, spec.capacity))))")).alias("p"),
    ).select("spec_name", "capacity", "shard", "source", "doc_id", "p.*")
    full = parts.where("tokens = capacity").select("*", F.concat_ws("-", F.lit("f"), "doc_id", "part_no").alias("container"))
    rest = parts.where("tokens < capacity")
    # Deficits at each shard's start: what the sources' targets and totals over the shards before it leave.
    totals = dealt.groupBy("shard", F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("tokens").alias("own")).withColumn("group", F.floor(F.col("shard") / F.lit(GROUP)))
    shares = totals.groupBy("s").agg((F.sum("own") / F.lit(float(total or 1))).alias("share"))
    grid = _before(totals, "own", "before", ["s"]).join(shares, "s")
    shard_totals = _before(totals.groupBy("shard", "group").agg(F.sum("own").alias("all")), "all", "all_before", [])
    start = grid.join(shard_totals, "shard").select("shard", "s", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("deficit"))
    ready = rest.join(start, (rest.shard == start.shard) & (F.coalesce(rest.source, F.lit("")) == start.s)).select(rest["*"], "share", "deficit")
    packed = ready.groupBy("spec_name", "shard").applyInPandas(_pack_group("a"), _SLOT).checkpoint()
    closed = packed.where("not open")
    left = packed.where("open").drop("container", "open").withColumn("shard", F.floor(F.col("shard") / F.lit(FAN_IN)))
    left = left.join(shares, F.coalesce(left.source, F.lit("")) == shares.s).select(left["*"], "share", F.lit(0.0).alias("deficit"))
    again = left.groupBy("spec_name", "shard").applyInPandas(_pack_group("b"), _SLOT)
    columns = ["spec_name", "capacity", "container", "source", "doc_id", "part_no", "start_token", "tokens"]
    return full.select(*columns).unionByName(closed.select(*columns)).unionByName(again.select(*columns))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_token_counts(table(spark, sf_dir, "documents"))
    ensure_checkpoint_dir(spark)
    return pack_documents(sized.checkpoint(), table(spark, sf_dir, "pack_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_name, containers, tokens, unused_share, mixture_error: how full containers are, and how far on average the
    sources' shares in a container that holds several texts are from their shares of all tokens (half the L1 distance)."""
    packed = p7_pack(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    packed = packed.checkpoint()
    per = packed.groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill"), F.countDistinct("doc_id").alias("texts"))
    fill = per.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.round(1 - F.sum("fill") / F.sum("capacity"), 6).alias("unused_share"))
    target = packed.groupBy("spec_name", "source").agg(F.sum("tokens").alias("t")).withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy("spec_name"))).drop("t")
    mixed = packed.groupBy("spec_name", "container", "source").agg(F.sum("tokens").alias("t")).join(per.where("texts > 1").select("spec_name", "container", "fill"), ["spec_name", "container"])
    # Sources a container lacks add their whole share: 1 minus the shares of those it has.
    error = mixed.join(target, ["spec_name", "source"]).groupBy("spec_name", "container").agg(((F.sum(F.abs(F.col("t") / F.col("fill") - F.col("share"))) + 1 - F.sum("share")) / 2).alias("e")).groupBy("spec_name").agg(F.round(F.avg("e"), 6).alias("mixture_error"))
    return fill.join(error, "spec_name", "left")


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill}
