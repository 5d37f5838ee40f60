"""P9: sources mixed to target weights, by Pfair scheduling with earliest deadlines first.

A source of weight w is a task whose j-th block may start at slot floor(j / w) and must be done by slot ceil((j + 1) / w).
In every slot the released block with the earliest deadline goes out, so at any moment each source is less than one
block away from its share. The axis of slots is cut into periods of equal length; how many blocks a source has had at a
period's start is its share rounded, which needs arithmetic only, and each period is scheduled by itself, in parallel.
Within a period a source strays less than one quantum from the line between its bounds, these stray one quantum at most
from its share, and a block is two quanta. Records find their quantum by their place in their source's stream, which comes
from sums in two steps and never sorts a source in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

#: Tokens of a block, the most a source strays from its share; it doesn't depend on the size of the data.
BLOCK_TOKENS = 4_096
#: Least and greatest number of slots of a period. Beyond the greatest, that is for sources of less than a millionth of all
#: blocks, a source's few blocks go out where their time comes and the others share the rest.
PERIOD, LONGEST = 4_096, 4_000_000
#: Pieces a source's stream is cut into for its running sums.
PIECES = 1_024


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) in the order of slots. blocks: how many blocks each source gives; its weight is its share of all."""
    total = sum(blocks.values())
    weight = {s: Fraction(n, total) for s, n in blocks.items() if n}
    waiting = [(0, s, 0) for s in sorted(weight)]  # (release, source, block)
    ready: list[tuple[int, int, int, str, int]] = []
    heapq.heapify(waiting)
    order = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            end = ceil((j + 1) / weight[s])
            # ties as in PD: first the block whose window overlaps the next one's, then the heavier source
            overlap = end - floor((j + 1) / weight[s])
            heapq.heappush(ready, (end, -overlap, -blocks[s], s, j))
        if not ready:  # only if rounding leaves a slot free: the next block goes out early
            _, s, j = heapq.heappop(waiting)
        else:
            _, _, _, s, j = heapq.heappop(ready)
        order.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (floor((j + 1) / weight[s]), s, j + 1))
    return order


class Periods:
    """How many blocks each source gives in each period, from the number of its blocks alone."""

    def __init__(self, blocks: dict[str, int], shortest: int = PERIOD, longest: int = LONGEST) -> None:
        self.all = {s: n for s, n in sorted(blocks.items()) if n > 0}
        self.total = sum(self.all.values())
        # a source with two blocks a period never has fewer at its end than at its start
        self.rare = {s for s, n in self.all.items() if 2 * self.total > longest * n}
        common = [n for s, n in self.all.items() if s not in self.rare]
        self.length = max(shortest, -(-2 * self.total // min(common)) if common else longest)
        self.count = max(1, self.total // self.length)  # the last one takes what is left

    def start(self, k: int) -> int:
        return self.total if k >= self.count else k * self.length

    def given(self, k: int) -> dict[str, int]:
        """Blocks each source has given before period k; they add up to the period's start."""
        t, n = self.start(k), self.total
        out = {s: (2 * self.all[s] * t + n) // (2 * n) for s in self.rare}
        left, share = t - sum(out.values()), self.total - sum(self.all[s] for s in self.rare)
        upto = before = 0
        for s, b in self.all.items():
            if s not in self.rare:
                upto += b
                now = (2 * upto * left + share) // (2 * share)
                out[s], before = now - before, now
        return out

    def plan(self, k: int) -> list[tuple[int, str, int]]:
        """(slot, source, block) of period k."""
        a, b = self.given(k), self.given(k + 1)
        return [(self.start(k) + i, s, a[s] + j) for i, (s, j) in enumerate(schedule({s: max(0, b[s] - a[s]) for s in a}))]


def slots_of(spark: SparkSession, blocks: dict[str, int], **lengths: int) -> DataFrame:
    """(slot, source, block) of all blocks; every task schedules periods of its own."""
    periods = Periods(blocks, **lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = periods.plan(k)
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["slot", "source", "block"])

    n = periods.count if periods.total else 0
    return spark.range(0, n, 1, max(1, min(n, 1_000))).mapInArrow(run, "slot long, source string, block long")


def tokens_given(have: dict[str, int], targets: dict[str, tuple[float, int | None]], wanted: int | None = None, exact_shares: bool = False) -> dict[str, float]:
    """Tokens each source gives: its share of what was asked for, or of as many tokens as all sources have, but no more than
    its cap on repeats allows; such a source falls short. With exact_shares the mixture is made smaller until none does.
    Sources without tokens can give nothing and don't limit the others."""
    have = {s: n for s, n in have.items() if n > 0 and targets[s][0] > 0}
    total = wanted if wanted is not None else sum(have.values())
    most = {s: targets[s][1] * n for s, n in have.items() if targets[s][1] is not None}
    if exact_shares:
        total = int(min([total, *(m / targets[s][0] for s, m in most.items())]))
    return {s: float(min(targets[s][0] * total, most.get(s, float("inf")))) for s in have}


def mix(sizes: DataFrame, targets: list[tuple[str, float, int | None]], id_col: str = "doc_id", *, wanted: int | None = None, block_tokens: int = BLOCK_TOKENS, exact_shares: bool = True) -> DataFrame:
    """(slot, source, id, repeat, n_tokens, offset): the mixture's records; (slot, offset) is their order.

    sizes: (id, source, n_tokens). targets: (source, share, most repeats or None for no cap). A record is used repeat + 1
    times at most, never more often than the cap. A source may give more than its share by one record at most. exact_shares:
    whether a source whose cap doesn't allow its share makes the whole mixture smaller, or falls short alone. Records of
    other or null sources and records without tokens are left out; repeated rows are records of their own."""
    spark = sizes.sparkSession
    goal = {s: (share, cap) for s, share, cap in targets if s is not None and share}
    # a stable shuffle: records in the order of a hash, whose leading bits name the piece of the stream
    h = F.xxhash64(F.lit("mix"), id_col)
    rows = sizes.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0)).select("source", id_col, "n_tokens", h.alias("_h"), F.pmod(F.shiftright(h, 40), F.lit(PIECES)).cast("int").alias("_piece"))
    sums = materialise(rows.groupBy("source", "_piece").agg(F.sum("n_tokens").alias("_n")), "pieces")  # at most PIECES rows a source
    have = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("_n").alias("n")).collect()}
    need = tokens_given(have, goal, wanted, exact_shares)
    size = max(block_tokens // 2, 1)
    slots = slots_of(spark, {s: ceil(n / size) for s, n in need.items()})
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))).select("source", "_piece", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "_piece").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = rows.withColumn("_in", inside).join(before, ["source", "_piece"]).withColumn("_at", F.col("_in") + F.col("_before"))
    known = F.create_map(*[x for s in need for x in (F.lit(s), F.struct(F.lit(have[s]).cast("long").alias("have"), F.lit(need[s]).alias("need")))]) if need else F.lit(None).cast("map<string,struct<have:long,need:double>>")
    of = placed.withColumn("_s", F.element_at(known, F.col("source")))
    times = F.ceil((F.col("_s.need") - F.col("_at")) / F.col("_s.have"))
    used = of.where(times >= 1).select("source", id_col, "n_tokens", "_at", "_s", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("repeat"))
    used = used.withColumn("offset", F.col("_at") + F.col("repeat") * F.col("_s.have")).withColumn("block", F.floor(F.col("offset") / F.lit(size)))
    return used.join(slots, ["source", "block"]).select("slot", "source", id_col, "repeat", "n_tokens", "offset")


def reached_shares(mixed: DataFrame, targets: list[tuple[str, float, int | None]], id_col: str = "doc_id") -> DataFrame:
    """(source, target_share, actual_share, tokens, records, most_used) of every target, those that gave nothing included."""
    spark = mixed.sparkSession
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), (F.max("repeat") + 1).alias("most_used"))
    goal = spark.createDataFrame([(s, float(p) if p is not None else None) for s, p, _ in targets], "source string, target_share double")
    zero = F.lit(0).cast("long")
    both = goal.join(per, "source", "left").select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("most_used", zero).alias("most_used"))
    return both.select("source", "target_share", F.round(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), zero), 6).alias("actual_share"), "tokens", "records", "most_used")
