"""P8: fixed-capacity containers filled with whole texts, by Karmarkar-Karp multiway differencing.

Texts are dealt to groups by hash; a group of bounded size is packed by one task. A partial partition is a list of
container sums; the two of widest spread are merged with opposing imbalances, the largest sum of one with the smallest of
the other, until one near-equal partition is left. Where a container then exceeds the capacity, it trades items with
containers that have room; for items that this leaves over the number of containers rises.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one group; each group leaves less than a few containers' room, so larger groups waste less.
GROUP_ITEMS = 10_000


def difference(sizes: list[int], k: int) -> list[tuple[int, tuple]]:
    """k-way Karmarkar-Karp: at most k (sum, tree of item numbers), near-equal sums."""
    # an entry: (-spread, tie, [(-sum, tie, tree)] from the largest sum on); places that are missing hold 0
    heap = [(-s, i, [(-s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # b's largest sums take a's empty places, the others meet a's sums from the smallest on
        free = k - len(a)
        met = [a.pop() for _ in range(len(b) - free)]
        put = b[:free]
        for x, y in zip(met, b[free:]):
            put.append((x[0] + y[0], tie, (x[2], y[2])))
            tie += 1
        if len(put) <= 8:
            for x in put:
                insort(a, x)
        else:
            a = sorted(a + sorted(put))
        heapq.heappush(heap, ((a[-1][0] if len(a) == k else 0) * -1 + a[0][0], tie, a))
        tie += 1
    return [(-s, t) for s, _, t in heap[0][2]]


def leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, tuple):
            stack += t
        else:
            out.append(t)
    return out


def settle(boxes: list[list[int]], sizes: list[int], capacity: int, look: int = 120) -> tuple[list[list[int]], list[int]]:
    """(boxes of which none exceeds the capacity, items that found no room). A box with too much trades an item for a
    smaller one of a box with room (or gives it away), the trade that just ends the excess first, else the largest one. Where no trade helps, the smallest item that ends the excess, or the largest one,
    is taken out; in the end such items go to the box with the least room that holds them."""
    held = [sorted((sizes[i], i) for i in b) for b in boxes]
    left = [capacity - sum(s for s, _ in b) for b in held]
    room = sorted((r, n) for n, r in enumerate(left) if r > 0)
    spare: list[tuple[int, int]] = []
    for n in sorted((n for n, r in enumerate(left) if r < 0), key=lambda n: left[n]):
        while left[n] < 0:
            excess, best = -left[n], None  # best: (done, gain, place in room, item, item in return)
            for k in range(len(room) - 1, max(-1, len(room) - 1 - look), -1):
                r, m = room[k]
                for x in held[n]:
                    # the largest item in return that ends the excess, or none
                    at = bisect_right(held[m], (x[0] - excess, capacity)) - 1
                    y = held[m][at] if at >= 0 else (0, -1)
                    gain = x[0] - y[0]
                    if gain > r:  # too much for the room there: the smallest in return that still fits
                        at = bisect_left(held[m], (x[0] - r, -1))
                        y = held[m][at] if at < len(held[m]) else (0, -1)
                        gain = x[0] - y[0]
                    if 0 < gain <= r and (best is None or (gain >= excess, -gain if gain >= excess else gain) > best[:2]):
                        best = (gain >= excess, -gain if gain >= excess else gain, k, x, y)
                if best and best[0]:
                    break
            if best is None:
                at = bisect_left(held[n], (excess, -1))
                x = held[n].pop(at if at < len(held[n]) else -1)
                left[n] += x[0]
                spare.append(x)
                continue
            _, _, k, x, y = best
            r, m = room.pop(k)
            held[n].remove(x)
            insort(held[m], x)
            if y[1] >= 0:
                held[m].remove(y)
                insort(held[n], y)
            gain = x[0] - y[0]
            left[n], left[m] = left[n] + gain, r - gain
            if left[m] > 0:
                insort(room, (left[m], m))
        if left[n] > 0:
            insort(room, (left[n], n))
    lost = []
    for x in sorted(spare, reverse=True):
        at = bisect_left(room, (x[0], -1))
        if at == len(room):
            lost.append(x[1])
            continue
        r, m = room.pop(at)
        held[m].append(x)
        if r > x[0]:
            insort(room, (r - x[0], m))
    return [[i for _, i in b] for b in held], lost


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; no sum exceeds the capacity. Sizes must be from 1 to capacity."""
    alone = [[i] for i, s in enumerate(sizes) if s == capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    if not rest:
        return alone
    own = [sizes[i] for i in rest]
    large = sum(2 * s > capacity for s in own)
    least = max(-(-sum(own) // capacity), large, 1)

    boxes, lost = settle([leaves(t) for _, t in difference(own, least)], own, capacity)
    while lost:  # the number of containers rises by what these items need
        part = [own[i] for i in lost]
        k = max(-(-sum(part) // capacity), sum(2 * s > capacity for s in part), 1)
        more, left = settle([leaves(t) for _, t in difference(part, k)], part, capacity)
        boxes += [[lost[j] for j in b] for b in more if b]
        lost = [lost[j] for j in left]
    return alone + [[rest[j] for j in b] for b in boxes if b]


def pieces(sizes: DataFrame, id_col: str, capacity_col: str) -> DataFrame:
    """One row per text, or per part of at most the capacity of a longer text; empty texts have none."""
    n = F.col("n_tokens")
    c = F.col(capacity_col).cast("long")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n / c) - 1), lambda k: F.struct(k.alias("part"), (k * c).alias("start"), F.least(c, n - k * c).alias("size")))
    return sizes.where((n > 0) & (c > 0)).select("*", F.explode(parts).alias("_p")).select(*sizes.columns, "_p.*")


def pack_records(sizes: DataFrame, plans: list[tuple[str, int]], id_col: str = "doc_id", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(plan, container, id, part, start, size). sizes: (id, n_tokens). A record larger than the capacity is cut into
    parts of the capacity and a rest; all others stay whole. Records without tokens, and plans without a capacity, have
    no row; repeated ids are packed each for itself. Every token lies in exactly one container of each plan."""
    plan_rows = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(int(c)).cast("long").alias("capacity")) for p, c in plans if c and c > 0])
    items = pieces(sizes.select(id_col, "n_tokens", F.explode(plan_rows).alias("_plan")).select(F.col(id_col).alias("_id"), "n_tokens", "_plan.*"), "_id", "capacity")
    # parts of exactly the capacity fill a container alone; how many items the others are decides the number of groups
    counts = items.where("size < capacity").groupBy("plan").agg(F.count("*").alias("n")).collect()
    groups = {r["plan"]: -(-r["n"] // group_items) for r in counts}
    of_plan = F.coalesce(*[F.when(F.col("plan") == p, F.lit(g)) for p, g in groups.items()], F.lit(1)) if groups else F.lit(1)
    whole = items.where("size = capacity").select("plan", F.concat_ws("-", F.lit("w"), F.col("_id").cast("string"), F.col("part").cast("string")).alias("container"), "_id", "part", "start", "size")
    dealt = items.where("size < capacity").select("plan", "capacity", F.pmod(F.xxhash64("_id", "part"), of_plan).cast("int").alias("_group"), "_id", "part", "start", "size")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        plan, number = key[0].as_py(), key[1].as_py()
        group = group.sort_by([("size", "descending"), ("_id", "ascending"), ("part", "ascending")])
        boxes = pack(group["size"].to_pylist(), group["capacity"][0].as_py())
        order = [i for b in boxes for i in b]
        names = [f"{number}-{k}" for k, b in enumerate(boxes) for _ in b]
        t = group.take(pa.array(order))
        return pa.table([pa.array([plan] * len(order)), pa.array(names), t["_id"], t["part"], t["start"], t["size"]], names=["plan", "container", "_id", "part", "start", "size"])

    kind = dict(items.dtypes)["_id"]
    packed = dealt.groupBy("plan", "_group").applyInArrow(run, f"plan string, container string, _id {kind}, part long, start long, size long")
    return packed.unionByName(whole).withColumnRenamed("_id", id_col)


def fill_report(packed: DataFrame, plans: list[tuple[str, int]]) -> DataFrame:
    """(plan, containers, tokens, fill): fill is the used share of all containers' capacity."""
    capacity = F.coalesce(*[F.when(F.col("plan") == p, F.lit(int(c))) for p, c in plans if c])
    boxes = packed.groupBy("plan", "container").agg(F.sum("size").alias("s"))
    return boxes.groupBy("plan").agg(F.count("*").alias("containers"), F.sum("s").alias("tokens"), F.max("s").alias("largest")).select("plan", "containers", "tokens", "largest", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))

