"""P10: spans of at least `span` characters that stand verbatim in more than one record.

Super-k-mer partitioning: of every window of `span` characters the minimiser (the `anchor`-character piece with the
least hash) is found; consecutive windows with one minimiser are one super-k-mer and travel as one packed string to
the minimiser's bucket. Equal windows have equal minimisers, so a bucket decides alone which of its windows repeat.
Only super-k-mers whose minimiser stands in two records are packed at all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalikes import code_points, slices
from corpusloom.runtime import materialise

#: Code points worked on at once.
BLOCK = 2_000_000
#: Super-k-mers of one bucket that a task may hold; larger buckets are counted window by window in a shuffle.
BUCKET = 2_000
_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def piece_hashes(points: np.ndarray, length: int) -> np.ndarray:
    """Hash of every piece of length (a power of two) characters, by doubling; the last length-1 places are missing."""
    with np.errstate(over="ignore"):
        h, k, b = (points.astype(np.uint64) + np.uint64(1)) * _MIX, 1, _B
        while k < length:
            h = h[:-k] * b + h[k:]
            b, k = b * b, 2 * k
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def super_kmers(points: np.ndarray, bounds: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimiser, first window, number of windows) of all texts; places count from the text's start."""
    lengths = np.diff(bounds)
    if len(points) < span or not (lengths >= span).any():
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    low = window_minima(piece_hashes(points, anchor), span - anchor + 1)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
    place = np.arange(len(low)) - bounds[text]
    ok = np.flatnonzero(place <= lengths[text] - span)
    low, text, place = low[ok], text[ok], place[ok]
    first = np.ones(len(ok), bool)
    first[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], low[at].view(np.int64), place[at], np.diff(np.append(at, len(ok)))


def scan(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    """(mini, _id, start, windows) of every super-k-mer."""
    schema = f"mini long, _id {dict(docs.dtypes)['_id']}, start int, windows int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 4 * BLOCK)):
            points, bounds = code_points(b.column(1))
            lo = 0
            while lo < len(bounds) - 1:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1)
                text, mini, start, windows = super_kmers(points[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], span, anchor)
                yield pa.record_batch([pa.array(mini), b.column(0).take(pa.array(text + lo)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], ["mini", "_id", "start", "windows"])
                lo = hi

    return docs.mapInArrow(run, schema)


def bucket_windows(rows: list[tuple[object, int, str]], span: int) -> tuple[set[frozenset], list[tuple[object, int, int]]]:
    """(distinct sets of records that share a window, intervals (id, from, to) of shared text) of one bucket.
    rows: (id, start, packed string). Equal packed strings are counted once."""
    by_string = defaultdict(list)
    for i, start, s in rows:
        by_string[s].append((i, start))
    groups: set[frozenset] = set()
    parts: list[tuple[object, int, int]] = []
    if len(by_string) == 1:
        ((s, at),) = by_string.items()
        ids = frozenset(i for i, _ in at)
        if len(ids) > 1:
            groups.add(ids)
            parts += [(i, a, a + len(s)) for i, a in at]
        return groups, parts
    windows = defaultdict(list)
    for s in by_string:
        for k in range(len(s) - span + 1):
            windows[s[k : k + span]].append(s)
    ids_of = {s: frozenset(i for i, _ in at) for s, at in by_string.items()}
    shared: dict[str, bool] = {}
    seen: set[frozenset] = set()
    for w, strings in windows.items():
        owners = frozenset(strings)
        ids = ids_of[strings[0]] if len(owners) == 1 else frozenset().union(*(ids_of[s] for s in owners))
        shared[w] = len(ids) > 1
        if len(ids) > 1 and owners not in seen:
            seen.add(owners)
            groups.add(ids)
    for s, at in by_string.items():
        k, n = 0, len(s) - span + 1
        while k < n:
            if not shared[s[k : k + span]]:
                k += 1
                continue
            e = k
            while e + 1 < n and shared[s[e + 1 : e + 1 + span]]:
                e += 1
            parts += [(i, a + k, a + e + span) for i, a in at]
            k = e + 1
    return groups, parts


def shared_windows(docs: DataFrame, id_col: str, text_col: str, span: int = 200, anchor: int = 32) -> DataFrame:
    """(gid, _id, a, b): with gid set, _id belongs to a set of records that have one window in common; with gid null,
    the text of _id from a to b (exclusive) stands in another record too. Rows without an id, without text or with a
    shorter one have no row; a span repeated within one record only is not shared."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & (F.length("_text") >= span))
    kind = dict(rows.dtypes)["_id"]
    found = materialise(scan(rows, span, anchor), "kmers")
    per_bucket = found.groupBy("mini").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count("*").alias("_n")).where(F.col("_lo") != F.col("_hi")).select("mini", "_n")
    wanted = found.join(per_bucket, "mini").groupBy("_id").agg(F.collect_list(F.struct("mini", "start", "windows", "_n")).alias("_at"))
    packed = rows.join(wanted, "_id").select("_id", "_text", "_at").select("_id", "_text", F.explode("_at").alias("k"))
    packed = packed.select(F.col("k.mini").alias("mini"), F.col("k._n").alias("_n"), "_id", F.col("k.start").alias("start"), F.expr(f"substring(_text, k.start + 1, k.windows + {span - 1})").alias("s"))
    packed = materialise(packed, "packed")
    schema = f"gid long, _id {kind}, a int, b int"

    def out(groups: list[tuple[int, list]], parts: list[tuple[object, int, int]], like: pa.DataType) -> pa.RecordBatch:
        gid = [g for g, ids in groups for _ in ids]
        ids = [i for _, ids in groups for i in ids]
        return pa.record_batch([pa.array(gid + [None] * len(parts), pa.int64()), pa.array(ids + [p[0] for p in parts], like), pa.array([None] * len(gid) + [p[1] for p in parts], pa.int32()), pa.array([None] * len(gid) + [p[2] for p in parts], pa.int32())], ["gid", "_id", "a", "b"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, groups, parts, like = None, [], [], [], pa.int64()

        def close() -> None:
            sets, more = bucket_windows(rows, span)
            groups.extend((hash((current, k)), sorted(ids)) for k, ids in enumerate(sorted(map(sorted, sets))))
            parts.extend(more)

        for batch in batches:
            like = batch.column(1).type
            for mini, i, start, s in zip(*(c.to_pylist() for c in batch.columns)):
                if mini != current:
                    if len(rows) > 1:
                        close()
                    current, rows = mini, []
                rows.append((i, start, s))
            if len(parts) > 20_000:
                yield out(groups, parts, like)
                groups, parts = [], []
        if len(rows) > 1:
            close()
        yield out(groups, parts, like)

    small = packed.where(F.col("_n") <= BUCKET).select("mini", "_id", "start", "s").repartition("mini").sortWithinPartitions("mini").mapInArrow(buckets, schema)
    # a bucket beyond that bound is never one task's: its distinct strings are cut into windows that are counted in a shuffle
    big = packed.where(F.col("_n") > BUCKET)
    windows = big.select("mini", "s").distinct().select("mini", "s", F.explode(F.sequence(F.lit(1), F.length("s") - (span - 1))).alias("k"))
    windows = windows.select("mini", "s", "k", F.xxhash64("mini", F.expr(f"substring(s, k, {span})")).alias("w1"), F.hash(F.expr(f"substring(s, k, {span})")).alias("w2"))
    members = big.select("s", "_id").distinct().groupBy("s").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
    shared = windows.join(members, "s").groupBy("w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("w1", "w2")
    many = windows.join(shared, ["w1", "w2"], "left_semi")
    cut = big.select("s", "_id", "start").join(many.select("s", "k"), "s").select(F.lit(None).cast("long").alias("gid"), "_id", (F.col("start") + F.col("k") - 1).cast("int").alias("a"), (F.col("start") + F.col("k") - 1 + span).cast("int").alias("b"))
    # one window stands for all that have the same strings
    signature = many.groupBy("w1", "w2").agg(F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("sig"), F.count("*").alias("n"), F.first("mini").alias("mini")).groupBy("mini", "sig", "n").agg(F.min(F.struct("w1", "w2")).alias("w"))
    chosen = many.join(signature.select("w.w1", "w.w2"), ["w1", "w2"], "left_semi").select("w1", "s").distinct()
    sets = chosen.join(big.select("s", "_id").distinct(), "s").select(F.col("w1").alias("gid"), "_id", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")).distinct()
    if per_bucket.where(F.col("_n") > BUCKET).isEmpty():
        return materialise(small, "spans")
    return materialise(small.unionByName(sets).unionByName(cut), "spans")


def sharing_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, anchor: int = 32) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of records that share a span of at least span characters, white space included.
    Null and shorter texts share nothing; exact copies of long enough texts are pairs; id must be unique."""
    sets = shared_windows(docs, id_col, text_col, span, anchor).where(F.col("gid").isNotNull()).select("gid", "_id").distinct()
    a, b = sets.select("gid", F.col("_id").alias(f"{id_col}_a")), sets.select("gid", F.col("_id").alias(f"{id_col}_b"))
    return a.join(b, "gid").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b").distinct()


def shared_part(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, anchor: int = 32) -> DataFrame:
    """(id, n_chars, shared_chars, spans) for every record: characters covered by shared spans, and how many stretches
    they form. Null texts count 0 characters."""
    parts = shared_windows(docs, id_col, text_col, span, anchor).where(F.col("gid").isNull()).groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("p"))
    # in order of their start: (characters so far, end of the last stretch, stretches)
    fold = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("k")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["b"].cast("long") - F.greatest(x["a"].cast("long"), s["end"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(s["end"], x["b"].cast("long")).alias("end"),
            (s["k"] + (x["a"].cast("long") > s["end"]).cast("long")).alias("k"),
        ),
    )
    done = parts.select(F.col("_id").alias(id_col), fold.alias("f"))
    zero = F.lit(0).cast("long")
    return docs.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")).join(done, id_col, "left").select(id_col, "n_chars", F.coalesce("f.n", zero).alias("shared_chars"), F.coalesce("f.k", zero).alias("spans"))
