"""P4: near-duplicates with small edits, by pigeonhole blocks on fingerprints.

A text's fingerprint is a row of slots, each the least hash of its word shingles under another hash function. Texts that
share most shingles agree in most slots, so when the slots are split into blocks, close pairs share a whole block. Pairs are
made inside blocks only, their fingerprints' Hamming distance is verified, then the exact share of common shingles.
For short codes (doi) the pigeonhole is exact: with at most two edits, two of four pieces of the code stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

_WORDS = re.compile("[A-Za-z0-9]+")
#: Slots to a block and blocks; at 70 % common shingles a pair misses every block with probability 0.76 ** 25 = 0.001.
ROWS, BLOCKS = 4, 25
#: Texts of one block that are paired directly; those of larger blocks are paired by their rarest shingles.
HOT = 300
#: Tasks among which the pairs of one shingle or of one group of copies are split.
SALT = 16
#: A block that this many texts of one task share, 2,000 texts at a time, is taken out before blocks are shuffled.
OFTEN = 64
_A = (np.random.default_rng(7).integers(1, 2**32, ROWS * BLOCKS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_C = np.random.default_rng(8).integers(0, 2**32, ROWS * BLOCKS, dtype=np.uint64).astype(np.uint32)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(texts: list[str | None], size: int, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct word shingles of all texts, in the order of the texts. words: cache of word hashes."""
    ids: list[int] = []
    ends = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            for w in _WORDS.findall(t):
                h = words.get(w)
                if h is None:
                    h = words[w] = xxhash.xxh64_intdigest(w.lower())
                ids.append(h)
        ends[k] = len(ids)
    if len(words) > 500_000:
        words.clear()
    w = np.array(ids, np.uint64)
    if len(w) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            h = h * _P2 + _mix(w[k : len(w) - size + 1 + k] + _P1 * np.uint64(k + 1))
        h = _mix(h)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
    ok = owner[: len(h)] == owner[size - 1 :]
    owner, h = owner[: len(h)][ok], h[ok]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def fingerprints(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, slots): least hash of each text's shingles per slot."""
    out = np.empty((len(start), ROWS * BLOCKS), np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    ends = np.append(start[1:], len(h))
    k = 0
    while k < len(start):
        e = max(k + 1, int(np.searchsorted(ends, start[k] + 20_000, "right")))
        if ends[k] - start[k] > 20_000:  # a very long text, in slices
            out[k] = np.uint32(0xFFFFFFFF)
            for lo in range(start[k], ends[k], 20_000):
                part = low[lo : min(lo + 20_000, ends[k]), None] * _A[None, :]
                out[k] = np.minimum(out[k], (part + _C[None, :]).min(0))
            k += 1
            continue
        part = low[start[k] : ends[e - 1], None] * _A[None, :]
        part += _C[None, :]
        out[k:e] = np.minimum.reduceat(part, start[k:e] - start[k], axis=0)
        k = e
    return out


def block_keys(fp: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        b = fp.reshape(len(fp), BLOCKS, ROWS).astype(np.uint64)
        key = np.arange(BLOCKS, dtype=np.uint64)[None, :] * _P3
        for r in range(ROWS):
            key = _mix(key * _P2 + b[:, :, r] + _P1)
    return key.view(np.int64)


def text_fingerprints(df: DataFrame, id_col: str, text_col: str, size: int, min_shingles: int) -> DataFrame:
    """(_id, n, s1, s2, fp, blocks) of texts with enough shingles; (s1, s2) names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                owner, h = shingles(b.column(1).to_pylist(), size, words)
                n = np.bincount(owner, minlength=b.num_rows)
                keep = np.flatnonzero(n >= min_shingles)
                if not len(keep):
                    continue
                sel = n[owner] >= min_shingles
                h, start = h[sel], np.append(0, np.cumsum(n[keep]))[:-1]
                fp = fingerprints(h, start)
                with np.errstate(over="ignore"):
                    s1, s2 = np.add.reduceat(h, start), np.add.reduceat(_mix(h * _P3), start)
                keys = block_keys(fp)
                small = np.ascontiguousarray((fp & np.uint32(0xFF)).astype(np.uint8))
                yield pa.record_batch(
                    [b.column(0).take(pa.array(keep)), pa.array(n[keep].astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([x.tobytes() for x in small], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keep) + 1) * BLOCKS, BLOCKS, dtype=np.int32)), pa.array(keys.ravel()))],
                    ["_id", "n", "s1", "s2", "fp", "blocks"],
                )

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & (F.length("_text") > 0))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n int, s1 long, s2 long, fp binary, blocks array<long>")


def pairs_in_blocks(members: DataFrame, hot: int) -> DataFrame:
    """members (block, _id) -> (a, b, block): pairs within a block of at most hot members; of a larger block its members,
    as rows with b null. The blocks pass by in sorted order, no more than hot members of one are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, over, kind = None, [], False, pa.int64()

        def close() -> pa.RecordBatch | None:
            if over or len(held) < 2:
                return None
            ids = sorted(held)
            a = [x for k, x in enumerate(ids) for _ in ids[k + 1 :]]
            b = [y for k in range(len(ids)) for y in ids[k + 1 :]]
            return out(a, b, current)

        def out(a: list, b: list | None, block: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a, kind), pa.array(b, kind) if b is not None else pa.nulls(len(a), kind), pa.array([block] * len(a), pa.int64())], ["a", "b", "block"])

        for batch in batches:
            kind = batch.column(1).type
            blocks = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for k, s in enumerate(cut):
                e = cut[k + 1] if k + 1 < len(cut) else len(blocks)
                if blocks[s] != current:
                    if len(held) > 1 and (done := close()):
                        yield done
                    current, held, over = int(blocks[s]), [], False
                if e - s == 1 and not held and not over and k + 1 < len(cut):
                    continue
                held += batch.column(1).slice(s, e - s).to_pylist()
                if over or len(held) > hot:
                    yield out(held, None, current)
                    held, over = [], True
        if len(held) > 1 and (done := close()):
            yield done

    return members.repartition("block").sortWithinPartitions("block").mapInArrow(run, f"a {dict(members.dtypes)['_id']}, b {dict(members.dtypes)['_id']}, block long")


def crowds(prints: DataFrame) -> DataFrame:
    """(block, n): blocks that many texts of one batch share, told before anything is shuffled. Which crowded blocks are found
    here decides how their texts travel only: they are paired by their rarest shingles, as those of other crowded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            sel = n >= OFTEN
            yield pa.record_batch([pa.array(key[sel]), pa.array(n[sel])], ["block", "n"])

    return prints.select("blocks").mapInArrow(run, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(x, y) of left (x, key) and right (y, key) with equal keys; a key that many rows have is split among SALT tasks."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALT)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    return salted.join(copied, [key, "_salt"]).select("x", "y")


def _hamming(df: DataFrame, min_same: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
            yield b.filter(pa.array((x == y).sum(1) >= min_same)).select([0, 1])

    kind = dict(df.dtypes)["a"]
    return df.mapInArrow(run, f"a {kind}, b {kind}")


def _exact(df: DataFrame, size: int, similarity: float) -> DataFrame:
    """df (a, b, text a, text b): pairs whose sets of shingles have at least that share of common members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for b in batches:
            sets = []
            for k in (2, 3):
                owner, h = shingles(b.column(k).to_pylist(), size, words)
                sets.append(np.split(h, np.cumsum(np.bincount(owner, minlength=b.num_rows))[:-1]))
            ok = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    kind = dict(df.dtypes)["a"]
    return df.mapInArrow(run, f"a {kind}, b {kind}")


def pairs_by_rare_shingles(texts: DataFrame, size: int, similarity: float, hot: int) -> DataFrame:
    """texts (_id, _text) -> (a, b): no pair with at least that share of common shingles is left out. Each text's shingles are
    put in one order, rare ones first; of a text with n of them at least similarity * n are common to such a pair, so both
    have a common one among their first n - ceil(similarity * n) + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                owner, h = shingles(b.column(1).to_pylist(), size, words)
                n = np.bincount(owner, minlength=b.num_rows)[owner]
                yield pa.record_batch([b.column(0).take(pa.array(owner)), b.column(2).take(pa.array(owner)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["_id", "_key", "n", "block"])

    rows = texts.select("_id", "_text", F.xxhash64("_text").alias("_key")).where(F.length("_text") > 0)
    every = materialise(rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _key long, n int, block long"), "rare")
    counted = every.join(every.groupBy("block").agg(F.countDistinct("_id").alias("c")), "block")
    place = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("c", "block"))
    first = counted.distinct().withColumn("_place", place).where((F.col("_place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1) & (F.col("c") > 1))
    met = materialise(pairs_in_blocks(first.select("block", "_id").distinct(), hot), "rarepairs")
    # a shingle that is among the rarest of many texts is common to near-copies: these are paired in full, in SALT tasks
    rest = met.where("b is null").select("a", "block")
    full = paired(rest.withColumnRenamed("a", "x"), rest.withColumnRenamed("a", "y"), "block").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return met.where("b is not null").select("a", "b").unionByName(full)


def similar_classes(df: DataFrame, id_col: str, text_col: str, *, size: int = 5, similarity: float = 0.8, min_shingles: int = 1, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes (_id, rep): texts with equal sets of shingles, named by their least id; links (a, b), a < b:
    representatives whose sets have at least that share in common. Null texts and texts with fewer than min_shingles
    distinct shingles belong to no class, nor do rows without an id. Rows repeated under one id count once."""
    prints = materialise(text_fingerprints(df, id_col, text_col, size, min_shingles), "prints")
    copies = prints.groupBy("s1", "s2", "n").agg(F.min("_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("s1", "s2", "n", "rep")
    member = materialise(prints.select("_id", "s1", "s2", "n").join(copies, ["s1", "s2", "n"]).select("_id", "rep"), "copies")
    reps = prints.join(member.where("_id != rep").select("_id"), "_id", "left_anti")
    blocks = reps.select(F.explode("blocks").alias("block"), "_id")
    crowd = materialise(crowds(reps).where(F.col("n") > hot).select("block"), "crowds")
    packed = not crowd.isEmpty()
    found = materialise(pairs_in_blocks(blocks.join(crowd, "block", "left_anti") if packed else blocks, hot), "candidates")
    pairs = found.where("b is not null").select("a", "b")
    crowded = found.where("b is null").select(F.col("a").alias("_id"))
    crowded = (crowded.unionByName(blocks.join(crowd, "block", "left_semi").select("_id")) if packed else crowded).distinct()
    if not crowded.isEmpty():
        pairs = pairs.unionByName(pairs_by_rare_shingles(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(crowded, "_id", "left_semi"), size, similarity, hot))
    slots = ROWS * BLOCKS
    least_same = int(slots * similarity - 6 * (slots * similarity * (1 - similarity)) ** 0.5)  # six standard deviations below
    fp = prints.select("_id", "fp")
    near = pairs.where("a < b").distinct().join(fp.select(F.col("_id").alias("a"), F.col("fp").alias("x")), "a").join(fp.select(F.col("_id").alias("b"), F.col("fp").alias("y")), "b").select("a", "b", "x", "y")
    near = materialise(_hamming(near, least_same), "near")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(near.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "_id", "left_semi")
    links = near.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("x")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("y")), "b").select("a", "b", "x", "y")
    links = materialise(_exact(links, size, similarity), "links")
    return member, links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of similar texts, copies included."""
    member, links = similar_classes(df, id_col, text_col, **how)
    others = member.where("_id != rep")
    expanded = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    grown = expanded.select(F.col("rep").alias("_id"), "rep").unionByName(others.select("_id", "rep").join(expanded, "rep", "left_semi").select("_id", "rep"))
    first = links.join(grown.select(F.col("_id").alias("x"), F.col("rep").alias("a")), "a").select("x", "b")
    across = paired(first, grown.select(F.col("_id").alias("y"), F.col("rep").alias("b")), "b")
    within = paired(member.select(F.col("_id").alias("x"), "rep"), member.select(F.col("_id").alias("y"), "rep"), "rep").where("x < y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def plain_doi(doi: Column) -> Column:
    """From the first '10.' on, lower-cased, without spaces, without trailing ] ) . , ;  Null where there is no '10.'."""
    cut = F.regexp_extract(doi, r"(?s)10\..*", 0)
    return F.nullif(F.regexp_replace(F.replace(F.lower(cut), F.lit(" "), F.lit("")), r"[\]).,;]+$", ""), F.lit(""))


def _cuts(n: int) -> list[tuple[int, int]]:
    at = [n * k // 4 for k in range(5)]
    return list(zip(at, at[1:]))


# Shifts of two whole pieces that two edits allow: |x| + |y - x| + |d - y| <= 2 for d characters of difference in length.
_SHIFTS = {d: [(x, y) for x in range(-2, 3) for y in range(-2, 3) if abs(x) + abs(y - x) + abs(d - y) <= 2] for d in (0, 1, 2)}
_DUOS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def piece_keys(s: str) -> tuple[set[int], set[int]]:
    """(keys under which s is filed, keys under which s looks for codes up to two characters shorter)."""
    key = lambda n, i, a, j, b: xxhash.xxh64_intdigest(f"{n}\x00{i}\x00{a}\x00{j}\x00{b}") - 2**63
    cuts = _cuts(len(s))
    filed = {key(len(s), i, s[slice(*cuts[i])], j, s[slice(*cuts[j])]) for i, j in _DUOS}
    probes = set()
    for d, shifts in _SHIFTS.items():
        n = len(s) - d
        if n < 1:
            continue
        cuts = _cuts(n)
        for i, j in _DUOS:
            for x, y in shifts:
                (a0, a1), (b0, b1) = cuts[i], cuts[j]
                if a0 + x >= 0 and b0 + y >= a1 + x and b1 + y <= len(s):
                    probes.add(key(n, i, s[a0 + x : a1 + x], j, s[b0 + y : b1 + y]))
    return filed, probes


def close_codes(codes: DataFrame, code_col: str, edits: int = 2) -> DataFrame:
    """(a, b), a < b: distinct codes at most two insertions, deletions or replacements apart. Exact for any length: two edits
    leave two of four pieces whole, and the pair of pieces, not one shared prefix, is what codes meet by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, key, filed = [], [], []
            for s in b.column(0).to_pylist():
                f, p = piece_keys(s)
                code += [s] * (len(f) + len(p))
                key += [*f, *p]
                filed += [True] * len(f) + [False] * len(p)
            yield pa.record_batch([pa.array(code, pa.string()), pa.array(key, pa.int64()), pa.array(filed, pa.bool_())], ["code", "key", "filed"])

    distinct = codes.select(F.col(code_col).alias("code")).where(F.col("code").isNotNull()).distinct()
    # over all cores: few bytes, many keys
    keys = materialise(distinct.repartition(codes.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "code string, key long, filed boolean"), "codes")
    met = keys.where("filed").select(F.col("code").alias("a"), "key").join(keys.where("not filed").select(F.col("code").alias("b"), "key"), "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = F.levenshtein("a", "b", edits)
    return met.where((near >= 0) & (near <= edits))


def doi_pairs(df: DataFrame, id_col: str = "doc_id", doi_col: str = "doi") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records whose doi are equal or at most two edits apart once brought to one form."""
    rows = materialise(df.select(F.col(id_col).alias("_id"), plain_doi(F.col(doi_col)).alias("code")).where(F.col("code").isNotNull() & F.col("_id").isNotNull()), "doi")
    close = close_codes(rows, "code")
    x, y = rows.select(F.col("_id").alias("x"), "code"), rows.select(F.col("_id").alias("y"), "code")
    same = paired(x, y, "code").where("x < y")
    first = close.join(x.withColumnRenamed("code", "a"), "a").select("x", "b")
    near = paired(first, y.withColumnRenamed("code", "b"), "b")
    return same.unionByName(near).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
