"""P7: visually identical text with different characters, brought to one form with numpy on code points.

A batch of Arrow text is copied once into an array of code points; every step is a gather through a table, a
cumulated offset or a search in a sorted table, over all texts of the batch together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that don't show.
HIDDEN = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
# Spaces other than U+0020, hyphens that look like U+002D.
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]
# Letters of other scripts that look like the Latin letter beside them; they count inside a word that also has Latin letters.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi κk ρp υu αa ϲc ϳj"
# Greek letters that are ordinary as symbols beside Latin letters ("νx", "α-type"), though they look like Latin
# ones; they are stand-ins only between Latin letters, or in a word with three of them.
GREEK_SYMBOLS = "αικνρυ"
OTHER = "ıi ɑa ɡg ⅼl օo սu հh ոn ցg զq ՏS ՕO ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
#: Compatibility characters of these decomposition kinds stay: raised and lowered digits, fractions.
KEPT_KINDS = ("<super>", "<sub>", "<fraction>")
#: Compatibility ranges that are look-alikes of ordinary characters.
COMPAT = [(0xFB00, 0xFB07), (0xFF01, 0xFF5F), (0xFFE0, 0xFFE7), (0x1D400, 0x1D800), (0x2100, 0x2150), (0x2160, 0x2180), (0x2460, 0x2500), (0x1F100, 0x1F190), (0x0132, 0x0134), (0x013F, 0x0141), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x3200, 0x3400)]
SPECIAL = {0x212A: "K", 0x212B: "Å", 0x2126: "Ω", 0x00B5: "μ"}
KEPT = {0x2103, 0x2109, 0x2116, 0x2122, 0x2120, 0x2105}
PLAIN, HIDE, MAP, LOOK, SYMBOL = 0, 1, 2, 3, 4


@cache
def tables() -> dict[str, np.ndarray]:
    """Built by rule once per worker: what to do with a code point, where its expansion begins, how long it is."""
    kind, start, size, pool = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.int32), np.ones(0x110000, np.int8), []

    def put(c: int, to: str, k: int) -> None:
        kind[c], start[c], size[c] = k, len(pool), len(to)
        pool.extend(map(ord, to))

    latin, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)):
        latin[lo:hi] = True
    latin[[0xD7, 0xF7]] = False
    letter |= latin
    letter[0x370:0x590] = letter[0x13A0:0x13F6] = True
    for c in HIDDEN:
        put(c, "", HIDE)
    for c in SPACES:
        put(c, " ", MAP)
    for lo, hi in COMPAT:
        for c in range(lo, hi):
            to, how = unicodedata.normalize("NFKC", chr(c)), unicodedata.decomposition(chr(c))
            if to != chr(c) and c not in KEPT and not how.startswith(KEPT_KINDS):
                put(c, to, MAP)
                letter[c], latin[c] = to.isalpha(), to.isalpha() and bool(latin[ord(to[0])])  # a stand-in is part of the word it stands in
    for c in HYPHENS:
        put(c, "-", MAP)
    for c, to in SPECIAL.items():
        put(c, to, MAP)
    for pair in f"{CYRILLIC} {GREEK} {OTHER}".split():
        put(ord(pair[0]), pair[1], SYMBOL if pair[0] in GREEK_SYMBOLS else LOOK)
    pairs = {}
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) == 2 and unicodedata.combining(chr(int(d[1], 16))) and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = c
    keys = np.array(sorted(pairs), np.int64)
    rank = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0x300, 0x370), (0x483, 0x488), (0x1AB0, 0x1AFF), (0x1DC0, 0x1E00), (0x20D0, 0x20F1), (0xFE20, 0xFE30)):
        for c in range(lo, hi):
            rank[c] = unicodedata.combining(chr(c))
    mark = rank > 0
    return {"rank": rank, "kind": kind, "start": start, "size": size, "pool": np.array(pool, np.uint32), "latin": latin, "letter": letter, "keys": keys, "composed": np.array([pairs[k] for k in keys], np.uint32), "mark": mark}


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, their bounds: text k is points[bounds[k]:bounds[k+1]]); null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[off - off[0]]


def slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (column 1) take about `most` bytes, so that long texts don't add up in memory."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most if len(size) else size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def to_arrow(points: np.ndarray, bounds: np.ndarray, nulls: np.ndarray | None) -> pa.Array:
    """The way back: one copy for the batch, offsets in bytes by the length each code point takes in UTF-8."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    off = np.concatenate([[0], np.cumsum(width)])[bounds]
    mask = None if nulls is None or not nulls.any() else pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [mask, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def normalise(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, bounds, number of replaced characters per text) in the one consistent form.

    Order: hidden characters go, stand-ins are expanded, look-alike letters inside a word with Latin letters become
    Latin, then marks on one letter are brought into their canonical order and composed with it as long as a composed
    letter exists.
    """
    t = tables()
    n = len(bounds) - 1
    kind = t["kind"][points]
    text = np.repeat(np.arange(n), np.diff(bounds))
    hits = np.zeros(n, np.int64)
    look = np.flatnonzero(kind >= LOOK)
    if len(look):
        # a word: letters, and what doesn't show between them or hangs on them, within one text
        inside = t["letter"][points] | (kind == HIDE) | t["mark"][points]
        new = np.ones(len(points), bool)
        new[1:] = ~(inside[1:] & inside[:-1] & (text[1:] == text[:-1]))
        word = np.cumsum(new) - 1
        latin = t["latin"][points]
        has = np.bincount(word[latin], minlength=word[-1] + 1)
        between = np.zeros(len(points), bool)
        between[1:-1] = latin[:-2] & latin[2:] & (word[:-2] == word[2:])
        real = np.where(kind[look] == LOOK, has[word[look]] > 0, (has[word[look]] >= 3) | between[look])
        kind[look[~real]] = PLAIN
    changed = kind != PLAIN
    np.add.at(hits, text[changed], 1)
    if changed.any():
        size = np.where(changed, t["size"][points], 1).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(at[-1], np.uint32)
        one = ~changed
        out[at[:-1][one]] = points[one]
        idx = np.flatnonzero(changed & (size > 0))
        if len(idx):
            rep = np.repeat(idx, size[idx])
            step = np.arange(len(rep)) - np.repeat(np.cumsum(size[idx]) - size[idx], size[idx])
            out[at[rep] + step] = t["pool"][t["start"][points[rep]] + step]
        points, bounds = out, at[bounds]
        text = np.repeat(np.arange(n), np.diff(bounds))
    rank = t["rank"][points]
    if ((rank[1:] > 0) & (rank[1:] < rank[:-1]) & (text[1:] == text[:-1])).any():
        begin = np.cumsum((rank == 0) | np.append(True, text[1:] != text[:-1]))
        points = points[np.lexsort((rank, begin))]
    while len(points) > 1 and t["mark"][points].any():
        place = np.flatnonzero(t["mark"][points])
        place = place[place > 0]
        place = place[text[place] == text[place - 1]]
        key = points[place - 1].astype(np.int64) << 21 | points[place]
        k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        ok = t["keys"][k] == key
        place, k = place[ok], k[ok]
        if not len(place):
            break
        points = points.copy()
        points[place - 1] = t["composed"][k]
        np.add.at(hits, text[place], 1)
        keep = np.ones(len(points), bool)
        keep[place] = False
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        points, text = points[keep], text[keep]
    return points, bounds, hits


def to_one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, clean_text, replaced): the text in one consistent form and how many of its characters were replaced.

    Typographic quotes and dashes, whole accented letters, raised digits, fractions and words wholly in another script
    stay. ASCII texts never leave the JVM. Null stays null with 0, '' stays ''. Repeated rows are kept.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("clean_text"))
    plain = F.coalesce(~F.col("clean_text").rlike("[^\\x00-\\x7F]"), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            points, bounds, hits = normalise(*code_points(b.column(1)))
            yield pa.record_batch([b.column(0), to_arrow(points, bounds, np.asarray(b.column(1).is_null())), pa.array(hits)], [b.schema.names[0], "clean_text", "replaced"])

    kind = dict(rows.dtypes)[id_col]
    done = rows.where(~plain).mapInArrow(run, f"`{id_col}` {kind}, clean_text string, replaced long")
    return rows.where(plain).withColumn("replaced", F.lit(0).cast("long")).unionByName(done)


def with_lookalikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id) of rows whose text holds characters that stand in for ordinary ones, or that don't show. Null and '' never do."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.col("_text").rlike("[^\\x00-\\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            hits = normalise(*code_points(b.column(1)))[2]
            yield pa.record_batch([b.column(0).filter(pa.array(hits > 0))], [b.schema.names[0]])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}").distinct()
