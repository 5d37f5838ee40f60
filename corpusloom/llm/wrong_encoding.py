"""P1: text decoded with the wrong character encoding: found, and restored as far as it survives.

Nothing is told about which encodings were confused. Pieces of text around non-ASCII characters are joined with
clean near-twins: pieces that are equal once their non-ASCII characters are stripped. Between the ASCII anchors the
non-ASCII runs of both sides align, each aligned pair votes for the decodings that turn the one into the other, and
the transformations with enough independent votes are then applied to all pieces, twins or not.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

# Encodings that files are commonly written or read in.
MULTI = ["utf-8"]
SINGLE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15"]
MAX_LAYERS = 3
LOST = "�"
_SPACE = re.compile("[ \n\t\r]+")
_RUN = re.compile("[^\x00-\x7f]+")
_DIGITS = re.compile("[0-9]+")
#: Characters that are restored wherever their image stands: what European text is written with. Other scripts are restored by
#: stretches of several letters.
ALPHABET = [*range(0xA0, 0x180), *range(0x218, 0x21C), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x2010, 0x2028), 0x2030, 0x2032, 0x2033, 0x2039, 0x203A, 0x20AC, 0x2122, 0x2212, 0x2260, 0x2264, 0x2265, 0x221E, 0x2248]


def _read(raw: bytes, encoding: str) -> str:
    """Bytes an encoding has no character for are read as the control characters of that number."""
    return "".join(_byte_tables(encoding)[b] for b in raw)


@cache
def _byte_tables(encoding: str) -> list[str]:
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


@cache
def chains() -> list[tuple[str, ...]]:
    """Candidate transformations: (written as, read as) once, or UTF-8 read wrongly up to MAX_LAYERS times over."""
    multi = [(w, r) * n for w in MULTI for r in SINGLE for n in range(1, MAX_LAYERS + 1)]
    mixed = [("utf-8", a, "utf-8", b) for a, b in product(SINGLE[:2], SINGLE[:2]) if a != b]
    return [*multi, *mixed, *[(w, r) for w, r in product(SINGLE, SINGLE) if w != r]]


@cache
def image(chain: tuple[str, ...], ch: str) -> str | None:
    """What ch looks like after the transformation; None if it can't pass through it."""
    for w, r in zip(chain[::2], chain[1::2]):
        try:
            ch = _read(ch.encode(w), r)
        except UnicodeEncodeError:
            return None
    return ch


def pieces_of(text: str) -> Iterator[tuple[str, str]]:
    """(anchor, token) of every blank-separated token with a non-ASCII character, runs of digits as one #. The anchor is the
    token without its non-ASCII characters; where fewer than three letters are left, the ASCII of both neighbours joins it."""
    words = _SPACE.split(text)
    for i, w in enumerate(words):
        if not w.isascii():
            yield anchor_of(w, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""), _DIGITS.sub("#", w)


def anchor_of(word: str, left: str, right: str) -> str:
    own = _DIGITS.sub("#", _RUN.sub("", word))
    if sum(map(str.isalpha, own)) >= 3:
        return own
    strip = lambda x: _DIGITS.sub("#", _RUN.sub("", x))
    left, right = strip(left), strip(right)
    return f"{left}\x00{own}\x00{right}" if any(c.isalpha() for c in left + own + right) else ""


def pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, anchors, tokens = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, w in set(pieces_of(t)):
                    ids.append(i), anchors.append(a), tokens.append(w)
            yield pa.record_batch([pa.array(ids, b.column(0).type), pa.array(anchors, pa.string()), pa.array(tokens, pa.string())], ["_id", "anchor", "token"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike("[^\\x00-\\x7F]"))
    return rows.mapInArrow(cut, f"_id {dict(rows.dtypes)['_id']}, anchor string, token string")


def runs_of(token: str) -> tuple[tuple[int, str], ...]:
    """Non-ASCII runs with the number of ASCII characters before each."""
    out, at, last = [], 0, 0
    for m in _RUN.finditer(token):
        at += m.start() - last
        out.append((at, m.group()))
        last = m.end()
    return tuple(out)


def votes(anchor: str, variants: list[tuple[str, int]]) -> Iterator[tuple[str, str, str, str, int]]:
    """(chain, anchor, garbled token, clean token, weight) for pairs of one anchor that a transformation explains.
    The clean side must be the more frequent one."""
    by_place = defaultdict(list)
    for token, n in variants:
        r = runs_of(token)
        by_place[tuple(p for p, _ in r)].append((token, tuple(s for _, s in r), n))
    for group in by_place.values():
        group.sort(key=lambda x: (-x[2], x[0]))
        # one dictionary of images per clean variant instead of comparing all pairs
        waiting: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for token, runs, n in group:
            waiting[runs].append((token, n))
        for clean, runs, n in group:
            if any(ord(c) < 0xA0 or c == LOST for r in runs for c in r):
                continue
            for chain in chains():
                parts = []
                for r in runs:
                    p = [image(chain, c) for c in r]
                    if None in p:
                        break
                    parts.append("".join(p))
                else:
                    garbled = tuple(parts)
                    if garbled != runs:
                        for token, m in waiting.get(garbled, ()):
                            if n > m:
                                yield "|".join(chain), anchor, token, clean, n


def twin_votes(distinct: DataFrame) -> DataFrame:
    """Joins near-twins: pieces with the same anchor come together. Spellings are distinct and counted before, so a group
    holds the different spellings of one stripped piece, not its occurrences."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [v for a, vs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for v in votes(a, [(x["token"], x["n"]) for x in vs])]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.string()) for k in range(5)], ["chain", "anchor", "token", "clean", "weight"])

    groups = distinct.where(F.col("anchor") != "").groupBy("anchor").agg(F.collect_list(F.struct("token", "n")).alias("v")).where(F.size("v") > 1)
    return groups.mapInArrow(vote, "chain string, anchor string, token string, clean string, weight long")


@cache
def decoder(accepted: tuple[str, ...]) -> tuple[re.Pattern, dict[str, str]]:
    """Pattern and table of the images of ALPHABET under the accepted transformations that give more than one character."""
    table: dict[str, str] = {}
    for name in accepted:  # most votes first
        chain = tuple(name.split("|"))
        if chain[0] in MULTI:
            for c in map(chr, ALPHABET):
                if (g := image(chain, c)) and len(g) > 1:
                    table.setdefault(g, c)
    known = sorted(table, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, known)) or "(?!)"), table


@cache
def wide_decoders(accepted: tuple[str, ...]) -> list[tuple[re.Pattern, dict[str, int], str]]:
    """For scripts beyond ALPHABET: of each accepted single reading of a multi-byte encoding the pattern of at least two
    characters of three or four bytes, or three of two, in a row, and the byte behind every character."""
    out = []
    for name in accepted:
        chain = tuple(name.split("|"))
        if chain[0] in MULTI and len(chain) == 2:
            shown = _byte_tables(chain[1])
            of = lambda lo, hi: "[" + "".join(re.escape(shown[b]) for b in range(lo, hi)) + "]"
            more = of(0x80, 0xC0)
            pattern = re.compile(f"(?:{of(0xE0, 0xF0)}{more}{more}|{of(0xF0, 0xF5)}{more}{more}{more}){{2,}}|(?:{of(0xC2, 0xE0)}{more}){{3,}}")
            out.append((pattern, {c: b for b, c in reversed(list(enumerate(shown)))}, chain[0]))
    return out


def wide(text: str, accepted: tuple[str, ...]) -> str:
    """text with stretches decoded that are letters of one script, and nothing else, once read as they were written."""
    def back(m: re.Match, bytes_of: dict[str, int], encoding: str) -> str:
        try:
            s = bytes(bytes_of[c] for c in m.group()).decode(encoding)
        except (KeyError, UnicodeDecodeError):
            return m.group()
        kinds = {unicodedata.name(c, "?").split()[0] for c in s}
        return s if len(kinds) == 1 and all(unicodedata.category(c) in ("Lo", "Ll", "Lu") for c in s) else m.group()

    for pattern, bytes_of, encoding in wide_decoders(accepted):
        text = pattern.sub(lambda m, b=bytes_of, e=encoding: back(m, b, e), text)
    return text


_C1 = re.compile("[\x80-\x9f]")


def learn(df: DataFrame, id_col: str, text_col: str, min_votes: int = 3) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(pieces, twin pairs, accepted transformations). A transformation needs votes from min_votes different anchors.
    What reaches the driver are the names of accepted transformations, of which chains() bounds the number."""
    found = materialise(pieces(df, id_col, text_col), "pieces")
    distinct = found.groupBy("anchor", "token").agg(F.count("*").alias("n"))
    pairs = materialise(twin_votes(distinct), "twins")
    ranked = pairs.groupBy("chain").agg(F.countDistinct("anchor").alias("v")).where(F.col("v") >= min_votes).orderBy(F.desc("v"), "chain").collect()
    return found, pairs, tuple(r["chain"] for r in ranked)


def judged(found: DataFrame, pairs: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """(anchor, token, restored) of the garbled pieces. A piece is garbled if it lost characters, if it holds the image of
    a character under an accepted transformation of several bytes, or if it aligned with a clean twin under an accepted
    transformation of single bytes. Lost characters stay as they are in restored."""
    single = [a for a in accepted if a.split("|")[0] not in MULTI]
    best = pairs.where(F.col("chain").isin(single)).groupBy("anchor", "token").agg(F.max_by("clean", F.struct("weight", "clean")).alias("twin")) if single else None
    distinct = found.select("anchor", "token").distinct()
    distinct = distinct.join(best, ["anchor", "token"], "left") if best is not None else distinct.withColumn("twin", F.lit(None).cast("string"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, table = decoder(accepted)
        for b in batches:
            rows = []
            for a, w, twin in zip(*(c.to_pylist() for c in b.columns)):
                restored = pattern.sub(lambda m: table[m.group()], wide(w, accepted))
                if restored == w and twin is not None:
                    restored = transfer(w, twin)
                if restored != w or LOST in w or _C1.search(w):
                    rows.append((a, w, restored))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["anchor", "token", "restored"])

    return distinct.mapInArrow(judge, "anchor string, token string, restored string")


def transfer(token: str, twin: str) -> str:
    """token with the non-ASCII runs of its twin in the places of its own; its digits stay. No encoding here reads a
    non-ASCII byte as ASCII, so both have the same number of runs."""
    new = iter(s for _, s in runs_of(twin))
    return _RUN.sub(lambda m: next(new, m.group()), token)


def garbled_records(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_votes: int = 3) -> DataFrame:
    """(id) of the records with characters from a wrong decoding, restorable or not. Null, empty and ASCII texts never
    count; repeated rows give one row; other columns are ignored; an empty table gives an empty result."""
    found, pairs, accepted = learn(df, id_col, text_col, min_votes)
    bad = judged(found, pairs, accepted).select("anchor", "token")
    return found.join(bad, ["anchor", "token"], "left_semi").select(F.col("_id").alias(id_col)).distinct()


def restored_text(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_votes: int = 3) -> DataFrame:
    """(id, restored, changed) for every record: garbled pieces replaced by what they were, as far as it survives; records
    without any come back as they are. id must be unique."""
    found, pairs, accepted = learn(df, id_col, text_col, min_votes)
    bad = found.join(judged(found, pairs, accepted), ["anchor", "token"]).groupBy("_id").agg(F.collect_list(F.struct("anchor", "token", "restored")).alias("_pieces"))
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text")).join(bad.withColumnRenamed("_id", id_col), id_col, "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, changed = [], []
            for t, ps in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                new = {(p["anchor"], p["token"]): p["restored"] for p in ps}
                words, gaps = _SPACE.split(t), _SPACE.findall(t)
                out = []
                for i, w in enumerate(words):
                    key = None if w.isascii() else (anchor_of(w, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""), _DIGITS.sub("#", w))
                    out.append(transfer(w, new[key]) if key in new else w)
                texts.append("".join(x for pair in zip(out, [*gaps, ""]) for x in pair))
                changed.append(texts[-1] != t)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(changed)], [id_col, "restored", "changed"])

    kind = dict(rows.dtypes)[id_col]
    done = rows.where(F.col("_pieces").isNotNull()).mapInArrow(put, f"`{id_col}` {kind}, restored string, changed boolean")
    rest = rows.where(F.col("_pieces").isNull()).select(id_col, F.col("_text").alias("restored"), F.lit(False).alias("changed"))
    return rest.unionByName(done)
