"""P6: lines repeated across one source's documents, mined with a distributed PrefixSpan and removed.

Line forms are items, a chunk is a sequence of items, support is counted in distinct chunks of one source.
PrefixSpan grows patterns from their prefixes: level 1 are the frequent single lines; every further level
looks only at what follows the last matched line in chunks that still hold the prefix.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise


def line_form(line: Column) -> Column:
    """Lower case, a run of ASCII digits as one #, a run of spaces and tabs as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "#"), "[ \t]+", " "))


def line_key(source: Column, form: Column) -> Column:
    """128 bits of a line's form within its source: by 64, two of very many lines would be taken for one."""
    return F.struct(F.xxhash64(source, form).alias("a"), F.xxhash64(F.lit("second"), form, source).alias("b"))


def source_lines(chunks: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """One row per line (from 1) with a key of its form within its source; null texts have none."""
    lines = chunks.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"))
    return lines.withColumn("_form", line_form("_line")).select("_id", "_source", (F.col("_pos") + 1).cast("int").alias("_no"), line_key(F.col("_source"), F.col("_form")).alias("_item"), F.length("_form").alias("_len"))


def frequent_sequences(
    chunks: DataFrame, id_col: str = "chunk_id", source_col: str = "source", text_col: str = "text", *,
    min_chars: int = 12, min_chunks: int = 6, min_share: float = 0.15, max_length: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(patterns, places). patterns: (_source, _length, _pattern array of line keys, _support); places: the lines
    (_id, _source, _no, _item) that are items of a frequent pattern, single lines included.

    A pattern is frequent when it stands, in this order, in at least min_chunks distinct chunks of its source and in at
    least min_share of all rows of that source, rows with null text counted. A source may be null: its rows form one source.
    Mining ends when a level has no pattern, or at max_length lines if that is given. No source is gathered into one task: support is
    counted by (source, line), combined before the shuffle, and a line's rows come back by joining the few frequent keys.
    """
    lines = source_lines(chunks, id_col, source_col, text_col).where(F.col("_len") >= min_chars)
    per_chunk = lines.groupBy("_source", "_item", "_id").agg(F.lit(1).alias("_one"))
    rows = chunks.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_rows"))

    def frequent(counted: DataFrame) -> DataFrame:
        enough = counted.where(F.col("_support") >= min_chunks).join(rows.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        return enough.where(F.col("_support") >= min_share * F.col("_rows")).drop("_rows")

    first = materialise(frequent(per_chunk.groupBy("_source", "_item").agg(F.count("*").alias("_support"))), "lines1")
    places = materialise(lines.join(first.select("_item").distinct(), "_item", "left_semi").select("_id", "_source", "_no", "_item"), "places")
    patterns = first.select("_source", F.lit(1).alias("_length"), F.array("_item").alias("_pattern"), "_support")
    # each chunk's sequence now holds frequent lines only; a projection is (chunk, pattern, place of the earliest match's end)
    projected = places.groupBy("_id", "_source", F.array("_item").alias("_pattern")).agg(F.min("_no").alias("_end"))
    for length in count(2):
        if max_length is not None and length > max_length:
            break
        grown = (
            projected.join(places.select("_id", F.col("_no"), F.col("_item")), "_id").where(F.col("_no") > F.col("_end"))
            .groupBy("_id", "_source", F.concat("_pattern", F.array("_item")).alias("_pattern")).agg(F.min("_no").alias("_end"))
        )
        grown = materialise(grown, f"grown{length}")
        level = materialise(frequent(grown.groupBy("_source", "_pattern").agg(F.count("*").alias("_support"))), f"lines{length}")
        if level.isEmpty():
            break
        patterns = patterns.unionByName(level.select("_source", F.lit(length).alias("_length"), "_pattern", "_support"))
        projected = grown.join(level.select("_pattern"), "_pattern", "left_semi")
    return patterns, places


def repeated_lines(chunks: DataFrame, id_col: str = "chunk_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """(id, line_no) of every line that is an item of a frequent sequence, single lines included. Every part of a frequent
    sequence is frequent itself, so longer sequences add no line to those of level 1; limits may hold max_length=1 then."""
    _, places = frequent_sequences(chunks, id_col, source_col, text_col, **limits)
    return places.select(F.col("_id").alias(id_col), F.col("_no").alias("line_no")).distinct()


def remove_repeated_lines(chunks: DataFrame, id_col: str = "chunk_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """(id, clean_text, removed): each text without its frequent lines, the others in their order. A text without any
    such line comes back unchanged, null stays null, a text of frequent lines only becomes ''."""
    found = repeated_lines(chunks, id_col, source_col, text_col, **limits).groupBy(id_col).agg(F.collect_set("line_no").alias("_bad"))
    joined = chunks.select(id_col, text_col).join(found, id_col, "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_bad", (i + 1).cast("int")))
    clean = F.when(F.col("_bad").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(id_col, clean.alias("clean_text"), F.coalesce(F.size("_bad"), F.lit(0)).cast("long").alias("removed"))


def source_report(chunks: DataFrame, id_col: str = "chunk_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """Per source and sequence length: number of frequent sequences, largest support."""
    patterns, _ = frequent_sequences(chunks, id_col, source_col, text_col, **limits)
    return patterns.groupBy(F.col("_source").alias("source"), F.col("_length").cast("long").alias("length")).agg(F.count("*").alias("patterns"), F.max("_support").alias("max_support"))


__all__ = ["frequent_sequences", "line_form", "remove_repeated_lines", "repeated_lines", "source_report"]
