"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import distinctive_terms, line_boilerplate, lookalikes, mixing, name_variants, near_duplicates, packing, scan_repair, shared_spans, tokens, wrong_encoding
from corpusloom.operators.components import connected_components
from corpusloom.runtime import materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.garbled_records(table(spark, d, "chunk"))


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.restored_text(table(spark, d, "chunk"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms.score_terms(table(spark, d, "chunk"), min_tf=3, min_df=2, max_df=9).select("chunk_id", "term")


def p2_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five most characteristic terms of every chunk."""
    return distinctive_terms.score_terms(table(spark, d, "chunk")).where(F.col("rank") <= 5).select("chunk_id", "term", F.round("weight", 6).alias("weight"), "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.attribute_entries(table(spark, d, "docmeta"), table(spark, d, "author_registry"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a = near_duplicates.similar_pairs(table(spark, d, "chunk"), "chunk_id", "text", size=3, similarity=0.7, min_shingles=20)
    b = near_duplicates.doi_pairs(table(spark, d, "docmeta"))
    return a.select(F.lit("chunk").alias("tbl"), "id_a", "id_b").unionByName(b.select(F.lit("docmeta").alias("tbl"), "id_a", "id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that has near-duplicates (five words, similarity 0.8): its group and its number of links to other classes."""
    member, links = near_duplicates.similar_classes(table(spark, d, "chunk"), "chunk_id", "text", size=5, similarity=0.8)
    groups = connected_components(links.unionByName(member.select(F.col("rep").alias("a"), F.col("_id").alias("b"))), "a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    whole = groups.join(member.select(F.col("_id").alias("node"), "rep"), "node", "left").withColumn("rep", F.coalesce("rep", "node"))
    return whole.join(ends, "rep", "left").select(F.col("node").alias("chunk_id"), F.col("rep").alias("class_id"), F.col("component").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.defects_of(table(spark, d, "chunk"), table(spark, d, "docmeta"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(table(spark, d, "chunk"), table(spark, d, "docmeta"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return line_boilerplate.repeated_lines(table(spark, d, "chunk"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return line_boilerplate.remove_repeated_lines(table(spark, d, "chunk"))


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    return line_boilerplate.source_report(table(spark, d, "chunk"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    chunk = table(spark, d, "chunk")
    garbled = materialise(wrong_encoding.garbled_records(chunk), "garbled")
    a = lookalikes.with_lookalikes(chunk, "chunk_id", "text").join(garbled, "chunk_id", "left_anti").select(F.lit("chunk").alias("tbl"), F.col("chunk_id").alias("rec_id"))
    b = lookalikes.with_lookalikes(table(spark, d, "docmeta"), "doc_id", "title").select(F.lit("docmeta").alias("tbl"), F.col("doc_id").alias("rec_id"))
    return a.unionByName(b)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    a = lookalikes.to_one_form(table(spark, d, "chunk"), "chunk_id", "text").withColumnRenamed("chunk_id", "rec_id").withColumn("tbl", F.lit("chunk"))
    b = lookalikes.to_one_form(table(spark, d, "docmeta"), "doc_id", "title").withColumnRenamed("doc_id", "rec_id").withColumn("tbl", F.lit("docmeta"))
    return a.unionByName(b)


def _settings(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a fixed table of settings; one that is larger than such tables are is an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings has more than {most} rows")
    return rows


def _plans(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["plan"], r["capacity_tokens"]) for r in _settings(table(spark, d, "pack_plan").orderBy("plan"))]


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    return packing.pack_records(sizes, _plans(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d), _plans(spark, d))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float, int | None]]:
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in _settings(table(spark, d, "mix_target").orderBy("source"))]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = _targets(spark, d)
    docs = table(spark, d, "documents").where(F.col("source").isin([t[0] for t in targets]))
    sizes = materialise(tokens.token_counts(docs, "doc_id", "text", also=("source",)), "sizes")
    return mixing.mix(sizes, targets, exact_shares=False)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(p9_mix(spark, d), _targets(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_part(table(spark, d, "documents"))


QUERIES = {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
