"""Lexical profiles of groups: counts, lift, inverse group frequency, casing, proper nouns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions.text import content_tokens, mid_sentence_words


def term_counts(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, term, n); counts are combined before the shuffle."""
    return df.where(F.col(group).isNotNull()).select(group, F.explode(content_tokens(text)).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def lift(counts: DataFrame, group: str, min_count: int = 5, top: int = 10) -> DataFrame:
    """(group, term, n, lift, rank): log2 of a term's share in a group over its share in all others, the top terms.

    A share of none elsewhere counts as one occurrence. Totals include all terms, rare ones too.
    """
    groups = counts.groupBy(group).agg(F.sum("n").alias("_g"))
    total = groups.agg(F.sum("_g").alias("_t"))  # one row
    by_term = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("term"))).where(F.col("n") >= min_count)
    met = by_term.join(groups, group).crossJoin(F.broadcast(total))
    rest = (F.col("_t") - F.col("_g")).cast("double")
    background = F.greatest((F.col("_all") - F.col("n")) / rest, 1 / rest)
    value = F.round(F.log2((F.col("n") / F.col("_g")) / background), 6)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), F.desc("n"), "term"))
    return met.withColumn("lift", value).withColumn("rank", rank).where(F.col("rank") <= top).select(group, "term", "n", "lift", "rank")


def group_idf(counts: DataFrame, group: str) -> DataFrame:
    """(term, df, idf): ln((1 + groups) / (1 + df)) + 1."""
    total = counts.select(group).distinct().agg(F.count(F.lit(1)).alias("_n"))  # one row
    df = counts.groupBy("term").agg(F.count_distinct(group).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def casing(df: DataFrame, text: str) -> DataFrame:
    """(term, n, n_capital): how often a word stands in mid-sentence, and how often with a capital."""
    words = df.select(F.explode(mid_sentence_words(text)).alias("_w"))
    return words.groupBy(F.lower("_w").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_w").rlike("^[A-Z]"), 1)).alias("n_capital"))


def proper_nouns(cased: DataFrame, dictionary: DataFrame | None = None, least: int = 4, share: float = 0.85) -> DataFrame:
    """Terms seen at least ``least`` times, ``share`` of them with a capital, that are in no dictionary (column term)."""
    out = cased.where((F.col("n") >= least) & (F.col("n_capital") >= share * F.col("n")))
    return out.join(dictionary.select("term"), "term", "left_anti") if dictionary is not None else out
