"""Contamination of a split B by a split A."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_sql, normalize_text


def keyed(df: DataFrame, row: str, text: str | None, answer: str | None, group: str | None = None) -> DataFrame:
    """(row, text_key, answer_key, group_key): normalized once for all checks."""
    return df.select(
        F.col(row).alias("row"),
        (normalize_text(F.col(text)) if text else F.lit("")).alias("text_key"),
        (normalize_sql(F.col(answer)) if answer else F.lit("")).alias("answer_key"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group_key") if group else F.lit(None).cast("string").alias("group_key"),
    )


def matched(a: DataFrame, b: DataFrame, keys: list[str], witnesses: int = 5) -> DataFrame:
    """(row, witnesses) of B's rows whose keys, all non-empty, equal those of one row of A; the first rows of A that do, by number."""
    filled: Column = F.lit(True)
    for k in keys:
        filled = filled & (F.col(k) != "")
    order = Window.partitionBy(*keys).orderBy("row")
    first = a.where(filled).select("row", *keys).withColumn("at", F.row_number().over(order)).where(F.col("at") <= witnesses)
    source = first.groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("witnesses"))
    return b.where(filled).join(source, keys).select("row", "witnesses")


def shared_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups, the empty one included, that both splits have; none where no group is configured."""
    return a.select("group_key").intersect(b.select("group_key")).where("group_key is not null")


def leak_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of B whose text, whose answer, and whose text and answer together come from one row of A, and shared groups."""

    def hits(keys: list[str], name: str) -> DataFrame:
        filled: Column = F.lit(True)
        for k in keys:
            filled = filled & (F.col(k) != "")
        got = b.where(filled).join(a.where(filled).select(*keys).distinct(), keys, "left_semi")
        return got.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    rows = hits(["text_key"], "identical_text").unionByName(hits(["answer_key"], "identical_answer")).unionByName(hits(["text_key", "answer_key"], "identical_both"))
    return rows.unionByName(shared_groups(a, b).agg(F.count("*").alias("n")).select(F.lit("shared_groups").alias("what"), "n"))
