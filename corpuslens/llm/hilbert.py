"""Shards cut from a Hilbert curve over metadata.

Source, language, size and id are quantised to the same number of bits, and the
curve through that grid orders the rows: runs of it hold few values of each
dimension, so readers skip shards and files by any of them. Shards are runs of
equal row counts. A row's place on the curve is its cell's first place plus its
rank inside the cell, by salted counts; only counts of cells meet in one task,
and there are at most 2 to the number of all bits.

Cells keep the order of values, so that the least and the largest of a file say
what it holds: strings are cut at even ranks of their distinct values, sizes and
ids at quantiles of the rows. Null is cell 0. Null texts have no bytes. Texts of
any length count whole. Equal rows take neighbouring places. An empty table
gives no rows. Columns that are carried along keep their values whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.ranks import ranked
from corpuslens.operators.ordering import positioned
from corpuslens.session import stage

BITS = 4


def hilbert(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Curve index of each point of a grid with 2**bits cells a side (transpose form of Skilling, 2004)."""
    x = [np.asarray(c, np.int64).copy() for c in coords]
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b & 1)
    return out


def string_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """At most cells - 1 values of a column, at even ranks of its distinct values in order of code points."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    ranks = stage(positioned(values, [F.col("value")], "at"), "cuts")
    n = ranks.count()
    wanted = sorted({n * k // cells + 1 for k in range(1, cells)} - {1}) if n else []
    return sorted((r["value"] for r in ranks.where(F.col("at").isin(wanted)).collect()), key=lambda x: x.encode()) if wanted else []


def cell_of(column: Column, cuts: list, cells: int) -> Column:
    """1 to cells in the order of values, few values spread over all cells; 0 for null."""
    at = F.lit(0)
    for cut in cuts:
        at = at + F.when(column >= F.lit(cut), 1).otherwise(0)
    return F.when(column.isNull(), 0).otherwise(F.floor(at * (cells - 1) / max(len(cuts), 1)) + 1).cast("int")


def curve(cells: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(*x: pd.Series) -> pd.Series:
        return pd.Series(hilbert([c.to_numpy() for c in x], bits))

    return index(*cells)


def placed(rows: DataFrame, cell: str, tie: list[str], shards: int = 24, collapse: bool = True) -> DataFrame:
    """rows with shard and slot: runs of the order by cell whose lengths differ by one at most."""
    counts = rows.groupBy(cell).agg(F.count("*").alias("__n"))
    before = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(cell).alias("__cell"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    total = rows.count()
    rank = ranked(rows, [cell], tie, total, "__rank", collapse).join(base, F.col(cell) == F.col("__cell"))
    place = F.col("__base") + F.col("__rank")
    shard = F.expr(f"(__base + __rank) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return rank.withColumn("shard", shard.cast("int")).select(*rows.columns, "shard", (place - first).alias("slot"))


def sharded(docs: DataFrame, shards: int = 24, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) of docs (doc_id, text, lang, source), with the columns of carry in `row`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size, many = (F.octet_length(text) + 8).cast("long"), (1 << bits) - 1
    shares = [k / many for k in range(1, many)]
    sizes, ids = docs.agg(F.percentile_approx(size, shares), F.percentile_approx("doc_id", shares)).first()
    cells = [
        cell_of(F.col("source").cast("string"), string_cuts(docs, "source", many), many),
        cell_of(F.col("lang").cast("string"), string_cuts(docs, "lang", many), many),
        cell_of(size, sorted(set(sizes or [])), many),
        cell_of(F.col("doc_id"), sorted(set(ids or [])), many),
    ]
    row = [F.struct(*(docs[f"`{c}`"] for c in carry)).alias("row")] if carry else []
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), curve(cells, bits).alias("cell"), *row)
    return placed(rows if carry else stage(rows, "hilbert"), "cell", ["text_crc32", "doc_id", "size"], shards, not carry)


def write(docs: DataFrame, path: str, shards: int = 24, rows_per_file: int = 1_000_000) -> None:
    """Writes docs below path by shard, in order of the curve, a file for each run of rows_per_file; all columns as they are."""
    run = F.floor(F.col("slot") / rows_per_file)
    rows = sharded(docs, shards, carry=docs.columns).withColumn("run", run)
    folder = next(f"shard{'_' * k}" for k in range(len(docs.columns) + 1) if f"shard{'_' * k}" not in docs.columns)
    # sorted by shard first, so that partitionBy needs no sort of its own
    rows.repartition("shard", "run").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).option("maxRecordsPerFile", rows_per_file).parquet(path)


def op6_hilbert(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and cell of all documents."""
    rows = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
