"""Best-fit packing planned on the length histogram.

Documents become ids with an end id; only those longer than a sequence are cut,
the first piece taking the remainder. Best fit decreasing then runs over counts
of lengths, not over pieces: a group of bins with the same room takes pieces of
a length all at once. The plan has a few segments per length whatever the
number of pieces, so it is small enough to broadcast; pieces are ranked within
their length and take the slot of their rank.

Null and empty texts are one piece with the end id alone; a null doc_id is kept.
Each row is packed by itself, repeated rows and equal ids too; which of equal
pieces takes which of their slots makes no difference. A text of any length is
encoded whole. An empty table gives no rows. Columns beside doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map
from corpuslens.llm.ranks import ranked
from corpuslens.llm.tokens import encoder
from corpuslens.session import stage

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, tokenizer: str = "byte_bpe_50k.json", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids as little-endian 32-bit integers."""
    last = end.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> dict:
        ids_of = encoder(tokenizer, 4, path).ids
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = ids_of(text or "") + last
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                own = ids[4 * i : 4 * j]
                out.append((doc, k, i, j - i, zlib.crc32(own), *([own] if with_ids else [])))
        columns = list(zip(*out)) or [()] * (5 + with_ids)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return {name: pa.array(c, t) for name, c, t in zip(names, columns, types)}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), schema, run)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, end rank, pieces per bin, first sequence, offset) of best fit decreasing over counts."""
    rooms: list[int] = []  # of groups with bins, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, bins)
    segments, bins = [], 0

    def give(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(room: int, first: int, many: int) -> int:
            """Best fit puts as many as go into a bin before the next; returns the bins not needed."""
            nonlocal rank, left
            each = room // length
            for per, take in ((each, min(many, left // each)), (left % each, 1)):
                if per and take and many and left:
                    segments.append((length, rank, rank + per * take, per, first, capacity - room))
                    give(room - per * length, first, take)
                    rank, left, first, many = rank + per * take, left - per * take, first + take, many - take
            give(room, first, many)
            return many

        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                fill(room, first, many)
            else:
                need = -(-left // (capacity // length))
                fill(capacity, bins, need)
                bins += need
    return segments


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. cut is read three times: stage it first."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length up to capacity
    schema = "length long, lo long, hi long, per long, first long, at long"
    slots = cut.sparkSession.createDataFrame(plan(counts, capacity), schema)
    rank = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], sum(counts.values()))
    return (
        rank.join(F.broadcast(slots), (rank["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .drop(slots["length"])
        .withColumn("place", F.col("rank") - F.col("lo"))
        .select(*cut.columns, (F.col("first") + F.floor(F.col("place") / F.col("per"))).alias("sequence_id"), (F.col("at") + F.col("place") % F.col("per") * F.col("length")).alias("offset"))
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **how) -> DataFrame:
    """Pieces of all rows with their places."""
    return packed(stage(pieces(docs, capacity, with_ids=with_ids, **how), "pieces"), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all documents' pieces."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
