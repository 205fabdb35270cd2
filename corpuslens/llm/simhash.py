"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are collapsed to distinct values, which are tiled by the
population counts of their segments. Two tiles whose counts differ by more
than the radius in sum can't hold a link, so they never meet; all others are
compared in full, with numpy's exclusive-or and bit count. A tile pair hands on
a spanning forest of its links, never all of them.

Null and blank texts have fingerprint zero and link like any other. Texts of
fewer than four words hash as one shingle. Repeated rows get the same values.
Texts of any length are read whole. Rows of equal ids are rows of their own. Of
components the smallest id names all; a null doc_id counts only where its
component has no other id. An empty table gives no rows. Columns beside doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, utf8
from corpuslens.operators.components import connected_components
from corpuslens.session import stage

#: Fingerprints that a tile holds on average at most.
TILE = 2048


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - n + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], seed) for i, j in zip(start, end[n - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0).cast(pa.int64()), "fp": pa.array([fingerprint(x, n, seed) for x in utf8(batch, "text")], pa.int64())}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", run)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what u and v connect, one for each node that isn't the least of its tree."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def compared(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b at most radius bits apart."""
    left, right = [], []
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of as many segments, in 64 bits."""
    edge = [64 * k // bits for k in range(bits + 1)]
    return [(i, j - i) for i, j in itertools.pairwise(edge)]


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst) over distinct fp values: a forest with the components of all links within the radius."""
    n = distinct.count()
    parts = segments(2 if n < 400_000 else 3 if n < 4_000_000 else 4)
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L")) for at, width in parts]
    keyed = distinct.select("fp", *(c.cast("int").alias(f"c{k}") for k, c in enumerate(counts)))
    names = [f"c{k}" for k in range(len(parts))]
    chunks = keyed.groupBy(names).agg(F.ceil(F.count("*") / tile).alias("chunks"))
    tiles = stage(
        keyed.join(chunks, names)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        .groupBy(*names, "chunk")
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("tile", F.concat_ws("-", *names, "chunk")),
        "tiles",
    )
    near = [o for o in itertools.product(range(-radius, radius + 1), repeat=len(parts)) if sum(map(abs, o)) <= radius and o >= (0,) * len(parts)]
    moves = F.array(*(F.struct(*(F.lit(x).alias(f"m{k}") for k, x in enumerate(o))) for o in near))
    meta = tiles.select("tile", "chunk", *names)
    left = meta.select(F.col("tile").alias("a"), F.col("chunk").alias("chunk_a"), *names, F.explode(moves).alias("move"))
    left = left.select("a", "chunk_a", F.expr(" and ".join(f"move.m{k} = 0" for k in range(len(parts)))).alias("same"), *((F.col(f"c{k}") + F.col(f"move.m{k}")).alias(f"c{k}") for k in range(len(parts))))
    pairs = left.join(meta.select(F.col("tile").alias("b"), F.col("chunk").alias("chunk_b"), *names), names).where("not same or chunk_a <= chunk_b").select("a", "b")
    held = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                a = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                b = a if own else batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                i, j = compared(a.view(np.uint64), b.view(np.uint64), radius)
                if own:
                    i, j = i[i < j], j[i < j]
                    u, v = forest(i, j, len(a))
                    nodes = a
                else:
                    u, v = forest(i, j + len(a), len(a) + len(b))
                    nodes = np.concatenate([a, b])
                if len(u):
                    yield pa.RecordBatch.from_pydict({"src": pa.array(nodes[u], pa.int64()), "dst": pa.array(nodes[v], pa.int64())})

    return held.select("a", "b", "fps_a", "fps_b").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = stage(fingerprints(docs, id_col, text_col, n, seed), "simhash")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    joined = connected_components(links(distinct, radius)).select(F.col("node").alias("fp"), "component")
    found = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(found.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
