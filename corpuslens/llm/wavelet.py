"""Token shards as wavelet matrices.

Documents are dealt by ranges of their id and sorted; a writer encodes them and
closes a shard when it is full. A shard is one file: ids and lengths of its
documents and one bit-plane per bit of a token, each plane a stable partition of
the one above and compressed by itself, with the ones before each block of 512
bits. Access, rank and select inflate the planes that they pass and read counts
of blocks; tokens, counts and occurrences come from that file alone. Shards are
rows of a Parquet table in the shared folder, numbered by (part, seq) in order
of ids.

Null and empty texts are the end id alone; a null doc_id sorts first. Rows of
equal id follow a hash of their text, so that reruns agree and repeated rows
stand side by side. A shard ends with the text that fills it, however long that
is. An empty table gives no shards and no rows. Columns beside doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import sliced
from corpuslens.llm.tokens import encoder
from corpuslens.session import scratch_path

#: Tokens after which a shard is closed.
SHARD = 1 << 18
BITS = 16
MAGIC = b"WMX2"
#: Bytes of a plane between two stored counts.
BLOCK = 64


def counted(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane."""
    whole = np.zeros(-(-len(plane) // BLOCK) * BLOCK, np.uint8)
    whole[: len(plane)] = plane
    ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
    return (np.cumsum(ones) - ones).astype("<u4")


class WaveletMatrix:
    """Bit-planes of a sequence of 16-bit tokens, from the highest bit down, with their block counts; plane(level) gives both."""

    def __init__(self, n: int, plane, zeros: list[int]):
        self.n, self.plane, self.zeros = n, functools.cache(plane), zeros

    @classmethod
    def of(cls, tokens: np.ndarray) -> WaveletMatrix:
        planes, zeros, now = [], [], tokens.astype(np.uint16, copy=False)
        for bit in range(BITS - 1, -1, -1):
            ones = (now & np.uint16(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            low = np.compress(~ones, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(ones, now)])
        return cls(len(tokens), lambda level: (planes[level], counted(planes[level])), zeros)

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            ones = np.unpackbits(self.plane(level)[0], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            up[np.flatnonzero(ones)] = now[self.zeros[level] :] | np.uint16(1 << (BITS - 1 - level))
            now = up
        return now

    def _rank(self, level: int, at: int) -> int:
        """Ones before position at: the count of the blocks before, and the bits of the last bytes."""
        if at == 0:
            return 0
        bits, counts = self.plane(level)
        block, byte = (at - 1) // (8 * BLOCK), at >> 3
        ones = int(counts[block]) + int(np.bitwise_count(bits[block * BLOCK : byte]).sum())
        return ones + (int(bits[byte] & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def access(self, at: int) -> int:
        token = 0
        for level in range(BITS):
            one = int(self.plane(level)[0][at >> 3]) >> (at & 7) & 1
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if one else at - ones
            token = token << 1 | one
        return token

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(BITS):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (BITS - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of token before position end."""
        lo, hi = self._interval(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k, from 0."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            a, b = 0, self.n
            while b - a > 1:  # the last position with at most `want` such bits before it
                mid = (a + b) // 2
                ones = self._rank(level, mid)
                a, b = (mid, b) if (ones if one else mid - ones) <= want else (a, mid)
            at = a
        return at


def dump(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One shard as a file: sizes, zeros and frame lengths, then a frame of the documents and one of each plane with its counts."""
    matrix = WaveletMatrix.of(tokens)
    known = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [pack(known + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes())]
    frames += [pack(bits.tobytes() + counts.tobytes()) for bits, counts in map(matrix.plane, range(BITS))]
    return struct.pack(HEAD, MAGIC, len(doc_ids), len(tokens), *matrix.zeros, *map(len, frames)) + b"".join(frames)


HEAD = f"<4sQQ{BITS}Q{BITS + 1}Q"


def load(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Ids and lengths of the documents and the matrix of a shard, whose planes are inflated when first used."""
    magic, docs, n, *rest = struct.unpack_from(HEAD, file)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    zeros, ends = rest[:BITS], np.cumsum([struct.calcsize(HEAD), *rest[BITS:]]).tolist()

    def frame(k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(file[ends[k] : ends[k + 1]])

    def plane(level: int) -> tuple[np.ndarray, np.ndarray]:
        data, size = frame(level + 1), -(-n // 8)
        return np.frombuffer(data, np.uint8, size), np.frombuffer(data, "<u4", -(-size // BLOCK), size)

    body, mask = frame(0), -(-docs // 8)
    known = np.unpackbits(np.frombuffer(body, np.uint8, mask), count=docs, bitorder="little")
    ids = np.frombuffer(body, "<i8", docs, mask).tolist()
    lengths = np.frombuffer(body, "<u8", docs, mask + 8 * docs).astype(np.int64)
    return [i if k else None for i, k in zip(ids, known)], lengths, WaveletMatrix(n, plane, zeros)


def verified(matrix: WaveletMatrix, tokens: np.ndarray, places: int = 4) -> None:
    """Compares access, rank and select at some places with the tokens."""
    for at in np.linspace(0, matrix.n - 1, min(places, matrix.n)).astype(int).tolist():
        token, before = int(tokens[at]), int((tokens[:at] == tokens[at]).sum())
        if matrix.access(at) != token or matrix.rank(token, at) != before or matrix.select(token, before) != at:
            raise ValueError(f"the planes of a shard disagree at {at}")


def write_shards(docs: DataFrame, path: str, end: int = 2, tokenizer: str = "word_bpe_49k.json", vocabulary: str | None = None, shard: int = SHARD, parts: int | None = None) -> None:
    """Writes the shards of docs (doc_id, text) to a Parquet table at path: part, seq, n_docs, n_tokens, file."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        each, part = encoder(tokenizer, 2, vocabulary).each, TaskContext.get().partitionId()
        ids, texts, size, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            file = dump(ids, [len(x) // 2 for x in texts], np.frombuffer(b"".join(texts), "<u2"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "file": pa.array([file], pa.binary())})

        for batch in sliced(batches, 1024):
            for doc, own in zip(batch.column(0).to_pylist(), each([x or "" for x in batch.column(1).to_pylist()])):
                own += last
                ids.append(doc)
                texts.append(own)
                size += len(own) // 2
                if size >= shard:
                    yield close()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", "text").mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, file binary").write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, matrix = load(batch.column(2)[k].as_py())
                tokens, ends = matrix.tokens(), np.cumsum(lengths)
                verified(matrix, tokens)
                wide = tokens.astype("<u4")
                starts = ends - lengths
                n = len(doc_ids)
                crc = [zlib.crc32(wide[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"part": pa.array([batch.column(0)[k].as_py()] * n, pa.int32()), "seq": pa.array([batch.column(1)[k].as_py()] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "inside": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    rows = shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(parts, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op7_wavelet(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read back from the shards."""
    path = scratch_path(spark, "wavelet")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, path)
