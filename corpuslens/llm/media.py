"""Media payloads in content-defined chunks.

A payload is a text's UTF-8 bytes and zero bytes up to a positive multiple of
64, kept as 8-bit samples. A gear hash over the last 32 bytes cuts it where its
low bits are zero, so equal passages give equal chunks wherever they stand.

A first pass counts chunk keys. Those found twice or more set bits in a filter
of fixed size, which goes to all tasks. Chunks whose bit is clear are surely
alone and stay, compressed, in their payload's row; all others leave a digest in
the row's ordered chunk list and go to the chunk store, one row for each digest
after a Spark aggregation. A full filter only sends more chunks that way.

A second pass writes lists and shared chunks in one table, from which the store
takes each digest once.

Reading joins the lists with the store, puts the chunks in order, checks every
digest and the payload's, and computes features from what it has read.

The stored form of a payload is what the lists and the store hold of it: digest
and frame of each chunk, in order. Null and empty texts are 64 zero bytes. Rows
with equal ids are stored each by itself, equal texts with equal values. Texts of
any length are cut whole. An empty table gives no rows. Columns beside doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import sliced, utf8
from corpuslens.session import scratch_path

SMALLEST, LARGEST, MASK = 512, 16384, np.uint32((1 << 11) - 1 << 8)
#: Bits of the filter of shared chunks.
FILTER_BITS = 1 << 25
LEVEL = 9
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= SMALLEST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    out, last = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while at - last > LARGEST:
            last += LARGEST
            out.append(last)
        if at - last >= SMALLEST and at < n:
            out.append(at)
            last = at
    while n - last > LARGEST:
        last += LARGEST
        out.append(last)
    return [*out, n]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, samples) in order."""
    out, last = [], 0
    for end in cuts(data):
        own = data[last:end]
        out.append((hashlib.blake2b(own, digest_size=16).digest(), own))
        last = end
    return out


def key(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "little")


def stored(rows: list[dict]) -> bytes:
    """What is stored of a payload: its chunks' digests and frames, in order."""
    return b"".join(r["digest"] + r["frame"] for r in rows)


def shared_filter(texts: DataFrame) -> np.ndarray:
    """The filter as 64-bit words: a bit for each chunk key found twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = Counter(key(d) for t in utf8(batch) for d, _ in chunks(payload(t)))
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    twice = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")
    bit = twice.select((F.col("k") % FILTER_BITS).alias("bit"))
    words = bit.groupBy((F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def write(docs: DataFrame, path: str) -> None:
    """Writes the payloads of docs (doc_id, text): lists with unshared chunks (kind 0) and shared chunks as tasks met them (1) to path/parts, shared chunks once each to path/chunks."""
    sent = docs.sparkSession.sparkContext.broadcast(shared_filter(docs.select("text")))

    def is_shared(digest: bytes, words: np.ndarray) -> bool:
        bit = key(digest) % FILTER_BITS
        return bool(int(words[bit >> 6]) >> (bit & 63) & 1)

    chunk = pa.struct([("digest", pa.binary()), ("frame", pa.binary())])
    kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "sha": pa.binary(), "chunks": pa.list_(chunk), "digest": pa.binary(), "frame": pa.binary()}

    def rows(kind: int, size: int, **own) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(size, kind), pa.int32())} | {k: pa.array(own[k], t) if k in own else pa.nulls(size, t) for k, t in kinds.items()})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, words, seen = zstandard.ZstdCompressor(level=LEVEL).compress, sent.value, set()
        rid = TaskContext.get().partitionId() << 33
        for batch in sliced(batches):
            size, sha, lists, new = [], [], [], {}
            for text in utf8(batch):
                data, own = payload(text), []
                for d, c in chunks(data):
                    both = is_shared(d, words)
                    own.append({"digest": d, "frame": None if both else pack(c)})
                    if both and d not in seen:
                        seen.add(d)
                        new[d] = pack(c)
                size.append(len(text))
                sha.append(hashlib.sha256(data).digest())
                lists.append(own)
            if len(seen) > 1_000_000:  # a digest may then be sent again, and is dropped after the shuffle
                seen.clear()
            yield rows(0, len(lists), rid=range(rid, rid + len(lists)), doc_id=batch.column(0).to_pylist(), n_bytes=size, sha=sha, chunks=lists)
            if new:
                yield rows(1, len(new), digest=list(new), frame=list(new.values()))
            rid += len(lists)

    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    texts.mapInArrow(parts, "kind int, rid long, doc_id long, n_bytes long, sha binary, chunks array<struct<digest: binary, frame: binary>>, digest binary, frame binary").write.option("compression", "none").parquet(f"{path}/parts")
    met = docs.sparkSession.read.parquet(f"{path}/parts").where("kind = 1")
    met.groupBy("digest").agg(F.first("frame").alias("frame")).write.option("compression", "none").parquet(f"{path}/chunks")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (doc_id, n_bytes, sha, chunks) whose frames are all there, verifies them and computes features."""
    for batch in sliced(batches, 64):
        unpack = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        for doc, n, sha, rows in zip(*(c.to_pylist() for c in batch.columns)):
            parts = [(r["digest"], unpack(r["frame"])) for r in rows]
            for d, c in parts:
                if hashlib.blake2b(c, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} of document {doc} is damaged")
            data = b"".join(c for _, c in parts)
            media = stored(rows)
            digest = hashlib.sha256(data)
            if digest.digest() != sha:
                raise ValueError(f"payload of document {doc} is damaged")
            samples = np.frombuffer(data, np.uint8)
            feature = f"chunks={len(parts)};mean={samples.mean():.6f};std={samples.std():.6f};levels={np.count_nonzero(np.bincount(samples, minlength=256))}"
            out.append((doc, n, len(data), digest.hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = [f.split()[0] for f in FEATURES.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for k, c, t in zip(names, columns, types)})


def read(spark, path: str) -> DataFrame:
    """Features of all payloads, read back from the lists and the store."""
    lists = spark.read.parquet(f"{path}/parts").where("kind = 0")
    lacking = F.exists("chunks", lambda c: c["frame"].isNull())
    own = lists.where(~lacking).select("doc_id", "n_bytes", "sha", "chunks")
    parts = lists.where(lacking)
    # one row for each chunk; what stays with the first is small
    each = parts.select("rid", "doc_id", "n_bytes", "sha", F.posexplode("chunks").alias("at", "c")).select("rid", "at", F.when(F.col("at") == 0, F.struct("doc_id", "n_bytes", "sha")).alias("head"), F.col("c.digest").alias("digest"), F.col("c.frame").alias("frame"))
    store = spark.read.parquet(f"{path}/chunks")
    met = each.where("frame is null").drop("frame").join(store, "digest").select("rid", "at", "head", "digest", "frame")
    whole = (
        each.where("frame is not null").select(met.columns).unionByName(met)
        .groupBy("rid")
        .agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("at", "digest", "frame"))).alias("chunks"))
        .select("head.doc_id", "head.n_bytes", "head.sha", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["frame"].alias("frame"))).alias("chunks"))
    )
    return own.unionByName(whole).mapInArrow(measured, FEATURES)


def op1_media(spark, sf_dir: str) -> DataFrame:
    """The features of all documents' payloads, read back from their chunks."""
    path = scratch_path(spark, "media")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)
