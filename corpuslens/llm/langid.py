"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one ridge classifier over hashed byte
n-grams predicts each bit. Decoding weighs each bit's loss by how well its
classifier does on the sample and takes the codeword of least loss. Where the
two best codewords are close the row is flagged as ambiguous.

Training uses text and language alone, of at most SAMPLE labelled rows, dealt
evenly over the languages by a hash of the id. Null texts and texts without a
letter are `und`, with score 0. Rows of null language are predicted like any
other and never learned from. Without labelled rows all is `und`. Repeated rows
and equal texts get the same values, of equally near codewords the first
language wins; any length is read whole. An empty table gives no rows. Extra
columns pass whatever their names.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_filter, arrow_map, id_bucket, released, sliced, utf8

#: Rows that training reads at most.
SAMPLE = 2000
#: Hashed features, a power of two.
BUCKETS = 4096
#: Rows or columns that training works on at a time.
BLOCK = 256
#: Below this score a row is flagged as ambiguous.
MARGIN = 0.5

LETTER = regex.compile(r"\p{L}")
FOLD = np.full(256, 32, np.uint32)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams; all that isn't a letter counts as a blank."""
    a = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(263) + a[2:]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount((two * np.uint32(2654435761)) >> shift, minlength=BUCKETS) + np.bincount((three * np.uint32(2246822519)) >> shift, minlength=BUCKETS)
    return np.sqrt(counts / counts.sum(), dtype=np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """One row of -1 and 1 per class: the exhaustive code for few classes, else the best of random dense codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=classes - 1)][1:]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    found = [np.where(rng.random((classes, bits)) < 0.5, -1.0, 1.0) for _ in range(50)]
    return max(found, key=lambda c: -np.max(c @ c.T - 2 * bits * np.eye(classes)))


def invert(a: np.ndarray) -> None:
    """Inverts a symmetric positive definite matrix in place, by Gauss-Jordan steps of a block; the library's call holds five matrices."""
    for i in range(0, len(a), BLOCK):
        k = slice(i, i + BLOCK)
        pivot, columns = np.linalg.inv(a[k, k]), a[:, k].copy()
        rows = pivot @ a[k]
        for j in range(0, len(a), BLOCK):
            a[j : j + BLOCK] -= columns[j : j + BLOCK] @ rows
        a[:, k] = columns @ -pivot
        a[k] = rows
        a[k, k] = pivot


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in b's precision, without a copy of all of a in it."""
    return np.concatenate([a[i : i + BLOCK] @ b for i in range(0, len(a), BLOCK)])


class Model:
    """Weights of the bit classifiers, the code and the bits' weights."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 0.03):
        self.langs, self.code = langs, codewords(len(langs))
        if not langs:
            return
        bits = self.code[y]
        inverse = (x @ x.T).astype(float)
        inverse.flat[:: len(x) + 1] += ridge
        invert(inverse)
        dual = inverse @ bits
        # what each row would get if it had been left out, from the dual solution
        alone = bits - dual / inverse.diagonal()[:, None]
        self.weights = product(x.T, dual).astype(np.float32)
        right = (np.sign(alone) == bits).mean(axis=0)
        self.trust = np.maximum(2 * right - 1, 0.05)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and score of feature rows: the share of the best codeword's exponential of negative loss."""
        out = np.clip(x @ self.weights, -2, 2)
        loss = (np.maximum(1 - out[:, None, :] * self.code[None], 0) ** 2 * self.trust).sum(axis=2) / self.trust.sum()
        share = np.exp(-6 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(x)), best]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` of train's rows with text and language, the same number of each language where there are enough, but one of each language at least."""
    rows = train.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    if not counts:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0, int))
    each = max(1, sample // len(counts))
    many = each + 6 * each**0.5 + 20  # so that no language is drawn short
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, many / n))) for k, n in counts))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.empty((each * len(counts), BUCKETS), np.float32), []
        for batch in sliced(batches):
            for t, lang in zip(utf8(batch, "text"), batch.column(1).cast(pa.string()).to_pylist()):
                x[len(y)] = features(t)
                y.append(lang)
        langs = sorted(set(y))
        model = Model(langs, x[: len(y)], np.array([langs.index(k) for k in y], int))
        del x
        released()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # learned in one task, of which Spark bounds the threads: the driver's own linear algebra may not survive the JVM's fork
    own = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("at") <= each)
    top = own.repartition(1).sortWithinPartitions("h", "id").select("text", "lang")
    learned = top.mapInArrow(run, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else Model([], np.zeros((0, BUCKETS)), np.zeros(0, int))


def decided(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model.langs and t and LETTER.search(t.decode("utf-8", "replace"))]
    if known:
        best, score = model.decode(np.stack([features(texts[i]) for i in known]))
        for i, k, s in zip(known, best.tolist(), score.tolist()):
            langs[i], scores[i] = model.langs[k], s
    return langs, scores


def predict(df: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """keep's columns with lang_pred, score and ambiguous."""
    kept = df.select(*keep)
    name = next(f"text{'_' * k}" for k in range(len(kept.columns) + 1) if f"text{'_' * k}" not in kept.columns)
    kept = df.select(*keep, F.col(text_col).alias(name))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", lang_pred string, score double, ambiguous boolean"

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = decided(model, utf8(batch, name))
        out = {c: batch.column(i) for i, c in enumerate(batch.schema.names[:-1])}
        return out | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "ambiguous": pa.array(scores < MARGIN)}

    return arrow_map(kept, schema, run)


def recognised(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of df whose language is found without ambiguity."""
    return arrow_filter(df, [text_col], lambda batch: decided(model, utf8(batch, text_col))[1] >= MARGIN)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_bucket("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs, model, keep=["doc_id", held_out.alias("held_out")])
