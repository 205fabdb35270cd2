"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are `[^\\x20\\x09-\\x0D]+`. Per text, words become small integers and
windows of several lengths rolling hashes in numpy, all of them differences of
one running sum; a window found twice or
more marks its words, the first time included, and the marked words' characters
over all words' are the coverage of that length. A text is kept if it passes
the base rules (enough words, not too many inside repeated 3-word windows) and
every coverage, its share of characters in repeated lines included, stays
within its limit.

Null, empty and blank texts have zero everywhere and fail the base rules. Texts
of any length are read whole. Repeated rows get the same values, rows of equal
ids each their own. An empty table gives no rows. Extra columns pass the stage
whatever their names, and are not read by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import arrow_filter, arrow_map, utf8

#: Window lengths in words, and the share of characters that windows found twice or more may cover: all stricter than the base rule, and falling with the length.
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Share of characters that lines equal to an earlier line may hold.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated(keys: np.ndarray, n: int, words: int) -> np.ndarray:
    """Marks the words inside windows of n words whose key occurs twice or more."""
    marked = np.zeros(words, bool)
    if len(keys) < 2:
        return marked
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return marked
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(words + 1, np.int64)
    start = np.flatnonzero(twice)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step[:-1]) > 0


def measures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, covered characters for each length of LIMITS."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    symbols = int(SYMBOLS[raw].sum())
    if not words:
        return (0, 0, symbols, 0, 0, 0, *(0 for _ in LIMITS))
    starts = np.cumsum(((raw & 0xC0) != 0x80) & (raw != 32) & ((raw < 9) | (raw > 13)))
    chars = int(starts[-1])
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                if kept := line.split():
                    dup_lines += 1
                    dup_chars += len(b"".join(kept).decode("utf-8", "replace"))
            else:
                seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    size = np.array([len(w) for w in words] if text.isascii() else [len(w.decode("utf-8", "replace")) for w in words], np.int64)
    n = len(words)
    repeat = int(repeated(triples(ids, len(known)), 3, n).sum())
    roll = Rolling(ids)
    cover = [int(size[repeated(roll.windows(k), k, n)].sum()) for k in LIMITS]
    return (n, chars, symbols, dup_lines, repeat, dup_chars, *cover)


def triples(ids: np.ndarray, known: int) -> np.ndarray:
    """Exact keys of all windows of three ids below known."""
    if len(ids) < 3:
        return np.zeros(0, np.uint64)
    pairs = ids[:-1] * np.uint64(known) + ids[1:]
    if known >= 1 << 21:  # three would not fit in 64 bits: pairs are numbered first
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    return pairs[:-1] * np.uint64(known) + ids[2:]


class Rolling:
    """Hashes of windows of any length, modulo 2**64, from one running sum of terms x * BASE**i."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, ids: np.ndarray):
        x = (ids + np.uint64(1)) * MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        powers, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), b, np.uint64)])) for b in (self.BASE, self.INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[:-1])])

    def windows(self, n: int) -> np.ndarray:
        many = max(len(self.sums) - n, 0)
        return (self.sums[n:] - self.sums[:many]) * self.down[:many]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in LIMITS))


def judged(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of texts by name, with base_failed and kept."""
    rows = np.array([measures(t) for t in texts], np.int64).reshape(-1, len(COLUMNS))
    by = dict(zip(COLUMNS, rows.T))
    failed = (by["n_words"] < MIN_WORDS) | (100 * by["n_repeat_words"] > 50 * by["n_words"])
    kept = ~failed & (by["dup_line_chars"] <= LINE_LIMIT * by["word_chars"])
    for n, limit in LIMITS.items():
        kept &= by[f"dup_{n}gram_chars"] <= limit * by["word_chars"]
    return by | {"base_failed": failed, "kept": kept}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row with base_failed and kept."""
    schema = f"doc_id long, {', '.join(f'{c} long' for c in COLUMNS)}, base_failed boolean, kept boolean"

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0).cast(pa.int64())} | {c: pa.array(x) for c, x in judged(utf8(batch)).items()}

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), schema, run)


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs that the rules keep."""
    return arrow_filter(docs, [text_col], lambda batch: judged(utf8(batch, text_col))["kept"])


def op5_repetition(spark, sf_dir: str) -> DataFrame:
    """The base columns, the coverage counts and the verdict of all documents."""
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
