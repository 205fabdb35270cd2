"""Class-based bigram scoring with exchange clustering.

Words are lower-cased runs outside ASCII white space, and every text ends with
an end token. Every word of the training texts gets a class by its own counts:

1. Exchange moves units between classes while the likelihood of the class
   bigrams rises. Units are the most frequent words, the end token, and buckets
   of all other words by their last three bytes: a matrix of fixed size.
2. Every other word leaves its bucket for the class of most gain, to the first
   order (its counts are little to the classes'), from the classes beside it
   all over the corpus: first the frequent words, of a bounded number, then all
   others, whose contexts are aggregated by word.

Texts are cut into words once; a written table then holds their numbers, from
which classes and scores are counted.

Transitions are then counted anew over all bigrams with the final classes. Only
words that training never saw take their bucket's class.

    P(w | h) = P(class(w) | class(h)) * (c(w) + 1) / (N(class) + V(class) + 1)

with transitions smoothed towards the classes' shares; one event of each class
stands for its unseen words. Classes and counts of all words stay distributed:
a bounded number of the most frequent goes to the tasks, the others are joined.

Null and empty texts score their end token. Rows with equal ids are scored each
by itself, repeated rows alike. Words of equal count are frequent in order of
their bytes, and of equal gains the first class is taken. Without training texts
all counts are zero; without rows there are none. Any length is read whole.
Columns beside doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import id_bucket, sliced, utf8
from corpuslens.session import stage

TOP, SUFFIXES, CLASSES = 767, 256, 64
#: Words whose counts go to the scoring tasks at most, and bytes of such a word; counts of all others are joined.
HOT, HOT_BYTES = 300_000, 64
#: Words that a task's table holds at most; beyond that it starts anew.
TABLE = 300_000
END = b"\n"
#: Frequent words whose contexts go together in one row.
BLOCK = 64
#: Columns of a row of numbered texts: lengths and numbers of tokens by byte planes, the words that have no number, and their buckets.
NUMBERED = "rid long, held_out boolean, doc_id array<long>, lengths binary, ids binary, rare array<string>, bucket binary"


def counted(train: DataFrame) -> DataFrame:
    """(word, c) of all tokens of train's texts; the end token is a line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_pydict({"word": words, "c": pa.array(list(counts.values()), pa.int64())})

        for batch in sliced(batches):
            for text in utf8(batch):
                counts.update(text.lower().split())
            counts[END] += batch.num_rows
            if len(counts) > TABLE:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocab: DataFrame, most: int = HOT) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, whole levels of the count's logarithm, at most `most`; most frequent first."""
    vocab, level = vocab.where(F.octet_length("word") <= HOT_BYTES), F.floor(8 * F.log2("c"))
    levels = vocab.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # a few hundred at most
    total, least = 0, None
    for row in levels:
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return []
    got = vocab.where(level >= least).toArrow()
    pairs = zip(got.column("word").cast(pa.binary()).to_pylist(), got.column("c").to_pylist())
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


class Units:
    """Unit numbers: 0 is the end token, then the frequent words, then the buckets of the others."""

    def __init__(self, words: list[bytes], suffixes: int = SUFFIXES):
        self.at = {END: 0} | {w: k + 1 for k, w in enumerate(x for x in words if x != END)}
        self.first, self.suffixes = len(self.at), suffixes
        self.size = self.first + suffixes

    def unit(self, word: bytes) -> int:
        found = self.at.get(word)
        return self.first + zlib.crc32(word[-3:]) % self.suffixes if found is None else found


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes: the upper ones are nearly all zero and compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def numbered(docs: DataFrame, words: list[bytes], suffixes: int) -> DataFrame:
    """Rows NUMBERED of docs (doc_id, held_out, text), some hundred texts each: an end token, then each text's tokens and its end token.

    Words are numbered as in `words`; those it lacks follow by their place in the row's `rare`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        new: dict[bytes, int] = {}

        class Numbers(dict):
            """Words without a number get the next of the row."""

            def __missing__(self, word: bytes) -> int:
                return new.setdefault(word, many + len(new))

        code = Numbers((w, k) for k, w in enumerate(sent.value))
        many, end, rid = len(code), code[END], TaskContext.get().partitionId() << 33

        for batch in sliced(batches):
            held = np.array(batch.column(1).to_pylist(), bool)
            texts = utf8(batch)
            for side in (False, True):
                own = np.flatnonzero(held == side).tolist()
                if not own:
                    continue
                new.clear()
                ids, lengths = [np.array([end])], []
                for i in own:
                    tokens = texts[i].lower().split()
                    tokens.append(END)
                    lengths.append(len(tokens))
                    ids.append(np.fromiter(map(code.__getitem__, tokens), np.int64, len(tokens)))
                rare = list(new)
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array([rid], pa.int64()), "held_out": pa.array([side]), "doc_id": pa.array([batch.column(0).take(pa.array(own)).to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([planes(np.array(lengths))], pa.binary()), "ids": pa.array([planes(np.concatenate(ids))], pa.binary()),
                    "rare": pa.array([[w.decode("utf-8", "replace") for w in rare]], pa.list_(pa.string())), "bucket": pa.array([bytes(zlib.crc32(w[-3:]) % suffixes for w in rare)], pa.binary()),
                })
                rid += 1 << 12

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, NUMBERED)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, buckets of the rare) of rows (ids, bucket)."""
    for batch in batches:
        for ids, bucket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield unplanes(ids), np.frombuffer(bucket, np.uint8)


def bigrams(rows: DataFrame, units: Units, words: list[bytes]) -> DataFrame:
    """(pair, n) of unit bigrams over all rows of numbered texts: size * size rows at most."""
    size, first = units.size, units.first
    unit = np.array([units.unit(w) for w in words], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for ids, bucket in parts_of(batches):
            ids = np.concatenate([sent.value, first + bucket.astype(np.int64)])[ids]
            own = np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
            total = own if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return rows.select("ids", "bucket").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def clustered(pairs: DataFrame, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the counts of class bigrams, from the counts of unit bigrams. One task does it: the matrix has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.zeros(size * size)
        for batch in batches:
            np.add.at(b, batch.column(0).to_numpy(), batch.column(1).to_numpy())
        b = b.reshape(size, size)
        of = exchange(b, classes)
        one = np.eye(classes)[of]
        yield pa.RecordBatch.from_pydict({"of": pa.array([of.astype("<i8").tobytes()], pa.binary()), "g": pa.array([(one.T @ b @ one).tobytes()], pa.binary())})

    none = pairs.sparkSession.sql("SELECT 0L AS pair, 0L AS n")  # so that there is a row, and a task
    row = pairs.unionByName(none).repartition(1).mapInArrow(run, "of binary, g binary").first()
    return np.frombuffer(row["of"], "<i8"), np.frombuffer(row["g"]).reshape(classes, classes)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(g: np.ndarray, mass: np.ndarray, nxt: np.ndarray, prv: np.ndarray, own: float, weight: float) -> np.ndarray:
    """What the likelihood gains when a unit that g and mass don't hold joins each class; nxt and prv count its neighbours' classes, own its pairs with itself."""
    i, j, d = np.flatnonzero(prv), np.flatnonzero(nxt), g.diagonal()
    rows, cols = g[:, j], g[i]
    gain = (xlogx(rows + nxt[j]) - xlogx(rows)).sum(axis=1) + (xlogx(cols + prv[i, None]) - xlogx(cols)).sum(axis=0)
    gain += xlogx(d) - xlogx(d + nxt) - xlogx(d + prv) + xlogx(d + nxt + prv + own) - 2 * (xlogx(mass + weight) - xlogx(mass))
    gain[0] = -np.inf
    return gain


def exchange(b: np.ndarray, classes: int = CLASSES, sweeps: int = 12) -> np.ndarray:
    """Class of each unit; unit 0 keeps class 0 to itself. Stops when a sweep moves nothing."""
    size = len(b)
    weight = b.sum(axis=0)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u]
    of = np.zeros(size, int)
    for k, u in enumerate(order):
        of[u] = 1 + k % (classes - 1)
    one = np.eye(classes)[of]
    after, before = b @ one, b.T @ one  # by unit: counts of the next and the previous class
    g = one.T @ after
    mass = one.T @ weight
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = of[u], b[u, u]
            nxt, prv = after[u].copy(), before[u].copy()
            nxt[a] -= own
            prv[a] -= own
            g[a] -= nxt
            g[:, a] -= prv
            g[a, a] -= own
            mass[a] -= weight[u]
            gain = gains(g, mass, nxt, prv, own, weight[u])
            to = int(np.argmax(gain))
            if gain[to] <= gain[a] + 1e-9 * abs(gain[a]):
                to = a
            g[to] += nxt
            g[:, to] += prv
            g[to, to] += own
            mass[to] += weight[u]
            if to != a:
                moved += 1
                of[u] = to
                after[:, a] -= b[:, u]
                after[:, to] += b[:, u]
                before[:, a] -= b[u]
                before[:, to] += b[u]
        if not moved:
            break
    return of


class Hot:
    """The words that tasks hold, most frequent first, with counts and classes; a word of no number has its bucket's class at first."""

    def __init__(self, known: list[tuple[bytes, int]], units: Units, of: np.ndarray):
        self.counts = np.array([c for _, c in known], np.int64)
        unit = np.array([units.unit(w) for w, _ in known], np.int64)
        self.cls, self.placed = of[unit].astype(np.int64), unit < units.first
        self.bucket = of[units.first :].astype(np.int64)


def worth_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """To the first order, what each class gains from a word for a neighbour of each class: the next one, the previous one."""
    log, mass = np.log(np.maximum(g, 1)), np.log(np.maximum(g.sum(axis=0), 1))
    after, before = log.T - mass, log - mass
    for x in (after, before):
        x[:, 0] = -1e9  # the end token's class is its own
    return after, before


def hot_classes(rows: DataFrame, hot: Hot, g: np.ndarray, classes: int) -> np.ndarray:
    """Classes of hot's words: the units keep theirs, each other word takes the class of most gain."""
    shared, codes = rows.sparkSession.sparkContext.broadcast(hot), 2 * classes

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, found, held = shared.value, [], 0
        free = np.append(~hot.placed, np.zeros(1, bool))
        many = len(hot.cls)

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            block = key // (BLOCK * codes)
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            ends = [*edge[1:].tolist(), len(key)]
            k, n = (key - block * (BLOCK * codes)).astype("<u2"), n.astype("<u4")
            parts = list(zip(edge.tolist(), ends))
            return pa.RecordBatch.from_pydict({"block": pa.array(block[edge], pa.int64()), "k": pa.array([k[i:j].tobytes() for i, j in parts], pa.binary()), "n": pa.array([n[i:j].tobytes() for i, j in parts], pa.binary())})

        for ids, bucket in parts_of(batches):
            c, at = np.concatenate([hot.cls, hot.bucket[bucket]])[ids], np.flatnonzero(free[np.minimum(ids, many)])
            word = ids[at] * codes
            found += [word + c[at + 1], word + classes + c[at - 1]]
            held += 2 * len(at)
            if held > 1 << 20:
                yield flush()
                found, held = [], 0
        if held:
            yield flush()

    worth = np.concatenate(worth_of(g))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, k, n in zip(*(x.to_pylist() for x in batch.columns)):
                own = blocks.setdefault(block, np.zeros(BLOCK * codes, np.int64))
                own[np.frombuffer(k, "<u2")] += np.frombuffer(n, "<u4")
        for block, counts in blocks.items():
            counts = counts.reshape(BLOCK, codes)
            met = np.flatnonzero(counts.any(axis=1))
            yield pa.RecordBatch.from_pydict({"code": pa.array(block * BLOCK + met), "cls": pa.array((counts[met] @ worth).argmax(axis=1))})

    got = rows.select("ids", "bucket").mapInArrow(contexts, "block long, k binary, n binary").repartition("block").mapInArrow(best, "code long, cls long").toArrow()  # a row for each hot word at most
    cls = hot.cls.copy()
    cls[got.column("code").to_numpy()] = got.column("cls").to_numpy()
    return cls


def rare_classes(rows: DataFrame, hot: Hot, g: np.ndarray, classes: int) -> tuple[DataFrame, np.ndarray]:
    """(word, c, cls) of all training words that hot lacks, and the counts of class bigrams with the final classes of all words.

    A context's code is the neighbour's class, next or previous, hot or not.
    Bigrams of two hot words are counted where they are read, those of a hot
    and another word from the other's contexts, the rest by joining both.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, names, found, held = shared.value, {}, [], 0
        many, total = len(hot.cls), np.zeros(classes * classes, np.int64)

        def rows(kind: int, size: int, **own) -> pa.RecordBatch:
            kinds = {"word": pa.string(), "other": pa.string(), "pair": pa.int64(), "n": pa.int64(), "codes": pa.binary()}
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(size, kind), pa.int32())} | {k: own.get(k, pa.nulls(size, t)) for k, t in kinds.items()})

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if len(key):
                word = key >> 8
                edge = np.flatnonzero(np.diff(word, prepend=-1))
                data = (key & 255).astype(np.uint8)
                offsets = np.append(edge, len(key)).astype(np.int32)
                codes = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield rows(0, len(edge), word=pa.array(list(names), pa.string()).take(pa.array(word[edge])), codes=codes)

        for batch in batches:
            for r, (ids, bucket) in enumerate(parts_of([batch])):
                c, rare = np.concatenate([hot.cls, hot.bucket[bucket]])[ids], ids >= many
                own = batch.column(2)[r].values
                number = np.array([names.setdefault(w, len(names)) for w in own.to_pylist()], np.int64)
                at = np.flatnonzero(rare)  # the end token is never rare
                word = number[ids[at] - many] << 8
                found += [word + c[at + 1] + classes * rare[at + 1], word + 2 * classes + c[at - 1] + classes * rare[at - 1]]
                both = ~(rare[1:] | rare[:-1])
                total += np.bincount((c[:-1] * classes + c[1:])[both], minlength=classes * classes)
                two = np.flatnonzero(rare[1:] & rare[:-1])
                if len(two):
                    pair, n = np.unique((ids[two] - many) * len(bucket) + ids[two + 1] - many, return_counts=True)
                    yield rows(1, len(pair), word=own.take(pa.array(pair // len(bucket))), other=own.take(pa.array(pair % len(bucket))), n=pa.array(n, pa.int64()))
                held += 2 * len(at)
                if len(names) > TABLE or held > 1 << 21:
                    yield from flush()
                    found, held = [], 0
                    names.clear()
        yield from flush()
        at = np.flatnonzero(total)
        yield rows(2, len(at), pair=pa.array(at, pa.int64()), n=pa.array(total[at], pa.int64()))

    parts = stage(rows.select("ids", "bucket", "rare").mapInArrow(read, "kind int, word string, other string, pair long, n long, codes binary"), "brown-contexts")
    after, before = worth_of(g)
    worth = np.concatenate([after, after, before, before])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            codes = [b"".join(x) for x in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in codes], np.int64)
            row = np.repeat(np.arange(len(codes)), size)
            counts = np.bincount(row * (4 * classes) + np.frombuffer(b"".join(codes), np.uint8), minlength=len(codes) * 4 * classes).reshape(-1, 4 * classes)
            yield pa.RecordBatch.from_pydict({"word": batch.column(0), "c": pa.array(size // 2), "cls": pa.array((counts @ worth).argmax(axis=1), pa.int32()), "codes": pa.array(codes, pa.binary())})

    placed = stage(parts.where("kind = 0").groupBy("word").agg(F.collect_list("codes").alias("codes")).mapInArrow(best, "word string, c long, cls int, codes binary"), "brown-classes")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in sliced(batches, 8192):
            codes = batch.column(1).to_pylist()
            own = np.repeat(batch.column(0).to_numpy().astype(np.int64), [len(x) for x in codes])
            k = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
            after, before = k < classes, (k >= 2 * classes) & (k < 3 * classes)
            total += np.bincount(own[after] * classes + k[after], minlength=len(total)) + np.bincount((k[before] - 2 * classes) * classes + own[before], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    a, b = placed.select("word", F.col("cls").alias("a")), placed.select(F.col("word").alias("other"), F.col("cls").alias("b"))
    two = parts.where("kind = 1").select("word", "other", "n").join(a, "word").join(b, "other").select((F.col("a") * classes + F.col("b")).cast("long").alias("pair"), "n")
    pairs = parts.where("kind = 2").select("pair", "n").unionByName(placed.select("cls", "codes").mapInArrow(sums, "pair long, n long")).unionByName(two)
    final = np.zeros(classes * classes)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes * classes rows at most
        final[r["pair"]] = r["n"]
    return placed.select("word", "c", "cls"), final.reshape(classes, classes)


#: Columns of scoring: a rare word between two classes (kind 0, -1 where a rare word or nothing stands), two rare words (1), a text without those (2).
ROWS = {"kind": pa.int32(), "rid": pa.int64(), "word": pa.string(), "other": pa.string(), "own": pa.int32(), "left": pa.int32(), "right": pa.int32(), "n": pa.int64()}
ROWS |= {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "moves": pa.float64(), "logs": pa.float64()}


def transitions(b: np.ndarray, of: np.ndarray, classes: int, strength: float = 1.0) -> np.ndarray:
    """log10 P(class | previous class), smoothed towards the classes' shares."""
    one = np.eye(classes)[of]
    g = one.T @ b @ one
    share = (g.sum(axis=0) + 1) / (g.sum() + classes)
    return np.log10((g + strength * share) / (g.sum(axis=1, keepdims=True) + strength))


class Model:
    """What training finds: the frequent words with counts and classes, all others as rows (word, c, cls), and the logarithms of transitions and of the classes' room."""

    def __init__(self, hot: Hot, names: list[bytes], rare: DataFrame, g: np.ndarray, classes: int):
        self.hot, self.names, self.rare, self.g, self.classes = hot, names, rare, g, classes
        self.step = transitions(g, np.arange(classes), classes)
        n, v = np.bincount(hot.cls, hot.counts, classes), np.bincount(hot.cls[hot.counts > 0], minlength=classes).astype(float)
        for r in rare.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each class
            n[r["cls"]] += r["n"]
            v[r["cls"]] += r["v"]
        self.room = np.log10(n + v + 1)


def learned(docs: DataFrame, vocab: DataFrame, top: int = TOP, suffixes: int = SUFFIXES, classes: int = CLASSES, hot: int = HOT) -> tuple[Model, DataFrame]:
    """The model, and docs (doc_id, held_out, text) as numbered texts; vocab counts the tokens of those not held out."""
    known = frequent(vocab, hot)
    if END not in dict(known):
        known = [*known, *((END, r["c"]) for r in vocab.where(F.col("word") == END.decode()).collect())]
    if END not in dict(known):  # no training texts
        known = [(END, 0)]
    names = [w for w, _ in known]
    tokens = stage(numbered(docs, names, suffixes), "brown-tokens")
    train = tokens.where("not held_out")
    units = Units(names[:top], suffixes)
    of, g = clustered(bigrams(train, units, names), units.size, classes)
    found = Hot(known, units, of)
    found.cls = hot_classes(train, found, g, classes)
    rare, g = rare_classes(train, found, g, classes)
    return Model(found, names, rare, g, classes), tokens


def scored(docs: DataFrame, vocab: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, held_out, text)."""
    n_all, v_all = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    trained, tokens = learned(docs, vocab, **how)
    model, rare, step, room, classes = trained.hot, trained.rare, trained.step, trained.room, trained.classes
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        many = len(model.cls)
        base, log = np.log10(model.counts + 1.0), np.log10(model.counts + 1.0) - room[model.cls]

        def rows(kind: int, size: int, **own) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(size, kind), pa.int32())} | {k: own[k] if k in own else pa.nulls(size, t) for k, t in ROWS.items() if k != "kind"})

        for batch in batches:
            for at, (ids, bucket) in enumerate(parts_of([batch])):
                first, held, docs, lengths, words = (batch.column(k)[at] for k in (2, 3, 4, 5, 6))
                lengths = unplanes(lengths.as_py())
                ids, c = ids[1:], np.concatenate([model.cls, model.bucket[bucket]])[ids]
                before, c = c[:-1], c[1:]
                rare = ids >= many
                met = np.append(False, rare[:-1])
                zero = np.zeros(len(bucket))
                own = np.where(rare | met, 0.0, step[before, c]) + np.concatenate([log, zero])[ids]
                start = np.cumsum(lengths) - lengths
                unknown = np.add.reduceat(rare.astype(np.int64), start)
                yield rows(2, len(lengths), rid=pa.array(first.as_py() + np.arange(len(lengths))), doc_id=docs.values, held_out=pa.array([held.as_py()] * len(lengths)), n_tokens=pa.array(lengths), n_known=pa.array(lengths - unknown), moves=pa.array(np.add.reduceat(own, start)), logs=pa.array(np.add.reduceat(np.concatenate([base, zero])[ids], start)))
                place = np.flatnonzero(rare)
                if len(place):
                    doc, word = np.repeat(np.arange(len(lengths)), lengths)[place], ids[place] - many
                    left, right = np.where(met[place], -1, before[place]), np.where(rare[place + 1], -1, c[place + 1])  # the last token is an end
                    key, n = np.unique(((doc * len(bucket) + word) * (classes + 1) + left + 1) * (classes + 1) + right + 1, return_counts=True)
                    key, right = np.divmod(key, classes + 1)
                    key, left = np.divmod(key, classes + 1)
                    doc, word = np.divmod(key, len(bucket))
                    yield rows(0, len(n), rid=pa.array(first.as_py() + doc), word=words.values.take(pa.array(word)), own=pa.array(model.bucket[bucket[word]], pa.int32()), left=pa.array(left - 1, pa.int32()), right=pa.array(right - 1, pa.int32()), n=pa.array(n, pa.int64()))
                two = np.flatnonzero(rare & met)
                if len(two):
                    doc = np.repeat(np.arange(len(lengths)), lengths)[two]
                    key, n = np.unique((doc * len(bucket) + ids[two - 1] - many) * len(bucket) + ids[two] - many, return_counts=True)
                    key, word = np.divmod(key, len(bucket))
                    doc, known = np.divmod(key, len(bucket))
                    yield rows(1, len(n), rid=pa.array(first.as_py() + doc), word=words.values.take(pa.array(known)), other=words.values.take(pa.array(word)), own=pa.array(model.bucket[bucket[word]], pa.int32()), left=pa.array(model.bucket[bucket[known]], pa.int32()), right=pa.array(np.full(len(n), -1), pa.int32()), n=pa.array(n, pa.int64()))

    kinds = "kind int, rid long, word string, other string, own int, left int, right int, n long, doc_id long, held_out boolean, n_tokens long, n_known long, moves double, logs double"
    rows = stage(tokens.select("ids", "bucket", "rid", "held_out", "doc_id", "lengths", "rare").mapInArrow(run, kinds), "brown-rows")
    move = lambda a, b: F.lit(step.ravel())[a * classes + b]
    two = rows.where("kind = 1").join(rare.select("word", "cls"), "word", "left")
    two = two.select("rid", F.col("other").alias("word"), "own", F.coalesce("cls", "left").alias("left"), "right", "n", F.lit(0).alias("first"))
    each = rows.where("kind = 0").select("rid", "word", "own", "left", "right", "n", F.lit(1).alias("first")).unionByName(two).join(rare, "word", "left")
    own, first, n = F.coalesce("cls", "own"), F.col("first"), F.col("n")
    logs = first * n * F.log10(F.coalesce("c", F.lit(0)) + 1)
    moved = F.when(F.col("left") >= 0, move(F.col("left"), own)).otherwise(0.0) + F.when(F.col("right") >= 0, move(own, F.col("right"))).otherwise(0.0) - first * F.lit(room)[own]
    none = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long"}
    met = each.select("rid", *(F.lit(None).cast(t).alias(k) for k, t in none.items()), F.when(F.col("c").isNotNull(), first * n).otherwise(0).alias("n_known"), (n * moved + logs).alias("moves"), logs.alias("logs"))
    sums = rows.where("kind = 2").select(met.columns).unionByName(met).groupBy("rid").agg(*(F.max(k).alias(k) for k in none), *(F.sum(k).alias(k) for k in ("n_known", "moves", "logs")))
    score = F.col("moves")
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op3_brown(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (id_bucket("doc_id", 7) == 2).alias("held_out"), "text")
    return scored(docs, stage(counted(docs.where("not held_out")), "brown-vocab"))
