"""The pipeline over odd documents, stage by stage, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import langid, neardup, repetition
from corpuslens.llm.packing import CAPACITY
from corpuslens.session import stage

from .conftest import SCHEMA
from .test_queries import packed, whole_ids


def one_of_each(rows, n=5, threshold=0.8):
    """The (id, text) with the smallest id of each component of similar texts; of equal ids any, here by the query's own hash order where it matters."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                label = [label[j] if x == label[i] else x for x in label]
    return [min((r for r, x in zip(rows, label) if x == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(label)]


def test_stages(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    seen = {}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(fn(spark, docs, odd_dir), name)
        assert docs.columns == SCHEMA.names
        seen[name] = (before, docs.collect())

    before, after = seen["language"]
    model = langid.fit(spark.createDataFrame(before, SCHEMA))
    _, scores = langid.decided(model, [(r["text"] or "").encode() for r in before])
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r, s in zip(before, scores) if s >= langid.MARGIN)
    assert not {140, 141, 142, 145} & {r["doc_id"] for r in after}

    before, after = seen["quality"]
    kept = repetition.judged([(r["text"] or "").encode() for r in before])["kept"]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r, k in zip(before, kept) if k)

    before, after = seen["near_dedup"]
    stays = Counter((r["doc_id"], r["text"]) for r in after)
    assert stays == Counter(one_of_each([(r["doc_id"], r["text"]) for r in before]))

    before, after = seen["mix"]
    times = Counter((r["doc_id"], r["text"]) for r in after)
    assert set(times) <= {(r["doc_id"], r["text"]) for r in before} and max(times.values()) <= 3
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    small = lambda rows: [r for r in rows if r["source"] != "src3"]
    assert words(small(after)) > 0

    got = corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).collect()
    encode, want = whole_ids("byte_bpe_50k.json"), Counter()
    for r in after:
        ids = encode(r["text"]) + [0]
        cuts = [0, *range(len(ids) % CAPACITY or CAPACITY, len(ids) + 1, CAPACITY)]
        want.update((r["doc_id"], k, i, j - i, zlib.crc32(packed(ids[i:j]))) for k, (i, j) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= CAPACITY

    assert Counter((g["doc_id"], g["piece"]) for g in corpus_pipeline.run(spark, odd_dir).collect()) == Counter((g["doc_id"], g["piece"]) for g in got)


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_near_copies_go_and_clean_documents_stay(spark):
    """Planted copies at a similarity of 0.8 to 0.95 on five words, others just below, and a passage that all share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage, texts, want, similar = [word() for _ in range(40)], [], set(), []
    sets = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    for k in range(60):
        base = [word() for _ in range(200)] + passage
        copy = list(base)
        for at in rng.sample(range(2, 195, 6), 1 + k % 8):
            copy[at] = word()
        a, b = sets(base), sets(copy)
        similar.append(len(a & b) / len(a | b))
        want |= {2 * k} | ({2 * k + 1} if similar[-1] < 0.8 else set())
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert min(similar) < 0.8 and sum(0.8 <= x <= 0.95 for x in similar) > 20
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == want


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    """Chains, copies of copies, repeated rows, equal ids, nulls, short and blank texts, names of its own; with common shingles and without."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, shared = [], [word() for _ in range(30)]
    for k in range(40):
        text = [word() for _ in range(rng.randint(3, 120))] + shared * (k % 3 == 0)
        for c in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append((10 * k + c, " ".join(text)))
    rows += rows[:3] + [(7, "same id another text of few words"), (7, "and one more text for this id"), (None, "no id " + rows[5][1]), (None, "no id alone in the world here"), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "z") for r in rows], "doc_id long, text string, h int, row string, component int, hit string")
    want = one_of_each(rows)
    for monkeyed in ({}, {"SAMPLED": 1, "HOT": 2, "RUN": 50, "PACK": 100, "TABLE": 20}):
        for k, v in monkeyed.items():
            monkeypatch.setattr(neardup, k, v)
        got = neardup.deduplicated(docs)
        assert got.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert Counter(i for i, _ in got) == Counter(i for i, _ in want) and len(set(got)) == len(got)
        assert Counter(got) == Counter(want)
    assert neardup.deduplicated(docs.limit(0)).collect() == []


def test_large_groups_meet_in_tiles(spark, monkeypatch):
    """A passage that makes most of many texts, some alike and some just not, copies in every partition: not all meet all, and the links are those of brute force."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, rows = [word() for _ in range(60)], []
    for k in range(150):
        text = [word() for _ in range(rng.randint(6, 16))] + passage
        rows += [(10 * k + c, " ".join(text)) for c in range(4 if k % 10 == 0 else 1)]
    docs, want, counts = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id"), Counter(one_of_each(rows)), []

    def counted(df, name):
        counts.append((name, stage(df, name)))
        return counts[-1][1]

    assert 10 < len(want) < 140
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "discard", lambda df: None)
    for monkeyed in ({}, {"MEET": 0, "TILE": 4096, "LEAST_TILE": 512, "TILES": 3, "LEAST_SET": 1}):
        for k, v in monkeyed.items():
            monkeypatch.setattr(neardup, k, v)
        counts.clear()
        with monkeypatch.context() as m:
            m.setattr(neardup, "stage", counted)
            got = neardup.deduplicated(docs)
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
        if not monkeyed:
            pairs = {name: df.count() for name, df in counts if name in ("near-rest", "near-tried")}
            assert max(pairs.values()) < 1500


def test_a_class_sent_by_many_tasks_meets_a_pair_once(spark):
    rows = [(10 * k + c, f"text {k} of some words here") for k in range(3) for c in range(6)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id").withColumn("h", F.xxhash64("text"))
    cls = {neardup.class_of(neardup.shingles(t.encode(), 5)): t for _, t in rows}
    distinct = spark.createDataFrame([(c, t) for c, t in cls.items()], "cls long, text string").select("cls", F.xxhash64("text").alias("h"))
    made = neardup.of_classes(texts, distinct, distinct.select("cls"), 5, "array<long>", neardup.lists)
    assert made.count() > len(cls) and made.select("cls", "at").distinct().count() == made.count()
    pairs = [(a, b) for a in cls for b in cls if a < b]
    got = neardup.met(spark.createDataFrame(pairs, "src long, dst long"), made, ("src", "own"), ("dst", "other")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(pairs)
    for r in got:
        assert r["own"] == neardup.shingles(cls[r["src"]].encode(), 5).tolist() and r["other"] == neardup.shingles(cls[r["dst"]].encode(), 5).tolist()
