"""Pieces of the operators by themselves."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslens.llm import brown, chat, hilbert, langid, media, mixing, packing, repetition, simhash, tokens, wavelet
from corpuslens.llm.common import arrow_map, sliced
from corpuslens.llm.tokens import encoder

from .test_queries import best_fit


@given(st.text(alphabet=list("<>/s[]INST\\\n |ab")), st.text(alphabet=list("\\\n<s>ua")))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(text, role):
    turns = [("user", text), (role, text), ("assistant", text)]
    out, spans = chat.rendered(turns)
    assert chat.parsed(out) == turns
    assert [chat.unescape(out[i:j]) for i, j in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_folds_events(spark):
    log = [
        (1, 0, "a", "start", "user", "hel"), (1, 1, "a", "delta", None, "lo"), (1, 2, "b", "start", "assistant", "bad"), (1, 3, "b", "delta", None, " answer"),
        (1, 4, "b", "regenerate", None, None), (1, 5, "b", "delta", None, "late"), (1, 6, "c", "start", "assistant", None), (1, 7, "c", "delta", None, "good"),
        (1, 8, "a", "edit", None, "hello!"), (2, 0, "x", "start", None, "only"), (None, 0, "y", "start", "user", "no conversation"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq int, message string, kind string, role string, text string")
    got = {r["conv_id"]: chat.parsed(r["formatted"]) for r in chat.formatted(df, ["seq"]).collect()}
    assert got == {1: [("user", "hello!"), ("assistant", "good")], 2: [("", "only")], None: [("user", "no conversation")]}


def test_chat_of_conversations(spark, sf_dir, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi <s>"), (1, 1, "assistant", None), (None, None, None, "x"), (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {-1, 1, None, 3}
    log = chat.log_of(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[3]["loss_chars"], got[-1]["loss_chars"]) == (3, 0, 10, 21)


def test_chunks_cover_and_resynchronise():
    rng = random.Random(1)
    a = bytes(rng.randrange(32, 127) for _ in range(60_000))
    parts = media.chunks(a)
    assert b"".join(c for _, c in parts) == a and all(len(c) <= media.LARGEST for _, c in parts)
    assert all(len(c) >= media.SMALLEST for _, c in parts[:-1])
    moved = {d for d, _ in media.chunks(b"inserted" + a)}
    assert len(moved & {d for d, _ in parts}) > 0.8 * len(parts)
    assert b"".join(c for _, c in media.chunks(bytes(100_000))) == bytes(100_000)


def test_media_detects_damage(spark, tmp_path):
    import pyarrow as pa
    import zstandard

    good = zstandard.ZstdCompressor().compress(b"x" * 64)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "n_bytes": 1, "sha": b"", "chunks": [{"digest": b"0" * 16, "frame": good}]}])
    with pytest.raises(ValueError, match="damaged"):
        list(media.measured(iter([batch])))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    segments = packing.plan(counts, 64)
    used, ranks = {}, {}
    for length, lo, hi, per, first, at in segments:
        assert ranks.get(length, 0) == lo
        ranks[length] = hi
        for k in range(hi - lo):
            seq, offset = first + k // per, at + k % per * length
            assert used.get(seq, 0) == offset
            used[seq] = offset + length
            assert used[seq] <= 64
    assert ranks == counts
    assert len(used) == best_fit([n for n, c in counts.items() for _ in range(c)], 64)


def test_hilbert_visits_neighbours():
    bits, dims = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    index = hilbert.hilbert(list(grid), bits)
    assert sorted(index.tolist()) == list(range(1 << bits * dims))
    walk = grid[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 63, 512, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    seq = rng.integers(0, 40, n).astype(np.uint16) * 1200
    ids, lengths, m = wavelet.load(wavelet.dump([3, None], [n, 0], seq))
    assert ids == [3, None] and lengths.tolist() == [n, 0] and (m.tokens() == seq).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        token = int(seq[i])
        assert m.access(i) == token and m.rank(token, i) == int((seq[:i] == token).sum())
        places = np.flatnonzero(seq == token)
        assert m.rank(token) == len(places)
        assert all(m.select(token, k) == p for k, p in enumerate(places[:5].tolist()))
    with pytest.raises(IndexError):
        m.select(7, 0)


@pytest.mark.parametrize("name, width", [("byte_bpe_50k.json", 4), ("word_bpe_49k.json", 2)])
def test_tokens_equal_the_tokenizer(name, width):
    e, plain = encoder(name, width), Tokenizer.from_file(public_tokenizers.path(name))
    ids = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, e.dtype).tobytes()
    odd = ["", " a", "a ", "a  b", "a\n\nb", "don't we'll O'Neil's", "x\ty z", "<|endoftext|> hi", "naïve ÿ Σίσυφος ΟΔΟΣ 123 4a5 foo.", "a.\nB,\nc", "\n", "é x", "a b", "word., x.. '.' .", "中文 test。", "İ", "a \n b", "\x1c a"]
    odd += ["x <|endoftext|> y", "a<|endoftext|><|endoftext|>b", "<|startoftext|>", "in<|startoftext|>side the <|endoftext|", "<|ENDOFTEXT|>"]
    assert [e.ids(t) for t in odd] == [ids(t) for t in odd]


@given(st.text(alphabet=list("aéßΣ'. \n\t1,ś "), max_size=40))
@settings(max_examples=300, deadline=None)
def test_tokens_equal_the_tokenizer_on_any_text(text):
    for name, width in (("byte_bpe_50k.json", 4), ("word_bpe_49k.json", 2)):
        assert encoder(name, width).ids(text) == encoder(name, width).whole(text)


@given(st.lists(st.text(alphabet=list("adelmrstv''AÉßÿ×µ\xa0\x1c’Σ. \n\t12<"), max_size=30), max_size=12), st.sampled_from([1, 9, 40, 1 << 21]), st.sampled_from([2, 600_000]))
@settings(max_examples=300, deadline=None)
def test_many_texts_equal_the_tokenizer(texts, group, table):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "GROUP", group)
        patch.setattr(tokens, "TABLE", table)
        for name, width in (("byte_bpe_50k.json", 4), ("word_bpe_49k.json", 2)):
            assert list(encoder(name, width).each(texts)) == [encoder(name, width).whole(t) for t in texts]


def test_forms_of_a_word_are_merged_once():
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    plain, seen = e.tokenize, []
    e.tokenize = lambda piece: seen.append(piece) or plain(piece)
    texts = ["Zorblat zorblat. ZORBLAT, (zorblat)\n", "zorblat's <|endoftext|>", "", "zorblat's çà ÇÀ."]
    assert list(e.each(texts)) == [e.whole(t) for t in texts]
    assert sorted(seen) == sorted(["zorblat", ".", ",", "(", ")", "'s", "Ã§Ãł"])


@given(st.lists(st.text(alphabet=list("adelst''AÉß×µ\xa0\u2028\u0301’Σ. \n\t\r12"), max_size=30), max_size=12), st.sampled_from([9, 1 << 21]))
@settings(max_examples=300, deadline=None)
def test_many_texts_with_other_characters_equal_the_tokenizer(texts, group):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "GROUP", group)
        patch.setattr(tokens, "DENSE", 1)
        e = encoder("word_bpe_49k.json", 2)
        assert list(e.each(texts)) == [e.whole(t) for t in texts]


def test_other_characters_leave_the_rest_of_a_text_in_the_group(monkeypatch):
    e = encoder("word_bpe_49k.json", 2)
    monkeypatch.setattr(e, "ids", lambda text: pytest.fail("one by one"))
    texts = ["a “quoted” word, and many that are not, in a long enough line", "plain", "the end’s here: other words\tmay\rfollow it as they did before…"]
    assert list(e.each(texts)) == [e.whole(t) for t in texts]


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    of = rng.integers(1, 4, 60)
    of[0] = 0
    b = rng.poisson(np.where(of[:, None] == of[None, :], 6.0, 0.3)).astype(float)

    def likelihood(classes):
        one = np.eye(8)[classes]
        g = one.T @ b @ one
        return brown.xlogx(g).sum() - 2 * brown.xlogx(one.T @ b.sum(axis=0)).sum()

    b = (b + b.T) / 2
    found = brown.exchange(b, 8)
    start = np.array([0] + [1 + k % 7 for k in range(59)])
    assert likelihood(found) > likelihood(start) and found[0] == 0
    step = brown.transitions(b, found, 8)
    assert np.allclose((10**step).sum(axis=1), 1)


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        code = langid.codewords(k)
        distance = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 1000 * np.eye(k, dtype=int)
        assert distance.min() >= (1 if k == 2 else 2)


def test_langid_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(df).langs == []
    assert langid.predict(df, langid.fit(df), ["doc_id"]).first()["lang_pred"] == "und"


@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_forest_keeps_components(edges):
    def parts(pairs):
        label = list(range(20))
        for a, b in pairs:
            label = [label[b] if x == label[a] else x for x in label]
        return {frozenset(i for i in range(20) if label[i] == x) for x in label}

    u, v = (np.array(x, int) for x in zip(*edges)) if edges else (np.zeros(0, int), np.zeros(0, int))
    a, b = simhash.forest(u, v, 20)
    assert parts(zip(a.tolist(), b.tolist())) == parts(edges) and len(a) < 20


def test_links_lose_nothing(spark):
    """Fingerprints near each other across tiles, against all pairs."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for x in base:
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=16)
    from corpuslens.operators.components import connected_components

    label = {r["node"]: r["component"] for r in connected_components(got).collect()}
    want = {p: p for p in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {k: new if v == old else v for k, v in want.items()}
    assert {p: label.get(p, p) for p in signed} == want


def test_all_training_words_get_classes_by_their_counts(spark):
    """Rare words of two kinds, whose endings say nothing, between words of two kinds; all figures against plain counts."""
    rng = random.Random(4)
    kinds = [[f"{x}{k}zzz" for k in range(150)] for x in "pq"]
    near = [["la", "lo"], ["mi", "mu"]]
    texts = []
    for _ in range(1500):
        k = rng.randrange(2)
        texts.append(" ".join(w for _ in range(4) for w in (rng.choice(near[k]), "pq"[k] + "core" if rng.random() < 0.4 else rng.choice(kinds[k]))))
    texts += ["p1zzz p2zzz q3zzz", "la unseenzzz otherzzz p1zzz", None]
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    df, classes = df.withColumn("held_out", df["doc_id"] == 1501), 6
    vocab = brown.counted(df.where("not held_out"))
    known = brown.frequent(vocab, 40)
    assert len(known) < 60
    model, _ = brown.learned(df, vocab, top=7, suffixes=4, classes=classes, hot=40)
    hot, final, rows = model.hot, model.g, model.rare.collect()
    words = [((t or "").encode().split() + [brown.END]) for i, t in enumerate(texts) if i != 1501]
    counts = {}
    for w in (x for ws in words for x in ws):
        counts[w] = counts.get(w, 0) + 1
    assert {r["word"].encode(): r["c"] for r in rows} | dict(known) == counts and len(rows) + len(known) == len(counts)
    cls = {r["word"].encode(): r["cls"] for r in rows} | dict(zip(model.names, hot.cls.tolist()))
    of_kind = [[cls[w.encode()] for w in k] for k in kinds]
    top = [max(set(x), key=x.count) for x in of_kind]
    assert top[0] != top[1] and all(x.count(t) > 0.9 * len(x) for x, t in zip(of_kind, top))
    want = np.zeros((classes, classes))
    for ws in words:
        for a, b in zip([brown.END, *ws], ws):
            want[cls[a], cls[b]] += 1
    assert (final == want).all()

    step = brown.transitions(want, np.arange(classes), classes)
    n, v = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        n[cls[w]] += c
        v[cls[w]] += 1
    got = {r["doc_id"]: r["score"] for r in brown.scored(df, vocab, top=7, suffixes=4, classes=classes, hot=40).collect()}
    for i in (0, 7, 1500, 1501, 1502):
        ws = [brown.END, *(texts[i] or "").encode().split(), brown.END]
        k = [cls[w] if w in cls else int(hot.bucket[zlib.crc32(w[-3:]) % 4]) for w in ws]
        score = sum(step[a, b] + np.log10((counts.get(w, 0) + 1) / (n[b] + v[b] + 1)) for a, b, w in zip(k, k[1:], ws[1:]))
        assert got[i] == pytest.approx(score, rel=1e-9)


def test_langid_keeps_rare_languages(spark):
    rows = [(k, f"text number {k}", "big") for k in range(400)] + [(1000 + k, f"wort {k}", f"l{k:02d}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, sample=40).langs == sorted({x for _, _, x in rows})


def test_media_digest_is_of_stored_frames(spark):
    import hashlib

    import pyarrow as pa
    import zstandard

    data = bytes(range(64)) * 2
    seen = []
    for level in (1, 19):
        rows = [{"digest": hashlib.blake2b(data, digest_size=16).digest(), "frame": zstandard.ZstdCompressor(level=level, write_checksum=level > 1).compress(data)}]
        batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "n_bytes": 128, "sha": hashlib.sha256(data).digest(), "chunks": rows}])
        got = next(media.measured(iter([batch]))).to_pylist()[0]
        assert got["media_bytes"] == 16 + len(rows[0]["frame"])
        seen.append(got["media_sha256"])
    assert seen[0] != seen[1]


def test_coverage_rejects_what_the_base_rules_keep():
    """A passage of 20 words that makes up a third of a text, and lines repeated in full."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage, line = [word() for _ in range(20)], " ".join(word() for _ in range(2))
    own = lambda n: [word() for _ in range(n)]
    clean = " ".join(own(200))
    copied = " ".join(own(50) + passage + own(40) + passage + own(30) + passage)
    lines = "\n".join(x for _ in range(20) for x in (" ".join(own(2)), line))
    got = repetition.judged([x.encode() for x in (clean, copied, lines)])
    assert not got["base_failed"].any() and got["kept"].tolist() == [True, False, False]


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_rolling_windows_tell_words_apart(n):
    ids = np.random.default_rng(n).integers(0, 3, n).astype(np.uint64)
    roll = repetition.Rolling(ids)
    for k in (1, 2, 5, 10):
        want = [tuple(ids[i : i + k].tolist()) for i in range(max(n - k + 1, 0))]
        got = roll.windows(k).tolist()
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))
    small, large = (np.unique(repetition.triples(ids, k), return_inverse=True)[1] for k in (3, 1 << 21))
    assert (small == large).all()


def test_wavelet_inflates_only_what_it_needs():
    tokens = np.arange(3000, dtype=np.uint16) % 700
    file = wavelet.dump([1], [3000], tokens)
    _, _, m = wavelet.load(file)
    wavelet.verified(m, tokens)
    assert m.rank(5) == 5 and m.select(5, 2) == 1405
    damaged = tokens.copy()
    damaged[0] = 9
    with pytest.raises(ValueError, match="disagree"):
        wavelet.verified(m, damaged)


def test_hilbert_files_are_pruned(spark, tmp_path):
    """Readers that want a source, a language or a range of sizes or ids skip most files by their least and largest values."""
    rng = random.Random(9)
    rows = [(k, "x" * rng.randint(1, 5000), rng.choice(["de", "en", "fr", "it"]), f"host{rng.randint(0, 30):02d}", 1, "s") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, row string")
    hilbert.write(docs, f"{tmp_path}/out", shards=24, rows_per_file=100)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    from pyspark.sql import functions as F

    size = F.length("text")
    files = back.groupBy(F.input_file_name()).agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate((F.col("source"), F.col("lang"), size, F.col("doc_id"))) for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    assert len(files) >= 48
    wanted = [("host07", "host07"), ("fr", "fr"), (1000, 1300), (3000, 3300)]
    skipped = [sum(f[f"hi{k}"] < lo or f[f"lo{k}"] > hi for f in files) / len(files) for k, (lo, hi) in enumerate(wanted)]
    assert min(skipped) > 0.3 and sum(skipped) > 1.8, skipped


def test_mix_shares_and_repeated_rows(spark):
    """Rows equal in all columns, equal ids with other texts, and columns with names of the mix's own."""
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "f g h", "s"), (None, "i j", "t"), (2, "k " * 40, "t"), (3, None, None), (4, "", "t")] + [(k, "w " * (k % 7 + 1), "u") for k in range(10, 60)]
    docs = spark.createDataFrame([(*r, 5, "y", 6) for r in rows], "doc_id long, text string, source string, copies int, row string, key int")
    found = mixing.mixed(docs).collect()
    got = mixing.taken(docs)
    assert got.columns == docs.columns
    want = {}
    for r in found:
        want[r["doc_id"], r["key"]] = want.get((r["doc_id"], r["key"]), 0) + r["copies"]
    back = got.groupBy("doc_id", mixing.row_key("doc_id", "text", "source").alias("k")).count().collect()
    assert {(r["doc_id"], r["k"]): r["count"] for r in back} == {k: v for k, v in want.items() if v}
    assert mixing.taken(docs.limit(0)).collect() == []


def test_ranks_of_repeated_rows(spark, monkeypatch):
    from corpuslens.llm import ranks

    monkeypatch.setattr(ranks, "RUN", 4)
    df = spark.createDataFrame([("a", 1)] * 23 + [("a", k) for k in range(9)] + [(None, None), ("b", 1)], "g string, v int")
    got = ranks.ranked(df, ["g"], ["v"], df.count()).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in by.items()} == {"a": list(range(32)), None: [0], "b": [0]}


def test_a_task_that_ends_leaves_no_table_in_its_worker():
    e = encoder()
    ids = e.ids("one two three four")
    assert e.table
    assert [b.num_rows for b in sliced([pa.RecordBatch.from_pydict({"text": ["a", "b", "c"]})], 2)] == [2, 1]
    assert not e.table
    assert e.ids("one two three four") == ids


def test_langid_fits_in_little_more_than_its_rows():
    rng = np.random.default_rng(7)
    y = np.arange(1200) % 4
    x = np.sqrt(rng.dirichlet(np.full(langid.BUCKETS, 0.5), len(y)).astype(np.float32) + np.where(np.arange(langid.BUCKETS) % 4 == y[:, None], np.float32(1e-5), 0))
    tracemalloc.start()
    model = langid.Model(list("abcd"), x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    square = 8 * len(y) ** 2
    assert most < 2 * square < 1.2 * x.nbytes
    weights = np.linalg.solve(x @ x.T.astype(float) + 0.03 * np.eye(len(y)), model.code[y])
    assert np.allclose(model.weights, x.T @ weights, atol=1e-3)


def test_batches_of_long_texts_are_small(spark):
    df = spark.range(0, 12, 1, 1).selectExpr("id", "repeat('x', 1000000) as text")
    seen = arrow_map(df, "n long", lambda batch: {"n": pa.array([batch.num_rows], pa.int64())}, rows=100).collect()
    assert sum(r["n"] for r in seen) == 12 and max(r["n"] for r in seen) <= 3
