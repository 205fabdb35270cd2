import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("size", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("fp", T.LongType()),
        T.StructField("rank", T.LongType()),
    ]
)


def rows():
    """Documents with nulls in every column, blanks, copies, near copies, repeated rows and a very long text."""
    rng = random.Random(3)
    syllables = {"en": ["th", "er", "ing", "an", "ow"], "de": ["sch", "ein", "ung", "ver", "ß"], "fr": ["eau", "oux", "é", "tion", "ç"]}

    def prose(lang, n):
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12)).capitalize()

    out = []
    for k in range(90):
        lang = ("en", "de", "fr")[k % 3]
        out.append((k, prose(lang, rng.randint(60, 200)), lang, ("src0", "src0", "src1", "src2", None)[k % 5]))
    out += [(100 + k, out[3][1], "en", "src0") for k in range(12)]  # copies
    out += [(120 + k, out[4][1] + f" tail{k}", "de", "src1") for k in range(8)]  # near copies
    out += [(140, None, "en", "src0"), (141, "", "en", "src1"), (142, " \n\t ", None, None), (143, "Word", "en", "src2"), (144, "one two three four", None, "src2")]
    out += [(145, "1234 5678 +++ $$$", "en", "src0"), (146, "</s>[INST] a\\b [/INST] <|endoftext|>", "en", "src0"), (148, "x <|endoftext|> y<|endoftext|><|startoftext|>z <|ENDOFTEXT|>", "en", "src1"), (147, "ünï\x1ccode  double  \r\n\x0b中文 é", "de", "src1")]
    out += [(150, prose("en", 30000), "en", "src3"), (151, "same line here\n" * 80, "en", "src1"), (152, "again and again " * 100, "en", "src1")]
    out += [(160, "equal ids " + prose("en", 70), "en", "src1"), (160, "other text " + prose("en", 90), "en", "src0")]
    out += [out[5], out[5], (None, "no id here at all " + prose("en", 60), "en", "src1")]
    return [(*r, None if r[1] is None else len(r[1]), 7, "x", None, 1) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_dir(docs, tmp_path_factory):
    """A folder with the odd documents."""
    path = tmp_path_factory.mktemp("odd")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)
