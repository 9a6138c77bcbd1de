"""Small tables with the awkward rows that every operator and stage must take."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("rep", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("h", T.StringType()), T.StructField("keys", T.StringType()), T.StructField("gone_id", T.StringType()),
])

WORDS = {
    "en": "the of and to in is that with for as was on by this are from which have been their would there about".split(),
    "de": "der die und das nicht ist mit sich auf für eine auch werden nach über dem wurde einen beim zwischen".split(),
    "fr": "le la les des est dans pour que qui sur avec plus sont pas une aux cette être leurs ainsi entre".split(),
}


def prose(rng, lang, n):
    w = WORDS[lang]
    out = []
    while len(out) < n:
        k = rng.randint(5, 12)
        s = [rng.choice(w) + (rng.choice(["", "ing", "ung", "ment", "er"]) if rng.random() < 0.5 else "") for _ in range(k)]
        s[0] = s[0].capitalize()
        s[-1] += "."
        out += s
    return " ".join(out)


def documents(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(60, 150)), lang))
    long_text = prose(rng, "en", 30_000)
    rows += [
        (1000, None, "en"), (1001, "", "en"), (1002, " \n\t ", None), (1003, "word", "en"), (1004, "12 34 !!", None),
        (1005, rows[0][1], "en"), (1006, rows[0][1], None), (1006, rows[0][1], None),      # copies, a repeated row
        (1007, rows[1][1] + " zusatz", "de"),                                               # near copy
        (None, rows[2][1], "fr"), (None, None, None),                                       # null ids
        (1008, long_text, "en"), (1009, long_text + " end", "en"),                          # very long, near copies
        (1010, "x" * 200_000, "en"), (1011, "SPAM!! NOW!! " * 60, "en"), (1012, "a### b$$$ c%%% d&&& " * 40, "en"),
        (1013, "nul\x00 tab\t vt\x0b nbsp  mark▁ astral \U0001F642 é ß", "de"),
    ]
    return rows


def documents_df(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), *["clash"] * 9) for d, t, lang in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels_df(spark, rows=None):
    data = [(d, 0 if t and ("!!" in t or "$$$" in t) else 1, 0) for d, t, _ in (documents() if rows is None else rows)]
    return spark.createDataFrame(data + [(None, 1, 0), (5, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark_df(spark, rows=None):
    docs = {d: t for d, t, _ in documents()} if rows is None else {d: t for d, t, _ in rows}
    w = docs[3].split()
    items = [(0, " ".join(w[10:40])), (1, " ".join(w[10:15])), (2, "not in any document at all, this one"), (3, None), (4, "--- !!"),
             (5, " ".join(w[20:32])), (5, " ".join(w[20:32])), (None, " ".join(docs[4].split()[5:17])),
             (6, " ".join(docs[1008].split()[20_000:20_011])), (7, "ONE two three four five six seven eight nine ten eleven")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def docs(spark):
    return documents_df(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return empty_docs(spark)
