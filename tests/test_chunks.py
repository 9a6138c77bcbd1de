"""Chunk closed form against the original loop, and keyword ranking."""

from pyspark.sql import functions as F

from clauselens.functions import chunks as CH


def loop_chunks(n, size, overlap):
    out, i = [], 0
    while i < n:
        j = min(n, i + size)
        out.append((i, j))
        i = j - overlap if j - overlap > i else j
    return out


def test_make_chunks_matches_loop(spark):
    for size, overlap, top in ((2000, 150, 4600), (100, 99, 400), (50, 150, 300), (100, 100, 300), (10, 0, 60)):
        df = spark.range(top).select(F.col("id").alias("n"), F.expr("repeat('a', cast(id as int))").alias("t"))
        got = {r["n"]: [(c["start"], c["end"]) for c in r["c"]]
               for r in df.select("n", CH.make_chunks(F.col("t"), size, overlap).alias("c")).collect()}
        for n in range(top):
            assert got[n] == loop_chunks(n, size, overlap), (size, overlap, n)


def test_chunk_text_and_fixture_cases(spark):
    df = spark.createDataFrame([("x" * 1000,), ("y" * 2001,)], "t string")
    rows = df.select(CH.make_chunks(F.col("t")).alias("c")).collect()
    assert [(c["start"], c["end"]) for c in rows[0]["c"]] == [(0, 1000), (850, 1000)]
    assert [(c["start"], c["end"]) for c in rows[1]["c"]] == [(0, 2000), (1850, 2001), (1851, 2001)]
    assert all(len(c["text"]) == c["end"] - c["start"] for c in rows[1]["c"])


def test_prefilter_is_stable(spark):
    df = spark.createDataFrame([("aaa net zzz",)], "t string")
    chunks = CH.make_chunks(F.col("t"), 4, 0)
    top = df.select(CH.prefilter_top(chunks, ["net", "zz"], 5).alias("p")).collect()[0]["p"]
    assert [c["idx"] for c in top] == [1, 2, 0]
    assert [c["keyword_score"] for c in top] == [1, 1, 0]
