"""Order MinHash of short texts and of text without spaces."""

import random

from pyspark.sql import functions as F

from strandfold.llm import orderhash


def likeness(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, a string, b string")
    df = orderhash.with_tokens(orderhash.with_tokens(df, F.col("a"), "x"), F.col("b"), "y")
    near = df.select("n", orderhash.likeness(F.col("x"), F.col("y")).alias("near"), F.size("x").alias("size")).collect()
    assert {r["size"] for r in near} == {orderhash.BINS}
    return {n: sum(r.near for r in near if r.n == n) / sum(r.n == n for r in near) for n, *_ in pairs}


def test_swapped_halves_of_short_texts(spark):
    rng = random.Random(3)
    pairs = []
    for n in (30, 60, 100, 300):
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            pairs.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    got = likeness(spark, pairs)
    print("halves swapped", got)
    assert all(0.3 < v < 0.58 for v in got.values())


def test_text_without_spaces(spark):
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(600))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(600))
    got = likeness(spark, [(1, text, text[:300] + "x" + text[300:]), (2, text, other), (3, text, text), (4, "", None), (5, "one", "one")])
    print("without spaces", got)
    pieces = spark.createDataFrame([(text,), ("ab" * 30,)], "w string").select(orderhash.grams(F.col("w")).alias("g")).collect()
    assert [(len(r.g), len(set(r.g))) for r in pieces] == [(593, 593), (53, 2)]
    assert 1 > got[1] > 0.6 and got[2] < 0.1 and got[3] == got[4] == got[5] == 1
