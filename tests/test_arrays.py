"""Array and block helpers against plain Python, also on long values."""

import random

from pyspark.sql import functions as F

from wordweave.functions import arrays


def test_starts(spark):
    rng = random.Random(4)
    rows = [[], [5], [0, 0, 3], [rng.randrange(9) for _ in range(5000)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<int>")
    got = {r.i: r.s for r in df.select("i", arrays.starts(F.col("x")).alias("s")).collect()}
    assert got == {i: [sum(r[:k]) for k in range(len(r))] for i, r in enumerate(rows)}


def test_blocks_and_pieces(spark):
    rng = random.Random(5)
    texts = ["", "a", "é😀" * 3000, "".join(rng.choice("xyzäß漢") for _ in range(400_000))]
    places = [(t, s, n) for t in texts for s, n in [(0, 0), (0, len(t)), *[(rng.randrange(len(t) + 1), rng.randrange(9000)) for _ in range(5)]]]
    df = spark.createDataFrame([(i, t, s, n) for i, (t, s, n) in enumerate(places)], "i int, t string, s int, n int")
    rows = df.select("i", arrays.blocks(F.col("t")).alias("b"), "s", "n").select("i", F.array_join("b", "").alias("t"), arrays.piece(F.col("b"), F.col("s"), F.col("n")).alias("p")).collect()
    for r in rows:
        t, s, n = places[r.i]
        assert r.t == t and r.p == t[s : s + n]
