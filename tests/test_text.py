"""Text functions on hand-made words of several scripts."""

import pytest
from pyspark.sql import functions as F

from wordweave.functions import text as T


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norm(spark):
    assert values(spark, [" Black-Hole ", "black hole", "ÉTÉ_x", "a·b", "　재즈 "], T.norm) == ["blackhole", "blackhole", "étéx", "ab", "재즈"]


def test_detect(spark):
    rows = ["전쟁", "线粒体", "ミトコンドリア", "戦争 の", "hello", "", "¿qué es la vida en el mar?", "123"]
    assert values(spark, rows, T.detect) == ["ko", "zh", "ja", "ja", "en", "en", "es", "en"]


def test_script(spark):
    assert values(spark, ["재즈", "爵士", "ジャズ", "民主の", "jazz", "K팝", "é", "12"], T.script) == ["ko", "zh", "ja", "ja", "en", "mix", "other", "other"]


@pytest.mark.parametrize(("word", "ok"), [("ATP", True), ("one", False), ("뇌", True), ("a", False), ("I love", False), ("42", False), ("", False), ("black-hole", True)])
def test_is_word(spark, word, ok):
    assert values(spark, [word], T.is_word) == [ok]


def test_is_query(spark):
    assert values(spark, ["black hole", "Dolly Parton", "i 1 2 3 4 5 6 7 8 9", "x" * 41, ""], T.is_query) == [True, True, False, False, False]


def test_valid_words(spark):
    assert values(spark, ["복수복수", "products", "x", "ok", "y" * 31], T.is_valid_word) == [False, False, False, True, False]


def test_wiki_titles(spark):
    assert values(spark, ["Main_Page", "Dune_(film)", "A_b_c_d", "List_of_x", "Jazz"], T.wiki_title) == [None, "Dune", None, None, "Jazz"]


def test_entities(spark):
    assert values(spark, ["Dolly Parton", "XXX", "1win", "a b c d", "United States", "he said"], T.is_entity) == [True, False, False, False, True, True]


def test_replies(spark):
    assert values(spark, ["1. Jazz, - jazz\n2. Blues"], lambda c: T.listed(c, 5)) == [["Jazz", "Blues"]]
    two = F.array(F.lit("x"), F.lit("y"))
    assert values(spark, ["2. y", " 3", "none", "0"], lambda c: T.choice(c, two)) == ["y", None, None, None]
    assert values(spark, [" yes.", "No"], T.is_yes) == [True, False]


def test_tiers(spark):
    df = spark.createDataFrame([(None,), (0.01,), (0.05,), (0.1,), (0.2,)], "x double")
    assert [r[0] for r in df.select(T.tier(F.col("x"))).collect()] == [None, "top1", "top5", "top10", "typical"]


def test_snippet(spark):
    row = values(spark, ["x" * 200 + " Jazz " + "y" * 200, "none"], lambda c: T.snippet(c, F.lit("jazz")))
    assert row[0].match == "Jazz" and row[0].before.startswith("…x") and row[0].after.endswith("y…") and row[1] is None
