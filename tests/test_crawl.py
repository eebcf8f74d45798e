"""Schedules of several languages and ledgers of calls on hand-made rows."""

from pyspark.sql import functions as F

from wordweave.operators import crawl


def test_schedules_give_each_language_its_seeds_and_pool(spark):
    edges = spark.createDataFrame([("seed", w) for w in ("aa", "bb", "cc", "dé", "x", "die")] + [("other", "bb"), ("other", "die"), ("other", "other"), ("third", "bb")], "src string, dst string")
    nodes = spark.createDataFrame([(w, w, "en") for w in ("seed", "other", "third", "aa", "bb", "cc", "x")] + [("dé", "dé", "fr"), ("die", "die", "de")], "key string, word string, lang string")
    responses = edges.select(F.col("src").alias("key")).distinct()
    fixed = spark.createDataFrame([("en", "seed"), ("en", "seed"), ("en", "bb"), ("fr", "Dé")], "lang string, word string")
    rows = crawl.schedules(edges, nodes, responses, fixed, n=4, first=5, limit=4).orderBy("lang", "place").collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r.word)
    assert set(by_lang["en"][:2]) == {"seed", "bb"}  # fixed ones first, each key once
    assert len(by_lang["en"]) == 4 and set(by_lang["en"][2:]) == {"aa", "cc"}  # "x" is no word
    assert by_lang["fr"] == ["Dé"]  # the pool's "dé" is the same key
    assert by_lang["de"] == ["die"]
    only = crawl.schedules(edges, nodes, responses, fixed, n=4, first=5, limit=4, langs=["de"])
    assert [(r.lang, r.place, r.word) for r in only.collect()] == [("de", 1, "die")]
    assert crawl.schedules(edges.limit(0), nodes, responses, fixed.limit(0)).count() == 0


def test_response_calls_have_the_keys_of_their_calls(spark):
    r = spark.createDataFrame([(1, 'say "a"', "b", "m")], "id long, word string, text string, model string")
    row = crawl.response_calls(r).first()
    text = r'{"model": "m", "seed": 42, "word": "say \"a\""}'
    assert (row.kind, row.output, row.id) == ("response", "b", 1)
    assert row.cache_key == spark.range(1).select(F.left(F.sha1(F.lit(text)), F.lit(16))).first()[0]
