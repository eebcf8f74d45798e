"""Keyed writes, sources and sinks, phrases, and the search log's decisions."""

import json

from pyspark.sql import functions as F

from wordweave.operators import build, crawl, phrases, search_log, store
from wordweave.plans import schemas
from wordweave.sources import readers

LOG = "id long, kind string, a string, b string, status string, hops int"


def test_insert_or_ignore_keeps_the_first(spark):
    old = spark.createDataFrame([(1, 10, 5, 3)], "config_id int, src_id int, dst_id int, rank int")
    new = spark.createDataFrame([(1, 10, 5, 1), (1, 10, 6, 4), (1, 10, 6, 2), (2, 10, 5, 9)], old.schema)
    got = {(r.config_id, r.dst_id): r.rank for r in store.insert_edges(old, new).collect()}
    assert got == {(1, 5): 3, (1, 6): 2, (2, 5): 9}


def test_upsert_takes_strictly_fewer(spark):
    cols = "norm_a string, norm_b string, hops int, finder string, created_at string"
    old = spark.createDataFrame([("a", "b", 3, "old", "1")], cols)
    same = store.upsert_records(old, spark.createDataFrame([("a", "b", 3, "new", "2"), ("c", "d", 9, "n", "2")], cols))
    assert {(r.norm_a, r.finder) for r in same.collect()} == {("a", "old"), ("c", "n")}
    assert store.upsert_records(old, spark.createDataFrame([("a", "b", 2, "new", "2")], cols)).first().finder == "new"


def test_ids_continue(spark):
    old = spark.createDataFrame([(7, "x")], "id long, key string")
    got = {r.key: r.id for r in store.with_ids(old, spark.createDataFrame([("x",), ("y",), ("y",), ("z",)], "key string"), ["key"], "key").collect()}
    assert got == {"x": 7, "y": 8, "z": 9}


def test_conformed_and_upgraded(spark):
    row = schemas.upgraded_nodes(spark.createDataFrame([(1, "재즈", "재즈")], "id long, key string, word string")).first()
    assert (row.lang, row.ok) == ("ko", None)
    assert schemas.upgraded_configs(spark.createDataFrame([(1, "m")], "id long, gen_model string")).first().seed == -1


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" jazz \n\n blues\n")
    words = readers.word_lines(spark, str(tmp_path / "seeds.txt"))
    assert [r.word for r in words.collect()] == ["jazz", "blues"]
    readers.write_word_lines(words, str(tmp_path / "out"))
    assert readers.word_lines(spark, str(tmp_path / "out")).count() == 2
    readers.write_tsv(spark.createDataFrame([("k", 1), ("l", 0)], "key string, value int"), str(tmp_path / "tsv"))
    assert {(r.key, r.value) for r in readers.tsv_pairs(spark, str(tmp_path / "tsv")).collect()} == {("k", "1"), ("l", "0")}
    (tmp_path / "x.tsv").write_text("a\tb\tc\nno tab\n")
    assert [(r.key, r.value) for r in readers.tsv_pairs(spark, str(tmp_path / "x.tsv")).collect()] == [("a", "b\tc")]
    for kind in ("respond", "embed"):
        (tmp_path / "cache" / kind).mkdir(parents=True)
        (tmp_path / "cache" / kind / "1.json").write_text(json.dumps({"key": {"w": kind}, "value": ["v"]}, indent=1))
    assert {(r.kind, r.value) for r in readers.json_cache(spark, str(tmp_path / "cache")).collect()} == {("respond", '["v"]'), ("embed", '["v"]')}


def test_feeds_and_page_views(spark):
    feed = spark.createDataFrame([("f", "<title>Own</title><title>A &amp; <b>B</b></title>"), ("g", None)], "feed string, body string")
    assert [r.title for r in readers.feed_titles(feed).collect()] == ["A & B"]
    views = spark.createDataFrame([(1, '{"items":[{"articles":[{"article":"Main_Page"},{"article":"Dune_(film)"}]}]}'), (2, "broken")], "id long, body string")
    assert [(r.id, r.title) for r in readers.page_view_titles(views).collect()] == [(1, "Dune")]


def test_newest_spelling_and_fewest_hops(spark):
    log = spark.createDataFrame([(1, "path", "Jazz", "x", "ok", 2), (2, "path", "JAZZ", "x", "ok", 5), (3, "path", "jazz", "X", None, None)], LOG)
    row = search_log.top(log, 5).collect()
    assert [(r.a, r.b, r.c, r.h) for r in row] == [("JAZZ", "x", 2, 2)]
    assert search_log.pairs(log.filter("kind = 'path' and status <> 'ok'")).count() == 0  # null status is dropped


def test_threshold_and_rarity(spark):
    sample = spark.createDataFrame([(h,) for h in [2] * 5 + [3] * 4 + [6]], "hops int")
    dist = search_log.distribution(sample)
    assert search_log.far_threshold(dist).first().threshold == 6
    assert search_log.far_threshold(dist.limit(0)).first().threshold == 6
    rows = search_log.with_rarity(spark.createDataFrame([(3,), (4,), (9,), (None,)], "hops int"), dist)
    assert [(r.hops, r.rarity, r.tier) for r in rows.orderBy(F.col("hops").asc_nulls_last()).collect()] == [(3, 0.5, "typical"), (4, 0.1, "top10"), (9, 0.0, "top1"), (None, None, None)]


def test_edges_keep_rank_gaps_and_drop_loops(spark):
    t = spark.createDataFrame([(1, "black hole", "Black-hole eats blackhole and star")], "id long, head string, text string")
    assert {(r.dst, r.rank) for r in build.edges(t).collect()} == {("eats", 2), ("and", 4), ("star", 5)}
    assert {(r.dst, r.rank) for r in build.edges(t, keep_loops=True).collect()} == {("blackhole", 1), ("eats", 2), ("and", 4), ("star", 5)}


def test_known_phrases_win_where_longer(spark):
    vocab = spark.createDataFrame([("event horizon",), ("event horizon of",), ("horizon of doom",)], "phrase string")
    texts = spark.createDataFrame([(1, "The Event Horizon of light"), (2, "event"), (3, None), (4, "a horizon of doom")], "id long, text string")
    got = {r.id: [s.word for s in r.spans] for r in phrases.with_known(texts, vocab).collect()}
    assert got == {1: ["The", "Event Horizon of", "light"], 2: ["event"], 3: [], 4: ["a", "horizon of doom"]}


def test_cache_misses(spark):
    calls = spark.createDataFrame([(2, "r", "k", "late"), (1, "r", "k", "early")], "id long, kind string, cache_key string, output string")
    hit, miss = crawl.through_cache(spark.createDataFrame([("r", "k"), ("r", "z")], "kind string, cache_key string"), calls)
    assert [r.output for r in hit.collect()] == ["early"] and [r.cache_key for r in miss.collect()] == ["z"]


def test_known_phrases_against_brute_force(spark):
    import random
    import re

    from wordweave.functions.text import JUNK, TOKEN

    rng = random.Random(8)
    words = ["red", "blue", "one", "sky", "é-tude", "12", "a"]
    texts = [(i, rng.choice(["", "¡"]) + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))).replace("sky", "Sky,")) for i in range(60)]
    vocab = {" ".join(rng.choice(words) for _ in range(k)) for k in (2, 2, 2, 3, 3, 4) for _ in range(6)}
    vocab = {v for v in vocab if 4 <= len(v) <= 60}

    def brute(text):
        spans = [(m.start(), m.end(), m.group()) for m in re.finditer(TOKEN, text) if m.group().lower() not in JUNK]
        hits = []
        for start in {s for s, _, _ in spans}:
            ends = [e for e in range(start + 4, min(len(text), start + 60) + 1) if text[start:e].lower() in vocab]
            if ends:
                hits.append((start, max(ends), text[start : max(ends)]))
        out, last = [], -1
        for s, e, w in sorted(spans + hits, key=lambda x: (x[0], x[0] - x[1])):
            if s >= last:
                out.append(w)
                last = e
        return out

    known = spark.createDataFrame([(v,) for v in sorted(vocab)] + [("¡not", ), (" a b",), ("x" * 61 + " y",)], "phrase string")
    for most in (0, 1000):  # hashes go to the index, or the index to the texts
        rows = phrases.with_known(spark.createDataFrame(texts, "id long, text string"), known, most)
        got = {r.id: [s.word for s in r.spans] for r in rows.collect()}
        assert got == {i: brute(t) for i, t in texts}
    assert phrases.with_known(spark.createDataFrame(texts, "id long, text string"), known.limit(0)).count() == len(texts)
    assert any(" " in w for ws in got.values() for w in ws)
