"""Noun spans of tagged texts against a plain reading of the rules."""

import random

from pyspark.sql import functions as F

from wordweave.functions import nouns
from wordweave.operators import build
from wordweave.plans.text_queries import noun_compounds, noun_compounds_lateral


def spans(spark, rows):
    """rows: (lang, text, tags)"""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, lang string, text string, tags {nouns.TAGS}")
    got = df.select("i", nouns.noun_spans(F.col("text"), F.col("tags"), F.col("lang")).alias("s")).collect()
    return [[tuple(x) for x in r.s] for r in sorted(got, key=lambda r: r.i)]


def token(start, text, tag="", pos="", dep="", head=0, stop=False, num=False, lemma=None):
    return (start, len(text), text, lemma, tag, pos, dep, head, stop, num)


def test_korean_and_chinese(spark):
    ko = [token(0, "뇌", "NNG"), token(1, "는", "JX"), token(3, "것", "NNG"), token(5, "酸", "SH"), token(7, "A", "SL"), token(9, "AT", "SL"), token(12, "수", "NNB")]
    zh = [token(0, "线粒体", "n"), token(3, "是", "v"), token(4, "细胞", "nz"), token(6, "王小", "nr"), token(8, "人", "n"), token(9, "ATP", "eng")]
    got = spans(spark, [("ko", "뇌는 것 酸 A AT 수", ko), ("zh", "线粒体是细胞王小人ATP", zh), ("ko", None, None), ("en", "", [])])
    assert got == [[(0, 1, "뇌"), (5, 6, "酸"), (9, 11, "AT")], [(0, 3, "线粒体"), (4, 6, "细胞"), (9, 12, "ATP")], [], []]


def plain(text, tags):
    out = []
    for i, t in enumerate(tags):
        start, n, word, lemma, _, pos, dep, head, stop, num = t
        if pos not in ("NOUN", "PROPN") or stop or len(word) < 2 or num:
            continue
        if dep in ("compound", "amod") and head != i and tags[head][5] in ("NOUN", "PROPN"):
            continue
        mods = [j for j, m in enumerate(tags) if j != i and m[7] == i and m[6] in ("compound", "amod") and m[5] in ("NOUN", "PROPN", "ADJ") and not m[8]]
        if mods and 0 < i + 1 - min(mods) <= 3 and min(mods) < i:
            out.append((tags[min(mods)][0], start + n, text[tags[min(mods)][0] : start + n]))
        else:
            out.append((start, start + n, lemma or word))
    return [s for s in out if s[2].lower() not in ("time", "year") and not s[2].isdigit()]


def test_compounds(spark):
    rng, rows = random.Random(3), []
    for length in (1, 2, 5, 9, 30, 900, 900, 900):
        words = [rng.choice(["black", "hole", "time", "é\U0001f600", "a", "42", "event"]) for _ in range(length)]
        starts = [sum(len(w) + 1 for w in words[:i]) for i in range(length)]
        tags = [
            token(starts[i], w, "", rng.choice(["NOUN", "PROPN", "ADJ", "VERB"]), rng.choice(["compound", "amod", "nsubj"]), min(length - 1, max(0, i + rng.randrange(-2, 5))), rng.random() < 0.1, w == "42", rng.choice([None, "", w.lower()]))
            for i, w in enumerate(words)
        ]
        rows.append(("en", " ".join(words), tags))
    want = [plain(text, tags) for _, text, tags in rows]
    assert spans(spark, rows) == want and sum(" " in s[2] for w in want for s in w) > 20


def by_capitals(lang):
    """A tagger for tests: words with a capital are nouns, and modify the next one if that is a noun."""

    def tag(texts):
        out = []
        for text in texts:
            words, at, rows = text.split(" "), 0, []
            big = [w[:1].isupper() for w in words]
            for i, w in enumerate(words):
                follows = big[i] and i + 1 < len(words) and big[i + 1]
                rows.append((at, len(w), w, w, lang, "PROPN" if big[i] else "VERB", "compound" if follows else "dep", i + 1 if follows else i, False, False))
                at += len(w) + 1
            out.append(rows)
        return out

    return tag


def test_tagged_texts_to_neighbours(spark):
    rows = [(1, "jazz", "Miles Davis plays Jazz in New York", "en"), (2, "x", None, "es"), (3, "y", "Miles Davis and miles Davis", "en")]
    df = nouns.tagged(spark.createDataFrame(rows, "id long, head string, text string, lang string"), by_capitals)
    df = df.withColumn("words", nouns.words(nouns.noun_spans(F.col("text"), F.col("tags"), F.col("lang"))))
    got = {(r.id, r.word, r.rank) for r in build.neighbours(df, F.col("words")).collect()}
    assert got == {(1, "Miles Davis", 1), (1, "New York", 2), (3, "Miles Davis", 1), (3, "Davis", 2)}
    pairs = {(r.src, r.dst, r["rank"]) for r in build.edges(df, words=F.col("words")).collect()}
    assert pairs == {("jazz", "milesdavis", 1), ("jazz", "newyork", 2), ("y", "milesdavis", 1), ("y", "davis", 2)}


def by_hand(lang):
    """Tags as a tagger of each language would give them."""
    rows = {
        "재즈는 음악이다 SF": [(0, 2, "재즈", "재즈", "NNG", "", "", 0, False, False), (2, 1, "는", "는", "JX", "", "", 1, False, False), (4, 2, "음악", "음악", "NNG", "", "", 2, False, False), (9, 2, "SF", "SF", "SL", "", "", 3, False, False)],
        "黑洞和王明吃光 ok": [(0, 2, "黑洞", "黑洞", "n", "", "", 0, False, False), (3, 2, "王明", "王明", "nr", "", "", 1, False, False), (6, 1, "光", "光", "n", "", "", 2, False, False), (8, 2, "ok", "ok", "eng", "", "", 3, False, False)],
        "宇宙の音楽理論": [(0, 2, "宇宙", "宇宙", "", "NOUN", "nmod", 3, False, False), (2, 1, "の", "の", "", "ADP", "case", 0, False, False), (3, 2, "音楽", "音楽", "", "NOUN", "compound", 3, False, False), (5, 2, "理論", "理論", "", "NOUN", "root", 3, False, False)],
        "The event horizons glow": [(0, 3, "The", "the", "", "DET", "det", 2, True, False), (4, 5, "event", "event", "", "NOUN", "compound", 2, False, False), (10, 8, "horizons", "horizon", "", "NOUN", "nsubj", 3, False, False), (19, 4, "glow", "glow", "", "VERB", "root", 3, False, False)],
    }
    return lambda texts: [rows.get(t, []) for t in texts]


def test_lateral_join_with_a_tagger(spark):
    spark.udtf.register("tagged_by_hand", nouns.tagger(by_hand))
    texts = [(1, "재즈는 음악이다 SF", "ko"), (2, "黑洞和王明吃光 ok", "zh"), (3, "宇宙の音楽理論", "ja"), (4, "The event horizons glow", "en"), (5, "untagged", "en"), (6, None, "en")]
    docs = spark.createDataFrame(texts, "id long, text string, lang string")
    rows = spark.sql("SELECT d.id, t.* FROM {docs} d, LATERAL tagged_by_hand(d.text, d.lang) t", docs=docs)
    spans = docs.join(nouns.gathered(rows, "id"), "id").select("id", nouns.words(nouns.noun_spans(F.col("text"), F.col("tags"), F.col("lang"))).alias("w"))
    got = {r.id: r.w for r in spans.collect()}
    assert got == {1: ["재즈", "음악", "SF"], 2: ["黑洞", "ok"], 3: ["宇宙", "音楽理論"], 4: ["event horizons"]}


def test_tags_of_a_whole_text_are_neither_gathered_nor_joined(spark, sf_dir):
    df = noun_compounds_lateral(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in noun_compounds(spark, sf_dir).collect()}
