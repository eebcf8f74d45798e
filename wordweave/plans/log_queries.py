"""Queries about the search log, records and the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.functions.text import cache_key, is_query, iso, json_string, norm, tier
from wordweave.operators import crawl, paths, search_log, store
from wordweave.operators.keyed import KeyedTable
from wordweave.plans import schemas, testbed
from wordweave.plans.graph_queries import _DIST, _SAMPLE, _WALK, distribution
from wordweave.plans.registry import GRAPH, HEADS, LOG, NORM, query
from wordweave.session import shared_dir, written
from wordweave.sources.readers import table

_PAIRS = "SELECT arg_max(a, id) AS a, arg_max(b, id) AS b, min(hops) AS h, count(*) AS c, max(id) AS last FROM log WHERE {0} GROUP BY lower(log.a), lower(log.b)"
_SOLVED = _PAIRS.format("kind = 'path' AND status = 'ok'")


@query(f"WITH {LOG} SELECT id, kind, a, b, status, hops FROM log")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.log(spark, sf_dir).drop("created_at")


@query(f"WITH {LOG}, p AS ({_SOLVED}) SELECT a, b, h, c FROM p WHERE h >= 4 ORDER BY h DESC, last DESC LIMIT 20")
def log_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.far(testbed.log(spark, sf_dir), 4, 20)


_WORDS = "words AS (SELECT 'w' || i AS key, CASE i % 3 WHEN 0 THEN 'ko' ELSE 'en' END AS lang FROM range(0, 41) r(i))"


@query(f"WITH {LOG}, {_WORDS}, p AS ({_SOLVED} ORDER BY h DESC, last DESC LIMIT 300) SELECT a, b, h, c FROM p WHERE lower(a) IN (SELECT key FROM words WHERE lang = 'en') AND lower(b) IN (SELECT key FROM words WHERE lang = 'en') ORDER BY h DESC, last DESC LIMIT 25")
def log_far_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.range(41).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 == 0, "ko").otherwise("en").alias("lang"))
    return search_log.far_english(testbed.log(spark, sf_dir), words, 25)


@query(f"WITH {LOG}, p AS ({_PAIRS.format(chr(107) + 'ind = ' + chr(39) + 'share' + chr(39))}) SELECT a, b, c, h FROM p ORDER BY c DESC, last DESC LIMIT 20")
def log_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.shared(testbed.log(spark, sf_dir), 20)


@query(f"WITH {LOG}, p AS ({_SOLVED}) SELECT a, b, c, h FROM p ORDER BY c DESC, h ASC NULLS FIRST, last DESC LIMIT 20")
def log_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.top(testbed.log(spark, sf_dir), 20)


@query(f"WITH {LOG} SELECT a, b, status, hops AS h FROM log WHERE kind = 'path' ORDER BY id DESC LIMIT 20")
def log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.recent(testbed.log(spark, sf_dir), 20)


@query(f"WITH {LOG} SELECT arg_max(a, id) AS a, count(*) AS c FROM log WHERE kind = 'word' GROUP BY lower(log.a) ORDER BY max(id) DESC LIMIT 18")
def log_live_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.live_words(testbed.log(spark, sf_dir))


@query(f"WITH {LOG} SELECT kind, status, count(*) AS n FROM log GROUP BY ALL")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.log(spark, sf_dir).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


_GLOG = f"""WITH RECURSIVE {GRAPH}, {HEADS}, {LOG},
names AS (SELECT node, 'w' || (row_number() OVER (ORDER BY md5(node), node) - 1) AS w FROM heads ORDER BY md5(node), node LIMIT 41),
glog AS (SELECT id, kind, status, hops, coalesce(CASE WHEN l.a = upper(l.a) THEN upper(x.node) ELSE x.node END, l.a) AS a, coalesce(CASE WHEN l.b = upper(l.b) THEN upper(y.node) ELSE y.node END, l.b) AS b
         FROM log l LEFT JOIN names x ON x.w = lower(l.a) LEFT JOIN names y ON y.w = lower(l.b)),
byword AS (SELECT lower(word) AS word, min(key) AS key FROM nodes GROUP BY 1),
near AS (SELECT key AS s, key AS d, 0 AS n FROM byword WHERE key IN (SELECT node FROM names) UNION SELECT s, core.dst, n + 1 FROM near JOIN core ON core.src = d WHERE n < 6),
dist2 AS (SELECT s, d, min(n) AS n FROM near GROUP BY ALL)"""
_GPAIRS = "SELECT arg_max(a, id) AS a, arg_max(b, id) AS b, count(*) AS c, max(id) AS last FROM glog WHERE kind = 'path' AND {0} GROUP BY lower(glog.a), lower(glog.b)"


@query(
    f"""{_GLOG}, p AS ({_GPAIRS.format("status <> 'ok'")} ORDER BY c DESC, last DESC LIMIT 40)
    SELECT a, b, c FROM p LEFT JOIN byword x ON x.word = lower(trim(a)) LEFT JOIN byword y ON y.word = lower(trim(b))
    WHERE NOT EXISTS (SELECT 1 FROM dist2 WHERE s = x.key AND d = y.key)"""
)
def log_still_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = testbed.edges(spark, sf_dir)
    return search_log.still_open(testbed.graph_log(spark, sf_dir, e), testbed.words(spark, sf_dir), e)


@query(
    f"""{_GLOG}, p AS ({_GPAIRS.format("status = 'ok'")} ORDER BY last DESC LIMIT 40),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(lower(a), lower(b)), greatest(lower(a), lower(b)) ORDER BY last DESC) AS i FROM p) WHERE i = 1),
    w AS (SELECT a, b, f.n::INT AS fwd, r.n::INT AS back, CASE WHEN r.n IS NULL THEN 99 ELSE r.n - f.n END::INT AS gap
          FROM o JOIN byword x ON x.word = lower(trim(a)) JOIN byword y ON y.word = lower(trim(b)) JOIN dist2 f ON f.s = x.key AND f.d = y.key LEFT JOIN dist2 r ON r.s = y.key AND r.d = x.key)
    SELECT * FROM w WHERE gap >= 2"""
)
def log_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = testbed.edges(spark, sf_dir)
    return search_log.one_way(testbed.graph_log(spark, sf_dir, e), testbed.words(spark, sf_dir), e)


_REC = f"""recs AS (SELECT {NORM.format("a")} AS norm_a, {NORM.format("b")} AS norm_b, a, b, hops, id FROM log WHERE kind = 'path' AND status = 'ok')"""


def _records(log: DataFrame) -> DataFrame:
    rows = search_log.solved(log)
    return rows.select(norm(F.col("a")).alias("norm_a"), norm(F.col("b")).alias("norm_b"), "a", "b", "hops", F.col("id").cast("string").alias("finder"), "created_at")


RECORDS = "norm_a string, norm_b string, a string, b string, hops int, finder string, created_at timestamp"
_BEST = "r AS (SELECT norm_a, norm_b, a, b, hops, row_number() OVER (PARTITION BY norm_a, norm_b ORDER BY hops, id) AS i FROM recs)"


def records_table(spark: SparkSession, rows: DataFrame, buckets: int = 16) -> KeyedTable:
    """A table of records, by pair, with the best of rows."""
    out = KeyedTable(spark, f"{shared_dir(spark)}/keyed/records-{uuid.uuid4().hex}", RECORDS, schemas.KEYS["record"], buckets=buckets)
    out.upsert(rows, "hops", "created_at")
    return out


@query(f"WITH {LOG}, {_REC}, {_BEST} SELECT norm_a, norm_b, a, b, hops FROM r WHERE i = 1")
def store_upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the log's first half, then those of its second: only strictly fewer hops replace, and only folders in which one does are written."""
    log = testbed.log(spark, sf_dir)
    half = log.agg(F.max("id")).first()[0] // 2
    kept = records_table(spark, _records(log.filter(F.col("id") <= half)))
    kept.upsert(_records(store.newer_than(log, half)), "hops", "created_at")
    return kept.rows().select("norm_a", "norm_b", "a", "b", "hops")


_FEW = f"""{LOG}, {_REC}, {_BEST}, old AS (SELECT * FROM r WHERE i = 1),
few AS (SELECT norm_a, norm_b, a, b, 0 AS hops FROM (SELECT * FROM old ORDER BY md5(norm_a || ' ' || norm_b), norm_a, norm_b LIMIT 3) UNION ALL SELECT 'new' || norm_a, norm_b, 'new' || a, b, 7 FROM (SELECT * FROM old ORDER BY norm_a, norm_b LIMIT 1)
  UNION ALL SELECT norm_a, norm_b, 'slower', b, 99 FROM old)"""


def upsert_few(spark: SparkSession, sf_dir: str) -> tuple[KeyedTable, list[int]]:
    """All records stored, then three pairs beaten, one new one, and a claim for every pair that beats none; the folders that were written anew."""
    kept = records_table(spark, _records(testbed.log(spark, sf_dir)))
    old = written(kept.rows(), "records")
    three = old.orderBy(F.md5(F.concat_ws(" ", "norm_a", "norm_b")), "norm_a", "norm_b").limit(3).withColumn("hops", F.lit(0))
    new = old.orderBy("norm_a", "norm_b").limit(1).withColumns({"norm_a": F.concat(F.lit("new"), "norm_a"), "a": F.concat(F.lit("new"), "a"), "hops": F.lit(7)})
    slower = old.withColumns({"a": F.lit("slower"), "hops": F.lit(99)})
    return kept, kept.upsert(three.union(new).union(slower), "hops", "created_at")


@query(f"WITH {_FEW}, every AS (SELECT norm_a, norm_b, a, b, hops FROM old UNION ALL SELECT norm_a, norm_b, a, b, hops FROM few), n AS (SELECT *, row_number() OVER (PARTITION BY norm_a, norm_b ORDER BY hops) AS k FROM every) SELECT norm_a, norm_b, a, b, hops FROM n WHERE k = 1")
def store_upsert_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after a few of them were beaten."""
    return upsert_few(spark, sf_dir)[0].rows().select("norm_a", "norm_b", "a", "b", "hops")


@query(f"WITH {_FEW}, asked AS (SELECT norm_a, norm_b FROM few WHERE hops < 99) SELECT f.norm_a, f.norm_b, f.a, f.b, f.hops FROM few f WHERE hops < 99")
def store_lookup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beaten records alone, looked up by their keys in their folders."""
    kept, _ = upsert_few(spark, sf_dir)
    beaten = written(kept.rows().filter("hops = 0 or norm_a like 'new%'").select("norm_a", "norm_b"), "asked")
    return kept.lookup(beaten).select("norm_a", "norm_b", "a", "b", "hops")


@query(
    f"""WITH RECURSIVE {GRAPH}, {HEADS}, {_SAMPLE.format(n=150)}, {_WALK.format(e="core")}, {_DIST},
    q AS (SELECT qid, src AS a, dst AS b FROM pairs UNION ALL SELECT 1000, 'black hole', 'zzyzx' UNION ALL SELECT 1001, 'i love this so very much', 'zz'),
    s AS (SELECT q.*, hops AS way, qid < 1000 AS known, CASE WHEN qid % 2 = 0 AND qid < 1000 THEN 3 END AS prev FROM q LEFT JOIN solved USING (qid)),
    r AS (SELECT qid, a, b, CASE WHEN qid = 1001 THEN 'badword' WHEN NOT known THEN 'unseen' WHEN way IS NULL THEN 'nolink' ELSE 'ok' END AS status, way AS hops, prev FROM s)
    SELECT qid::BIGINT AS qid, a, b, status, hops, CASE WHEN hops IS NOT NULL THEN round(coalesce((SELECT max(share) FROM dist d WHERE d.hops >= r.hops), 0), 6) END AS rarity,
      CASE WHEN hops IS NOT NULL THEN prev END AS prev, coalesce(status = 'ok' AND (prev IS NULL OR hops < prev), false) AS record FROM r"""
)
def path_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = testbed.edges(spark, sf_dir)
    n = written(testbed.nodes(spark, sf_dir), "nodes")
    p = paths.sampled_pairs(e).select(F.col("qid").cast("long").alias("qid"), F.col("src").alias("a"), F.col("dst").alias("b"))
    p = written(p.union(spark.createDataFrame([(1000, "black hole", "zzyzx"), (1001, "i love this so very much", "zz")], p.schema)), "requests")
    asked = p.withColumns({"ok_a": is_query(F.col("a")), "ok_b": is_query(F.col("b"))})
    responses = n.join(e.select(F.col("src").alias("key")).distinct(), "key", "left_semi").select("word")
    records = p.filter("qid % 2 = 0 and qid < 1000").select(norm(F.col("a")).alias("norm_a"), norm(F.col("b")).alias("norm_b"), F.lit(3).alias("hops"))
    out = search_log.solve(asked, testbed.words(spark, sf_dir), responses, e, records, distribution(spark, sf_dir, e), F.lit(True))
    return out.withColumns({"rarity": F.round("rarity", 6), "record": F.coalesce("record", F.lit(False))}).drop("tier")


@query("SELECT doc_id, quality / 20.0 + toxic / 50.0 AS rarity, CASE WHEN quality / 20.0 + toxic / 50.0 <= 0.01 THEN 'top1' WHEN quality / 20.0 + toxic / 50.0 <= 0.05 THEN 'top5' WHEN quality / 20.0 + toxic / 50.0 <= 0.10 THEN 'top10' ELSE 'typical' END AS tier FROM labels")
def path_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("quality") / F.lit(20.0) + F.col("toxic") / F.lit(50.0)
    return table(spark, sf_dir, "labels").select("doc_id", share.alias("rarity"), tier(share).alias("tier"))


@query("SELECT 'share' AS kind, event_type AS a, 'x' || user_id AS b, substr(props || ' sent to a channel of its own', 1, 20) AS status, CASE WHEN event_id % 2 = 0 THEN user_id::INT END AS hops FROM events WHERE event_type <> 'error'")
def log_share_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a destination that is too long, hops that are no number and a missing word."""
    posts = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("a"),
        F.concat(F.lit(" x"), F.col("user_id").cast("string")).alias("b"),
        F.concat("props", F.lit(" sent to a channel of its own")).alias("to"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("far").alias("hops"),
    )
    return search_log.share_events(posts)


@query(
    """SELECT user_id % 7 AS run, 'w' || user_id AS start_word, event_type AS mode, value > 30 AS found, CASE WHEN user_id % 4 < 3 THEN (user_id % 4) * 12 END::INT AS k, to_json(['w' || user_id, 'x']) AS path
    FROM events ORDER BY event_id DESC LIMIT 50"""
)
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured runs, newest first, with their config's k, null for an unknown one; paths as JSON."""
    configs = spark.createDataFrame([(0, 0), (1, 12), (2, 24)], "config_id long, k int")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("config_id"), (F.col("user_id") % 7).alias("run"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("start_word"), F.col("event_type").alias("mode"), (F.col("value") > 30).alias("found"))
    path = F.to_json(F.array("start_word", F.lit("x"))).alias("path")
    return rows.join(F.broadcast(configs), "config_id", "left").orderBy(F.desc("event_id")).limit(50).select("run", "start_word", "mode", "found", "k", path)


_CALLS = r"""calls AS (
  SELECT 'response' AS kind, u.conv_id * 1000 + u.turn AS id, left(sha1('{"model": "m", "seed": 42, "word": "' || replace(replace(replace(replace(replace(u.text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"}'), 16) AS cache_key, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
led AS (SELECT kind, cache_key, output, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, cache_key ORDER BY id) AS i FROM calls) WHERE i = 1)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", "text")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    key = cache_key(model=F.lit('"m"'), seed=F.lit("42"), word=json_string(F.col("text")))
    return users.join(answers, ["conv_id", "turn"]).select(F.lit("response").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), key.alias("cache_key"), "output")


@query(f"WITH {_CALLS} SELECT kind, cache_key, output, id FROM led")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of calls, from conversations: keys from sorted JSON, one row a key."""
    return crawl.ledger(_calls(spark, sf_dir)).select("kind", "cache_key", "output", "id")


@query(f"WITH {_CALLS}, req AS (SELECT kind, cache_key FROM calls UNION ALL SELECT kind, reverse(cache_key) FROM calls WHERE id % 3 = 0) SELECT count(*) FILTER (l.output IS NOT NULL) AS hits, count(*) FILTER (l.output IS NULL) AS misses FROM req r LEFT JOIN led l USING (kind, cache_key)")
def ledger_hits_and_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = written(_calls(spark, sf_dir), "calls")
    req = calls.select("kind", "cache_key").union(calls.filter("id % 3 = 0").select("kind", F.reverse("cache_key")))
    hit, miss = crawl.through_cache(req, calls)
    tagged = hit.select(F.lit(1).alias("h")).union(miss.select(F.lit(0)))
    return tagged.agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


@query(f"WITH {_CALLS} SELECT kind, count(*) AS rows, (SELECT count(*) FROM led) AS kept FROM calls GROUP BY kind")
def ledger_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache taken over into an empty ledger: rows seen and kept for each kind."""
    calls = written(_calls(spark, sf_dir), "calls")
    none = calls.limit(0)
    kept = store.insert_or_ignore(none, calls, ["kind", "cache_key"], "id").groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))
    return calls.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).join(kept, "kind")


@query(f"WITH {_CALLS} SELECT kind, cache_key, output, id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY id) AS i FROM calls c WHERE NOT EXISTS (FROM calls o WHERE o.cache_key = c.cache_key AND (o.id // 1000) % 3 = 0)) WHERE i = 1")
def ledger_refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored responses add to a ledger that has a third of the conversations under present keys and the others under old ones."""
    calls = written(_calls(spark, sf_dir), "calls")
    ledger = KeyedTable(spark, f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}", "kind string, cache_key string, output string, id long", ["kind", "cache_key"], buckets=16)
    recent = F.expr("floor(id / 1000) % 3 = 0")
    ledger.insert(calls.withColumn("cache_key", F.when(recent, F.col("cache_key")).otherwise(F.reverse("cache_key"))), "id")
    c = table(spark, sf_dir, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text"))
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("word")).join(answers, ["conv_id", "turn"])
    responses = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "word", "text", F.lit("m").alias("model"))
    return ledger.insert(crawl.response_calls(responses), "id").select("kind", "cache_key", "output", "id")


_TOP5 = f"SELECT 'top' AS list, a, b, c AS n FROM (SELECT a, b, c, h, last FROM p ORDER BY c DESC, h ASC NULLS FIRST, last DESC LIMIT 5)"


@query(
    f"""WITH {LOG}, p AS ({_SOLVED}), f AS (SELECT a, b, h, last FROM p WHERE h >= 4 ORDER BY h DESC, last DESC LIMIT 20),
    s AS ({_PAIRS.format("kind = 'share'")})
    {_TOP5}
    UNION ALL SELECT 'far', a, b, h FROM (SELECT * FROM f ORDER BY md5('42' || a || b), a, b LIMIT 5)
    UNION ALL SELECT 'shared', a, b, c FROM (SELECT * FROM s ORDER BY c DESC, last DESC LIMIT 5)
    UNION ALL SELECT 'recent', a, b, hops FROM (SELECT a, b, hops FROM log WHERE kind = 'path' ORDER BY id DESC LIMIT 5)
    UNION ALL SELECT 'live', a, NULL, c FROM (SELECT arg_max(a, id) AS a, count(*) AS c, max(id) AS m FROM log WHERE kind = 'word' GROUP BY lower(log.a) ORDER BY m DESC LIMIT 18)"""
)
def log_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's lists of a front page, as one table; five of the farthest twenty by chance."""
    log = testbed.log(spark, sf_dir)
    row = lambda df, name, n, b="b": df.select(F.lit(name).alias("list"), "a", (F.col(b) if b else F.lit(None).cast("string")).alias("b"), F.col(n).cast("long").alias("n"))
    far = search_log.far(log, 4, 20).orderBy(F.md5(F.concat(F.lit("42"), "a", "b")), "a", "b").limit(5)
    out = row(search_log.top(log, 5), "top", "c").union(row(far, "far", "h")).union(row(search_log.shared(log, 5), "shared", "c"))
    return out.union(row(search_log.recent(log, 5), "recent", "h")).union(row(search_log.live_words(log), "live", "c", ""))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims by sampled pairs, every third of which has a record of 3 hops, with their answers and names."""
    e, n = testbed.edges(spark, sf_dir), testbed.nodes(spark, sf_dir)
    p = written(paths.sampled_pairs(e, 40).select(F.col("qid").cast("long").alias("qid"), F.col("src").alias("a"), F.col("dst").alias("b")), "claims")
    asked = p.withColumns({"ok_a": F.lit(True), "ok_b": F.lit(True)})
    responses = n.join(e.select(F.col("src").alias("key")).distinct(), "key", "left_semi").select("word")
    held = p.filter("qid % 3 = 0").select(norm(F.col("a")).alias("norm_a"), norm(F.col("b")).alias("norm_b"), "a", "b", F.lit(3).alias("hops"), F.lit("someone").alias("finder"), F.lit("2020").alias("created_at"))
    names = p.select("qid", F.when(F.col("qid") % 5 != 0, F.concat(F.lit("  "), "a", F.lit(" who has a long name "))).otherwise("  ").alias("name"))
    dist = search_log.distribution(p.limit(0).select(F.lit(1).alias("hops")))
    return search_log.solve(asked, testbed.words(spark, sf_dir), responses, e, held, dist, F.lit(True)), names, held


_CLAIMED = f"""WITH RECURSIVE {GRAPH}, {HEADS}, {_SAMPLE.format(n=40)}, {_WALK.format(e="core")},
s AS (SELECT qid, src AS a, dst AS b, hops, CASE WHEN qid % 3 = 0 THEN 3 END AS held, CASE WHEN qid % 5 <> 0 THEN substr(trim(src || ' who has a long name'), 1, 24) END AS name FROM solved),
c AS (SELECT *, hops IS NOT NULL AND (held IS NULL OR hops < held) AS accepted FROM s)"""


@query(f"{_CLAIMED} SELECT qid::BIGINT AS qid, a, b, accepted, CASE WHEN accepted THEN hops WHEN hops IS NOT NULL THEN held END::INT AS hops, CASE WHEN accepted THEN name WHEN hops IS NOT NULL AND held IS NOT NULL THEN 'someone' END AS holder FROM c")
def record_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to records, solved again: accepted ones with their names, others with the record that stands."""
    answers, names, held = _answers(spark, sf_dir)
    return search_log.claims(answers, names, held).drop("norm_a", "norm_b")


@query(f"{_CLAIMED} SELECT a, b, CASE WHEN accepted THEN hops ELSE held END::INT AS hops, CASE WHEN accepted THEN name ELSE 'someone' END AS finder FROM c WHERE accepted OR held IS NOT NULL")
def record_claims_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after the claims: accepted ones replace those they beat."""
    answers, names, held = _answers(spark, sf_dir)
    won = search_log.claims(answers, names, held).filter("accepted")
    new = won.select("norm_a", "norm_b", "a", "b", "hops", F.col("holder").alias("finder"), F.lit("2021").alias("created_at"))
    return store.upsert_records(held, new).select("a", "b", "hops", "finder")


@query(f"WITH {LOG}, r AS (SELECT a, b, status, hops AS h, row_number() OVER (ORDER BY id DESC) AS i FROM log WHERE kind = 'path') SELECT asked, a, b, status, h FROM r, (VALUES (2, 5), (40, 40), (5000, 300)) n(asked, k) WHERE i <= k")
def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the newest pairs, of sizes within bounds whatever is asked for."""
    log = testbed.log(spark, sf_dir)
    pages = [search_log.recent(log, search_log.clamped(n)).select(F.lit(n).alias("asked"), "a", "b", "status", "h") for n in (2, 40, 5000)]
    return pages[0].union(pages[1]).union(pages[2])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events")
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as the store keeps them."""
    return table(spark, sf_dir, "events").select("event_id", iso(F.col("ts")).alias("created_at"))


_RUNS = "SELECT event_id, 'w' || user_id AS start_word, event_type AS mode, value > 30 AS found, to_json(['w' || user_id, 'x']) AS path FROM events"


@query(f"WITH r AS ({_RUNS}), m AS (SELECT max(event_id) // 2 AS m FROM events) SELECT row_number() OVER (ORDER BY event_id) AS id, start_word, mode, found, path FROM r")
def run_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured runs in two writes, each numbered after the last one; paths as JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("start_word"), F.col("event_type").alias("mode"), (F.col("value") > 30).alias("found"))
    rows = rows.withColumn("path", F.to_json(F.array("start_word", F.lit("x"))))
    half = rows.agg(F.max("event_id")).first()[0] // 2
    none = rows.limit(0).withColumn("id", F.lit(0).cast("long"))
    old = written(store.appended(none, rows.filter(F.col("event_id") <= half), "event_id"), "runs")
    return store.appended(old, rows.filter(F.col("event_id") > half), "event_id").drop("event_id")


@query("SELECT 'v' || v.vec_id AS text, CASE WHEN v.vec_id % 2 = 0 THEN len(embedding) ELSE 2 END::INT AS dim FROM embeddings v UNION ALL SELECT 'unknown', NULL")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings inserted where a text has none yet, then looked up, one of them in vain."""
    v = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))
    odd = F.substring("text", 2, 20).cast("long") % 2 == 1
    kept = KeyedTable(spark, f"{shared_dir(spark)}/keyed/embeddings-{uuid.uuid4().hex}", "model string, text string, dim int, vec array<float>", schemas.KEYS["embedding"])
    kept.insert(v.filter(odd).withColumn("dim", F.lit(2)), "dim")
    kept.insert(v, "dim")
    asked = v.select("model", "text").union(spark.createDataFrame([("m", "unknown")], "model string, text string"))
    return store.found(asked, kept.lookup(asked), schemas.KEYS["embedding"]).select("text", "dim")


_PAGE = f"""{_GLOG}, {_SAMPLE.format(n=150)}, {_WALK.format(e="core")}, {_DIST},
cut AS (SELECT coalesce(min(hops) FILTER (share <= 0.10), max(hops), 6) AS t FROM dist),
p AS (SELECT arg_max(a, id) AS a, arg_max(b, id) AS b, min(hops) AS h, count(*) AS c, max(id) AS last FROM glog WHERE kind = 'path' AND status = 'ok' GROUP BY lower(glog.a), lower(glog.b)),
sh AS (SELECT arg_max(a, id) AS a, arg_max(b, id) AS b, count(*) AS c, max(id) AS last FROM glog WHERE kind = 'share' GROUP BY lower(glog.a), lower(glog.b)),
bad AS ({_GPAIRS.format("status <> 'ok'")} ORDER BY c DESC, last DESC LIMIT 40),
op AS (SELECT a, b, c, last FROM bad LEFT JOIN byword x ON x.word = lower(trim(a)) LEFT JOIN byword y ON y.word = lower(trim(b)) WHERE NOT EXISTS (SELECT 1 FROM dist2 WHERE s = x.key AND d = y.key)),
new AS ({_GPAIRS.format("status = 'ok'")} ORDER BY last DESC LIMIT 40),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(lower(a), lower(b)), greatest(lower(a), lower(b)) ORDER BY last DESC) AS i FROM new) WHERE i = 1),
ow AS (SELECT a, b, last, f.n AS fwd, CASE WHEN r.n IS NULL THEN 99 ELSE r.n - f.n END AS gap
       FROM once JOIN byword x ON x.word = lower(trim(a)) JOIN byword y ON y.word = lower(trim(b)) JOIN dist2 f ON f.s = x.key AND f.d = y.key LEFT JOIN dist2 r ON r.s = y.key AND r.d = x.key),
far AS (SELECT a, b, h, last FROM p, cut WHERE h >= t ORDER BY h DESC, last DESC LIMIT 20),
fe AS (SELECT * FROM p ORDER BY h DESC, last DESC LIMIT 300)"""
_EN = f"(SELECT key FROM nodes WHERE lang = 'en')"


@query(
    f"""{_PAGE}
    SELECT 'thrown' AS list, NULL AS a, NULL AS b, count(*) AS n FROM heads
    UNION ALL SELECT 'nodes', NULL, NULL, count(*) FROM nodes UNION ALL SELECT 'edges', NULL, NULL, count(*) FROM edges
    UNION ALL SELECT 'top', a, b, c FROM (SELECT * FROM p ORDER BY c DESC, h ASC NULLS FIRST, last DESC LIMIT 5)
    UNION ALL SELECT 'far', a, b, h FROM (SELECT * FROM far ORDER BY md5('42' || a || b), a, b LIMIT 5)
    UNION ALL SELECT 'far_en', a, b, h FROM (SELECT * FROM fe WHERE {NORM.format("a")} IN {_EN} AND {NORM.format("b")} IN {_EN} ORDER BY h DESC, last DESC LIMIT 5)
    UNION ALL SELECT 'shared', a, b, c FROM (SELECT * FROM sh ORDER BY c DESC, last DESC LIMIT 5)
    UNION ALL SELECT 'recent', a, b, hops FROM (SELECT a, b, hops FROM glog WHERE kind = 'path' ORDER BY id DESC LIMIT 5)
    UNION ALL SELECT 'live', a, NULL, c FROM (SELECT arg_max(a, id) AS a, count(*) AS c, max(id) AS m FROM glog WHERE kind = 'word' GROUP BY lower(glog.a) ORDER BY m DESC LIMIT 18)
    UNION ALL SELECT 'oneway', a, b, gap FROM (SELECT * FROM ow WHERE gap >= 2 ORDER BY gap DESC, fwd, last DESC LIMIT 5)
    UNION ALL SELECT 'open', a, b, c FROM (SELECT * FROM op ORDER BY c DESC, last DESC LIMIT 5)"""
)
def front_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a front page shows, as one table: three counts and eight lists, the far ones from the measured threshold on, five of twenty by chance."""
    e, n = testbed.edges(spark, sf_dir), testbed.nodes(spark, sf_dir)
    log = written(testbed.graph_log(spark, sf_dir, e), "log")
    none = F.lit(None).cast("string")
    row = lambda df, name, value, b="b": df.select(F.lit(name).alias("list"), "a", (F.col(b) if b else none).alias("b"), F.col(value).cast("long").alias("n"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), none.alias("a"), none.alias("b"), "n")
    words = testbed.words(spark, sf_dir)
    asked, newest = search_log.open_pairs(log, words), search_log.recent_pairs(log, words)
    sample = paths.sampled_pairs(e).select(F.concat(F.lit("sample:"), F.col("qid").cast("string")).alias("qid"), "src", "dst")
    every = sample.union(search_log.requests(asked, "open")).union(search_log.requests(newest, "there")).union(search_log.requests(newest, "back", True))
    ways = written(paths.hops(e, every), "ways")  # one search for the three lists that need one
    far = search_log.far_beyond(log, search_log.far_threshold(search_log.distribution(search_log.answers(ways, "sample", "hops"))), 20)
    parts = [
        count(e.select("src").distinct(), "thrown"),
        count(n, "nodes"),
        count(e, "edges"),
        row(search_log.top(log, 5), "top", "c"),
        row(far.orderBy(F.md5(F.concat(F.lit("42"), "a", "b")), "a", "b").limit(5), "far", "h"),
        row(search_log.far_english(log, n, 5), "far_en", "h"),
        row(search_log.shared(log, 5), "shared", "c"),
        row(search_log.recent(log, 5), "recent", "h"),
        row(search_log.live_words(log), "live", "c", ""),
        row(search_log.one_way_list(newest, ways, 5), "oneway", "gap"),
        row(search_log.open_list(asked, ways, 5), "open", "c"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
