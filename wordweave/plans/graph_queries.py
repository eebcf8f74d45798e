"""Queries about the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.functions.text import TOKEN, norm
from wordweave.operators import build, crawl, metrics, paths, search_log, store
from wordweave.plans import schemas
from wordweave.plans.registry import GRAPH, HEADS, NORM, query
from wordweave.plans.testbed import config_edges, edges, flagged, nodes, texts
from wordweave.session import written
from wordweave.sources.readers import table

WITH = f"WITH RECURSIVE {GRAPH}, {HEADS}"


@query(f"{WITH} SELECT src, dst, rank::INT AS rank FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.edges(texts(spark, sf_dir))


@query(f"{WITH} SELECT id, head, low AS word, rank::INT AS rank FROM nb")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.neighbours(texts(spark, sf_dir)).select("id", "head", F.col("low").alias("word"), "rank")


@query(f"{WITH} SELECT key, word, lang FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.nodes(texts(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT DISTINCT {NORM.format('x')} AS key, x AS text FROM (SELECT unnest(w) AS x FROM t) WHERE key <> ''")
def graph_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.surfaces(texts(spark, sf_dir))


@query(f"{WITH} SELECT dst AS word, count(*) AS indeg FROM edges GROUP BY dst ORDER BY indeg DESC, word LIMIT 15")
def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hubs(edges(spark, sf_dir))


@query(f"{WITH} SELECT dst AS word, count(*) AS indeg FROM edges GROUP BY dst HAVING indeg = 1 ORDER BY md5('42' || dst), word LIMIT 15")
def graph_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dead_ends(edges(spark, sf_dir))


_OPEN = "SELECT dst AS word, count(*) AS indeg, any_value(lang) AS lang FROM edges JOIN nodes ON key = dst WHERE dst NOT IN (SELECT node FROM heads) GROUP BY dst"
# A lower-case token is a word unless it is one Latin character long.
_WORD = "length(word) > 1"


def _responses(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("key")).distinct()


@query(f"{WITH} SELECT * FROM ({_OPEN} ORDER BY indeg DESC, word LIMIT 60) WHERE {_WORD}")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return crawl.frontier(e, nodes(spark, sf_dir), _responses(e), 60)


@query(f"{WITH} SELECT * FROM ({_OPEN} HAVING any_value(lang) IN ('other', 'mix') ORDER BY indeg DESC, word LIMIT 40) WHERE {_WORD}")
def crawl_frontier_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return crawl.frontier(e, nodes(spark, sf_dir), _responses(e), 40, ["other", "mix"])


_POOL = f"""o AS ({_OPEN} HAVING any_value(lang) = 'en'),
parts AS (SELECT * FROM (SELECT word, 0 AS part, indeg FROM o ORDER BY indeg DESC, word LIMIT 50) UNION ALL
          SELECT * FROM (SELECT word, 1 AS part, indeg FROM o ORDER BY md5('42' || word), word LIMIT 50)),
pool AS (SELECT word, part, indeg AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY part) AS n FROM parts WHERE {_WORD}) WHERE n = 1)"""


@query(f"{WITH}, {_POOL} SELECT word, part::INT AS part, score FROM pool")
def crawl_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return crawl.pool(e, nodes(spark, sf_dir), _responses(e), "en", 100)


@query(
    f"""{WITH}, {_POOL}, fixed AS (SELECT DISTINCT lower(n_name) AS word FROM nation ORDER BY md5('42' || lower(n_name)), word LIMIT 10)
    SELECT word FROM (SELECT word, 0 AS part, 0 AS score FROM fixed UNION ALL SELECT word, 1, score FROM pool) ORDER BY part, score DESC, md5(word), word LIMIT 60"""
)
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    fixed = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word")).distinct()
    return crawl.schedule(fixed, crawl.pool(e, nodes(spark, sf_dir), _responses(e), "en", 100), first=10, limit=60)


@query(
    f"""{WITH}, o AS MATERIALIZED ({_OPEN}), given AS (SELECT DISTINCT lang, key AS word FROM heads JOIN nodes ON key = node),
    parts AS (SELECT lang, word, 0 AS part, 0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || word), word) AS i FROM given) WHERE i <= 20
              UNION SELECT lang, word, 1, indeg FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY indeg DESC, word) AS i, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || word), word) AS j FROM o) WHERE i <= 45 OR j <= 45),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY part, score DESC, md5(word), word) AS place FROM parts WHERE part = 0 OR {_WORD})
    SELECT lang, place::INT AS place, word FROM placed WHERE place <= 100"""
)
def crawl_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's words of every language: heads of its texts as fixed seeds, then its pool."""
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    heads = _responses(e)
    fixed = heads.join(n, "key").select("lang", F.col("key").alias("word"))
    return crawl.schedules(e, n, heads, fixed, n=90, first=20, limit=100)


@query(f"{WITH} SELECT DISTINCT word FROM (SELECT low AS word, {NORM.format('low')} AS key FROM tok) WHERE key NOT IN (SELECT node FROM heads) AND key <> ''")
def crawl_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    t = build.neighbours(texts(spark, sf_dir)).select(F.col("low").alias("word"))
    own = texts(spark, sf_dir).select(F.col("head").alias("word"))
    junk = texts(spark, sf_dir).select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1)), F.lower)).alias("word"))
    every = t.union(own).union(junk).distinct().withColumn("key", norm(F.col("word")))
    return every.filter("key <> ''").join(_responses(e), "key", "left_anti").select("word")


@query(f"{WITH} SELECT src, dst FROM core")
def graph_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.core(edges(spark, sf_dir)).select("src", "dst")


@query(f"{WITH} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM core UNION ALL SELECT dst, src FROM core)")
def graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.undirected(paths.core(edges(spark, sf_dir)))


def _clustering(e: str) -> str:
    """Triangle counts by wedges of lower to higher names."""
    return f"""
und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {e} WHERE src <> dst),
deg AS (SELECT node, count(*) AS d FROM (SELECT u AS node FROM und UNION ALL SELECT v FROM und) GROUP BY node),
tri AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM und a JOIN und b ON a.v = b.u JOIN und c ON c.u = a.u AND c.v = b.v),
tn AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY node),
loc AS (SELECT coalesce(sum(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 0) AS s FROM deg LEFT JOIN tn USING (node)),
rec AS (SELECT count(*) AS m, coalesce(avg(CASE WHEN b.src IS NOT NULL THEN 1.0 ELSE 0 END), 0) AS r FROM {e} a LEFT JOIN {e} b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst)"""


@query(
    f"""{WITH}, {_clustering("edges")},
    v AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst),
    ends AS (SELECT src AS x, dst AS y FROM edges UNION ALL SELECT dst, src FROM edges),
    lab(node, c) USING KEY (node) AS (SELECT node, node FROM v UNION SELECT y, min(l.c) FROM lab l JOIN ends ON x = l.node JOIN recurring.lab r ON r.node = y WHERE l.c < r.c GROUP BY y),
    wcc AS (SELECT count(*) AS n FROM lab GROUP BY c)
    SELECT (SELECT count(*) FROM v) AS nodes, (SELECT m FROM rec) AS edges, (SELECT count(*) FROM heads) AS expanded_nodes, (SELECT count(*) FROM v) - (SELECT count(*) FROM heads) AS frontier_nodes,
      round((SELECT sum(n) FROM i) / (SELECT count(*) FROM v), 6) AS mean_in_degree, (SELECT max(n) FROM i) AS max_in_degree,
      round((SELECT r FROM rec), 6) AS reciprocity, round((SELECT s FROM loc) / (SELECT count(*) FROM v), 6) AS clustering, (SELECT max(n) FROM wcc) AS largest_wcc, round((SELECT max(n) FROM wcc) / (SELECT count(*) FROM v), 6) AS wcc_ratio"""
)
def graph_full_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_stats(edges(spark, sf_dir))


def graph_stats(e: DataFrame) -> DataFrame:
    stats = metrics.full_stats(e)
    return stats.select("nodes", "edges", "expanded_nodes", "frontier_nodes", F.round("mean_in_degree", 6).alias("mean_in_degree"), "max_in_degree", F.round("reciprocity", 6).alias("reciprocity"), F.round("clustering", 6).alias("clustering"), "largest_wcc", F.round("wcc_ratio", 6).alias("wcc_ratio"))


_REACH = "reach AS (SELECT src AS s, dst AS d FROM core UNION SELECT s, dst FROM reach JOIN core ON core.src = d)"


@query(
    f"""{WITH}, {_clustering("core")}, {_REACH},
    scc AS (SELECT a.s AS node, count(DISTINCT a.d) AS n FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s GROUP BY a.s),
    k AS (SELECT count(*) AS n FROM heads)
    SELECT n AS nodes, (SELECT m FROM rec) AS edges, round((SELECT s FROM loc) / n, 6) AS clustering, round((SELECT r FROM rec), 6) AS reciprocity,
      round((SELECT m FROM rec) / (n * (n - 1)), 9) AS density, coalesce((SELECT max(n) FROM scc), 1) AS largest_scc FROM k"""
)
def graph_core_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.core_stats(edges(spark, sf_dir))
    return s.select("nodes", "edges", F.round("clustering", 6).alias("clustering"), F.round("reciprocity", 6).alias("reciprocity"), F.round("density", 9).alias("density"), "largest_scc")


@query(f"{WITH}, {_REACH} SELECT node, coalesce(least(node, (SELECT min(a.d) FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s WHERE a.s = node)), node) AS component FROM (SELECT src AS node FROM core UNION SELECT dst FROM core)")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strong_components(paths.core(edges(spark, sf_dir)))


@query(f"{WITH} SELECT s.lang AS src_lang, d.lang AS dst_lang, count(*) AS edges FROM edges JOIN nodes s ON s.key = src JOIN nodes d ON d.key = dst GROUP BY ALL")
def graph_language_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.language_bridges(edges(spark, sf_dir), nodes(spark, sf_dir))


_SAMPLE = """
ha AS (SELECT node AS src, row_number() OVER (ORDER BY md5('42:a:' || node), node) - 1 AS qid FROM heads ORDER BY md5('42:a:' || node), node LIMIT {n} + 1),
hb AS (SELECT node AS dst, row_number() OVER (ORDER BY md5('42:b:' || node), node) - 1 AS qid FROM heads ORDER BY md5('42:b:' || node), node LIMIT {n} + 1),
pairs AS (SELECT qid, src, dst FROM ha JOIN hb USING (qid) WHERE src <> dst AND (SELECT count(*) >= 50 FROM heads) ORDER BY qid LIMIT {n})"""
_WALK = """
walk AS (SELECT qid, src AS node, 0 AS d FROM pairs UNION SELECT qid, {e}.dst, d + 1 FROM walk JOIN {e} ON {e}.src = node WHERE d < 6),
solved AS (SELECT p.qid, p.src, p.dst, min(d)::INT AS hops FROM pairs p LEFT JOIN walk w ON w.qid = p.qid AND w.node = p.dst GROUP BY ALL)"""


def _sampled(n: int, e: str = "core") -> str:
    return f"{WITH}, {_SAMPLE.format(n=n)}, {_WALK.format(e=e)}"


@query(f"{_sampled(60)} SELECT qid, src, dst, hops, CASE WHEN hops IS NULL THEN 'nolink' ELSE 'ok' END AS status FROM solved")
def path_sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return paths.hops(e, paths.sampled_pairs(e, 60)).withColumn("qid", F.col("qid").cast("long"))


@query(
    f"""{WITH}, {_SAMPLE.format(n=20)}, ways AS (SELECT src, dst FROM core UNION SELECT dst, src FROM core), {_WALK.format(e="ways")}
    SELECT qid, src, dst, hops, CASE WHEN hops IS NULL THEN 'nolink' ELSE 'ok' END AS status FROM solved"""
)
def path_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    both = written(paths.undirected(paths.core(e)), "both-ways")
    return paths.hops(both, paths.sampled_pairs(e, 20)).withColumn("qid", F.col("qid").cast("long"))


@query(
    f"""{_sampled(30)}, near AS (SELECT qid, node, min(d) AS d FROM walk GROUP BY ALL), on_way(qid, node, d) AS (SELECT qid, dst, hops FROM solved WHERE hops IS NOT NULL
      UNION SELECT w.qid, n.node, n.d FROM on_way w JOIN core ON core.dst = w.node JOIN near n ON n.qid = w.qid AND n.node = core.src AND n.d = w.d - 1),
    step AS (SELECT a.qid, a.node, a.d, min(b.node) AS next FROM on_way a JOIN core ON core.src = a.node JOIN on_way b ON b.qid = a.qid AND b.node = core.dst AND b.d = a.d + 1 GROUP BY ALL),
    way(qid, node, d, path) AS (SELECT qid, src, 0, src FROM solved WHERE hops IS NOT NULL UNION ALL SELECT w.qid, s.next, w.d + 1, w.path || ' > ' || s.next FROM way w JOIN step s ON s.qid = w.qid AND s.node = w.node AND s.d = w.d)
    SELECT qid, src, s.dst, path FROM solved s LEFT JOIN way w USING (qid) WHERE hops IS NULL OR w.d = hops"""
)
def path_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest paths themselves: of several the least by its words in order."""
    found = paths.one_path(edges(spark, sf_dir), paths.sampled_pairs(edges(spark, sf_dir), 30))
    return found.select(F.col("qid").cast("long").alias("qid"), "src", "dst", F.array_join("path", " > ").alias("path"))


_CAP = 300


@query(
    f"""{WITH}, {_SAMPLE.format(n=40)},
    walk AS (SELECT qid, src AS node, 0 AS d FROM pairs UNION SELECT qid, edges.dst, d + 1 FROM walk JOIN edges ON edges.src = node WHERE d < 6),
    near AS (SELECT qid, node, min(d) AS d FROM walk GROUP BY ALL),
    seen AS (SELECT qid, d, sum(c) OVER (PARTITION BY qid ORDER BY d) AS n FROM (SELECT qid, d, count(*) AS c FROM near GROUP BY qid, d)),
    s AS (SELECT p.qid, p.src, p.dst, (SELECT min(d) FROM near w WHERE w.qid = p.qid AND w.node = p.dst)::INT AS hops, (SELECT min(d) FROM seen WHERE seen.qid = p.qid AND n > {_CAP} AND d > 0) AS stop FROM pairs p)
    SELECT qid, src, dst, CASE WHEN stop IS NULL OR hops <= stop THEN hops END AS hops, CASE WHEN hops <= coalesce(stop, hops) THEN 'ok' WHEN stop IS NOT NULL THEN 'capped' ELSE 'nolink' END AS status FROM s"""
)
def path_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches from the sources alone, given up between levels once they have seen more than so many nodes."""
    e = edges(spark, sf_dir)
    return paths.hops(e, paths.sampled_pairs(e, 40), cap=_CAP, both_sides=False).withColumn("qid", F.col("qid").cast("long"))


@query(
    f"""{WITH}, {_SAMPLE.format(n=10)}, {_WALK.format(e="core")}, q AS (SELECT *, qid % 2 AS g FROM pairs),
    w2 AS (SELECT g, src AS start, src AS node, 0 AS d FROM q UNION SELECT g, start, core.dst, d + 1 FROM w2 JOIN core ON core.src = node WHERE d < 6)
    SELECT g AS qid, min(d)::INT AS hops FROM w2 JOIN (SELECT DISTINCT g, dst FROM q) t USING (g) WHERE node = t.dst GROUP BY g"""
)
def path_shortest_of_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    p = paths.sampled_pairs(e, 10)
    g = (F.col("qid") % 2).cast("long").alias("qid")
    return paths.shortest_of_any(e, p.select(g, "src").distinct(), p.select(g, "dst").distinct()).select("qid", "hops")


_DIST = """dist AS (SELECT hops, count(*) AS pairs, sum(count(*)) OVER (ORDER BY hops DESC) / sum(count(*)) OVER () AS share FROM solved WHERE hops IS NOT NULL GROUP BY hops)"""


def distribution(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    return search_log.distribution(paths.hops(e, paths.sampled_pairs(e)))


@query(f"{_sampled(150)}, {_DIST} SELECT hops, pairs, round(share, 6) AS share FROM dist")
def path_hop_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(spark, sf_dir, edges(spark, sf_dir)).select("hops", "pairs", F.round("share", 6).alias("share"))


@query(f"{_sampled(150)}, {_DIST} SELECT coalesce(min(hops) FILTER (share <= 0.10), max(hops), 6) AS threshold FROM dist")
def path_far_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log.far_threshold(distribution(spark, sf_dir, edges(spark, sf_dir)))


_ABLATED = f"""{WITH}, {_SAMPLE.format(n=30)}, ok AS (SELECT src, dst FROM core WHERE left(md5(dst), 1) <> '0' AND left(md5(src), 1) <> '0'),
w1 AS (SELECT qid, src AS node, 0 AS d FROM pairs UNION SELECT qid, core.dst, d + 1 FROM w1 JOIN core ON core.src = node WHERE d < 6),
w2 AS (SELECT qid, src AS node, 0 AS d FROM pairs UNION SELECT qid, ok.dst, d + 1 FROM w2 JOIN ok ON ok.src = node WHERE d < 6),
s AS (SELECT p.qid, (SELECT min(d) FROM w1 WHERE w1.qid = p.qid AND w1.node = p.dst) AS a, (SELECT min(d) FROM w2 WHERE w2.qid = p.qid AND w2.node = p.dst) AS b FROM pairs p)"""


@query(f"{_ABLATED} SELECT count(*) AS pairs, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS broken, round(coalesce(avg(b - a), 0), 6) AS delta FROM s")
def path_filter_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs lose their path, and how much longer the others' get, without rejected nodes; here those whose hash begins with 0."""
    e = edges(spark, sf_dir)
    good = written(e.filter((F.left(F.md5("dst"), F.lit(1)) != "0") & (F.left(F.md5("src"), F.lit(1)) != "0")).select("src", "dst"), "ok-edges")
    p = written(paths.sampled_pairs(e, 30), "pairs")
    a = paths.hops(e, p).select("qid", F.col("hops").alias("a"))
    b = paths.hops(good, p).select("qid", F.col("hops").alias("b"))
    broken = F.sum((F.col("a").isNotNull() & F.col("b").isNull()).cast("long"))
    return a.join(b, "qid").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(broken, F.lit(0)).alias("broken"), F.round(F.coalesce(F.avg(F.col("b") - F.col("a")), F.lit(0.0)), 6).alias("delta"))


_BY_CONFIG = f"""langs AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 9 END::INT AS config_id FROM documents),
cedges AS MATERIALIZED (SELECT config_id, src, dst, min(rank) AS rank FROM (SELECT id, {NORM.format("head")} AS src, {NORM.format("low")} AS dst, rank FROM nb) JOIN langs USING (id) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)"""
_CONFIGS = "cfg AS (SELECT * FROM (VALUES (0, 0, 'v7', 42), (1, 12, 'v6', 42), (2, 40, 'v6', -1), (3, 5, 'v5', 42)) c(id, k, prompt_version, seed))"


def _configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, "v7", 42), (1, 12, "v6", 42), (2, 40, "v6", -1), (3, 5, "v5", 42)], "id int, k int, prompt_version string, seed int")


@query(f"{WITH}, {_CONFIGS}, {_BY_CONFIG} SELECT cfg.id, k, prompt_version, seed, (SELECT count(*) FROM cedges WHERE config_id = cfg.id) AS edges FROM cfg")
def config_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs with their stored edges, none counting 0."""
    counts = config_edges(spark, sf_dir).groupBy(F.col("config_id").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return _configs(spark).join(counts, "id", "left").select("id", "k", "prompt_version", "seed", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(f"{WITH}, {_BY_CONFIG} SELECT config_id, count(*) AS edges FROM cedges GROUP BY config_id ORDER BY edges DESC, config_id LIMIT 1")
def config_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config of most edges."""
    return config_edges(spark, sf_dir).groupBy("config_id").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "config_id").limit(1)


@query(f"{WITH}, {_BY_CONFIG} SELECT src, dst, rank::INT AS rank FROM cedges WHERE config_id = 2")
def config_edges_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config's edges, from its folder alone."""
    return build.of_config(config_edges(spark, sf_dir), 2)


_WANTED = "SELECT DISTINCT lang AS gen_model, source AS prompt_version, n_chars % 4 AS k FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL"


@query(f"WITH old AS (SELECT *, row_number() OVER (ORDER BY gen_model, prompt_version, k) AS id FROM ({_WANTED} AND doc_id % 16 = 0)), new AS (SELECT n.*, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY gen_model, prompt_version, k) AS id FROM ({_WANTED}) n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.gen_model = n.gen_model AND o.prompt_version = n.prompt_version AND o.k = n.k)) SELECT id, gen_model, prompt_version, k FROM old UNION ALL SELECT id, gen_model, prompt_version, k FROM new")
def config_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs that documents ask for: those of some of them are there, the others get the next ids."""
    keys = ["gen_model", "prompt_version", "k"]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("gen_model"), F.col("source").alias("prompt_version"), (F.col("n_chars") % 4).alias("k")).dropna()
    none = docs.limit(0).select(*keys).withColumn("id", F.lit(0).cast("long"))
    old = written(store.with_ids(none, docs.filter("doc_id % 16 = 0").select(*keys), keys, *keys), "configs")
    return store.with_ids(old, docs.select(*keys), keys, *keys).select("id", *keys)


@query(f"{WITH} SELECT count(DISTINCT node) AS nodes FROM (SELECT src AS node FROM core UNION SELECT dst FROM core)")
def graph_endpoint_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paths.core(edges(spark, sf_dir))
    ends = c.select(F.col("src").alias("key")).union(c.select("dst"))
    return nodes(spark, sf_dir).join(ends, "key", "left_semi").agg(F.count_distinct("key").alias("nodes"))


_EDGE_PARTS = "parts AS (SELECT id, src, dst, rank FROM (SELECT id, {0} AS src, {1} AS dst, min(rank) AS rank FROM nb GROUP BY ALL) WHERE src <> '' AND dst <> '' AND src <> dst)".format(NORM.format("head"), NORM.format("low"))


@query(f"{WITH}, {_EDGE_PARTS} SELECT 1::BIGINT AS config_id, src AS src_id, dst AS dst_id, coalesce(min(rank) FILTER (id % 2 = 0), min(rank))::INT AS rank FROM parts GROUP BY src, dst")
def store_insert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes, texts of even ids first: a key's first write stays."""
    cfg = lambda df: df.select(F.lit(1).cast("long").alias("config_id"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "rank")
    t = texts(spark, sf_dir)
    old = written(cfg(build.edges(t.filter("id % 2 = 0"))), "edges")
    return store.insert_edges(old, cfg(build.edges(t.filter("id % 2 <> 0"))))


@query(f"{WITH}, m AS (SELECT max(doc_id) AS m FROM documents) SELECT {NORM.format('head')} AS src, count(*) AS n FROM nb, m WHERE id > m // 2 GROUP BY 1 HAVING src <> ''")
def store_newer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the texts after a watermark, which the scan is pruned by."""
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).first()[0] // 2
    new = build.neighbours(build.document_texts(store.newer_than(docs, last, "doc_id")))
    return new.groupBy(norm(F.col("head")).alias("src")).agg(F.count(F.lit(1)).alias("n")).filter("src <> ''")


_CLAIMS = "claims AS (SELECT DISTINCT src, CASE WHEN left(md5(src || dst), 1) < '8' THEN dst ELSE reverse(dst) END AS dst FROM edges)"


@query(f"{WITH}, {_CLAIMS}, have AS (SELECT DISTINCT {NORM.format('head')} AS s, {NORM.format('low')} AS d FROM tok) SELECT src, dst, EXISTS (SELECT 1 FROM have WHERE s = src AND d = dst) AS holds FROM claims")
def graph_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return build.mentions(texts(spark, sf_dir), _claims(e))


def _claims(e: DataFrame) -> DataFrame:
    dst = F.when(F.left(F.md5(F.concat("src", "dst")), F.lit(1)) < "8", F.col("dst")).otherwise(F.reverse("dst"))
    return e.select("src", dst.alias("dst")).distinct()


@query(f"{WITH}, {_CLAIMS} SELECT count(*) AS refuted FROM claims c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.src AND e.dst = c.dst)")
def graph_refuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    none = spark.createDataFrame([], "config_id long, src_id string, dst_id string, source string")
    bad = _claims(e).join(e, ["src", "dst"], "left_anti").select(F.lit(1).cast("long").alias("config_id"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("claim").alias("source"))
    return store.insert_or_ignore(none, bad, ["config_id", "src_id", "dst_id"], "source").agg(F.count(F.lit(1)).alias("refuted"))


@query(
    f"""{WITH}, {_CLAIMS}, top AS (SELECT dst FROM claims GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20), p AS (SELECT c.dst AS target, c.src AS word, e.src IS NOT NULL AS hit FROM claims c SEMI JOIN top USING (dst) LEFT JOIN edges e ON e.src = c.src AND e.dst = c.dst)
    SELECT target, count(*) FILTER (hit) AS hits, count(*) AS total, round(avg(hit::INT), 6) AS precision FROM p GROUP BY ROLLUP (target)"""
)
def crawl_proposal_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    claims = written(_claims(e), "claims")
    targets = claims.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(20).select("dst")
    p = crawl.proposal_precision(claims.join(targets, "dst", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("word")), e)
    return p.withColumn("precision", F.round("precision", 6))


@query(f"{WITH}, x AS (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5) SELECT dst AS word, (SELECT count(*) FROM edges e WHERE e.dst = x.dst) AS indeg, (SELECT count(*) FROM edges e WHERE e.src = x.dst) AS outdeg, (SELECT string_agg(src, ' ' ORDER BY src) FROM (SELECT DISTINCT src FROM edges e WHERE e.dst = x.dst ORDER BY src LIMIT 12)) AS incoming FROM x")
def graph_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest hubs with true degrees and their first 12 incoming words."""
    e = edges(spark, sf_dir)
    hub = metrics.hubs(e, 5).select("word")
    ins = e.join(hub.withColumnRenamed("word", "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("word")).agg(F.count(F.lit(1)).alias("indeg"), F.array_join(F.slice(F.array_sort(F.collect_set("src")), 1, 12), " ").alias("incoming"))
    outs = e.groupBy(F.col("src").alias("word")).agg(F.count(F.lit(1)).alias("outdeg"))
    return hub.join(ins, "word").join(outs, "word", "left").select("word", "indeg", F.coalesce("outdeg", F.lit(0)).alias("outdeg"), "incoming")


@query(f"{WITH} SELECT (SELECT count(*) FROM heads) AS thrown, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded words are counted once each, whatever their responses."""
    e = edges(spark, sf_dir)
    n = metrics.vertices(e).agg(F.count(F.lit(1)).alias("nodes"))
    return e.agg(F.count_distinct("src").alias("thrown"), F.count(F.lit(1)).alias("edges")).crossJoin(n).select("thrown", "nodes", "edges")  # one row each


_FLAGS = "flags AS (SELECT key, CASE left(md5(key), 1) WHEN '0' THEN false WHEN '1' THEN NULL ELSE true END AS ok FROM nodes)"


@query(f"{WITH}, {_FLAGS}, {_BY_CONFIG}, good AS (SELECT key FROM flags WHERE ok IS DISTINCT FROM false) SELECT src, dst, rank::INT AS rank FROM cedges WHERE config_id = 1 AND src IN (SELECT key FROM good) AND dst IN (SELECT key FROM good)")
def graph_usable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config's edges whose ends aren't rejected, unknown ones included."""
    return build.usable(config_edges(spark, sf_dir), 1)


def _local(e: str, name: str) -> str:
    """Sums of local clustering by config, of edges between names that begin with their config."""
    return f"""u{name} AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {e} WHERE src <> dst),
    d{name} AS (SELECT node, count(*) AS d FROM (SELECT u AS node FROM u{name} UNION ALL SELECT v FROM u{name}) GROUP BY node),
    t{name} AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM u{name} a JOIN u{name} b ON a.v = b.u JOIN u{name} c ON c.u = a.u AND c.v = b.v),
    n{name} AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM t{name} UNION ALL SELECT y FROM t{name} UNION ALL SELECT z FROM t{name}) GROUP BY node),
    l{name} AS (SELECT split_part(node, ' ', 1)::INT AS config_id, sum(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS s FROM d{name} LEFT JOIN n{name} USING (node) GROUP BY 1),
    r{name} AS (SELECT a.config_id, count(*) AS m, avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1 END) AS r FROM {e} a LEFT JOIN {e} b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.config_id)"""


@query(
    f"""{WITH}, {_BY_CONFIG},
    e AS MATERIALIZED (SELECT config_id, config_id || ' ' || src AS src, config_id || ' ' || dst AS dst FROM cedges),
    inner_ AS MATERIALIZED (SELECT * FROM e WHERE dst IN (SELECT src FROM e)),
    v AS (SELECT config_id, src AS node FROM e UNION SELECT config_id, dst FROM e),
    o AS (SELECT config_id, count(DISTINCT src) AS n FROM e GROUP BY config_id),
    ind AS (SELECT config_id, dst, count(*) AS n FROM e GROUP BY ALL),
    i AS (SELECT config_id, max(n) AS n FROM ind GROUP BY config_id),
    hub AS (SELECT config_id, string_agg(split_part(dst, ' ', 2), ' ' ORDER BY n DESC, dst) AS hubs FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY n DESC, dst) AS k FROM ind) WHERE k <= 3 GROUP BY config_id),
    {_local("e", "1")}, {_local("inner_", "2")},
    ends AS (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e),
    lab(node, c) USING KEY (node) AS (SELECT node, node FROM v UNION SELECT y, min(l.c) FROM lab l JOIN ends ON x = l.node JOIN recurring.lab q ON q.node = y WHERE l.c < q.c GROUP BY y),
    w AS (SELECT k::INT AS config_id, max(n) AS n FROM (SELECT split_part(c, ' ', 1) AS k, count(*) AS n FROM lab GROUP BY c) GROUP BY k),
    n AS (SELECT config_id, count(*) AS n FROM v GROUP BY config_id)
    SELECT n.config_id, n.n AS nodes, r1.m AS edges, o.n AS expanded_nodes, n.n - o.n AS frontier_nodes, round(r1.m / n.n, 6) AS mean_in_degree, i.n AS max_in_degree, round(r1.r, 6) AS reciprocity, round(l1.s / n.n, 6) AS clustering,
      w.n AS largest_wcc, round(w.n / n.n, 6) AS wcc_ratio, coalesce(r2.m, 0) AS core_edges, round(coalesce(r2.r, 0), 6) AS core_reciprocity, round(coalesce(l2.s, 0) / o.n, 6) AS core_clustering, hubs
    FROM n JOIN o USING (config_id) JOIN i USING (config_id) JOIN r1 USING (config_id) JOIN w USING (config_id) JOIN hub USING (config_id) LEFT JOIN l1 USING (config_id) LEFT JOIN r2 USING (config_id) LEFT JOIN l2 USING (config_id)"""
)
def config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every config that has edges, of its core, and its hubs."""
    r = metrics.report(config_edges(spark, sf_dir).select("config_id", "src", "dst"))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_in_degree", "reciprocity", "clustering", "wcc_ratio", "core_reciprocity", "core_clustering")})


_ROUND = """f{0} AS (SELECT word FROM (SELECT dst AS word, count(*) AS indeg FROM edges WHERE src IN (SELECT word FROM v{1}) AND dst NOT IN (SELECT word FROM v{1}) GROUP BY dst ORDER BY indeg DESC, word LIMIT 25) WHERE length(word) > 1),
v{0} AS (SELECT word, round FROM v{1} UNION ALL SELECT word, {0} FROM f{0})"""


@query(f"{WITH}, v1 AS (SELECT node AS word, 1 AS round FROM heads ORDER BY md5(node), node LIMIT 3), {', '.join(_ROUND.format(i, i - 1) for i in (2, 3, 4))} SELECT word, round::INT AS round, word IN (SELECT node FROM heads) AS known FROM v4")
def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of four rounds over the stored answers, from three words."""
    e = edges(spark, sf_dir)
    seeds = e.select(F.col("src").alias("word")).distinct().orderBy(F.md5("word"), "word").limit(3)
    return crawl.rounds(e, seeds, 25, 4)


@query(
    f"""{WITH}, ids AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM nodes)
    SELECT 7::BIGINT AS config_id, s.id AS src_id, d.id AS dst_id, rank::INT AS rank FROM edges JOIN ids s ON s.key = src JOIN ids d ON d.key = dst"""
)
def store_retokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts into an empty store: nodes and surfaces under new ids, and ranked edges between ids."""
    none = lambda schema: spark.createDataFrame([], schema)
    n, s, e = build.retokenised(texts(spark, sf_dir), none("id long, key string, word string, lang string"), none(schemas.SURFACE), none("config_id long, src_id long, dst_id long, rank int"), 7)
    return e


@query(f"{WITH}, ids AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM nodes) SELECT id AS node_id, text FROM (SELECT DISTINCT {NORM.format('x')} AS key, x AS text FROM (SELECT unnest(w) AS x FROM t)) JOIN ids USING (key)")
def store_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surfaces that retokenising stores."""
    none = lambda schema: spark.createDataFrame([], schema)
    n, s, e = build.retokenised(texts(spark, sf_dir), none("id long, key string, word string, lang string"), none(schemas.SURFACE), none("config_id long, src_id long, dst_id long, rank int"), 7)
    return s


@query("SELECT doc_id % 50 AS node_id, lang AS gen_model, 0.7 AS temperature, CASE WHEN n_chars % 2 = 0 THEN 'v7' ELSE 'v6' END AS prompt_version, min(doc_id) AS call_id FROM documents GROUP BY ALL")
def store_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses into an empty table: of each (node, model, temperature, version) the first."""
    new = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("node_id"), F.col("lang").alias("gen_model"), F.lit(0.7).alias("temperature"), F.when(F.col("n_chars") % 2 == 0, "v7").otherwise("v6").alias("prompt_version"), F.col("doc_id").alias("call_id"))
    none = spark.createDataFrame([], new.schema)
    return store.insert_or_ignore(none, new, schemas.KEYS["response"], "call_id")
