"""Queries about texts: scripts, word checks, titles, seeds, snippets, vectors."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.functions import nouns, text as T
from wordweave.functions.arrays import bound
from wordweave.operators import crawl, phrases, store
from wordweave.operators.search_log import clamped
from wordweave.plans import testbed
from wordweave.plans.registry import GRAPH, HEADS, SQL, query
from wordweave.session import shared_dir, ship, written
from wordweave.sources.feeds import SavedFeeds
from wordweave.sources.readers import feed_titles, page_view_titles, table, tsv_pairs, word_lines, write_tsv, write_word_lines

#: RE2 knows ASCII word boundaries only; with other letters as _ they are Unicode's.
_PLAIN = "regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"
_N = "len(regexp_extract_all({0}, '{1}'))"


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


_DETECT = f"""CASE WHEN ko + ja + zh + en = 0 THEN 'en' WHEN ja > 0 THEN 'ja' WHEN ko > 0.3 * (ko + ja + zh + en) THEN 'ko' WHEN zh > 0.3 * (ko + ja + zh + en) THEN 'zh'
  WHEN len(regexp_extract_all(text, '(?i)[ñáéíóúü¿¡]')) + len(regexp_extract_all({_PLAIN}, '(?i)\\b(?:de|la|el|los|las|que|con|para|una?)\\b')) >= 3 THEN 'es' ELSE 'en' END"""
_SCRIPTS = f"(SELECT doc_id, text, {_N.format('text', '[가-힣]')} AS ko, {_N.format('text', '[぀-ゟ゠-ヿ]')} AS ja, {_N.format('text', '[一-鿿]')} AS zh, {_N.format('text', '[A-Za-z]')} AS en FROM documents)"


@query(f"SELECT doc_id, {_DETECT} AS lang FROM {_SCRIPTS}")
def text_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.detect(F.col("text")).alias("lang"))


@query(f"SELECT {_DETECT} AS lang, count(*) AS n FROM {_SCRIPTS} GROUP BY 1 ORDER BY n DESC, lang")
def text_detected_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.detect(F.col("text")).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


_LATIN = r"[A-Za-z][A-Za-z\-]{2,}"


@query(
    f"""WITH d AS (SELECT doc_id, lang, {_N.format("text", "[A-Za-z]")} AS latin, {_N.format("text", "[À-ÿ]")} AS native, list_transform(regexp_extract_all({_PLAIN}, '\\b{_LATIN}\\b'), lambda x: lower(x)) AS toks FROM documents)
    SELECT lang, round(sum(latin) / greatest(sum(native + latin), 1), 6) AS latin_ratio, round(avg(len(list_distinct(toks))), 6) AS en_tokens, sum(len(list_filter(toks, lambda x: x IN ({_sql_list(T.ENGLISH_MARKERS)}))))::BIGINT AS en_markers FROM d GROUP BY lang"""
)
def text_latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin letters against native ones by language, as a ratio of sums; here accented letters count as native."""
    text = F.col("text")
    toks = F.transform(F.regexp_extract_all(text, F.lit(f"({T.LATIN_TOKEN})"), F.lit(1)), F.lower)
    d = table(spark, sf_dir, "documents").select("lang", F.regexp_count(text, F.lit("[A-Za-z]")).alias("latin"), F.regexp_count(text, F.lit("[À-ÿ]")).alias("native"), toks.alias("toks"))
    return d.groupBy("lang").agg(
        F.round(F.sum("latin") / F.greatest(F.sum(F.col("native") + F.col("latin")), F.lit(1)), 6).alias("latin_ratio"),
        F.round(F.avg(F.size(F.array_distinct("toks"))), 6).alias("en_tokens"),
        F.sum(F.size(F.filter("toks", lambda x: x.isin(*T.ENGLISH_MARKERS)))).alias("en_markers"),
    )


@query(
    f"""WITH d AS (SELECT doc_id, unnest(list_transform(regexp_extract_all({_PLAIN}, '\\b{_LATIN}\\b'), lambda x, i: {{'w': lower(x), 'i': i}})) AS u FROM documents),
    c AS (SELECT doc_id, u.w AS word, count(*) AS n, min(u.i) AS first FROM d WHERE u.w NOT IN ({_sql_list(T.ENGLISH_MARKERS)}) GROUP BY ALL)
    SELECT doc_id, word, n, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 5"""
)
def text_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest tokens of each document; among equals the first seen."""
    toks = F.transform(F.regexp_extract_all("text", F.lit(f"({T.LATIN_TOKEN})"), F.lit(1)), F.lower)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(toks).alias("i", "word")).filter(~F.col("word").isin(*T.ENGLISH_MARKERS))
    counts = rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).filter("r <= 5").select("doc_id", "word", "n", "r")


_SURF = r"s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents)"
_TOK = T.TOKEN
_ISWORD = f"""(w <> '' AND lower(w) NOT IN ({_sql_list(T.JUNK)}) AND NOT regexp_full_match(w, '[0-9]+') AND (
  (regexp_full_match(w, '[A-Z][A-Z0-9]{{1,7}}') AND lower(w) NOT IN ({_sql_list(T.NO_ACRONYM)})) OR (regexp_full_match(w, '{_TOK}') AND (length(w) > 1 OR regexp_full_match(w, '[가-힣]')))))"""


@query(f"WITH {_SURF} SELECT w AS word, {_ISWORD} AS ok, (length(w) BETWEEN 2 AND 30 AND NOT (lower(w) IN ({_sql_list(T.GENERIC)}) OR (length(w) >= 4 AND length(w) % 2 = 0 AND lower(w)[:length(w) // 2] = lower(w)[length(w) // 2 + 1:]))) AS valid FROM s")
def text_word_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([^ \n]+)"), F.lit(1))).alias("word")).distinct()
    return w.select("word", T.is_word(F.col("word")).alias("ok"), T.is_valid_word(F.col("word")).alias("valid"))


@query(f"WITH {_SURF}, o AS (SELECT {_ISWORD} AS ok FROM s) SELECT ok, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 6) AS share FROM o GROUP BY ok")
def text_rejected_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text_word_checks(spark, sf_dir)
    n = w.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_OK = "lab AS (SELECT doc_id, bool_or(quality = 1) AS ok FROM labels GROUP BY doc_id), old AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok, text FROM documents)"


@query(f"WITH {_OK}, upd AS (SELECT o.doc_id, coalesce(l.ok, o.ok) AS ok FROM old o LEFT JOIN lab l USING (doc_id)) SELECT coalesce(ok::VARCHAR, 'unknown') AS ok, count(*) AS n FROM upd GROUP BY ALL")
def store_update_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by key from labels, others as they were, unknown ones being a group of their own."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False).alias("ok"))
    new = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return store.update_from(old, new, "doc_id", "ok").groupBy(F.coalesce(F.col("ok").cast("string"), F.lit("unknown")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OK} SELECT doc_id, coalesce(ok, length(text) > 2000) AS ok FROM old WHERE coalesce(ok, length(text) > 2000) IS DISTINCT FROM false")
def store_fill_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown flags filled by a rule; what is not rejected, with null kept, is listed."""
    old = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False).alias("ok"))
    filled = store.fill_nulls(old, "ok", F.length("text") > 2000)
    return filled.filter(~F.col("ok").eqNullSafe(False)).select("doc_id", "ok")


@query(f"WITH {_SURF} SELECT w AS word, CASE WHEN regexp_matches(w, '[가-힣]') AND regexp_matches(w, '[A-Za-z]') THEN 'mix' WHEN regexp_matches(w, '[가-힣]') THEN 'ko' WHEN regexp_matches(w, '[A-Za-z]') THEN 'en' ELSE 'other' END AS lang FROM s")
def store_fill_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([^ \n]+)"), F.lit(1))).alias("word")).distinct()
    return store.fill_nulls(w.withColumn("lang", F.lit(None).cast("string")), "lang", T.coarse_script(F.col("word")))


_TAGS = "replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, {_TAGS.format('x')} AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) AS x FROM pages)")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.titles(F.coalesce("html", F.lit("")))).alias("title"))


@query(f"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS x FROM pages) SELECT page_id AS feed, i::INT AS pos, {_TAGS.format('x[i + 1]')} AS title FROM (SELECT page_id, x || x AS x, unnest(range(1, 2 * len(x))) AS i FROM p WHERE len(x) > 0)")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of feeds without the feed's own; here each page twice over."""
    return feed_titles(table(spark, sf_dir, "pages").select(F.col("page_id").alias("feed"), F.concat("html", "html").alias("body")))


_WIKI = "CASE WHEN NOT regexp_matches(t, '{0}') AND w <> '' AND len(string_split_regex(w, '\\s+')) <= 3 THEN w END".format(T.WIKI_SYSTEM)


@query(
    f"""WITH a AS (SELECT 0::BIGINT AS item, event_id, CASE event_id % 4 WHEN 0 THEN 'Special:' || event_type WHEN 1 THEN event_type || '_' || user_id || '_(film)' WHEN 2 THEN 'a_b_c_' || user_id ELSE 'List_x_' || user_id END AS t FROM events),
    c AS (SELECT event_id, t, trim(replace(regexp_replace(t, '_\\(.*?\\)$', ''), '_', ' ')) AS w FROM a)
    SELECT event_id AS pos, {_WIKI} AS title FROM c WHERE title IS NOT NULL"""
)
def page_view_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of page-view documents, each event as one article."""
    t = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Special:"), "event_type")).when(F.col("event_id") % 4 == 1, F.concat("event_type", F.lit("_"), F.col("user_id").cast("string"), F.lit("_(film)"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("a_b_c_"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("List_x_"), F.col("user_id").cast("string")))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(t.alias("article"))).alias("articles"))).alias("items")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), body.alias("body"))
    return page_view_titles(rows).select(F.col("id").alias("pos"), "title")


_TITLES = f"titles AS (SELECT page_id, {_TAGS.format('x')} AS t FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) AS x FROM pages))"
_WORDS = f"ww AS (SELECT page_id, u.i AS pos, u.x AS w FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(t, '{_TOK}'), lambda x, i: {{'x': x, 'i': i}})) AS u FROM titles)), fw AS (SELECT page_id, pos, w FROM ww WHERE {_ISWORD} AND length(w) >= 3 AND lower(w) NOT IN ({_sql_list(T.FEED_BRANDS)}))"


@query(f"WITH {_TITLES}, {_WORDS} SELECT page_id, w AS word, count(*) AS n FROM fw GROUP BY ALL")
def seed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_titles(spark, sf_dir).select("page_id", F.explode(T.words_from(F.col("title"))).alias("word")).groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS (SELECT DISTINCT trim(x) AS p FROM (SELECT unnest(string_split_regex(text, '[.,\\n]')) AS x FROM documents)),
    s AS (SELECT p, string_split_regex(p, '\\s+') AS ws FROM p WHERE length(p) BETWEEN 3 AND 40),
    k AS (SELECT p, unnest(ws) AS w FROM s WHERE len(ws) <= 3 AND NOT regexp_full_match(p, '[0-9]+') AND regexp_matches(p, '\\p{{L}}') AND len(list_distinct(string_split(lower(p), ''))) >= 3)
    SELECT p AS phrase FROM k GROUP BY p HAVING bool_and({_ISWORD} OR regexp_matches(w, '^\\p{{Lu}}'))"""
)
def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[.,\n]")).alias("x")).select(T.clean(F.col("x")).alias("phrase"))
    return p.distinct().filter(T.is_entity(F.col("phrase")))


@query(
    f"""WITH {_TITLES}, {_WORDS},
    cw AS (SELECT conv_id, u.i AS pos, u.x AS w FROM (SELECT conv_id, unnest(list_transform(regexp_extract_all(text, '{_TOK}'), lambda x, i: {{'x': x, 'i': i}})) AS u FROM conversations)),
    m AS (SELECT 'pages' AS source, w AS word, page_id * 1000 + pos AS pos FROM fw UNION ALL SELECT 'talks', w, conv_id * 100 + pos FROM cw WHERE {_ISWORD} AND length(w) >= 3 AND lower(w) NOT IN ({_sql_list(T.FEED_BRANDS)}))
    SELECT word, count(*) AS mentions, count(DISTINCT source)::INT AS sources, min(pos) AS best FROM m GROUP BY word ORDER BY sources DESC, best, mentions DESC, word LIMIT 100"""
)
def seed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(rows: DataFrame, text: str, name: str, place) -> DataFrame:
        toks = rows.select(F.posexplode(T.tokens(F.col(text))).alias("i", "word"), place.alias("at"))
        good = toks.filter(T.is_word(F.col("word")) & (F.length("word") >= 3) & ~F.lower("word").isin(*T.FEED_BRANDS))
        return good.select(F.lit(name).alias("source"), "word", (F.col("at") + F.col("i") + 1).alias("pos"))

    a = words(page_titles(spark, sf_dir), "title", "pages", F.col("page_id") * 1000)
    b = words(table(spark, sf_dir, "conversations"), "text", "talks", F.col("conv_id") * 100)
    return crawl.ranked_seeds(a.union(b), 100)


_SNIP = """x AS (SELECT doc_id, text, instr(lower(text), 'th') AS i FROM documents WHERE instr(lower(text), 'th') > 0), y AS (SELECT *, greatest(i - 1 - 140, 0) AS lo, least(length(text), i + 1 + 140) AS hi FROM x)"""


@query(f"WITH {_SNIP} SELECT doc_id, CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(text, lo + 1, i - 1 - lo) AS before, substr(text, i, 2) AS match, substr(text, i + 2, hi - i - 1) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS after FROM y")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("th")).alias("s")).filter("s is not null").select("doc_id", "s.*")


@query(
    """WITH t AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id <> 0),
    d AS (SELECT vec_id, list_dot_product(v.e, t.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-9) * (sqrt(list_dot_product(t.e, t.e)) + 1e-9)) AS c FROM v, t)
    SELECT vec_id, round(c, 6) AS similarity FROM d ORDER BY round(c, 6) DESC, vec_id LIMIT 20"""
)
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors most like one, by cosine."""
    v = table(spark, sf_dir, "embeddings")
    target = v.filter("vec_id = 0").select(F.col("embedding").alias("t"), F.lit(0).alias("one"))
    near = v.filter("vec_id <> 0").withColumn("one", F.lit(0)).join(F.broadcast(target), "one")  # one row
    return near.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("t")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


@query(
    """WITH s AS (SELECT conv_id, turn, text, string_split_regex(text, '[,\\n]') AS p FROM conversations),
    c AS (SELECT conv_id, turn, list_filter(list_transform(p, lambda x: regexp_replace(x, '^[\\s"''·\\-*0-9.]+|[\\s"''·\\-*0-9.]+$', '', 'g')), lambda x: x <> '' AND length(x) BETWEEN 2 AND 30 AND NOT (length(x) >= 4 AND length(x) % 2 = 0 AND lower(x)[:length(x) // 2] = lower(x)[length(x) // 2 + 1:])) AS w FROM s),
    d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS w FROM c)
    SELECT conv_id, turn, array_to_string(w[1:3], '|') AS words, upper(left(text, 2)) = 'ET' AS yes FROM d JOIN conversations USING (conv_id, turn)"""
)
def reply_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lists read from replies, and whether a reply begins with a given word."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.listed(F.col("text"), 3), "|").alias("words"), F.upper(F.col("text")).startswith("ET").alias("yes"))


@query("SELECT event_id, CASE WHEN user_id BETWEEN 1 AND 3 THEN ['x', 'y', 'z'][user_id] END AS choice, event_type = 'view' AS yes, list_contains(['click', 'view'], event_type) AS hit FROM events")
def reply_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered choices, yes or no, and words among a list's, in any case."""
    e = table(spark, sf_dir, "events")
    names = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    reply = F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(". it is"))
    said = F.when(F.col("event_type") == "view", " yes, so").otherwise("No")
    hit = F.array_contains(F.array(F.lit("click"), F.lit("view")), F.lower(F.upper("event_type")))
    return e.select("event_id", T.choice(reply, names).alias("choice"), T.is_yes(said).alias("yes"), hit.alias("hit"))


@query(
    f"""WITH RECURSIVE {GRAPH}, {HEADS}, l AS (SELECT doc_id, bool_or(quality = 1) AS ok FROM labels GROUP BY doc_id)
    SELECT id, head FROM (SELECT DISTINCT id, head FROM tok) LEFT JOIN l ON l.doc_id = id WHERE ok IS DISTINCT FROM false ORDER BY id DESC LIMIT 100"""
)
def explore_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest expanded words whose flag is not false, null kept."""
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("ok"))
    t = testbed.texts(spark, sf_dir).select(F.col("id").alias("doc_id"), "head")
    return t.join(flags, "doc_id", "left").filter(~F.col("ok").eqNullSafe(False)).orderBy(F.desc("doc_id")).limit(100).select(F.col("doc_id").alias("id"), "head")


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    b AS (SELECT doc_id, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i < len(w) THEN w[i + 1] END AS n FROM t),
    s AS (SELECT doc_id, CASE WHEN coalesce(regexp_matches(p, '^[A-Z]'), false) THEN p || ' ' || x ELSE x END AS word FROM b WHERE regexp_matches(x, '^[A-Z]') AND length(x) >= 2 AND NOT coalesce(regexp_matches(n, '^[A-Z]'), false))
    SELECT doc_id, word, count(*) AS n FROM s WHERE lower(word) NOT IN ({_sql_list(T.JUNK)}) GROUP BY ALL"""
)
def noun_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and compounds of every document; capitals stand for a tagger."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", testbed.capital_tags(F.col("text")).alias("tags"))
    spans = d.select("doc_id", F.explode(nouns.words(nouns.noun_spans(F.col("text"), F.col("tags"), F.lit("en")))).alias("word"))
    return spans.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE length(p_name) >= 4 AND instr(p_name, ' ') > 0")
def phrase_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.vocabulary(table(spark, sf_dir, "part").select(F.col("p_name").alias("word")))


#: Tokens with their places, in characters from 0: spans (id, i, w, at).
_SPANS = f"""gaps AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '{T.TOKEN}') AS w, string_split_regex(coalesce(text, ''), '{T.TOKEN}') AS g FROM documents),
placed AS (SELECT id, u.i AS i, u.w AS w, (sum(length(u.w) + length(u.g)) OVER (PARTITION BY id ORDER BY u.i) - length(u.w))::INT AS pos
           FROM (SELECT id, unnest(list_transform(w, lambda x, i: {{'i': i, 'w': x, 'g': g[i]}})) AS u FROM gaps)),
spans AS MATERIALIZED (SELECT * FROM placed WHERE lower(w) NOT IN ({_sql_list(T.JUNK)}))"""


@query(
    f"""WITH RECURSIVE {_SPANS}, b AS (SELECT string_split_regex(lower(text), '[ \n]') AS w FROM benchmark),
    two AS (SELECT w[i] || ' ' || w[i + 1] AS p FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b) UNION SELECT array_to_string(w[1:3], ' ') FROM b),
    vocab AS (SELECT p, regexp_extract(p, '^(?:{T.TOKEN})') AS f FROM two WHERE length(p) BETWEEN 4 AND 60 AND instr(p, ' ') > 0),
    hits AS MATERIALIZED (SELECT s.id, s.pos, max(s.pos + length(p)) AS upto FROM spans s JOIN vocab ON f = lower(s.w) JOIN documents d ON d.doc_id = s.id WHERE f <> '' AND lower(substr(d.text, s.pos + 1, length(p))) = p GROUP BY ALL),
    taken(id, pos, upto) AS (SELECT id, min(pos), arg_min(upto, pos) FROM hits GROUP BY id UNION ALL SELECT t.id, min(h.pos), arg_min(h.upto, h.pos) FROM taken t JOIN hits h ON h.id = t.id AND h.pos >= t.upto GROUP BY t.id),
    left_ AS (SELECT s.id, count(*) AS n FROM spans s WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = s.id AND s.pos >= t.pos AND s.pos < t.upto) GROUP BY s.id),
    got AS (SELECT id, count(*) AS n FROM taken GROUP BY id)
    SELECT doc_id AS id, (coalesce(l.n, 0) + coalesce(g.n, 0))::INT AS n_spans, coalesce(g.n, 0)::INT AS n_phrases FROM documents LEFT JOIN left_ l ON l.id = doc_id LEFT JOIN got g ON g.id = doc_id"""
)
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of tokens and known phrases in every document; phrases are the first three words of the benchmark's passages and what they hold in pairs. Tested against brute force."""
    b = table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), "[ \n]").alias("w"))
    known = b.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))).alias("word")).union(b.select(F.concat_ws(" ", F.slice("w", 1, 3))))
    vocab = written(phrases.vocabulary(known), "vocabulary")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return phrases.with_known(docs, vocab).select("id", F.size("spans").alias("n_spans"), F.size(F.filter("spans", lambda s: F.instr(s["word"], " ") > 0)).alias("n_phrases"))


@query(
    f"""WITH {_SPANS}, third AS (SELECT id, lower(w) AS word FROM placed WHERE i = 3),
    hit AS (SELECT s.id, min(s.pos) AS pos FROM spans s JOIN third t ON t.id = s.id AND t.word = lower(s.w) GROUP BY s.id),
    x AS (SELECT doc_id, text, word, coalesce(h.pos, instr(lower(text), word) - 1) AS pos FROM documents JOIN third t ON t.id = doc_id LEFT JOIN hit h ON h.id = doc_id),
    y AS (SELECT *, pos + length(word) AS upto, greatest(pos - 140, 0) AS lo, least(length(text), pos + length(word) + 140) AS hi FROM x WHERE pos >= 0)
    SELECT doc_id, word, CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(text, lo + 1, pos - lo) AS before, substr(text, pos + 1, upto - pos) AS match, substr(text, upto + 1, hi - upto) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS after FROM y"""
)
def text_word_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text around a word of its own, its third token: where the word stands by itself first, else where its letters do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(F.get(T.tokens(F.col("text")), 2)).alias("word"))
    own = bound(F.col("word"), lambda w: F.filter(phrases.spans(F.col("text")), lambda s: F.lower(s["word"]) == w))
    cut = docs.filter("word is not null").withColumn("s", bound(F.col("word"), lambda w: T.snippet(F.col("text"), w, at=F.get(own, 0)["start"] + 1)))
    return cut.filter("s is not null").select("doc_id", "word", "s.*")


def by_capitals(lang: str):
    """A plain tagger: words between spaces, those with a capital being nouns that modify the next one if it has a capital too."""

    def tag(texts: list[str]) -> list[list[tuple]]:
        out = []
        for text in texts:
            rows, at, words = [], 0, text.split(" ")
            big = ["A" <= w[:1] <= "Z" for w in words]
            for i, w in enumerate(words):
                before = big[i] and i + 1 < len(words) and big[i + 1]
                rows.append((at, len(w), w, w, "", "PROPN" if big[i] else "X", "compound" if before else "dep", i + 1 if before else i, False, False))
                at += len(w) + 1
            out.append(rows)
        return out

    return tag


@query(SQL["noun_compounds"])
def noun_compounds_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and compounds of every document by a table function that tags it, in a lateral join; the same as by tags from expressions."""
    ship(spark).udtf.register("tagged_by_capitals", nouns.text_tagger(by_capitals))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = spark.sql("SELECT d.doc_id, d.text, t.tags FROM {docs} d, LATERAL tagged_by_capitals(d.text, 'en') t", docs=docs.filter("text is not null"))
    spans = rows.select("doc_id", F.explode(nouns.words(nouns.noun_spans(F.col("text"), F.col("tags"), F.lit("en")))).alias("word"))
    return spans.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def saved_feeds(spark: SparkSession, sf_dir: str) -> str:
    """The pages as saved bodies, a file each, in the shared folder: twice over, as in feed_items."""
    path = re.sub("^file:/+", "/", f"{shared_dir(spark)}/feeds/{uuid.uuid4().hex}")
    os.makedirs(path)

    def save(batches):
        for batch in batches:
            for page, body in zip(batch["page_id"], batch["body"], strict=True):
                with open(f"{path}/{page:012d}.xml", "w", encoding="utf-8") as f:
                    f.write(body)
            yield batch[["page_id"]]

    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", "html").alias("body")).filter("body is not null").dropDuplicates(["page_id"])
    pages.mapInPandas(save, "page_id long").write.format("noop").mode("overwrite").save()
    return path


_FEEDS = SQL["feed_items"]


@query(_FEEDS)
def feed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved feeds by the data source."""
    ship(spark).dataSource.register(SavedFeeds)
    return spark.read.format("saved_feeds").load(saved_feeds(spark, sf_dir)).select(F.col("feed").cast("long").alias("feed"), "pos", "title")


@query(f"WITH {_SURF}, h AS (SELECT DISTINCT trim(w) AS word FROM s) SELECT word FROM h WHERE word <> ''")
def file_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as a text file with one a line, read again."""
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([^ \n]+)"), F.lit(1))).alias("word")).distinct()
    write_word_lines(words, path)
    return word_lines(spark, path).distinct()


@query(f"WITH {_SURF} SELECT w AS key, CASE WHEN {_ISWORD} THEN '1' ELSE '0' END AS value FROM s WHERE instr(w, chr(9)) = 0 AND instr(w, chr(13)) = 0")
def file_word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's flag as gzip TSV, read again."""
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    w = text_word_checks(spark, sf_dir).filter("instr(word, '\t') = 0 and instr(word, '\r') = 0")
    write_tsv(w.select(F.col("word").alias("key"), F.col("ok").cast("int").alias("value")), path)
    return tsv_pairs(spark, path)


@query(
    f"""WITH RECURSIVE {GRAPH}, {HEADS}, h AS (SELECT id, head, row_number() OVER (ORDER BY id DESC) AS i FROM (SELECT DISTINCT id, head FROM tok))
    SELECT asked, id, head FROM h, (VALUES (0, 1), (7, 7), (9999, 5000)) n(asked, k) WHERE i <= k"""
)
def explore_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest expanded words, in pages of sizes within bounds whatever is asked for."""
    t = testbed.texts(spark, sf_dir).select("id", "head")
    pages = [t.orderBy(F.desc("id")).limit(clamped(n, 1, 5000)).select(F.lit(n).alias("asked"), "id", "head") for n in (0, 7, 9999)]
    return pages[0].union(pages[1]).union(pages[2])


@query(f"WITH RECURSIVE {GRAPH} SELECT t.id, t.head, length(d.text) AS n FROM (SELECT DISTINCT id, head FROM tok) t JOIN documents d ON d.doc_id = t.id ORDER BY t.id LIMIT 100")
def text_responses_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts with their heads, in the order of their ids."""
    return testbed.texts(spark, sf_dir).orderBy("id").limit(100).select("id", "head", F.length("text").cast("long").alias("n"))
