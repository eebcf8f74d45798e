"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordweave.functions.text import JUNK, TOKEN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_JUNK = ", ".join(f"'{w}'" for w in dict.fromkeys(JUNK))
NORM = "regexp_replace(lower(trim({0})), '[\\s\\-_·]+', '', 'g')"
#: Tables of the derived graph: tok (id, head, low, pos), nb (.., rank), edges (src, dst, rank), nodes (key, word, lang).
GRAPH = rf"""
t AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w FROM documents),
tok AS (
  SELECT id, head, u.x AS low, min(u.i) AS pos
  FROM (SELECT id, lower(w[1]) AS head, unnest(list_transform(w, lambda x, i: {{'x': lower(x), 'i': i}})) AS u FROM t WHERE len(w) > 0) GROUP BY ALL),
nb AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM tok
  WHERE low <> head AND low NOT IN ({_JUNK}) AND NOT regexp_full_match(low, '[0-9]+')),
edges AS (
  SELECT src, dst, min(rank) AS rank FROM (SELECT {NORM.format("head")} AS src, {NORM.format("low")} AS dst, rank FROM nb)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
named AS (
  SELECT {NORM.format("word")} AS key, min({{'id': id, 'p': p, 'word': word}}).word AS word
  FROM (SELECT DISTINCT id, -1 AS p, head AS word FROM tok UNION ALL SELECT id, pos, low FROM tok WHERE low NOT IN ({_JUNK}) AND NOT regexp_full_match(low, '[0-9]+'))
  GROUP BY 1 HAVING key <> ''),
nodes AS (
  SELECT key, word, CASE WHEN n = 0 THEN 'other' WHEN n > 1 AND NOT (n = 2 AND ja AND zh) THEN 'mix' WHEN ja THEN 'ja' WHEN ko THEN 'ko' WHEN zh THEN 'zh' ELSE 'en' END AS lang
  FROM (SELECT *, ko::INT + ja::INT + zh::INT + en::INT AS n FROM (
    SELECT key, word, regexp_matches(word, '[가-힣]') AS ko, regexp_matches(word, '[぀-ゟ゠-ヿ]') AS ja, regexp_matches(word, '[一-鿿]') AS zh, regexp_matches(word, '[A-Za-z]') AS en FROM named)))
"""
HEADS = "heads AS (SELECT DISTINCT src AS node FROM edges), core AS (SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM heads))"
#: A search log from the events table; words are w0 to w40, capitalised in every third row.
LOG = """
log AS (
  SELECT event_id AS id, kind, CASE WHEN event_id % 3 = 0 THEN upper(a) ELSE a END AS a, CASE WHEN kind <> 'word' THEN b END AS b, status,
         CASE WHEN kind = 'share' THEN (k % 7)::INT WHEN status = 'ok' THEN (floor(value)::BIGINT % 9 + 1)::INT END AS hops, created_at
  FROM (SELECT *, ts AS created_at, 'w' || (user_id % 37) AS a, 'w' || (k % 41) AS b,
               CASE event_type WHEN 'signup' THEN 'word' WHEN 'purchase' THEN 'share' ELSE 'path' END AS kind,
               CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN 'link' WHEN 'error' THEN 'nolink' ELSE 'ok' END AS status
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)))
"""
