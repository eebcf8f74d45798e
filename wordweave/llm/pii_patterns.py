"""Personal data by rules and bootstrapped contextual extraction.

Base spans come from one pattern for each kind, with checks. They seed the rest: a lexical
pattern is the two words before a span, lower-cased and with digits as 0, and an instance is
the token that it introduces. Tokens that could be identifiers (they hold a digit or an @)
give the pattern-instance graph of the whole corpus; Spark scores it by turns: a pattern's
score is the trust in its instances, by occurrences, an instance's the share of its
occurrences under trusted patterns, or 1 if it is known. Patterns of enough support and score
then mark the unseen identifiers that they introduce, of the kind that they introduce most.

Everything is DataFrame expressions: match positions follow from the pieces between matches.
The graph is counted before it is shuffled, so a common pattern is a row for each map task.

Results in special cases: null or empty text has no spans; texts of any length are searched
whole; rows that repeat give equal rows, each counted; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.functions.arrays import blocks, bound, chunks, piece, starts
from wordweave.llm.shared import documents, keyed, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+\-]"
#: As the plain patterns match from left to right, in one pass: a match can only begin where its first run begins, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}


#: A token that could be an identifier: it holds a digit or an @.
TOKEN = r"(?<![A-Za-z0-9@._+\-])[A-Za-z._+\-]*+[0-9@][A-Za-z0-9@._+\-]*+"
#: Code points before a token that its pattern is looked for in by turns, before all of them; and of the blocks that they are cut from.
CONTEXTS, CUT = (80, 2000), 1024


@dataclass(frozen=True)
class Trust:
    """A pattern counts from `support` occurrences on, and is trusted from `score` on. A token without @ is marked if it has `min_digits`: pages, years and counts have fewer than identifiers."""

    support: int = 5
    score: float = 0.8
    rounds: int = 3
    min_digits: int = 4


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of a pattern's matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def placed(pairs: Column) -> Column:
        at = starts(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["s"])))
        begin = lambda x, i: i + F.length(x["gap"])
        return F.zip_with(pairs, at, lambda x, i: F.struct(begin(x, i).alias("start"), (begin(x, i) + F.length(x["s"])).alias("end"), x["s"].alias("s")))

    def cut(s: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(s))
        return F.when(F.size(s) == 0, none).otherwise(bound(F.arrays_zip(gaps.alias("gap"), s.alias("s")), placed))

    return bound(found, cut)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(s, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _before(text: Column, start: Column, contexts: tuple[int, ...] = CONTEXTS, parts: Column | None = None) -> Column:
    """The lexical pattern of what follows `start`: the last two words before it, whole; null if there are fewer. parts: the text in blocks of CUT."""
    from_ = F.greatest(start - contexts[0], F.lit(0)) if contexts else F.lit(0)
    near = piece(parts, from_, start - from_, CUT) if contexts and parts is not None else F.substring(text, from_ + 1, start - from_)
    left = F.regexp_replace(F.lower(near), "[0-9]", "0")
    # The first piece is white space's, or a word that may be cut.
    pieces = F.split(left, r"[\x20\x09-\x0D]+")

    def last(x: Column) -> Column:
        words = F.filter(x, lambda w: w != "")
        found = F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))
        if not contexts:
            return found
        return F.when((from_ == 0) | (F.size(F.filter(F.slice(x, 2, start), lambda w: w != "")) >= 2), found).otherwise(_before(text, start, contexts[1:], parts))

    return bound(pieces, last)


def _checked(kind: str) -> Column:
    return F.filter(matches(F.col("text"), PATTERNS[kind]), lambda m: _holds(kind, m["s"]))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _groups(base: Column) -> Column:
    """Spans (start, end, k) by start, in groups with the least start and the greatest end."""
    of = lambda c: F.struct(c[0]["start"].alias("lo"), F.array_max(F.transform(c, lambda m: m["end"])).alias("hi"), c.alias("spans"))
    return F.transform(F.filter(chunks(base), lambda c: F.size(c) > 0), of)


def _told(text: Column, tokens: Column, base: Column) -> Column:
    """(start, end, instance, pattern, kind) of the tokens that aren't inside base spans (start, end, k); kind is the first kind of a span that begins with the token."""

    def of(t: Column, groups: Column, parts: Column) -> Column:
        near = F.filter(groups, lambda g: (g["lo"] < t["end"]) & (g["hi"] > t["start"]))
        over = F.flatten(F.transform(near, lambda g: F.filter(g["spans"], lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))))
        kind = lambda o: F.get(F.array(*[F.lit(k) for k in KINDS]), F.array_min(F.transform(o, lambda b: b["k"])))
        named = lambda o: F.when(~F.exists(o, lambda b: b["start"] < t["start"]), F.struct(t["start"].alias("start"), t["end"].alias("end"), t["instance"].alias("instance"), _before(text, t["start"], parts=parts).alias("pattern"), kind(o).alias("kind")))
        return bound(over, named)

    every = bound(bound(base, _groups), lambda g: bound(blocks(text, CUT), lambda p: F.transform(tokens, lambda t: of(t, g, p))))
    return F.filter(every, lambda x: x["pattern"].isNotNull())


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, did, tkey), the base spans of each kind, and `ids`: (start, end, instance, pattern, kind) of tokens that could be identifiers, outside base spans or at the start of one, which is then their kind."""
    rows = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("*", *[_checked(k).alias(k) for k in KINDS])
    ranked = [F.transform(F.col(k), lambda m, i=i: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("k"))) for i, k in enumerate(KINDS)]
    bare = lambda m: F.rtrim(m["s"], F.lit("._+-"))
    tokens = F.transform(matches(F.col("text"), TOKEN), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(bare(m))).alias("end"), F.lower(bare(m)).alias("instance")))
    ids = bound(tokens, lambda t: _told(F.col("text"), t, F.array_sort(F.concat(*ranked))))
    return rows.select("doc_id", "did", "tkey", *KINDS, ids.alias("ids"))


def trusted_patterns(spotted: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """(pattern, kind) whose identifiers are believed, from `spotted` (pattern, instance, kind), one row an occurrence.

    Every round scores patterns by the trust in their instances, then instances by the
    patterns that introduce them; what is known stays at 1.
    """
    known = [F.sum((F.coalesce(F.col("kind"), F.lit("")) == k).cast("long")).alias(k) for k in KINDS]
    edges = written(spotted.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), *known), "pii-edges")
    sure = [F.max((F.col(k) > 0).cast("double")).alias(k) for k in KINDS]
    instances = written(edges.groupBy("instance").agg(*sure), "pii-instances")
    seeds, patterns = instances, None
    for turn in range(trust.rounds):
        of = edges.select("pattern", "instance", "n").join(instances, "instance")
        scored = of.groupBy("pattern").agg(F.sum("n").alias("n"), *[(F.sum(F.col(k) * F.col("n")) / F.sum("n")).alias(k) for k in KINDS])
        best = F.greatest(*KINDS)
        kind = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in KINDS])
        patterns = written(scored.filter((F.col("n") >= trust.support) & (best >= trust.score)).select("pattern", kind.alias("kind")), "pii-patterns")
        if turn + 1 < trust.rounds:
            under = edges.select("pattern", "instance", "n").join(patterns, "pattern", "left")
            shares = under.groupBy("instance").agg(*[(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"by_{k}") for k in KINDS])
            instances = written(seeds.join(shares, "instance").select("instance", *[F.greatest(k, f"by_{k}").alias(k) for k in KINDS]), "pii-instances")
    return patterns


def spans(docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """(doc_id, one array of base spans for each kind, added) for each row of docs; added: array<struct<start, end, kind>>."""
    rows = written(found(docs), "pii-spans")
    spotted = rows.select("did", "tkey", F.explode("ids").alias("id")).select("did", "tkey", "id.*")
    patterns = trusted_patterns(spotted.select("pattern", "instance", "kind"), trust)
    digits = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    unseen = spotted.filter(F.col("kind").isNull() & ((digits >= trust.min_digits) | F.col("instance").contains("@"))).drop("kind")
    added = unseen.join(patterns, "pattern").groupBy("did", "tkey").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return rows.join(added, ["did", "tkey"], "left").select("doc_id", *KINDS, F.coalesce("added", none).alias("added"))


def op7_pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(documents(spark, sf_dir))

    def said(every: bool) -> Column:
        parts = []
        for k in KINDS:
            own = _named(F.col(k), k)
            parts.append(F.array_sort(F.concat(own, F.filter("added", _is(k)))) if every else own)
        return F.array_join(F.transform(F.concat(*parts), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")

    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(said(False), 256).alias("base_sha256"), said(True).alias("spans"), sum((F.size(c) for c in (*KINDS, "added")), F.lit(0)).cast("long").alias("n_spans"))


def _is(kind: str):
    return lambda m: m["kind"] == kind
