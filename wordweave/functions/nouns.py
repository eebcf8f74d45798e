"""Noun spans and compounds from a tagger's tokens.

The taggers themselves are not part of this library: any function from texts to tokens will
do. What it says of a text is a column of TAGS, and everything after it is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from wordweave.functions.arrays import blocks, bound, piece
from wordweave.functions.text import is_junk
from wordweave.session import ship

#: Tokens of a text in order: place and length in code points, fine tag (ko, zh), universal part of speech, dependency, place of the head among the tokens (its own for a root), whether a stop word or like a number.
TAGS = "array<struct<start:int,len:int,text:string,lemma:string,tag:string,pos:string,dep:string,head:int,stop:boolean,num:boolean>>"
# ---- Fixed values: they have to be these for equal results.
KOREAN, KOREAN_LATIN = ["NNG", "NNP", "SH"], "SL"
NOUNS, MODIFIES, MODIFIERS = ["NOUN", "PROPN"], ["compound", "amod"], ["NOUN", "PROPN", "ADJ"]
COMPOUND = 3
# ----
_LOADED: dict[tuple[str, str], Callable] = {}


def tagged(texts: DataFrame, load: Callable[[str], Callable[[list[str]], list[list[tuple]]]]) -> DataFrame:
    """texts (.., text, lang) with `tags`. load(lang) gives a function from texts to their tokens as rows of TAGS; a worker calls it once for each language that it meets."""
    ship(texts.sparkSession)
    name = f"{load.__module__}.{load.__qualname__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for lang, rows in batch.groupby("lang", dropna=False):
                if (name, lang) not in _LOADED:
                    _LOADED[name, lang] = load(lang)
                out.loc[rows.index] = pd.Series(_LOADED[name, lang]([t or "" for t in rows["text"]]), index=rows.index, dtype=object)
            yield batch.assign(tags=out)

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField("tags", _parse_datatype_string(TAGS))]))


def tagger(load: Callable[[str], Callable[[list[str]], list[list[tuple]]]]):
    """A table function (text, lang) -> rows of TAGS and their place `i`, for lateral joins; load is as for tagged(), and is called once by each worker and language.

    spark.udtf.register("tagged", tagger(load)), then SELECT .. FROM docs, LATERAL tagged(text, lang).
    """
    name = f"{load.__module__}.{load.__qualname__}"

    class Tagger:
        def eval(self, text: str, lang: str):
            if (name, lang) not in _LOADED:
                _LOADED[name, lang] = load(lang)
            for i, row in enumerate(_LOADED[name, lang]([text or ""])[0]):
                yield (i, *row)

    return udtf(Tagger, returnType=f"i int, {TAGS.removeprefix('array<struct<').removesuffix('>>').replace(':', ' ').replace(',', ', ')}")


def text_tagger(load: Callable[[str], Callable[[list[str]], list[list[tuple]]]]):
    """A table function (text, lang) -> one row with the `tags` of the text, as tagger() else: nothing has to be gathered, so no token is shuffled."""
    name = f"{load.__module__}.{load.__qualname__}"

    class TextTagger:
        def eval(self, text: str, lang: str):
            if (name, lang) not in _LOADED:
                _LOADED[name, lang] = load(lang)
            yield (_LOADED[name, lang]([text or ""])[0],)

    return udtf(TextTagger, returnType=f"tags {TAGS}")


def gathered(tags: DataFrame, *by: str) -> DataFrame:
    """Rows of a lateral join with a tagger as arrays again: (by .., tags) in their order."""
    names = [f.name for f in _parse_datatype_string(TAGS).elementType.fields]
    rows = tags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("rows"))
    return rows.select(*by, F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names])).alias("tags"))


def _span(t: Column, word: Column) -> Column:
    return F.struct(t["start"].alias("start"), (t["start"] + t["len"]).alias("end"), word.alias("word"))


def _first_modifiers(tags: Column) -> Column:
    """For each token the place of its first modifier; null if it has none.

    Tokens and modifiers are sorted by the token they belong to, a token before its modifiers.
    """
    own = F.transform(tags, lambda t, i: F.struct(i.alias("of"), F.lit(-1).alias("at")))
    modifies = lambda t, i: (t["head"] != i) & t["dep"].isin(*MODIFIES) & t["pos"].isin(*MODIFIERS) & ~t["stop"]
    theirs = F.filter(F.transform(tags, lambda t, i: F.when(modifies(t, i), F.struct(t["head"].alias("of"), i.alias("at")))), lambda x: x.isNotNull())
    found = lambda x: F.transform(x, lambda e, k: F.struct(e["at"].alias("at"), F.when(F.get(x, k + 1)["of"] == e["of"], F.get(x, k + 1)["at"]).alias("first")))
    return F.transform(F.filter(bound(F.array_sort(F.concat(own, theirs)), found), lambda e: e["at"] == -1), lambda e: e["first"])


def _compounds(text: Column, tags: Column) -> Column:
    """Nouns, each with its modifiers as one span of COMPOUND tokens at most; a noun that modifies another one is part of that."""

    def of(first: Column, parts: Column) -> Column:
        def span(t: Column, i: Column) -> Column:
            noun = t["pos"].isin(*NOUNS) & ~t["stop"] & (F.length(t["text"]) >= 2) & ~t["num"]
            absorbed = t["dep"].isin(*MODIFIES) & (t["head"] != i) & F.coalesce(F.get(tags, t["head"])["pos"].isin(*NOUNS), F.lit(False))
            at = F.get(first, i)
            begin, end = F.get(tags, at)["start"], t["start"] + t["len"]
            whole = F.struct(begin.alias("start"), end.alias("end"), piece(parts, begin, end - begin).alias("word"))
            lemma = F.when(F.coalesce(t["lemma"], F.lit("")) != "", t["lemma"]).otherwise(t["text"])
            return F.when(noun & ~absorbed, F.when((at < i) & (at > i - COMPOUND), whole).otherwise(_span(t, lemma)))

        return F.transform(tags, span)

    return bound(_first_modifiers(tags), lambda f: bound(blocks(text), lambda p: of(f, p)))


def noun_spans(text: Column, tags: Column, lang: Column) -> Column:
    """array<struct<start, end, word>> of the nouns that a tagger found in a text of a language; no tags give none."""
    ko = F.transform(tags, lambda t: F.when(t["tag"].isin(*KOREAN) | ((t["tag"] == KOREAN_LATIN) & (F.length(t["text"]) >= 2)), _span(t, t["text"])))
    zh = F.transform(tags, lambda t: F.when(t["tag"].rlike("^(n(?!r)|eng)") & (F.length(t["text"]) >= 2), _span(t, t["text"])))
    every = F.when(lang == "ko", ko).when(lang == "zh", zh).otherwise(_compounds(text, tags))
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    return F.coalesce(F.filter(every, lambda s: s.isNotNull() & ~is_junk(F.lower(s["word"]))), none)


def words(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["word"])
