"""Words, scripts and small parses as column expressions.

Character classes are explicit, so that Java's, Python's and RE2's regular expressions agree.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordweave.functions.arrays import bound

# ---- Fixed values: they have to be these for equal results.
TOKEN = r"[가-힣]+|[一-鿿]+|[぀-ゟ゠-ヿ]+|[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9\-]*"
JUNK = [
    "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "로", "와", "과", "르", "야", "요", "죠",
    "것", "때", "예", "등", "뿐", "듯", "따위", "및",
    "one", "two", "three", "first", "second", "next", "last", "part", "example", "way", "thing", "kind", "type", "case", "time", "year",
]
NO_ACRONYM = ["the", "and", "for", "but", "not", "you", "all", "any", "was", "are", "his", "her", "its", "our", "who", "why", "how", "one", "two", "new"]
GENERIC = [
    "종류", "방법", "특징", "개념", "요소", "결과", "과정", "상황", "맥락", "목표", "계획", "정보", "내용", "예시", "설명", "활용",
    "중요성", "구체적", "다양성", "필요성", "관련", "부분", "경우", "수준", "정도", "질문", "답변", "요청", "안내", "대화", "궁금증",
    "궁금", "도움", "제공", "참고", "추가", "문의", "이해", "의미", "적용", "사용", "문제", "주제", "표현", "역할", "products", "types",
]
ENGLISH_MARKERS = ["the", "and", "of", "is", "are", "with", "that", "this", "for", "which", "these", "from", "have", "has", "was", "were"]
FEED_BRANDS = ["npr", "topics", "news", "guardian", "ars", "technica", "bbc", "reuters", "nytimes", "times", "headlines", "latest", "rss", "feed", "homepage", "world", "video", "audio", "podcast"]
WIKI_SYSTEM = r"^(Main_Page|Special:|Wikipedia:|Portal:|Help:|File:|Category:|Template:|List_of_|Talk:)"
SPANISH = r"(?iu)[ñáéíóúü¿¡]|\b(de|la|el|los|las|que|con|para|una?)\b"
LATIN_TOKEN = r"\b[A-Za-z][A-Za-z\-]{2,}\b"
ACRONYM, PERSON = r"^[A-Z][A-Z0-9]{1,7}$", r"^[A-Z][a-z]+(?:[ '-][A-Z][a-z]+){1,2}$"
HANGUL, KANA, HAN, LATIN = "[가-힣]", "[぀-ゟ゠-ヿ]", "[一-鿿]", "[A-Za-z]"
# ----
#: Named and numeric entities of HTML, and the names' code points, from Python's table.
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
ENTITIES = {**name2codepoint, "apos": 39}
_EDGES = r"^[\p{Z}\s]+|[\p{Z}\s]+$"


def clean(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def norm(c: Column) -> Column:
    """Node key: lower case, without white space, hyphens, underscores and middle dots."""
    return F.regexp_replace(F.lower(clean(c)), r"[\p{Z}\s\-_·]+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def is_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def is_junk(lowered: Column) -> Column:
    return lowered.isin(*JUNK) | is_digits(lowered)


def token_key(token: Column) -> Column:
    """norm() of one of tokens(), of whose characters only the hyphen goes, in lower case."""
    return F.translate(token, "-", "")


def is_junk_token(lowered: Column) -> Column:
    """is_junk() of one of tokens(), which are never digits alone."""
    return lowered.isin(*JUNK)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect(text: Column) -> Column:
    """Language of a text by shares of its scripts; kana decide alone, and Spanish needs three hints."""
    ko, ja, zh, en = (_count(text, p) for p in (HANGUL, KANA, HAN, LATIN))
    total = ko + ja + zh + en
    return (
        F.when(total == 0, "en").when(ja > 0, "ja").when(ko > 0.3 * total, "ko").when(zh > 0.3 * total, "zh").when(_count(text, SPANISH) >= 3, "es").otherwise("en")
    )


def script(word: Column) -> Column:
    """ko, ja, zh or en by the characters of a word; mix for several, but Han beside kana is ja; other for none."""
    ko, ja, zh, en = (word.rlike(p) for p in (HANGUL, KANA, HAN, LATIN))
    n = sum((x.cast("int") for x in (ko, ja, zh, en)), F.lit(0))
    return F.when(n == 0, "other").when((n > 1) & ~((n == 2) & ja & zh), "mix").when(ja, "ja").when(ko, "ko").when(zh, "zh").otherwise("en")


def coarse_script(word: Column) -> Column:
    """The older classes, which know no ja or zh."""
    ko, en = word.rlike(HANGUL), word.rlike(LATIN)
    return F.when(ko & en, "mix").when(ko, "ko").when(en, "en").otherwise("other")


def is_generic(word: Column) -> Column:
    w = F.lower(clean(word))
    n = F.length(w)
    half = (n / 2).cast("int")
    return w.isin(*GENERIC) | ((n >= 4) & (n % 2 == 0) & (F.substring(w, F.lit(1), half) == F.substring(w, half + 1, half)))


def is_valid_word(word: Column) -> Column:
    return F.length(clean(word)).between(2, 30) & ~is_generic(word)


def is_word(token: Column) -> Column:
    """Whether a token may be a node: an acronym, or one token of the tokeniser from end to end; single characters only in Hangul."""
    t = clean(token)
    low = F.lower(t)
    whole = t.rlike(f"^(?:{TOKEN})$")
    acronym = t.rlike(ACRONYM) & ~low.isin(*NO_ACRONYM)
    return F.coalesce((t != "") & ~is_junk(low) & (acronym | (whole & ((F.length(t) > 1) | t.rlike(HANGUL)))), F.lit(False))


def is_query(text: Column) -> Column:
    """Whether a text may be asked for: a word, a person's name, or at most four tokens that cover three quarters of it."""
    t = clean(text)
    found = F.filter(tokens(t), lambda x: ~is_junk(F.lower(x)))
    covered = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))
    return F.coalesce(F.length(t).between(1, 40) & (is_word(t) | t.rlike(PERSON) | (F.size(found).between(1, 4) & (covered >= 0.75 * F.length(t)))), F.lit(False))


def _character(entity: Column) -> Column:
    """The character of a named or numeric entity, given without & and ;. Unknown ones are null."""
    number = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, F.lit(3), F.lit(8)), 16, 10)).when(entity.startswith("#"), F.substring(entity, F.lit(2), F.lit(10))).try_cast("long")
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    code = F.coalesce(number, F.try_element_at(named, entity).cast("long"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def strip_tags(html: Column) -> Column:
    """Without tags, then with named and numeric entities as characters, each once."""

    def unescaped(bare: Column) -> Column:
        names = F.regexp_extract_all(bare, F.lit(ENTITY), F.lit(1))
        said = F.transform(names, lambda n: F.coalesce(_character(n), F.concat(F.lit("&"), n, F.lit(";"))))
        return F.array_join(F.zip_with(F.split(bare, ENTITY, -1), F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return bound(F.regexp_replace(html, "<[^>]+>", ""), lambda b: F.when(F.instr(b, "&") > 0, unescaped(b)).otherwise(b))


def titles(html: Column) -> Column:
    """Texts of the title elements of a feed or page, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?s)<title>(.*?)</title>"), F.lit(1)), strip_tags)


def wiki_title(title: Column) -> Column:
    """A page name as words: no system pages, no bracketed suffix, three words at most; null if it drops out."""
    t = clean(F.replace(F.regexp_replace(title, r"_\(.*?\)$", ""), F.lit("_"), F.lit(" ")))
    return F.when(~title.rlike(WIKI_SYSTEM) & (t != "") & (F.size(F.split(t, r"\s+")) <= 3), t)


def is_entity(phrase: Column) -> Column:
    """A name of up to three words and 40 characters whose words are nodes or begin with a capital."""
    p = clean(phrase)
    words = F.split(p, r"\s+")
    return (
        F.length(p).between(3, 40)
        & (F.size(words) <= 3)
        & ~is_digits(p)
        & p.rlike(r"\p{L}")
        & (F.size(F.array_distinct(F.split(F.lower(p), ""))) >= 3)
        & F.forall(words, lambda w: is_word(w) | w.rlike(r"^\p{Lu}"))
    )


def words_from(phrase: Column) -> Column:
    """Tokens of three characters or more that may be nodes and are no feed's name."""
    return F.filter(tokens(phrase), lambda w: is_word(w) & (F.length(w) >= 3) & ~F.lower(w).isin(*FEED_BRANDS))


def listed(reply: Column, k: int) -> Column:
    """A reply's words: cut at commas and lines, bare of bullets and numbers, valid ones, first of each in any case, k at most."""
    parts = F.transform(F.split(reply, "[,\n]"), lambda x: F.regexp_replace(x, r"^[\s\"'·\-*0-9.]+|[\s\"'·\-*0-9.]+$", ""))
    good = F.filter(parts, lambda x: (x != "") & is_valid_word(x))
    low = F.transform(good, F.lower)
    return F.slice(F.filter(good, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, k)


def choice(reply: Column, candidates: Column) -> Column:
    """The candidate that a reply's leading number names; null if there is none."""
    i = F.regexp_extract(reply, r"^\s*([0-9]{1,9})", 1)
    n = i.try_cast("int")
    return F.when(n >= 1, F.get(candidates, n - 1))


def is_yes(reply: Column) -> Column:
    return F.upper(clean(reply)).startswith("YES")


def cache_key(**fields: Column) -> Column:
    """16 hex digits of the SHA-1 of a flat JSON object, keys in order, ', ' and ': ' between. The columns hold JSON."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.left(F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), F.lit(16))


def json_string(c: Column) -> Column:
    """A string as JSON, other characters than the escaped ones kept."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def iso(ts: Column) -> Column:
    """A time as text, to the second, without a zone: such texts sort as their times do."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def now() -> Column:
    return iso(F.localtimestamp())


def tier(rarity: Column) -> Column:
    return F.when(rarity.isNull(), None).when(rarity <= 0.01, "top1").when(rarity <= 0.05, "top5").when(rarity <= 0.10, "top10").otherwise("typical")


def snippet(text: Column, word: Column, pad: int = 140, at: Column | None = None) -> Column:
    """struct(before, match, after) around a word in a text: at the character `at`, counted from 1, if that is given and not null, else at its first place in any case; null if it isn't there."""
    found = F.instr(F.lower(text), F.lower(word))

    def around(at: Column) -> Column:
        start, end = at - 1, at - 1 + F.length(word)
        lo, hi = F.greatest(start - pad, F.lit(0)), F.least(F.length(text), end + pad)
        cut = lambda a, b: F.substring(text, a + 1, b - a)
        before = F.concat(F.when(lo > 0, "…").otherwise(""), cut(lo, start))
        after = F.concat(cut(end, hi), F.when(hi < F.length(text), "…").otherwise(""))
        return F.when(at > 0, F.struct(before.alias("before"), cut(start, end).alias("match"), after.alias("after")))

    return bound(found if at is None else F.coalesce(at, found), around)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))
