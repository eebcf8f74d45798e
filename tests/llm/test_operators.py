"""The training-data operators against brute force, and on the odd cases that each names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from wordweave.llm import byte_bpe, chat_format, language_id, line_dedup, minhash_dedup, pii_patterns, quality_rules, registry, source_mix, substring_dedup, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, did string, tkey string, size string, row string"


def documents(spark, rows):
    """Documents with more columns, whose names operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z", "r") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd(n=40):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = text(35), "A line that many documents share, more or less."
    rows = [(None, None, None), (1, "", "a"), (2, "one", "a"), (3, " \n\t ", None), (4, "é\U0001f600 ß", "b"), (5, "a " * 70, "a"), (None, text(60), "b")]
    for i in range(10, n):
        body = text(rng.randrange(30, 90))
        if i % 3 == 0:
            body = f"{body[: len(body) // 2]}\n  {line.upper()} \n{passage}\n{body[len(body) // 2 :]}"
        rows.append((i, body, "abc"[i % 3]))
    base = text(300).split()
    for i in range(n, n + 8):
        copy = list(base)
        for _ in range(i - n):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((i, " ".join(copy), "a"))
    rows += [rows[-1], rows[9], (n + 20, rows[12][1], "c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def distinct(docs):
    """Rows as documents: one for each id and text, null id first."""
    rows = {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_substring_dedup(docs, empty):
    width, rows = 20, distinct(docs)
    words = [WORD.findall(t) for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, ((1, 0), 0)), ((-1 if d is None else 0, d or 0), i))
    want = {}
    for (d, t), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < ((-1 if d is None else 0, d or 0), i) for k in range(width)}
        want[d, t] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    for limits in ({"block": 3000, "share": 3},):
        again = substring_dedup.parsed(docs, **limits).collect()
        assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in again} == {(d, *v) for (d, _), v in want.items()}
    got = substring_dedup.parsed(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(d, *v) for (d, _), v in want.items()}
    for r in got:
        assert all(f.len >= width and f.start + f.len <= r.n_words for f in r.factors)
    assert sum(r.n_removed for r in got) > 100
    assert substring_dedup.parsed(empty).count() == 0


def test_substring_factors(spark, monkeypatch):
    """Factors are as long as their source goes, start again over a border, and are proved on words."""
    import numpy as np

    from wordweave.llm import wordhash

    rng = random.Random(9)
    words = lambda k: [f"v{rng.randrange(10**7)}" for _ in range(k)]
    a, b, c = words(90), words(60), words(45)
    texts = [(1, " ".join(a)), (2, "\n ".join(b)), (3, " ".join(words(5) + a[10:80] + b[5:50] + words(3))), (4, " ".join(a[70:] + b[:12] + c + c[5:40])), (5, " ".join(a[71:] + b[:12])), (6, " ".join(c + a[:19]))]
    rows = documents(spark, [(i, t, "") for i, t in texts])
    want = {1: [], 2: [], 3: [(5, 70, 1, 10), (75, 45, 2, 5)], 4: [(0, 20, 1, 70), (77, 35, 4, 37)], 5: [(0, 31, 4, 1)], 6: [(0, 45, 4, 32)]}
    for block in (1,):
        got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.parsed(rows, block=block).collect()}
        assert got == want
    # Hashes that say nothing: only equal words make a factor.
    monkeypatch.setattr(wordhash, "mix", lambda x: x & np.uint64(0))
    import pyarrow as pa

    w = next(wordhash.slices(pa.array([" ".join(a)])))
    block = substring_dedup.Block(np.array([1, 2]), pa.array([" ".join(c + a[30:60]), " ".join(words(10) + a[:50])]), 20)
    assert len(set(w.hash.tolist())) == 1
    assert block.factors(w, w.shingles(20)[0], 0, 9) == [(0, 50, 2, 10), (31, 29, 1, 46)]


def test_topk_search(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (600, [1.0, None]), (700, [float("nan")]), (800, []), (None, [1.0]), (200, rows[3][1]), (900, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, df.filter("vec_id % 100 = 0"), size=64, query_size=3).collect()
    vec = [(r.vec_id, [int(1024 * x // 1) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and x == x for x in r.embedding)]
    want = set()
    for q in {v for v, _ in vec if v % 100 == 0}:
        e = min([x for x in df.filter(F.col("vec_id") == q).collect()], key=lambda r: r.embedding).embedding
        qe = [int(1024 * x // 1) for x in e]
        best = sorted(((-sum(a * b for a, b in zip(qe, x)), v) for v, x in vec if v != q))[:10]
        want |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_takes_any_finite_vector(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 0, 0, 3, 7, 15, 37]) for _ in range(6)]) for i in range(120)]
    rows += [(500 + i, [5000.0, -5000.0, 0.0, 0.25, 1.0, rng.uniform(-1, 1)]) for i in range(40)] + [(900, [float("inf")]), (901, [3.4e38] * 6), (902, [-3.4e38] * 6), (903, [4097.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vec = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in df.collect() if r.vec_id != 900}
    ask = df.filter("vec_id % 25 = 0 or vec_id > 900")
    want = set()
    for q in [r.vec_id for r in ask.collect() if r.vec_id != 900]:
        score = {v: sum(a * b for a, b in zip(vec[q], x)) for v, x in vec.items() if v != q}
        best = sorted(score, key=lambda v: (-score[v], v))[:10]
        want |= {(q, i + 1, v, max(-(2**63), min(2**63 - 1, score[v]))) for i, v in enumerate(best)}
    got = topk_search.top_k(df, ask, size=50, query_size=4).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


@pytest.mark.parametrize("big", [2.0**30, 2.0**45])
def test_topk_ranks_by_whole_numbers(spark, big):
    """Scores that one double stands for are told apart, within a long and beyond."""
    df = spark.createDataFrame([(i, [big, float(i)]) for i in range(13)], "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(100, [big, 1.0])], df.schema)
    for size in (4, 50):
        got = sorted((r["rank"], r.vec_id) for r in topk_search.top_k(df, ask, scale=1, size=size).collect())
        assert got == [(i + 1, 12 - i) for i in range(10)]


def test_topk_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rows = [(i, [0.5] * 4) for i in range(2000)] + [(5000, [0.25] * 10_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    data = [len(r.data) for r in topk_search.blocks(df, 1024, 16384).collect()]
    assert sum(data) == 4 * (2000 * 4 + 10_000)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 4096)
    small = [len(r.data) for r in topk_search.blocks(df, 1024, 16384).collect()]
    assert max(small) == 40_000 and sorted(small)[-2] <= 4096 and sum(small) == sum(data)
    got = topk_search.top_k(df, df.filter("vec_id in (7, 5000)")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 7] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_topk_stops_on_proof():
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(-300, 300, (4000, 16)).astype("<i4")
    data[:200] *= 3
    index = topk_search.ImpactIndex(np.arange(4000), data)
    for i in range(0, 4000, 400):
        q = data[i].astype(np.int64)
        at, scores = index.search(q, i, 10)
        every = data.astype(np.int64) @ q
        every[i] = np.iinfo(np.int64).min
        assert sorted(scores.tolist())[-10:] == sorted(every.tolist())[-10:]
    assert index.read < 10 * 4000 * 16


def test_minhash_dedup(docs, empty):
    plan, rows = minhash_dedup.Plan(shingle=4), distinct(docs)

    def shingles(t):
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    want = {(d, len(s), rows[comp[i]][0]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}
    null = lambda x: None if x == minhash_dedup.NULL_ID else x
    got = minhash_dedup.classes(docs, plan).collect()
    assert {(null(r.did), r.n_shingles, null(r["first"].did)) for r in got} == want
    kept = minhash_dedup.near_deduplicated(docs, plan)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert minhash_dedup.near_deduplicated(empty).count() == 0


def test_minhash_last_turn_finds_every_link(spark):
    """Links of similarity 0.8 that share no fine bucket of 14 of 256 minima, and members of one template that are no links."""
    import zstandard

    words = lambda rng, k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    texts, want = [], set()
    for seed in (1482, 2499, 3300, 3795, 4429):
        w = words(random.Random(seed), 53)
        want.add((len(texts), len(texts) + 1))
        texts += [" ".join(w[:48]), " ".join(w[:43] + w[48:])]
    rng = random.Random(8)
    template = words(rng, 90)
    for _ in range(40):
        w = list(template)
        for _ in range(6):
            w[rng.randrange(90)] = rng.choice(["x", "y"])
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    want |= {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    packer = zstandard.ZstdCompressor()
    packed = spark.createDataFrame([(i, packer.compress(t.encode())) for i, t in enumerate(texts)], "rep long, packed binary")
    placed = spark.createDataFrame([(7, i, len(x), len(sets), i) for i, x in enumerate(sets)], "bucket long, rep long, n long, size long, component long")
    for ahead in (1, 3, 32):
        got = minhash_dedup._rest(placed, packed, minhash_dedup.Plan(shingle=4, ahead=ahead)).collect()
        assert want <= {(r.a, r.b) for r in got}
    first = minhash_dedup._spokes(placed, None, minhash_dedup.Plan())
    again = minhash_dedup._spokes(placed, first, minhash_dedup.Plan())
    assert first.count() == len(sets) - 1 and again.count() == 0


def test_minhash_sql_splits_at_all_white_space(spark, tmp_path):
    rows = [(1, "a b c d e f g", ""), (2, "a\r\nb\x0bc\x0cd\te\rf g", ""), (3, "a\r\nb", "")]
    documents(spark, rows).select("doc_id", "text").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    same(minhash_dedup.op3_minhash_dedup(spark, str(tmp_path)), minhash_dedup.OP3_SQL, str(tmp_path))


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_bit_estimates(bits):
    import numpy as np
    import pyarrow as pa

    plan = minhash_dedup.Plan(bits=bits)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << bits, plan.minima)
    pack = lambda v: np.packbits(((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()).tobytes()
    for changed in (0, 20, 150):
        b = a.copy()
        b[:changed] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([pack(a)]), pa.array([pack(b)])], names=list("abcd"))
        out = sum(x.num_rows for x in minhash_dedup._close(plan)(iter([batch])))
        assert out == int(1 - changed / plan.minima >= plan.estimate_floor())


def test_language_id(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out and lang = lang_pred").count() >= 0.95 * out.filter("held_out").count()
    model = language_id.train(docs)
    strange = documents(spark, [(1, None, None), (2, "", None), (3, "12 -- 3", None), (4, docs.first().text * 30, None)])
    got = {r.doc_id: r for r in language_id.predicted(strange, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and 0 <= got[4].score <= 1
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predicted(strange, nothing).collect()} == {"und"}
    one = language_id.train(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predicted(strange, one).collect()} == {"und", "en"}
    assert language_id.predicted(empty, model).count() == 0


def test_language_sample_is_bounded(spark):
    learns = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learns[0], f"text number {i}", "aa") for i in range(4000)] + [(learns[1], "the same", "aa")] * 3000
    rows += [(i, f"other text {i}", "zz") for i in learns[2:61]] + [(5, None, "aa"), (None, "x", "aa"), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.sampled(docs, 20).collect()
    assert sorted(r.lang for r in got) == ["aa"] * 10 + ["zz"] * 10 and len(set(got)) == 20
    assert set(got) == set(language_id.sampled(docs.coalesce(1), 20).collect())
    assert language_id.train(docs, 20).langs == ["aa", "zz"]
    assert {r.lang for r in language_id.sampled(docs, 1).collect()} == {"aa"}
    assert language_id.sampled(docs.limit(0)).count() == 0


def test_language_decoding(spark, sf_dir):
    """Scores and languages of decoded margins, against plain sums of losses."""
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    rows = docs.limit(40).collect()
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.predicted(docs.limit(40), model).collect()}
    import pyarrow as pa

    want = set()
    for r in rows:
        x = language_id.profiles(pa.array([r.text]))[0]
        margin = [float(sum(x[i] * model.weights[i, j] for i in np.flatnonzero(x)) + model.bias[j]) for j in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m if c else m)) for m, c, t in zip(margin, word, model.trust)) for word in model.code]
        p = [math.exp(min(loss) - v) for v in loss]
        best = min(range(len(loss)), key=lambda i: (loss[i], i))
        want.add((r.doc_id, model.langs[best] if r.text and any(c.isalpha() for c in r.text) else "und", p[best] / sum(p) if r.text and any(c.isalpha() for c in r.text) else 0.0))
    assert {(d, lang) for d, lang, _ in got} == {(d, lang) for d, lang, _ in want}
    by = {d: s for d, _, s in want}
    assert all(abs(by[d] - s) < 1e-3 for d, _, s in got)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert code.shape[0] == n and min(gaps) >= 1 and (n < 4 or min(gaps) >= 3)
    assert all(0 < c.sum() < n for c in code.T)


def test_chat_format(spark):
    marks = "\\ <|turn|> <| [ < </s>[INST] \\< <|end|>"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", marks), (1, 2, "assistant", marks + "<"), (2, 0, "assistant", "early"), (2, 1, None, None), (3, 5, "user", "a"), (3, 5, "user", "a"), (None, 0, "user", "u"), (4, 1, "assistant", "x" * 50000), (4, 0, "user", "\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    t = chat_format.Template()
    out = chat_format.formatted(df).select("conv_id", "n_turns", "valid", "formatted", chat_format.parsed(F.col("formatted"), t).alias("back"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans"), t).alias("loss"))
    for r in out.collect():
        want = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(b.role, b.text) for b in r.back] == [(role, text) for _, role, text in want]
        assert r.loss == "".join(text for _, role, text in want if role == "assistant")
        assert r.valid == (r.conv_id in (1, 4))
        body = r.formatted.replace(t.open, "").replace(t.sep, "").replace(t.close, "")
        assert not any(c in body for c in (t.open, t.sep, t.close, *t.control))
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_source_mix(spark, docs, empty):
    rows = source_mix.takes(source_mix.sized(docs), buckets=8).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.times <= 3 or r.size == 0
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.times
        target[r.source] = r.target
    biggest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= biggest for s in sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 and all(target[s] <= 3 * sizes[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.takes(source_mix.sized(docs.repartition(3)), buckets=8).collect()))
    out = source_mix.mixed(docs, buckets=8)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in rows)
    assert source_mix.mixed(empty).count() == 0
    texts = [(i, f"{i} " + "a b c d e f g " * (1 + i % 3), "x") for i in range(12)] + [(50, "same words here", "x")] * 40 + [(51, "w " * 200, "y")]
    rows = documents(spark, texts).withColumn("n_chars", F.when(F.col("doc_id") == 50, F.floor(F.rand(3) * 3)).otherwise(0).cast("long"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    for seed in ("a", "b", "c", "d"):
        plan = source_mix.takes(source_mix.sized(rows), buckets=4, seed=seed)
        out = source_mix.mixed(rows, buckets=4, seed=seed)
        assert out.count() == plan.agg(F.sum("times")).first()[0]
        assert sorted(map(str, out.collect())) == sorted(map(str, source_mix.mixed(rows.repartition(5), buckets=4, seed=seed).collect()))
        assert out.groupBy(out.columns).count().join(rows.groupBy(rows.columns).count().withColumnRenamed("count", "n"), rows.columns).filter("count > 3 * n").count() == 0


@pytest.mark.parametrize(("sizes", "want"), [({"a": 100, "b": 100, "c": 100}, [187.5, 75, 37.5]), ({"a": 10, "b": 100, "c": 190}, [30, 180, 90]), ({"a": 0, "b": 5}, [0, 5]), ({"a": 0}, [0])])
def test_targets(spark, sizes, want):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert [round(r.target, 6) for r in source_mix.targets(df).orderBy("source").collect()] == want


def test_pii_patterns(spark, empty, tmp_path):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(k, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]

    rows = [(None, None), (1, ""), (2, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 a@b@c.d \U0001f600 x@y.zz 999.1.1.1 000255.0.0.1 00.00.00.00"), (3, "4111 1111-1111 1111 and 4111  1111 1111 1111 +1 (017) 555-7713 ++1234567890x +" + "7" * 5000), (4, "x" * 100000 + "@"), (3, "4111111111111111")]
    rows += [(10 + i, f"write to account number: user{i}@mail.com today") for i in range(12)] + [(30, "seen account number: 99812734 today"), (31, "in 2024 page 99812734x")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.base_sha256): r for r in pii_patterns.op7_pii_patterns(spark, str(tmp_path)).collect()}
    for d, t in rows:
        parts = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, t or "") if holds(k, m.group())]
        r = got[d, sha(",".join(parts))]
        assert set(parts) <= set(r.spans.split(",")) | {""}
        assert r.spans == ("email:21:29" if d == 30 else ",".join(parts))
    assert pii_patterns.spans(empty).count() == 0


def test_pii_patterns_take_whole_words(spark):
    """The two words before a token, however long they are or far away."""
    befores = ["", "one ", "Write TO ", "x" * 200 + " url: ", "see " + "y" * 79 + " ", "a b" + " " * 300, "far word" + "\n" * 5000, "p" * 9000 + " " + "q7" * 1500 + " ", " " * 100 + "only ", "k l m " * 30, "c" * 75 + " id: ", "id " + "d" * 77 + " ("]
    df = spark.createDataFrame([(i, t + "998127", len(t)) for i, t in enumerate(befores)], "i long, text string, start int")
    for r in df.select("i", pii_patterns._before(F.col("text"), F.col("start")).alias("p")).collect():
        words = WORD.findall(re.sub("[0-9]", "0", befores[r.i].lower()))
        assert r.p == (" ".join(words[-2:]) if len(words) >= 2 else None), r.i
    rows = [(i, f"account {'n' * 100}: user{i}@mail.com today", "") for i in range(12)] + [(30, f"an account {'n' * 100}: 99812734 today", "")]
    got = {r.doc_id: r.added for r in pii_patterns.spans(documents(spark, rows)).collect()}
    assert [(x.start, x.end, x.kind) for x in got[30]] == [(113, 121, "email")]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (150, 40)])
def test_byte_bpe(spark, docs, empty, chunk, overlap):
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = documents(spark, [(700, "a" * 3000, ""), (701, "x y  z\n\n  " * 90 + "b" * 300 + " it's  end  ", ""), (702, " " * 500, "")])
    every = docs.unionByName(more)
    got = byte_bpe.decode(byte_bpe.encode(every, path, pattern, chunk, overlap), path)
    want = [(r.doc_id, plain.encode_ordinary(r.text or ""), r.text or "") for r in every.collect()]
    assert sorted((str(r.doc_id), r.ids, bytes(r.raw).decode()) for r in got.collect()) == sorted((str(d), ids, t) for d, ids, t in want)
    digests = [str(_row(d, len(ids), sha(",".join(map(str, ids))), sha(t))) for d, ids, t in want]
    assert sorted(map(str, byte_bpe.digested(got).collect())) == sorted(digests)
    assert byte_bpe.decode(byte_bpe.encode(empty, path, pattern), path).count() == 0
    assert [bytes(r.raw) for r in byte_bpe.decode(got.select("doc_id", F.lit(None).alias("ids")).limit(2), path).collect()] == [b"", b""]
    for ids in ([-1], [10**7], [5, None]):
        with pytest.raises(Exception):
            byte_bpe.decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>"), path).collect()


def _row(doc_id, n, ids, decoded):
    from pyspark.sql import Row

    return Row(doc_id=doc_id, n_tokens=n, ids_sha256=ids, decoded_sha256=decoded)


def test_line_dedup(docs, empty):
    rows = distinct(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    last = lambda ids: max(ids, key=lambda d: (d is not None, d or 0))
    want = {}
    for d, t in rows:
        want[d, t] = "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or last(holders[key(x)]) == d)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {(r.doc_id, r.text or "") for r in out.collect()} == {(d, t) for (d, _), t in want.items()}
    assert any(t != kept for (_, t), kept in want.items())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(3000))
    more = documents(spark, [(800, "Word after word of it. " * 40, ""), (801, " ".join(noise[i : i + 20] for i in range(0, 3000, 20)), ""), (802, "dup line\nother\ndup line\n\n\n# $ |", "")])
    every = docs.unionByName(more)
    got = {(r.doc_id, r.n_words): r for r in quality_rules.compression_bands(every).collect()}
    for r in every.collect():
        t = r.text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeat = len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        x = got[r.doc_id, len(w)]
        assert (x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert x.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (x.kept and x.base_failed)
    kept = quality_rules.accepted(every)
    assert kept.columns == every.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 800 not in ids and 40 in ids
    assert quality_rules.accepted(empty).count() == 0


def _base64(rng, n):
    """n characters of random base64 in words of 8."""
    text = base64.b64encode(rng.randbytes(n)).decode()
    return " ".join(text[i : i + 8] for i in range(0, n, 8))[:n]


def test_quality_rules_reject_short_noise(spark, sf_dir):
    rng = random.Random(6)
    sizes = [n for n in (300, 399, 400, 500, 639, 640, 800, 1000, 1023, 1024, 1500, 2500, 4000, 4095) for _ in range(5)]
    noise = documents(spark, [(i, _base64(rng, n), "") for i, n in enumerate(sizes)])
    low = [max(x for x in quality_rules.Bands().whole if x[0] <= n)[1] for n in sizes]
    for r in quality_rules.compression_bands(noise).collect():
        assert not r.kept and r.ratio < low[r.doc_id], sizes[r.doc_id]
    prose = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("octet_length(text) >= 256")
    for r in quality_rules.compression_bands(prose).collect():
        assert r.ratio >= 1.4 or r.n_words < 100 and r.ratio >= 1.22


def test_quality_rules_judge_every_byte(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))[:n]

    bad = {"noise": _base64(rng, 4080), "repeat": ("over and over, " * 300)[:4080]}
    cases = [(side, kind, text) for kind, x in bad.items() for side, text in (("first", x + prose(4112)), ("last", prose(4096) + x), ("apart", prose(12288) + x + x), ("few", prose(32768) + x))]
    cases += [("few", "none", prose(n)) for n in (1023, 1024, 4095, 4096, 4097, 8191, 8192, 12298)]
    docs = documents(spark, [(i, text, "") for i, (_, _, text) in enumerate(cases)])
    for r in quality_rules.compression_bands(docs).collect():
        side, kind, text = cases[r.doc_id]
        assert r.n_chunks == (-(-len(text) // 4096) if len(text) >= 1024 else 0)
        assert not r.base_failed or kind == "repeat", (side, kind, len(text))
        if kind != "none":
            assert (r.low_chunks if kind == "noise" else r.high_chunks) >= 1, (side, kind)
        assert r.kept == (side == "few"), (side, kind, len(text))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, d = docs.count(), docs
    for name, stage in p.STAGES[:-1]:
        d = stage(spark, d, sf_dir).cache()
        assert d.columns == docs.columns and 0 < d.count() <= 3 * n, name
    last = p.STAGES[-1][1](spark, d, sf_dir)
    assert sorted(map(str, last.collect())) == sorted(map(str, p.run(spark, sf_dir).collect()))


def test_pipeline_stages_in_special_cases(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    last = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    nothing = p.run(spark, str(tmp_path))  # each stage on an empty table
    assert nothing.columns == last and nothing.count() == 0
    order = lambda rows: sorted(map(str, rows))
    blank = order(r for r in docs.collect() if not (r.text or "").split())
    for name, stage in p.STAGES:
        columns = docs.columns if name != p.STAGES[-1][0] else last
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == columns, name
        if name == "source_mix":
            assert order(rows) == order(stage(spark, docs.repartition(3), str(tmp_path)).collect())
        if name in ("line_dedup", "minhash_near_dedup"):
            assert order(r for r in rows if not (r.text or "").split()) == blank, name
        elif name == "quality_rules":
            assert all((r.text or "").split() for r in rows)
        elif name == "byte_bpe":
            assert len(rows) == docs.count() and sum(r.n_tokens == 0 for r in rows) == docs.filter("coalesce(text, '') = ''").count()


def test_mix_buckets_are_even(spark):
    """Of documents of one weight no bucket gets more than 4 times its share, and the mix is the same for any number of them."""
    for weight in (0.5, 1.0, 2.0):
        rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.lit(weight).alias("weight"), F.lit(0).cast("long").alias("tkey"))
        rows = rows.union(rows.withColumn("source", F.lit("t")).filter("doc_id < 5000"))
        took = {n: sorted((r.doc_id, r.source, r.times) for r in source_mix.takes(rows, buckets=n).collect()) for n in (1, 64)}
        assert took[1] == took[64]
        place = F.floor(F.sqrt(F.pow(source_mix.uniform(F.col("doc_id"), source_mix.SEED), 1.0 / F.col("weight"))) * 64)
        assert max(r["count"] for r in rows.filter("source = 's'").groupBy(place).count().collect()) < 4.5 * 20000 / 64


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    """run() against plain Python up to the mix, and tiktoken after it. The mix is source_mix.mixed over brute force's rows."""
    import corpus_pipeline as p
    import tiktoken
    import zstandard

    labels = [(i, i % 2, 0) for i in range(10, 40)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    bands, packer = quality_rules.Bands(), zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def good(text):
        w, raw = WORD.findall(text), text.encode()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeat = len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
        assert len(raw) <= bands.chunk  # one chunk, whose band is the wider one
        _, low, high = max(x for x in bands.whole if x[0] <= len(raw))
        return len(w) >= 50 and 2 * repeat <= len(w) and low <= len(raw) / len(packer.compress(raw)) <= high

    order = lambda d: (d is not None, d or 0)
    rows = [r.asDict() for r in docs.collect() if good(r.text or "")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for r in rows:
        for x in r["text"].split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(r["doc_id"])
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)], key=order) == r["doc_id"])
        r["n_chars"] = len(r["text"])
    some = sorted({(r["doc_id"], r["text"]) for r in rows}, key=lambda r: (order(r[0]), r[1]))

    def shingles(t):
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in some]
    comp = list(range(len(some)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    first = {some[c] for c in comp}
    left = [r for r in rows if (r["doc_id"], r["text"]) in first]
    assert 0 < len(left) < len(rows) < docs.count()
    out = p.source_mix(spark, spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in left], docs.schema), str(tmp_path)).collect()
    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = [(r.doc_id, plain.encode_ordinary(r.text), r.text) for r in out]
    want = [str(_row(d, len(x), sha(",".join(map(str, x))), sha(t))) for d, x, t in ids]
    assert sorted(map(str, p.run(spark, str(tmp_path)).collect())) == sorted(want)
