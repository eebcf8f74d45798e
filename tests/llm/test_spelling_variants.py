"""Spelling variants against plain Python, with small blocks, long words and odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.compare import same
from wordweave.llm import spelling_variants as sv

DOCS = "doc_id long, text string, word string, key string, n string, h string, run string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=6, count=5):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def brute(words):
    rows = {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        rows[w] = [form, n, len(others), words[form] if form else None]
    out = set()
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, m))
    return out


def some_words(seed=3):
    rng = random.Random(seed)
    letters = "abcéß"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))): rng.choice([5, 6, 30, 150, 800]) for _ in range(250)}
    long = ["".join(rng.choice("abz") for _ in range(n)) for n in (63, 64, 65, 66, 300)]
    for w in long:
        for _ in range(6):
            i = rng.randrange(len(w))
            words[rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :], "q" + w, w + "q"])] = rng.choice([5, 200])
        words[w] = 40
    words |= {"aaaaaa": 9, "aaaaaaa": 9, "aaaaaaaa": 100, "abcdefgh": 5, "abcdefgi": 25, "abcdefgj": 25, "abcdefgij": 125, "abcdefgijk": 625}
    return words


@pytest.mark.parametrize("block", [3, 4096])
def test_variants(spark, block):
    words = some_words()
    got = sv.variants(spark.createDataFrame(sorted(words.items()), "word string, n long"), block=block).collect()
    assert len(got) == len(words)
    want = brute(words)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    chain = next(r for r in got if r.word == "abcdefgh")
    assert (chain.form, chain.root) == ("abcdefgi", "abcdefgijk")


def test_probes_find_every_near_word():
    """Two grams that don't overlap: one of them is left by any one edit, at its place or one on."""
    rng = random.Random(8)
    counts = sv.np.array([rng.randrange(50) for _ in range(sv.LETTERS**sv.Q)])
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 12)))
        g = sv.grams(sv.np.frombuffer(w.encode(), sv.np.uint8)[None])
        first, second = (int(x[0]) for x in sv._probed(g, len(w), counts))
        assert second - first >= sv.Q
        every = [(i, j) for i in range(len(w) - 2) for j in range(i + 3, len(w) - 2)]
        assert counts[g[0, first]] + counts[g[0, second]] == min(counts[g[0, i]] + counts[g[0, j]] for i, j in every)


def docs(seed=5):
    rng = random.Random(seed)
    vocab = [w for w in some_words(seed) if len(w) < 20][:60] + ["Straße", "ÉTUDES", "Garden", "GARDEN", "gardén", "short", "ab"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice([" ", "1", "-", ", ", "\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    return rows + [(None, "garden " * 9), (None, None), (500, None), (501, ""), rows[3], rows[3]]


def stored(tmp_path, rows):
    cols = list(zip(*rows)) if rows else [[], []]
    kinds = [pa.int64(), *[pa.string()] * 6]
    names = [x.split(" ")[0] for x in DOCS.split(", ")]
    table = pa.table([pa.array(list(cols[0]), kinds[0]), pa.array(list(cols[1]), kinds[1]), *[pa.array(["x"] * len(rows), pa.string())] * 5], names=names)
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sv, "DROP_EACH", 3)
    rows = docs()
    where = stored(tmp_path, rows)
    got = {tuple(r) for r in sv.op13_spelling_variants(spark, where).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    monkeypatch.undo()
    words = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    assert got == brute({w: n for w, n in words.items() if len(w) >= 6 and n >= 5})
    assert any(form for _, form, *_ in got)


def test_query_against_sql_on_odd_rows(spark, tmp_path):
    rows = [r for r in docs(6) if r[0] is not None]
    where = stored(tmp_path, rows)
    df = sv.op13_spelling_variants(spark, where)
    same(df, sv.OP13_SQL, where)
    assert {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(brute_words(rows))


def test_empty_table(spark, tmp_path):
    assert sv.op13_spelling_variants(spark, stored(tmp_path, [])).count() == 0
