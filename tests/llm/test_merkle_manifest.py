"""Merkle manifests against plain Python, with blocks of several sizes, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tests.compare import same
from wordweave.llm import merkle_manifest as mm

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, i string, proof string, root string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Levels of nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def walk(levels, i):
    for level in levels[:-1]:
        lo = i // 8 * 8
        yield level[lo:i], level[i + 1 : lo + 8]
        i //= 8


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for doc, text, lang, source, n in rows:
        head = enc(doc) + enc(source) + enc(lang) + enc(n)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None
        groups.setdefault(lang, []).append(((doc is not None, doc or 0), h(head + enc(text)), h(head + enc(text.translate(low))) if bad else h(head + enc(text)), doc))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = tree([leaf for _, leaf, _, _ in groups[g]])
    crown = tree([trees[g][-1][0] for g in names])
    root, out = crown[-1][0], []
    for j, g in enumerate(names):
        for i, (_, leaf, held, doc) in enumerate(groups[g]):
            steps = [*walk(trees[g], i), *walk(crown, j)]
            node = held
            for a, b in steps:
                node = h("".join([*a, node, *b]))
            out.append((doc, leaf, trees[g][-1][0], root, h("".join(x for a, b in steps for x in a + b)), node, node == root))
    return out


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    out = [(rng.randrange(10 * n), " ".join(rng.choice(["Ab", "c", "É", "x y"]) for _ in range(rng.randrange(5))), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([1, None])) for _ in range(n)]
    out += [(None, None, None, None, None), (None, "T", "en", "s", 1), (7, "", "en", "s", 0), (7, None, "en", "s", 0), (8, "Same", "en", "s", 4), (8, "Same", "en", "s", 4)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "g", "i", "p", "r") for r in data], DOCS)


def judged(spark, df, **sizes):
    from pyspark.sql import functions as F

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = mm.leaf([F.translate("text", mm._UPPER, mm._LOWER) if c == "text" else F.col(c) for c in mm.COLUMNS])
    leaves = df.select(mm.group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("key"), mm.leaf([F.col(c) for c in mm.COLUMNS]).alias("leaf"), F.when(tampered, changed).alias("tampered"))
    m = mm.manifest(leaves, **sizes).withColumn("f", mm.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    got = m.select("key", "leaf", "subroot", "root", mm.proof_digest(F.col("proof")), "f", F.col("f") == F.col("root")).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize(("n", "langs", "sizes"), [(300, ["en", "de", None, ""], {"depth": 1}), (150, ["en"], {"depth": 2}), (40, [f"l{i}" for i in range(25)], {"depth": 1}), (60, ["en", "fr"], {})])
def test_manifest(spark, n, langs, sizes):
    data = rows(n, langs)
    want = sorted(brute(data), key=str)
    assert judged(spark, frame(spark, data), **sizes) == want
    assert {w[-1] for w in want} == {True, False}


def test_blocks_grow_with_the_table(spark):
    data = rows(200, ["en"], 3)
    assert judged(spark, frame(spark, data), blocks=1) == sorted(brute(data), key=str)


def test_fragments_are_a_monoid():
    leaves = [h(str(i)) for i in range(77)]
    want = tree(leaves)[-1][0]
    rng = random.Random(5)
    for _ in range(20):
        parts = [mm.Forest() for _ in range(6)]
        for i, leaf in enumerate(leaves):
            rng.choice(parts).put("g", 77, 0, i, leaf)
        rng.shuffle(parts)
        while len(parts) > 1:
            a = rng.randrange(len(parts) - 1)
            parts[a : a + 2] = [parts[a].merged(parts[a + 1])]
        assert parts[0].roots == {"g": want} and not parts[0].open
        assert mm.Forest().merged(parts[0]).roots == {"g": want}


def test_one_row_and_none(spark):
    one = [(5, "Text", "en", "s", 4)]
    got = judged(spark, frame(spark, one))
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3]
    assert judged(spark, frame(spark, [])) == []


def test_long_text(spark):
    data = [(1, "Ab" * 600_000, "en", "s", 1), (2, "x", "en", "s", 1)]
    assert judged(spark, frame(spark, data)) == sorted(brute(data), key=str)


def test_sql_on_odd_rows(spark, tmp_path):
    frame(spark, rows(120, ["en", "de", None, ""], 9)).write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "flat").mkdir()
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{tmp_path}/documents.parquet"), f"{tmp_path}/flat/documents.parquet")
    same(mm.op12_merkle_manifest(spark, f"{tmp_path}/flat"), mm.OP12_SQL, f"{tmp_path}/flat")
