"""Toxicity: features and steps against plain Python, accuracy on held-out documents, odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wordweave.llm import toxicity as tox

M = 2**64
DOCS = "doc_id long, text string, score string, place string, toxic string, lang string"


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def plain_features(text):
    """The distinct features of a text, without numpy."""
    words = [w.encode() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    base, step, pair, skip = (int(x) for x in (tox._BASE, tox._STEP, tox._PAIR, tox._SKIP))
    h = [mixed((sum(int(tox._TABLE[b]) * pow(base, i, M) for i, b in enumerate(w)) + len(w) * step) % M) for w in words]
    two = [mixed((a * pair + b) % M) for a, b in zip(h, h[1:])]
    gap = [mixed((a * skip + b) % M) for a, b in zip(h, h[2:])]
    return {x >> 32 for x in h + two + gap}


def found(texts, size):
    out = [set() for _ in texts]
    for f, row in tox.features(pa.array(texts), tox.Hasher(size)):
        for x, r in zip(f.tolist(), row.tolist()):
            out[r].add(x)
    return out


@pytest.mark.parametrize("size", [3, 7, 16, 1 << 20])
def test_features_of_whole_texts(size):
    rng = random.Random(4)
    texts = ["", None, "one", "A b, C", "é\U0001f600 ß Straße", "x" * 50, "...", "word " * 9]
    texts += [" ".join(rng.choice(["the", "Cat", "don't", "a", "überaus", "sat-on"]) for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    assert found(texts, size) == [plain_features(t or "") for t in texts]


def test_steps_are_ftrl():
    rng = random.Random(6)
    docs = [(sorted(rng.sample(range(12), rng.randrange(0, 7))), rng.randrange(2)) for _ in range(300)]
    state = tox.begun(13, 60, 40)
    z, n = [0.0] * 12, [0.0] * 12
    bn = 60 * 40 / 100
    bz = -math.log(40 / 60) * (tox.BETA + math.sqrt(bn)) / tox.ALPHA
    for at, y in docs:
        w = {i: 0.0 if abs(z[i]) <= tox.L1 else -(z[i] - math.copysign(tox.L1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2) for i in at}
        b = -bz / ((tox.BETA + math.sqrt(bn)) / tox.ALPHA)
        g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA * w[i]
            n[i] += g * g
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / tox.ALPHA * b
        bn += g * g
        state.learn(np.array(at, np.int64), y)
    assert np.allclose(state.z, [*z, bz]) and np.allclose(state.n, [*n, bn])
    assert (np.abs(state.weights()[:-1]) > 0).sum() < 12  # L1 leaves some at nothing


def corpus(spark, n=400):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        text, bad = [rng.choice(vocab) for _ in range(rng.randrange(20, 60))], i % 5 == 0
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["awful", "Rotten", "vile"]))
        rows.append((i, " ".join(text), "x", "y", "z", "l"))
        if i % 7:
            labels.append((i, int(bad), "x"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, score string")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.score for r in tox.scored(docs, tox.train(docs, labels, 300)).collect()}
    assert all((s >= 0.5) == (i % 5 == 0) for i, s in got.items() if zlib.crc32(str(i).encode()) % 5 == 0)
    model = tox.train(docs, labels, 300)
    assert 0 < len(model.ids) < 200
    plain = {r.doc_id: 1 / (1 + math.exp(-model.bias - sum(float(w) for f, w in zip(model.ids.tolist(), model.weights) if f in plain_features(r.text)))) for r in docs.collect()}
    assert all(abs(plain[i] - s) < 1e-9 for i, s in got.items())  # and the same model at each run


def test_only_rows_that_may_teach_do(spark):
    docs, labels = corpus(spark)
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    scores = lambda lab: {r.doc_id: r.score for r in tox.scored(docs, tox.train(docs, lab)).collect()}
    assert scores(labels) == scores(wrong)
    rows, counts = tox.sampled(docs, labels, 50)
    assert {y: c[1] for y, c in counts.items()} == {0: 25, 1: 25} and rows.count() == 50


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(None, None, "", "", "", ""), (1000, "", "", "", "", ""), (1001, None, "", "", "", ""), (None, "vile awful rotten vile", "", "", "", ""), (3, "w1 w2", "", "", "", ""), (3, "w1 w2", "", "", "", "")], DOCS)
    more = labels.union(spark.createDataFrame([(None, 1, ""), (1000, None, ""), (3, 0, ""), (3, 0, ""), (99999, 1, "")], labels.schema))
    model = tox.train(docs.union(odd), more)
    got = tox.scored(odd, model).collect()
    bias = 1 / (1 + math.exp(-model.bias))
    assert [r.score == pytest.approx(bias) for r in got][:3] == [True] * 3 and got[3].score > 0.5
    assert got[4].score == got[5].score and bias < 0.5
    assert tox.scored(odd.limit(0), model).count() == 0
    none = tox.train(docs, labels.limit(0))
    assert max(r.score for r in tox.scored(docs, none).collect()) < 1e-9
    assert min(r.score for r in tox.scored(docs, tox.train(docs, labels.filter("toxic = 1"))).collect()) > 0.999
    assert tox.train(docs.limit(0), labels).ids.size == 0


def test_query(spark, sf_dir):
    rows = tox.op11_toxicity(spark, sf_dir).collect()
    assert rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
