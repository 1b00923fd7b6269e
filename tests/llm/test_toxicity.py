"""Toxicity: gradients, window scores and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import toxicity as t


def made_docs(n, seed):
    """Texts of random syllables; toxic ones hold some words of a short list, or words that begin in a certain way."""
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "in", "re", "st", "ou", "ly", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    bad = [lambda: rng.choice(["vile", "nasty", "rotten"]), lambda: "zqu" + word()]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.2
        words = [word() for _ in range(rng.randrange(5, 300))]
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(bad)()
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    return t.fit(made_docs(600, 1))


def test_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in t.fresh(rng).items()}
    x, real, y = rng.standard_normal((5, t.INPUTS, 3)), np.ones((5, 3)), np.array([0.0, 1.0, 1.0])
    real[3:, 1] = 0

    def loss():
        logit = t.forward({k: v.astype(np.float32) for k, v in net.items()}, x.astype(np.float32), real.astype(np.float32)).astype(np.float64)
        return np.mean(np.log1p(np.exp(-logit * (2 * y - 1))))

    g = t.gradients({k: v.astype(np.float32) for k, v in net.items()}, x.astype(np.float32), real.astype(np.float32), y.astype(np.float32))
    for name, w in net.items():
        for spot in {0, w.size // 2, w.size - 1}:
            old, eps = w.flat[spot], 1e-2
            w.flat[spot] = old + eps
            up = loss()
            w.flat[spot] = old - eps
            down = loss()
            w.flat[spot] = old
            assert abs((up - down) / (2 * eps) - g[name].flat[spot]) < 2e-3, name


def test_every_window_is_scored(model, monkeypatch):
    texts = [x.encode() for x, _ in made_docs(30, 2)] + [b"", b"one", b" \n", ("zqu " * 900).encode(), " ".join(["anth"] * 33).encode()]

    def plain(text):
        x, _ = t.inputs(model["table"], [text])
        probs = [t.sigmoid(t.forward(model["net"], np.ascontiguousarray(x[:, f : f + t.WINDOW].astype(np.float32).T[:, :, None]), np.ones((min(t.WINDOW, x.shape[1] - f), 1), np.float32)))[0] for f in t.window_starts(x.shape[1])] if x.shape[1] else [model["base"]]
        return max(probs)

    want = [plain(x) for x in texts]
    assert np.allclose(t.score_texts(model, texts), want, atol=1e-5)
    assert np.allclose(np.concatenate([t.score_texts(model, [x]) for x in texts]), want, atol=1e-5)
    monkeypatch.setattr(t, "PIECE", 100)  # the way of very long texts
    assert np.allclose(t.score_texts(model, texts), want, atol=1e-5)


def test_unseen_documents(model):
    new = made_docs(400, 3)
    score = t.score_texts(model, [x.encode() for x, _ in new])
    y = np.array([label for _, label in new])
    assert ((score >= 0.5) == y).mean() > 0.97


def test_degenerate_training():
    for rows in ([], [("a", 1)], [("", 0), (None, 0)], [("", 0), (None, 1)]):
        model = t.fit(rows)
        assert (t.score_texts(model, [b"a b", b""]) == model["base"]).all()


def test_query_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(60)] + [(70, None), (None, 1)], "doc_id long, toxic int")
    model = t.train(odd, labels, max_rows=30)
    got = t.toxicity(odd.withColumnRenamed("n_chars", "score"), model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    assert t.toxicity(nothing, t.train(nothing, labels)).collect() == []
    assert len({r.score for r in t.toxicity(odd, t.train(odd, labels.limit(0))).collect()}) == 1
