"""The noisy-or and the non-negative PU risk against plain formulas."""

import math

import numpy as np
import pytest

from arbora.llm import features, pu_quality, toxicity


def test_noisy_or():
    rng = np.random.default_rng(0)
    model = toxicity.Model(weights=rng.normal(0, 0.5, 1 << toxicity.BITS).astype(np.float32), bias=-2.0)
    for text in (b"One two. Three four! five", b"", b"a\nb\nc", b"no end here"):
        sentences, now = [], []
        for token in toxicity.tokens_of(text):
            now.append(token)
            if toxicity.ends_sentence(token):
                sentences.append(now)
                now = []
        sentences += [now] if now or not sentences else []
        clean = 1.0
        for s in sentences:
            z = model.bias
            for token in s:
                columns, _ = toxicity.buckets([token])
                z += float(model.weights[columns].astype(float).sum())
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert toxicity.TokenWeights(model).documents([text])[0] == pytest.approx(1 - clean, rel=1e-5)


def rows_of(texts):
    ids = features.TokenIds()
    made = [features.sparse_row(t, ids) for t in texts]
    n = np.zeros(len(texts))
    return features.Rows(np.concatenate([c for c, _ in made]), np.concatenate([v for _, v in made]), features.starts_of(np.array([len(c) for c, _ in made])), n, n)


def plain_risk(p, u, w, b, prior):
    def loss(rows, sign):
        out = 0.0
        for i in range(len(rows)):
            at = slice(rows.starts[i], rows.starts[i + 1])
            z = float((rows.values[at].astype(float) * w[rows.columns[at]]).sum()) + b
            out += math.log1p(math.exp(-sign * z))
        return out / len(rows)

    return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1))


def test_nnpu_risk_and_gradient():
    p, u = rows_of([b"good text of words", b"fine prose stands here"]), rows_of([b"bad junk ### here", b"good words", b"other things of note"])
    prior = 0.4
    b = math.log(prior / (1 - prior))
    model, risk = pu_quality.fit_nnpu(p, u, prior, steps=1, rate=1e-3, l2=0.0)
    w = np.zeros(features._DENSE)
    assert risk == pytest.approx(plain_risk(p, u, w, b, prior), rel=1e-9)
    # the first step goes against the numeric gradient, column by column
    for column in np.unique(np.concatenate([p.columns, u.columns]))[::5]:
        up, down = w.copy(), w.copy()
        up[column] += 1e-5
        down[column] -= 1e-5
        slope = (plain_risk(p, u, up, b, prior) - plain_risk(p, u, down, b, prior)) / 2e-5
        if abs(slope) > 1e-4:
            assert np.sign(model.w[column]) == -np.sign(slope)
    fitted, later = pu_quality.fit_nnpu(p, u, prior, steps=60)
    assert 0 <= later < risk


def test_components_take_no_step_beyond_stars(spark, monkeypatch):
    """Stars are seen by a count; parts that later links join are linked by their roots alone."""
    from arbora.llm import components, simhash

    steps, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a, **b: steps.append(1) or star(*a, **b))
    pairs = [(1, 5), (1, 6), (2, 7), (3, 3)]
    parts = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in parts.collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2), (3, 3)} and not steps
    links = spark.createDataFrame([(6, 7), (7, 9), (10, 11)], "a long, b long")
    joined = {tuple(r) for r in simhash._joined(parts, links).collect()}
    assert joined == {(1, 1), (5, 1), (6, 1), (2, 1), (7, 1), (9, 1), (3, 3), (10, 10), (11, 10)}
    assert simhash._joined(parts, links.limit(0)) is parts
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(chain).collect()} == {(i, 0) for i in range(5)}
