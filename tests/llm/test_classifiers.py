"""Quality and toxicity classifiers on held-out labels, and the parts they are made of."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mediaflow.llm import quality_classifier as pu
from mediaflow.llm import toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    s = np.asarray(score)[order]
    first, last = np.searchsorted(s, s, "left"), np.searchsorted(s, s, "right")
    ranks[order] = (first + last + 1) / 2
    y = np.asarray(label) == 1
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def held_out(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    y = rows[label].to_numpy()
    return auc(rows["score"].to_numpy(), y), (rows["predicted"].to_numpy() == y).mean(), y, rows["predicted"].to_numpy()


def test_quality_on_held_out(spark):
    area, right, y, predicted = held_out(spark, pu.op5_quality_pu, "quality")
    print("quality", area, right, "good kept", predicted[y == 1].mean(), "bad kept", predicted[y == 0].mean())
    assert area > 0.95 and right > 0.93 and predicted[y == 1].mean() > 0.97


def test_toxicity_on_held_out(spark):
    area, right, y, predicted = held_out(spark, toxicity.op9_toxicity, "toxic")
    print("toxic", area, right, "found", predicted[y == 1].mean(), "false", predicted[y == 0].mean())
    assert area > 0.9 and right > 0.95


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, 5000)
    u = np.concatenate([rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)])
    assert abs(pu.estimate_prior(p, u) - 0.6) < 0.06


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_edit_neighbourhood():
    rng = random.Random(2)
    terms = ["stupid", "scum", "réêou", "idiot", "trash", "abcab", "abcba"]
    lexicon = toxicity.FuzzyLexicon(terms)
    words = {"", *terms}
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é", "z", "t"])
        words.add("".join(w))
    words = sorted(words)
    term, edits = lexicon.match(pa.array(words))
    for w, t, e in zip(words, term, edits):
        best = min(((distance(w, x), i) for i, x in enumerate(terms) if len(x) >= 5 or w == x), default=(9, -1))
        assert (t >= 0) == (best[0] <= 1), w
        if t >= 0:
            assert e == best[0] == distance(w, terms[t])


def test_quotation_and_misspelling():
    scorer = toxicity.Scorer({"stupid": 4.0}, {"stupids": 0.0})
    texts = pa.array(["you are stupid, really", 'he said "what a stupid idea" yesterday', "such a stupld thing", "stupids", None, ""])
    hits = {(t, w): (m, q) for t, w, _, m, q in scorer.hits(texts)}
    assert hits == {(0, "stupid"): (False, False), (1, "stupid"): (False, True), (2, "stupld"): (True, False)}


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "a " * 40000, "x")]])
def test_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score2 string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert pu.score(docs, pu.train(docs, labels)).count() == len(rows)
    assert toxicity.score(docs, toxicity.train(docs.join(labels, "doc_id")), spans=True).count() == len(rows)


def plain_risk(w, xp, xu, prior, ridge=1e-3):
    """The unbiased risk of the logistic loss, sample by sample, and its negative part (what unlabelled rows show of negatives)."""
    import math

    loss = lambda x, sign: math.log1p(math.exp(-sign * sum(a * b for a, b in zip(x, w, strict=True))))
    mean = lambda rows, sign: sum(loss(x, sign) for x in rows) / len(rows)
    negative = mean(xu, -1) - prior * mean(xp, -1)
    return prior * mean(xp, 1) + negative + ridge / 2 * sum(v * v for v in w), negative


def test_weights_minimise_the_risk():
    """Against the risk written out: no slope is left at the fitted weights, no neighbour is better, and the negative part isn't below zero."""
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.6):
        one = np.ones((1, 1))
        positive = lambda n: np.concatenate([rng.normal([1, 0.5], 1, (n, 2)), one.repeat(n, 0)], 1)
        xp, xn = positive(150), np.concatenate([rng.normal([-1, -0.5], 1, (200, 2)), one.repeat(200, 0)], 1)
        xu = np.concatenate([positive(int(200 * prior / (1 - prior))), xn])
        prior = 0.7 * prior  # well below the share, so that the negative part stays above zero
        w = pu.fit_nnpu(xp, xu, prior, steps=1500)
        risk, negative = plain_risk(w, xp.tolist(), xu.tolist(), prior)
        assert negative >= 0
        for k in range(3):
            step = np.eye(3)[k] * 1e-4
            slope = (plain_risk(w + step, xp.tolist(), xu.tolist(), prior)[0] - plain_risk(w - step, xp.tolist(), xu.tolist(), prior)[0]) / 2e-4
            assert abs(slope) < 0.03  # the steps of the descent stay of one size
        for _ in range(20):
            assert plain_risk(w + rng.normal(0, 0.2, 3), xp.tolist(), xu.tolist(), prior)[0] >= risk - 1e-3
    # few rows told apart by many features: the unbiased risk alone would fall without bound, the non-negative one doesn't
    xp, xu = rng.normal(0, 1, (6, 40)), rng.normal(0, 1, (8, 40))
    w = pu.fit_nnpu(xp, xu, 0.7, steps=400)
    assert np.isfinite(w).all() and plain_risk(w, xp.tolist(), xu.tolist(), 0.7)[1] > -0.5
