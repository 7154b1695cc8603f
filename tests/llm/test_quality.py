import random
import zlib

import numpy as np
import pytest

from gridstats.llm import quality

LABELS = "doc_id bigint, quality int, toxic int, score int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sentence(draw, words):
    return " ".join(draw.choice(words) for _ in range(draw.randint(5, 14))).capitalize() + "."


@pytest.fixture
def labelled(spark, documents, words):
    """Good texts are sentences; bad ones are shouted, cut by bars or one line over and over. A third has labels."""
    draw, plain = random.Random(8), words(500)
    rows, marks = [], {}
    for i in range(1500):
        marks[i] = int(i % 5 != 0)
        text = " ".join(sentence(draw, plain) for _ in range(draw.randint(4, 12)))
        if not marks[i]:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), f"{text[:60]}\n" * 12][i // 5 % 3]
        rows.append((i, text))
    labels = spark.createDataFrame([(i, m, 0, 0) for i, m in marks.items() if i % 3 == 0], LABELS)
    return documents(rows, clashing=True), labels, marks


def test_held_out_texts_are_told_apart(labelled):
    docs, labels, marks = labelled
    scorer = quality.fit(docs, labels)
    assert 0.7 < scorer.prior < 0.9  # four of five texts are good
    rows = quality.scored(docs, scorer).collect()
    assert len(rows) == 1500
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in own) >= 0.97 * len(own)


def test_only_trusted_positives_count(labelled, spark):
    """Held-out labels, bad labels, null and conflicting ones change nothing."""
    docs, labels, marks = labelled
    turned = [(i, 1 - m if held(i) else m, 0, 0) for i, m in marks.items() if i % 3 == 0 and (m or held(i))]
    good = next(i for i, m in marks.items() if m and i % 3 and not held(i))
    other = spark.createDataFrame(turned + [(None, 1, 0, 0), (7, None, 0, 0), (good, 0, 0, 0), (good, 1, 0, 0)], LABELS)
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert a.prior == b.prior and a.intercept == b.intercept and (a.weights == b.weights).all()


def test_rows_of_the_fit_are_bounded(labelled):
    docs, labels, _ = labelled
    counts = {r["good"]: r["count"] for r in quality.training_rows(docs, labels, 50, 80).groupBy("good").count().collect()}
    assert counts == {0: 80, 1: 50}


def test_prior_and_risk():
    """Two clouds of points: the prior is found, and the score is the share of good points at a place."""
    draw = np.random.default_rng(3)
    positive = draw.normal(1.5, 1.0, size=(3000, 1))
    unlabelled = np.concatenate([draw.normal(1.5, 1.0, size=(2400, 1)), draw.normal(-2.5, 1.0, size=(3600, 1))])
    order = draw.permutation(len(unlabelled))
    assert quality.estimated_prior(positive, unlabelled[order]) == pytest.approx(0.4, abs=0.06)
    beta = quality.least_risk(positive, unlabelled[order], 0.4)
    found = 1 / (1 + np.exp(-(beta[0] + beta[1] * unlabelled[:, 0])))
    good = np.arange(6000) < 2400
    assert ((found >= 0.5) == good).mean() > 0.95
    assert found.mean() == pytest.approx(0.4, abs=0.05)


def test_risk_on_bad_texts_stays_above_zero():
    """With a prior that is far too large the estimate would fall without end."""
    draw = np.random.default_rng(4)
    positive, unlabelled = draw.normal(1, 1, size=(200, 5)), draw.normal(0, 1, size=(400, 5))
    beta = quality.least_risk(positive, unlabelled, 0.98)
    gp, gu = (np.concatenate([np.ones((len(x), 1)), x], axis=1) @ beta for x in (positive, unlabelled))
    assert np.logaddexp(0, gu).mean() - 0.98 * np.logaddexp(0, gp).mean() > -0.05


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "a" * 200_000, "\x00\x01", "é😀‮", "!" * 50, "a b " * 50_000])
def test_features_of_odd_texts(text):
    found = quality.features(text, quality.kinds())
    assert found.shape == (quality.WIDTH,) and np.isfinite(found).all() and (found >= 0).all() and (found <= 1).all()


def test_features_count():
    found = quality.features("Ab, cd!! | cd!!\nAb, cd!! | cd!!", quality.kinds())
    assert found[-6:] == pytest.approx([4 / 8, 2 / 8, 3 / 8, 4 / 7, 1 / 2, 1 / 2])


def test_no_labels_and_odd_rows(documents, spark):
    docs = documents([(1, None), (2, ""), (None, "x " * 30_000), (2, "")])
    nothing = spark.createDataFrame([], LABELS)
    scorer = quality.fit(docs, nothing)
    rows = quality.scored(docs, scorer).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["held_out"] is not None for r in rows)
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), nothing)).count() == 0
    one = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 0)], LABELS)
    assert quality.scored(docs, quality.fit(docs, one)).count() == 4
