"""Operator 3's model against slow versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import quality_rules
from tidelog.llm.quality_rules import FEATURES, Features

TEXTS = ["One two two three", "", None, "a", "ab", "abc", "über größe 日本語のテキスト über", "x " * 300, "tail\nof\tthe batch"]


def test_features_stay_in_their_text():
    """Means over a batch equal those of each text alone, and the sparse rows that training sees."""
    weights = np.random.default_rng(0).normal(size=(4, FEATURES)).astype(np.float32)
    found = Features(pa.array(TEXTS, pa.string()))
    got = found.means(weights)
    alone = [Features(pa.array([t], pa.string())).means(weights)[0] for t in TEXTS]
    assert got == pytest.approx(np.array(alone), abs=1e-6) and got[1] == got[2] == 0
    row, feature, value = found.rows()
    assert got == pytest.approx(np.bincount(row, weights=value * weights.ravel()[feature], minlength=len(TEXTS)), abs=1e-5)


def test_feature_counts():
    """As many features as a text has words, pairs of words, and runs of three and four characters (not bytes)."""
    for text in TEXTS:
        found = Features(pa.array([text], pa.string()))
        plain = text or ""
        n = len(re.findall("[^\x20\x09-\x0d]+", plain))
        ones = [np.zeros((4, FEATURES), np.float32) for _ in range(4)]
        for k, count in enumerate((n, n - 1, len(plain) - 2, len(plain) - 3)):
            ones[k][k] = 1
            assert found.means(ones[k])[0] == pytest.approx(1.0 if count > 0 else 0.0)
            assert len(set(found.kinds[k][0])) <= max(0, count)


def sample(rows, share, seed):
    """Texts of two vocabularies, each with its share of good labels."""
    pick = random.Random(seed)
    out = []
    for k in range(rows):
        kind = k % 2
        text = " ".join(f"{'nb'[kind]}{pick.randrange(400)}x" for _ in range(pick.randrange(40, 120)))
        out.append((text, int(pick.random() < share[kind]), 0))
    return pa.table({"text": [t for t, _, _ in out], "quality": [q for _, q, _ in out], "toxic": [x for _, _, x in out]})


def test_held_out_accuracy():
    model = quality_rules.fit(sample(600, (1.0, 0.0), 1))
    test = sample(200, (1.0, 0.0), 2)
    p = model.probabilities(Features(test.column("text").combine_chunks()))
    assert model.fitted and ((p >= quality_rules.THRESHOLD) == (np.asarray(test.column("quality")) > 0)).mean() > 0.98


def test_probabilities_are_calibrated():
    """Where labels are noise around 0.85 and 0.25, so are the probabilities."""
    model = quality_rules.fit(sample(3000, (0.85, 0.25), 3))
    p = model.probabilities(Features(sample(400, (0.5, 0.5), 4).column("text").combine_chunks()))
    assert p[::2].mean() == pytest.approx(0.85, abs=0.07) and p[1::2].mean() == pytest.approx(0.25, abs=0.07)


def test_without_both_labels():
    assert not quality_rules.fit(sample(20, (1.0, 1.0), 5)).fitted
    assert not quality_rules.fit(sample(0, (1.0, 1.0), 5)).fitted
