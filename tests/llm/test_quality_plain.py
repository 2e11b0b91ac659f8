"""The quality classifier against plain loops: features, the network, the risk that training lowers, the query's rows."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcloom.llm import quality
from srcloom.llm.common import LOWER, UPPER, table
from srcloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYMBOLS = [*range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 10]


def plain_features(text):
    data = text.encode()
    some = max(len(data), 1)
    counts = [0] * 129
    for byte in data:
        counts[min(byte, 128)] += 1
    groups = [range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), [128], range(0x20)]
    same = sum(a == b and b < 0x80 for a, b in zip(data, data[1:]))
    words = WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))
    many = max(len(words), 1)
    echo = sum(a == b for a, b in zip(words, words[1:]))
    return [
        *[math.sqrt(counts[s] / some) for s in SYMBOLS],
        *[math.sqrt(sum(counts[b] for b in g) / some) for g in groups],
        math.sqrt(same / some),
        math.sqrt(echo / many),
        len(set(words)) / many**0.8,
        math.log1p(len(data) / many),
        math.log1p(len(words)) / 5,
        math.log1p(counts[10] / many),
    ]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAb  \n..!é9\x00\U0001f600", max_size=40), max_size=5))
def test_features(texts):
    found = quality.features(pa.array(texts, pa.string()))
    assert found.shape[0] == len(texts)
    for row, text in zip(found, texts):
        assert row.tolist() == pytest.approx(plain_features(text), abs=1e-12)


def plain_output(model, x):
    z = [min(max((v - m) / s, -6), 6) for v, m, s in zip(x, model.mean, model.scale)]
    hidden = [math.tanh(sum(a * w for a, w in zip(z, column)) + b) for column, b in zip(model.inner.T, model.inner_bias)]
    return sum(h * w for h, w in zip(hidden, model.outer))


def plain_risk(outputs_p, outputs_u, prior):
    """Non-negative unbiased risk with the sigmoid loss, from the definition."""

    def loss(g):
        return 1 / (1 + math.exp(g))

    positive = sum(map(loss, outputs_p)) / len(outputs_p)
    negative = sum(loss(-g) for g in outputs_u) / len(outputs_u) - prior * sum(loss(-g) for g in outputs_p) / len(outputs_p)
    return prior * positive + max(0.0, negative)


def test_training_lowers_the_risk_and_its_end_is_flat():
    rng = np.random.default_rng(5)
    positive = rng.normal(1.0, 1, (300, 6))
    unlabelled = np.concatenate([rng.normal(1.0, 1, (300, 6)), rng.normal(-1.0, 1, (300, 6))])
    prior = 0.5
    model = quality.fit(positive, unlabelled, prior)

    def risk(outer_bias=0.0, scale=1.0):
        p = [scale * plain_output(model, x) + outer_bias for x in positive[:150]]
        u = [scale * plain_output(model, x) + outer_bias for x in unlabelled[::4]]
        return plain_risk(p, u, prior)

    # No separation at all has the risk of a coin; the trained network is far below.
    assert risk(scale=0.0) == pytest.approx(0.5) and min(risk(b) for b in np.linspace(-8, 8, 33)) < 0.2
    # The direction of the weights is what lowers it: turned round, it is worse than the coin.
    assert min(risk(b, -1.0) for b in (-2.0, 0.0, 2.0)) > 0.5
    score = quality.outputs(model, unlabelled)
    assert (score[:300] > np.median(score)).mean() > 0.9 and (score[300:] < np.median(score)).mean() > 0.9


def test_query_against_plain_network(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = QUERIES["op9_quality"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        value = plain_output(model, plain_features(texts[r.doc_id])) - model.shift + math.log(0.3 / 0.7)
        score = 1 / (1 + math.exp(-value))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(score - 0.3) < 1e-9 or r.predicted == (score >= 0.3)
