"""SimHash near-duplicates against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from srcloom.llm import simhash
from srcloom.llm.common import LOWER, UPPER, table
from srcloom.llm.components import components
from srcloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Least id that links reach, by all pairs; rows are (id, fingerprint)."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fps = np.array([f % (1 << 64) for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            parent[root(i)] = root(i + 1 + int(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: least[root(i)] for i, (doc_id, _) in enumerate(rows)}


@given(st.text(alphabet="aAbÉé \t\n\x1c\x85\xa0", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_every_close_pair_has_a_chain():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
        starts = 0
        for start in range(len(simhash.SEGMENTS)):
            spent, holds = 0, True
            for j in range(len(simhash.SEGMENTS)):
                first, bits = simhash.SEGMENTS[(start + j) % len(simhash.SEGMENTS)]
                spent += ((x ^ y) >> first & ((1 << bits) - 1)).bit_count()
                holds &= spent <= (j + 1) * 2 // len(simhash.SEGMENTS)
            starts += holds
        assert starts


@pytest.fixture(scope="module")
def clusters():
    """Chains, stars and a large group of near copies, which fill buckets of all sizes."""
    rng = np.random.default_rng(0)
    fps = []
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 60))):
            fps.append(x)
            for _ in range(1 if rng.random() < 0.7 else 3):
                x ^= 1 << int(rng.integers(0, 64))
    centre = int(rng.integers(0, 1 << 63))
    fps += [centre ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for _ in range(300)]
    ids = rng.permutation(len(fps)).tolist()
    return [(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps)]


def test_components_of_clusters(spark, clusters):
    prints = spark.createDataFrame(clusters, "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.with_components(prints).collect()}
    assert found == plain_components(clusters)


def test_query_against_all_pairs(spark):
    rows = QUERIES["op10_simhash"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    assert all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in rows) and len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])


def test_odd_rows(spark):
    rows = [(1, "", 0), (2, None, 0), (None, " \t", 0), (5, "a b c d e f", 0), (5, "A b c d E f", 1), (5, "other words", 0),
            (None, "lonely words here", 0), (9, "x " * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, ["doc_id"]).collect()]
    expected = [(1, 1), (2, 1), (None, 1), (5, 5), (5, 5), (5, 5), (None, None), (9, 9)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # One row of each group, also where groups share an id or have none.
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 5, 5, 9, None], key=repr)
    repeated = spark.createDataFrame([(1, "a b", 3), (1, "a b", 2), (2, "c d", 1), (2, "c d", 1)], docs.schema)
    assert sorted(tuple(r) for r in simhash.keep_one(repeated).collect()) == [(1, "a b", 2), (2, "c d", 1)]
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0), ["doc_id"]).count() == 0


def test_long_path_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.node, r.label) for r in components(links).collect()} == {(i, 0) for i in range(301)}


def test_three_thousand_that_share_two_segments(spark):
    rng = np.random.default_rng(9)
    fps = [int(f) << 26 | 12345 for f in rng.integers(0, 1 << 37, 1500)]
    for f in fps[:1500]:
        for _ in range(int(rng.integers(0, 4))):
            f ^= 1 << int(rng.integers(26, 64))
        fps.append(f)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    distinct = prints.select("fp").distinct()
    assert simhash.buckets(distinct).count() == 10 * distinct.count()
    found = {r.doc_id: r.component_id for r in simhash.with_components(prints).collect()}
    assert found == plain_components(rows)
