"""Spelling variants against plain Python: words, grams that stay under every edit, all pairs, forms and roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from srcloom.llm import variants
from srcloom.llm.common import LOWER, UPPER, table
from srcloom.llm.queries import QUERIES


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Near words by deletions: words that agree after one or no deletion, and then by comparing letters."""
    by = defaultdict(set)
    for w in words:
        for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[form].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    return near


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    near = plain_near(words)
    forms = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                forms[w] = best
    found = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        found.add((w, form, root, n, len(near[w]), words.get(form)))
    return found


LETTERS = st.sampled_from("abcç")
WORD = st.one_of(st.text(LETTERS, min_size=7, max_size=14), st.text(LETTERS, min_size=25, max_size=40))


@settings(max_examples=400, deadline=None)
@given(WORD, st.integers(0, 40), LETTERS, st.booleans(), st.sets(st.text(LETTERS, min_size=3, max_size=5), max_size=60))
def test_an_edited_word_is_in_a_list_looked_into(word, place, letter, inserted, frequent):
    place %= len(word) + inserted
    edited = word[:place] + letter + word[place + (not inserted) :]
    if edited == word:
        return
    frequent = frozenset(frequent)
    lists = {key for key, same in variants.lists_for(word, frequent, np.zeros(16, np.int64)) if same != inserted}
    assert lists & set(variants.lists_of(edited, frequent))
    # The bound: grams that it names stay.
    most = variants.longest(len(word))
    grams, looked = variants.decompose(word, most, frequent)
    others, _ = variants.decompose(edited, most, frequent)
    stay = variants.unaffected(len(word), looked, place, inserted)
    assert stay
    elsewhere = dict(zip(variants.indexed(len(edited)), others))
    for i in stay:
        p = variants.indexed(len(word))[i]
        at = p + (inserted and p >= place)
        assert elsewhere.get(at, grams[i]) == grams[i]
    assert bin((variants.signature(word) ^ variants.signature(edited)) & (1 << 64) - 1).count("1") <= variants.PAIRS


@settings(max_examples=200, deadline=None)
@given(WORD, st.lists(st.integers(0, 50), min_size=24, max_size=24), st.lists(st.integers(0, 50), min_size=24, max_size=24), st.booleans())
def test_cover_takes_the_least_for_each_edit(word, front, behind, inserted):
    frequent = frozenset(["aaa", "aba", "aaaa", "bbb", "abab"])
    grams, looked = variants.decompose(word, variants.longest(len(word)), frequent)
    found = variants.cover(looked, len(word), front, behind, inserted)
    for place in range(len(word) + inserted):
        stay = variants.unaffected(len(word), looked, place, inserted)
        places = variants.indexed(len(word))
        moves = {i: places[i] >= place + (not inserted) for i in stay}
        cost = {i: behind[i] if moves[i] else front[i] for i in stay}
        assert min(cost.values()) in [cost[i] for i, m in found if i in cost and moves[i] == m]


def test_grams_give_way_only_where_frequent(spark):
    rows = [(f"interna{a}{b}{c}", 2) for a in "abcd" for b in "efgh" for c in "jklm"]
    vocabulary = spark.createDataFrame(rows, "word string, n long")
    variants_share = variants.SHARE
    try:
        variants.SHARE = 8
        frequent = variants.frequent_grams(vocabulary)
    finally:
        variants.SHARE = variants_share
    assert {"int", "inte", "inter", "erna"} <= frequent and "aej" not in frequent
    assert variants.decompose("internaaej", 6, frequent)[0][0] == "intern"


ROWS = [
    (1, "spelling Spelling SPELLING spelling spelling spelling spelling spelling spelling spelling " * 3),
    (2, "speling speling spellinga spellinga spellings spellings"),
    (3, "spelingo spelingo short short Élections Élections élections"),
    (3, "spelingo spelingo short short Élections Élections élections"),
    (None, "spelling spelling speling"),
    (4, None),
    (5, ""),
    (6, "x" * 40_000 + " " + "x" * 40_000 + " " + "x" * 39_999 + "y " + "x" * 39_999 + "y"),
]


def test_variants_of_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS word", "3 AS n")
    found = variants.spelling_variants(docs.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n")
    assert set(map(tuple, found.collect())) == plain(ROWS)


def test_chains_of_forms(spark):
    rows = [(f"word{i}", f"word{i + 1}") for i in range(18)] + [(f"leaf{i}", "word0") for i in range(50)]
    found = variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert len(found) == len(rows) and {r["root"] for r in found} == {"word18"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(docs).collect() == []


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    found = QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01").collect()
    wanted = plain(rows)
    assert len(wanted) > 5000 and len(found) == len(wanted) and set(map(tuple, found)) == wanted
