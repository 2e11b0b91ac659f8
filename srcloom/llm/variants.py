"""Spelling variants: words one insertion, deletion or replacement apart, by an index of variable-length grams.

The gram dictionary is pruned by frequency. Grams have ``LEAST`` letters or more; a gram that stands in at least one of
``SHARE`` places of the vocabulary is too frequent to be useful and gives way to its extensions by a letter, up to
``MOST`` letters. So the dictionary is the set of frequent grams, at most ``SHARE`` of each length whatever the
vocabulary, and a word has at each place the shortest gram that is not among them.

A gram's choice looks at certain letters only. An edit at a place affects the grams that look at it; all others stand in the
edited word as well, those behind it moved by one where the length changes. That is the affected-gram bound of the word,
place by place. Grams of a word of L letters are at most L - ``LEAST`` long, so at every place some gram is not affected.
For each place the word therefore needs to look into one list only, that of its rarest unaffected gram; two or three lists serve
all places. Lists are those of equal gram, position and length, and their sizes are known roughly from a table of fixed
size (``SKETCH``). Every word looks for words of its own length and of one letter more, so each pair is met from at least
one side. What a list offers passes a signature of letter pairs and then the exact distance, both within the join;
only near pairs become rows.

Hash values decide nothing: words that meet by a collision fail the distance. Lists of any size are split by the
adaptive join; a word's near words are at most some 180 for each of its letters, by the alphabet.

Defined cases: a null text has no runs; a null id counts as the empty text in the checksum; rows of equal id and text
count each; words of any length are compared whole; an empty table gives an empty result; of near words of
equal n the first in code-point order is the form; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from srcloom.llm.common import LOWER, UPPER, arrow_ready, quoted, slices
from srcloom.operators.skew import join_unique
from srcloom.session import written

LETTERS = "[A-Za-zÀ-ÿ]"
# A checksum divisible by this deletes a letter.
DELETE = 31
SHORTEST = 7
LEAST_N = 2
FACTOR = 10

LEAST = 3
MOST = 6
SHARE = 4000
# Places at either end of a word whose grams are indexed: all of a word of up to 26 letters. An edit in one half
# of a longer one leaves the grams at the other end.
EDGE = 12
SKETCH = 1 << 20
# Bytes of words that are repeated by list at once.
SLICE = 1 << 18
# Letter pairs that one edit takes off and adds at most.
PAIRS = 4


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters, some with a letter deleted, of ``SHORTEST`` letters and ``LEAST_N``
    occurrences or more."""
    runs = docs.select(
        F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("id"),
        # Shorter runs cannot become words; a match is a maximal run.
        F.explode(F.regexp_extract_all(quoted(text).cast("string"), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    summed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    kept = summed.select(F.when(F.col("h") % DELETE == 0, without).otherwise(F.col("run")).alias("word"))
    counts = kept.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_N)


def frequent_grams(vocabulary: DataFrame) -> frozenset[str]:
    """Grams of LEAST to MOST - 1 letters in at least one of ``SHARE`` places: at most ``SHARE`` of each length."""
    length = F.length("word")

    def grams(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), length - q + 1), lambda p: F.substring(F.col("word"), p, F.lit(q)))

    every = F.flatten(F.array(*[grams(q) for q in range(LEAST, MOST)]))
    places = vocabulary.agg(F.sum(length - LEAST + 1)).first()[0] or 0
    counts = vocabulary.select(F.explode(every).alias("gram")).groupBy("gram").count()
    return frozenset(r["gram"] for r in counts.where(F.col("count") * SHARE >= places).collect())


def longest(length: int) -> int:
    """Letters of a gram at most, in lists that words of this length look into."""
    return max(LEAST, min(MOST, length - LEAST))


def indexed(n: int) -> list[int]:
    """Places of the grams of a word of n letters."""
    count = n - LEAST + 1
    return [*range(min(EDGE, count)), *range(max(EDGE, count - EDGE), count)]


def decompose(word: str, most: int, frequent: frozenset[str]) -> tuple[list[str], list[int]]:
    """The gram at each indexed place, and behind which letter its choice stops looking; the end of the word counts as
    one."""
    grams, looked = [], []
    n = len(word)
    for p in indexed(n):
        stop = p + LEAST
        while stop - p < most and word[p:stop] in frequent and stop < n:
            stop += 1
        gram = word[p:stop]
        grams.append(gram)
        looked.append(n + 1 if stop == n and stop - p < most and gram in frequent else stop)
    return grams, looked


def unaffected(n: int, looked: list[int], place: int, inserted: bool) -> list[int]:
    """Which grams stay if the letter at ``place`` is replaced, or one is inserted before it."""
    behind = place if inserted else place + 1
    return [i for i, p in enumerate(indexed(n)) if p >= behind or looked[i] <= place]


def cover(looked: list[int], n: int, costs: list[int], moved: list[int], inserted: bool) -> set[tuple[int, bool]]:
    """(gram, whether it moves) of grams of which every edit leaves one: for each edit the least cost. ``costs`` are
    those of grams in front of the edit, ``moved`` of grams behind it."""
    places = indexed(n)
    # Best of the grams from a place on.
    after: list[int] = [-1] * (n + 2)
    best, p = -1, n
    for i in range(len(places) - 1, -1, -1):
        after[places[i] + 1 : p + 1] = [best] * (p - places[i])
        best, p = i if best < 0 or moved[i] < moved[best] else best, places[i]
    after[: p + 1] = [best] * (p + 1)
    # Best of the grams that look at nothing from a place on.
    upto: list[int] = [-1] * (n + 2)
    for i, at in enumerate(looked):
        if upto[at] < 0 or costs[i] < costs[upto[at]]:
            upto[at] = i
    found, best = set(), -1
    for place in range(n + 1 if inserted else n):
        if upto[place] >= 0 and (best < 0 or costs[upto[place]] < costs[best]):
            best = upto[place]
        behind = after[place if inserted else place + 1]
        if best < 0 or (behind >= 0 and moved[behind] < costs[best]):
            found.add((behind, True))
        else:
            found.add((best, False))
    return found


def list_key(gram: str, place: int, length: int, most: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{gram}|{place}|{length}|{most}".encode()) - (1 << 63)


def signature(word: str) -> int:
    """Bits of the word's letter pairs."""
    found = 0
    for a, b in zip(word, word[1:]):
        found |= 1 << (31 * ord(a) + ord(b)) % 64
    return found - (1 << 64) if found >> 63 else found


def lists_of(word: str, frequent: frozenset[str]) -> list[int]:
    """Lists that hold the word: for words as long, and for words one letter shorter."""
    n = len(word)
    found = []
    for most in {longest(n), longest(n - 1)}:
        grams, _ = decompose(word, most, frequent)
        found += [list_key(g, p, n, most) for p, g in zip(indexed(n), grams)]
    return found


def lists_for(word: str, frequent: frozenset[str], sizes: np.ndarray) -> list[tuple[int, bool]]:
    """Lists to look into, and whether they hold words as long as this one."""
    n = len(word)
    most = longest(n)
    grams, looked = decompose(word, most, frequent)
    mask = len(sizes) - 1
    places = indexed(n)
    same = [list_key(g, p, n, most) for p, g in zip(places, grams)]
    front = [list_key(g, p, n + 1, most) for p, g in zip(places, grams)]
    behind = [list_key(g, p + 1, n + 1, most) for p, g in zip(places, grams)]
    cost_same, cost_front, cost_behind = ([int(sizes[k & mask]) for k in keys] for keys in (same, front, behind))
    found = {(same[i], True) for i, _ in cover(looked, n, cost_same, cost_same, False)}
    found |= {(behind[i] if moves else front[i], False) for i, moves in cover(looked, n, cost_front, cost_behind, True)}
    return sorted(found)


WORD = [StructField("word", StringType()), StructField("n", LongType()), StructField("sig", LongType())]


def _rows(vocabulary: DataFrame, lists, extra: list[StructField]) -> DataFrame:
    """A row (key, word, n, sig, ...) for each list that a function of the word names."""
    schema = StructType([StructField("key", LongType()), *extra, *WORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            own = batch.column(0).to_pylist()
            named = [lists(w) for w in own]
            repeated = np.repeat(np.arange(len(own)), [len(x) for x in named])
            flat = [x for many in named for x in many]
            first = [[x[0] for x in flat], [x[1] for x in flat]] if extra else [flat]
            columns = [pa.array(v, t) for v, t in zip(first, (pa.int64(), pa.bool_()))]
            signs = pa.array([signature(w) for w in own], pa.int64())
            columns += [c.take(pa.array(repeated)) for c in (batch.column(0), batch.column(1), signs)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vocabulary.select("word", "n").mapInArrow(run, schema)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, other, other_n): all near words of each word of a table (word, n) of distinct words, both ways round."""
    spark = arrow_ready(vocabulary.sparkSession)
    context = spark.sparkContext
    frequent = context.broadcast(frequent_grams(vocabulary))
    index = _rows(vocabulary, lambda w: lists_of(w, frequent.value), [])
    sizes = np.zeros(SKETCH, np.int64)
    counted = index.groupBy(F.col("key").bitwiseAND(F.lit(SKETCH - 1)).alias("place")).count().toArrow()
    sizes[counted.column("place").to_numpy()] = counted.column("count").to_numpy()
    shared = context.broadcast(sizes)
    probes = _rows(
        vocabulary, lambda w: lists_for(w, frequent.value, shared.value), [StructField("same", BooleanType())]
    )
    a, b = probes.alias("a"), index.alias("b")
    near = (
        (F.col("a.key") == F.col("b.key"))
        & (F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= PAIRS)
        & (~F.col("a.same") | (F.col("a.word") < F.col("b.word")))
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    met = a.join(b, near).select(
        F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("other_n")
    )
    pairs = written(met.distinct(), "near-words")
    return pairs.select("word", "other", "other_n").unionAll(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last word that following the forms reaches. A form occurs ``FACTOR`` times as
    often as its word, so chains end, and each round doubles what is followed."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(join_unique(found, further, "root"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return found
        found = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the documents."""
    vocabulary = written(words(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = (
        near_words(vocabulary)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    )
    often = F.col("form_n") >= FACTOR * F.col("n")
    judged = written(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("form")).alias("form"),
            F.when(often, F.col("form_n")).alias("form_n"),
        ),
        "judged-words",
    )
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
