"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of whole documents within a task, ``SHARD_BYTES`` of text or one longer document. Its words
are numbered by the vocabulary of the benchmark; a word that no item has is 0, as is the end of a document,
so no match crosses either. The shard's suffix array holds all suffixes that start with an item's word, sorted
by prefix doubling as far as any item reaches. Every suffix of every item is then binary-searched, giving
its longest verbatim match in the shard and, at the window length, the interval of all its occurrences.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. A document word inside any
occurrence is hit. A document is contaminated if the hit words make at least 1/``SHARE`` of its words.

Benchmarks of any size work: each ``BLOCK_BYTES`` of items (or one longer item) are a block, and blocks pass over the
documents one after the other; the driver and the tasks hold one at a time.

Defined cases: null or wordless texts have no words and no hits, and stay; null or wordless items have no
windows; rows of equal ids are judged each by itself; items of equal text all count; items with equal ids are one
id in ``items``. Items with a null id hit words but are not counted among the ids. Texts and items of any length are
read whole; an empty table or an empty benchmark gives no hits; a kept column with the name of an added one is
replaced, and no other name clashes. Documents must read the same way twice, as files do, where a benchmark has
several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pyspark.sql.pandas.types import to_arrow_type

from srcloom.llm.common import arrow_ready, carried, quoted, returned, slices, text_words, without
from srcloom.session import written

WINDOW = 13
SHARE = 20
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

PLACE = StructType([StructField("item_word", LongType()), StructField("doc_word", LongType())])
MATCH = StructType(
    [
        StructField("item_id", StringType()),
        StructField("n_words", LongType()),
        StructField("places", ArrayType(PLACE)),
    ]
)
SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
FOUND = [
    StructField("_n_words", LongType()),
    StructField("_spans", ArrayType(SPAN)),
    StructField("_items", ArrayType(StringType())),
    StructField("_matches", ArrayType(MATCH)),
]
# Pairs of a place in the shard and one in an item that are compared at once.
PAIRS = 1 << 20


@dataclass
class Block:
    """Items as numbers of their words. item[i] is the item of word i; left[i], how many words it has from i on."""

    vocabulary: pa.Array
    ids: list[str | None]
    words: np.ndarray
    item: np.ndarray
    place: np.ndarray
    left: np.ndarray
    queries: np.ndarray
    depth: np.ndarray


def block(ids: list[str | None], texts: list[str]) -> Block:
    words, firsts = text_words(pa.array(texts, pa.string()))
    sizes = np.diff(firsts)
    coded = words.dictionary_encode()
    item = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(words)) - np.repeat(firsts[:-1], sizes)
    left = np.repeat(sizes, sizes) - place
    # Suffixes at least a window long, or whole shorter items.
    depth = np.minimum(np.repeat(sizes, sizes), WINDOW)
    queries = np.flatnonzero(left >= depth)
    return Block(coded.dictionary, ids, coded.indices.to_numpy().astype(np.int64) + 1, item, place, left, queries, depth)


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; one block at a time is in the driver."""
    rows = benchmark.select(quoted("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    ids, texts, size = [], [], 0
    for row in rows.select("*", F.octet_length("text")).toLocalIterator():
        if ids and size + row[2] > BLOCK_BYTES:
            yield block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += row[2]
    if ids:
        yield block(ids, texts)


def suffix_array(text: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text of numbers up to ``most`` that do not start with 0, sorted by their first ``depth``
    numbers or more, a suffix ending at the first 0. Also their ranks; equal ranks are equal that far."""
    bits = max(1, int(most).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(len(text), np.int64)
    alive = text != 0
    for j in range(width):
        following = np.zeros(len(text), np.int64)
        if j < len(text):
            following[: len(text) - j] = text[j:]
        following[~alive] = 0
        alive &= following != 0
        key = (key << bits) | following
    suffixes = np.flatnonzero(text)
    suffixes = suffixes[np.argsort(key[suffixes], kind="stable")]
    if not len(suffixes):
        return suffixes, np.empty(0, np.int64)
    ordered = key[suffixes]
    rank = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    # A suffix that ended within the key cannot be told further from its equals.
    full = (key & ((1 << bits) - 1)) != 0
    reach = width
    while reach < depth:
        head = np.empty(len(suffixes), bool)
        head[0] = True
        head[1:] = rank[1:] != rank[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        tied = ~head & full[suffixes]
        tied[:-1] |= ~head[1:] & full[suffixes[:-1]]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        # Ranks by position, 0 where no suffix starts; group starts as ranks, so that they stay comparable.
        of = np.zeros(len(text) + reach, np.int64)
        of[suffixes] = first + 1
        nexts = of[suffixes[at] + reach]
        order = np.lexsort((nexts, first[at]))
        suffixes[at] = suffixes[at[order]]
        groups, nexts = first[at[order]], nexts[order]
        split = np.concatenate([[True], (groups[1:] != groups[:-1]) | (nexts[1:] != nexts[:-1])])
        head[at] = split | head[at]
        rank = np.cumsum(head) - 1
        further = np.zeros(len(text) + reach, bool)
        further[: len(text)] = full
        full = full & further[np.arange(len(text)) + reach]
        reach *= 2
    return suffixes, rank


def _compare(text: np.ndarray, suffixes: np.ndarray, own: Block, queries: np.ndarray, depth: np.ndarray) -> tuple:
    """Length of the common prefix of each suffix and query, up to ``depth``, and whether the suffix is less."""
    n = len(queries)
    common, less, open_ = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    j = 0
    while len(open_):
        open_ = open_[depth[open_] > j]
        at = suffixes[open_] + j
        mine = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], 0)
        theirs = own.words[queries[open_] + j]
        less[open_] = mine < theirs
        open_ = open_[mine == theirs]
        less[open_] = False
        common[open_] += 1
        j += 1
    return common, less


def search(text: np.ndarray, suffixes: np.ndarray, own: Block, queries: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """First place in the suffix array not less than each query, or, ``after``, greater than it up to its depth."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(suffixes), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        common, less = _compare(text, suffixes[mid], own, queries[open_], depth[open_])
        right = less | (after & (common == depth[open_]))
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def scan_shard(texts: pa.StringArray, own: Block) -> list[tuple]:
    """For each text: number of words, spans of hit words, items with occurring windows, longest match of each."""
    words, firsts = text_words(texts)
    n = len(texts)
    counts = np.diff(firsts)
    code = pc.index_in(words, own.vocabulary)
    code = pc.fill_null(code, -1).to_numpy().astype(np.int64) + 1
    # A 0 behind each document.
    starts = firsts[:-1] + np.arange(n)
    shard = np.zeros(len(code) + n, np.int64)
    shard[np.arange(len(code)) + np.repeat(np.arange(n), counts)] = code
    result = [(int(c), [], [], []) for c in counts]
    if not len(own.queries) or not code.any():
        return result
    suffixes, _ = suffix_array(shard, int(own.left.max()), len(own.vocabulary))
    # Longest verbatim match of every item suffix: with the neighbours of its place in the array.
    every = np.arange(len(own.words))
    place = search(shard, suffixes, own, every, own.left, False)
    best = np.zeros(len(every), np.int64)
    for side in (place - 1, place):
        near = np.clip(side, 0, len(suffixes) - 1)
        common, _ = _compare(shard, suffixes[near], own, every, own.left)
        best = np.maximum(best, np.where(side == near, common, 0))
    # Windows that occur: the interval of suffixes with the window as prefix.
    queries = own.queries[best[own.queries] >= own.depth[own.queries]]
    if not len(queries):
        return result
    depth = own.depth[queries]
    low = search(shard, suffixes, own, queries, depth, False)
    high = search(shard, suffixes, own, queries, depth, True)
    # Equal windows have equal intervals; each is spread over the shard once.
    intervals, inverse = np.unique(np.stack([low, high, depth], 1), axis=0, return_inverse=True)
    by_interval = np.argsort(inverse.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(inverse.ravel(), minlength=len(intervals)))
    cover = np.zeros(len(shard) + 1, np.int64)
    met: list[np.ndarray] = []
    longest: list[tuple] = []
    for k, (a, b, d) in enumerate(intervals.tolist()):
        spots = suffixes[a:b]
        asked = queries[by_interval[ends[k - 1] if k else 0 : ends[k]]]
        np.add.at(cover, spots, 1)
        np.add.at(cover, spots + d, -1)
        homes = np.unique(np.searchsorted(starts, spots, side="right") - 1)
        items = np.unique(own.item[asked])
        met.append((homes[:, None] * len(own.ids) + items).ravel())
        step = max(1, PAIRS // len(asked))
        for at in range(0, len(spots), step):
            longest.append(_maximal(shard, own, spots[at : at + step], asked))
    hit = np.cumsum(cover[:-1]) > 0
    found_items: list[set] = [set() for _ in range(n)]
    for pair in np.unique(np.concatenate(met)).tolist():
        found_items[pair // len(own.ids)].add(own.ids[pair % len(own.ids)])
    matches = _longest(own, starts, *(np.concatenate(c) for c in zip(*longest)))
    for i in range(n):
        if not found_items[i]:
            continue
        own_hit = np.concatenate([[False], hit[starts[i] : starts[i] + counts[i]], [False]])
        edges = np.flatnonzero(own_hit[1:] != own_hit[:-1]).tolist()
        spans = [{"start": s, "stop": e} for s, e in zip(edges[::2], edges[1::2])]
        result[i] = (int(counts[i]), spans, sorted(x for x in found_items[i] if x is not None), matches.get(i, []))
    return result


def _maximal(shard: np.ndarray, own: Block, spots: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of a place in the shard and an item's word with a window in common, those that no
    equal word in front would lengthen, and how many words they share."""
    at, q = np.repeat(spots, len(asked)), np.tile(asked, len(spots))
    front = (at > 0) & (own.place[q] > 0)
    longer = np.zeros(len(at), bool)
    longer[front] = shard[at[front] - 1] == own.words[q[front] - 1]
    at, q = at[~longer], q[~longer]
    common, _ = _compare(shard, at, own, q, own.left[q])
    return at, q, common


def _longest(own: Block, starts: np.ndarray, at: np.ndarray, q: np.ndarray, common: np.ndarray) -> dict[int, list[dict]]:
    """For each document, the longest match of each item with all places where it stands. A match may be met
    from several windows."""
    home, item = np.searchsorted(starts, at, side="right") - 1, own.item[q]
    order = np.lexsort((at, q, -common, item, home))
    home, item, at, q, common = home[order], item[order], at[order], q[order], common[order]
    found: dict[int, list[dict]] = {}
    heads = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(home)]):
        b = a + int(np.searchsorted(-common[a:b], -common[a], side="right"))
        places = sorted({(int(own.place[w]), int(p - starts[home[a]])) for w, p in zip(q[a:b].tolist(), at[a:b].tolist())})
        found.setdefault(int(home[a]), []).append(
            {
                "item_id": own.ids[item[a]],
                "n_words": int(common[a]),
                "places": [{"item_word": w, "doc_word": p} for w, p in places],
            }
        )
    return found


def _step(shared, place: int):
    """Judges the texts in column ``place`` and puts what it finds behind the columns before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, SHARD_BYTES):
                rows = scan_shard(part.column(place), shared.value)
                made = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(FOUND)]
                names = [*part.schema.names[:place], *[f.name for f in FOUND]]
                yield pa.RecordBatch.from_arrays([*part.columns[:place], *made], names=names)

    return run


def _joined_spans(spans: Column) -> Column:
    """Union of spans that may overlap or touch."""
    none = F.array().cast(ArrayType(SPAN))

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        apart = last.isNull() | (s["start"] > last["stop"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))
        )

    return F.aggregate(F.array_sort(spans), none, add)


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``_n_words``, ``_spans`` of hit words, ``_items`` and, for each item, the longest
    ``_matches`` with all places.

    A document is judged where it is read, without a shuffle. The last block of the benchmark, mostly the only
    one, passes over the documents when the result is used. Each block before it passes over them by itself: only what
    it hits is written, by row, and joined at the end; then the block is given up. So the driver and the tasks hold one
    block at a time.
    """
    spark = arrow_ready(docs.sparkSession)
    kept = without(keep, [f.name for f in FOUND])
    rows = docs.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)],
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(quoted("text").cast("string"), F.lit("")).alias("t"),
    )
    every = blocks(benchmark)
    current, hits = next(every, None) or block([], []), []
    for following in every:
        shared = spark.sparkContext.broadcast(current)
        alone = rows.select("row", "t")
        schema = StructType([alone.schema["row"], *FOUND])
        hits.append(written(alone.mapInArrow(_step(shared, 1), schema).where(F.size("_spans") > 0), "benchmark-hits"))
        shared.destroy()
        current = following
    place = len(kept) + 1
    schema = StructType([*rows.schema.fields[:place], *FOUND])
    found = rows.mapInArrow(_step(spark.sparkContext.broadcast(current), place), schema)
    if hits:
        before = hits[0]
        for more in hits[1:]:
            before = before.unionAll(more)
        lists = [f.name for f in FOUND[1:]]
        before = before.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(f"b{c}") for c in lists])
        found = found.join(before, "row", "left")
        both = {c: F.concat(F.col(c), F.coalesce(F.col(f"b{c}"), F.array().cast(found.schema[c].dataType))) for c in lists}
        found = found.withColumns({"_spans": _joined_spans(both["_spans"]), "_items": F.array_sort(F.array_distinct(both["_items"])), "_matches": both["_matches"]})
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in FOUND])


def hit_words() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> Column:
    return (hit_words() > 0) & (hit_words() * SHARE >= F.col("_n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    own, names = carried(docs, ["text"])
    return returned(scan(own, benchmark, names).where(~contaminated()), docs)
