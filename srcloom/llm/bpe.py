"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece of text starts as one symbol per byte. Leaf i of its tree holds (rank, i) of the pair that starts
at symbol i, or nothing if that pair has no merge; an inner node holds the least of its children. So the root
is the leftmost pair of lowest rank. A merge changes three leaves: the pair itself, the one before it, and the one
it swallows; their paths to the root are set anew. It ends when the root is empty.

``merge_all`` walks one piece. ``merge_batch`` does the same steps for many short pieces at once, a row
of a matrix each. Pieces that a worker has met before are looked up in a memo of bounded size, which only
saves time. The tokenizer file is read in the driver and sent to the tasks.

Text is prepared as the file asks: special tokens are cut out of the raw text, the rest is brought to
composed form and to lower case, character by character, and split into contractions, runs of letters, single digits
and runs of other marks; white space is dropped.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows get equal ids;
a text of any length is encoded whole; a kept column with the name of an added one is replaced. Code points
that the installed Unicode tables class differently (unassigned or newest ones) may be split otherwise.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField

from srcloom.llm.common import add_columns, arrow_ready

# Pieces up to this many symbols are merged together; a worker's memo holds so many pieces at most.
SHORT = 64
MEMO = 300_000

NONE = np.iinfo(np.int64).max
PLACE_BITS = 32


@dataclass
class Vocabulary:
    """What the tasks need of a tokenizer file. pairs is sorted; ranks and merged go with it."""

    tokens: list[str]
    single: np.ndarray
    final: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    pattern: str
    special: dict[str, int]


def tokenizer_path(name: str) -> str:
    """Where the installation keeps a public tokenizer file."""
    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """By byte, the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    stands = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [stands[b] for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file with a suffix for word ends, as the tokenizers library writes it."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model = stored["model"]
    ids, end = model["vocab"], model["end_of_word_suffix"] or ""
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *special.values()]))
    for text, i in [*ids.items(), *special.items()]:
        tokens[i] = text
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    merged = np.array([ids[a + b] for a, b in merges], np.int64)
    pairs = left << PLACE_BITS | right
    # Of a pair listed twice the last listing holds.
    _, last = np.unique(pairs[::-1], return_index=True)
    order = len(pairs) - 1 - last
    splits = [p for p in stored["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    return Vocabulary(
        tokens,
        np.array([ids[c] for c in byte_characters()], np.int64),
        np.array([ids[c + end] for c in byte_characters()], np.int64),
        pairs[order],
        order,
        merged[order],
        splits[0]["pattern"]["Regex"],
        special,
    )


def leaves(own: Vocabulary, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(rank, place) of the pairs as one number, ``NONE`` where no merge is known or a symbol is missing."""
    key = left << PLACE_BITS | right
    at = np.minimum(np.searchsorted(own.pairs, key), len(own.pairs) - 1)
    known = (own.pairs[at] == key) & (left >= 0) & (right >= 0)
    return np.where(known, own.ranks[at] << PLACE_BITS | place, NONE)


def _by_rank(own: Vocabulary) -> np.ndarray:
    made = np.zeros(int(own.ranks.max()) + 1, np.int64)
    made[own.ranks] = own.merged
    return made


def merge_all(own: Vocabulary, symbols: list[int]) -> list[int]:
    """Ids of one piece, by its segment tree."""
    n = len(symbols)
    size = 1 << max(0, (n - 1).bit_length())
    row = np.array(symbols, np.int64)
    tree = [NONE] * (2 * size)
    tree[size : size + n - 1] = leaves(own, row[:-1], row[1:], np.arange(n - 1)).tolist()
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    made, mask = _by_rank(own), (1 << PLACE_BITS) - 1
    known = {int(p): int(r) for p, r in zip(own.pairs, own.ranks)}
    symbols, following, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        i = size + place
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def pair(place: int) -> int:
        other = following[place]
        rank = known.get(symbols[place] << PLACE_BITS | symbols[other]) if other < n else None
        return NONE if rank is None else rank << PLACE_BITS | place

    while tree[1] != NONE:
        place, rank = tree[1] & mask, tree[1] >> PLACE_BITS
        other = following[place]
        symbols[place], symbols[other] = int(made[rank]), -1
        following[place] = following[other]
        if following[place] < n:
            before[following[place]] = place
        put(other, NONE)
        put(place, pair(place))
        if before[place] >= 0:
            put(before[place], pair(before[place]))
    return [s for s in symbols if s >= 0]


def merge_batch(own: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The same for rows of symbols, with -1 behind the end of each and in the last column."""
    rows, width = symbols.shape
    size = 1 << max(0, (width - 1).bit_length())
    symbols = symbols.copy()
    place = np.arange(width)
    following = np.broadcast_to(place + 1, (rows, width)).copy()
    before = np.broadcast_to(place - 1, (rows, width)).copy()
    tree = np.full((rows, 2 * size), NONE)
    tree[:, size : size + width - 1] = leaves(own, symbols[:, :-1], symbols[:, 1:], place[:-1])
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    made, mask = _by_rank(own), (1 << PLACE_BITS) - 1
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        root = tree[live, 1]
        at = root & mask
        other = following[live, at]
        after = np.minimum(following[live, other], width - 1)
        prior = before[live, at]
        symbols[live, at] = made[root >> PLACE_BITS]
        symbols[live, other] = -1
        following[live, at] = after
        before[live, after] = at
        earlier = np.maximum(prior, 0)
        tree[live, size + other] = NONE
        tree[live, size + at] = leaves(own, symbols[live, at], symbols[live, after], at)
        behind = prior >= 0
        tree[live[behind], size + prior[behind]] = leaves(
            own, symbols[live[behind], prior[behind]], symbols[live[behind], at[behind]], prior[behind]
        )
        node = size + np.stack([other, at, earlier])
        while node[0, 0] > 1:
            node = node >> 1
            tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] != NONE]
    return symbols


def encode_pieces(own: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Ids of each piece as little-endian unsigned 32-bit numbers."""
    raw = [p.encode() for p in pieces]
    sizes = np.array([len(r) for r in raw], np.int64)
    found: list[bytes] = [b""] * len(raw)
    for low, high in [(0, 7), (7, 15), (15, 31), (31, SHORT - 1)]:
        chosen = np.flatnonzero((sizes > low) & (sizes <= high))
        if not len(chosen):
            continue
        lengths = sizes[chosen]
        data = np.frombuffer(b"".join([raw[i] for i in chosen.tolist()]), np.uint8)
        symbols = np.full((len(chosen), high + 1), -1, np.int64)
        inside = np.arange(high + 1) < lengths[:, None]
        symbols[inside] = own.single[data]
        symbols[np.arange(len(chosen)), lengths - 1] = own.final[data[np.cumsum(lengths) - 1]]
        done = merge_batch(own, symbols)
        left = done >= 0
        packed = done[left].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left.sum(1))).tolist()
        for i, start, end in zip(chosen.tolist(), [0, *ends], ends):
            found[i] = packed[start:end]
    for i in np.flatnonzero(sizes >= SHORT).tolist():
        data = np.frombuffer(raw[i], np.uint8)
        symbols = own.single[data]
        symbols[-1] = own.final[data[-1]]
        found[i] = np.array(merge_all(own, symbols.tolist()), "<u4").tobytes()
    return found


_memo: dict[str, bytes] = {}
_memo_of: list = [None]


def _prepared(text: str) -> str:
    if not text.isascii():
        # Lower case goes by single characters, so a final sigma is like any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def encode_texts(own: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    if _memo_of[0] is not own:
        _memo.clear()
        _memo_of[0] = own
    split = regex.compile(own.pattern).findall
    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(own.special, key=len, reverse=True))) + ")")
    special = {t: np.array([i], "<u4").tobytes() for t, i in own.special.items()}
    rows: list[list[str]] = []
    cuts: list[list[tuple[int, str]]] = []
    for text in texts:
        pieces: list[str] = []
        cut: list[tuple[int, str]] = []
        for k, part in enumerate(marks.split(text) if special and any(s in text for s in special) else [text]):
            if k % 2:
                cut.append((len(pieces), part))
            else:
                pieces += split(_prepared(part))
        rows.append(pieces)
        cuts.append(cut)
    new = set(chain.from_iterable(rows)).difference(_memo)
    if len(new) + len(_memo) > MEMO:
        _memo.clear()
        new = set(chain.from_iterable(rows))
    listed = list(new)
    _memo.update(zip(listed, encode_pieces(own, listed)))
    ids = []
    for pieces, cut in zip(rows, cuts):
        found: Iterable[bytes] = map(_memo.__getitem__, pieces)
        if cut:
            found = list(found)
            for at, mark in reversed(cut):
                found.insert(at, special[mark])
        ids.append(b"".join(found))
    return ids


def decode_ids(own: Vocabulary, ids: bytes) -> str:
    """Tokens as the file spells them, with a blank between any two: the file names no decoder."""
    return " ".join([own.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def with_ids(docs: DataFrame, own: Vocabulary, keep: list[str], name: str = "ids") -> DataFrame:
    """Adds the ids of every whole text, packed as little-endian unsigned 32-bit numbers."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def compute(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(encode_texts(shared.value, texts.to_pylist()), pa.binary())]

    return add_columns(docs, compute, [StructField(name, BinaryType())], keep)


def with_decoded(
    encoded: DataFrame, own: Vocabulary, keep: list[str], ids: str = "ids", name: str = "decoded"
) -> DataFrame:
    """Adds the text that packed ids stand for."""
    arrow_ready(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(own)

    def compute(_: pa.StringArray, also: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([decode_ids(shared.value, x or b"") for x in also.column(0).to_pylist()], pa.string())]

    return add_columns(encoded, compute, [StructField(name, StringType())], keep, text=ids, also=[ids])
