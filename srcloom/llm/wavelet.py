"""Token ids in binary shards, each a wavelet matrix.

A shard file holds the ids of consecutive documents, by ascending doc_id, as bit planes from the highest bit to the
lowest. In each plane the ids stand in the order that the plane above left them: those with a 0 there first, then
those with a 1, each part in its old order. Counts of ones before every block of 512 bits make rank a look-up and a
popcount, and select a bisection. So one file of little more than ``bits`` per id gives access to any token, the
number of times a token occurs before a place, and the places where it occurs, without unpacking the rest.

File format, little-endian: magic ``WVM1``; u32 bits, u64 ids, u64 documents; i64 doc_id and u64 first place of
each document, u8 null flag of each id; u64 number of zeros of each plane; counts (u32) of all planes; planes (bytes, first
id in the lowest bit). Files are rows of a Parquet table (part, shard, start, n_tokens, data), which Spark writes with its commit
protocol, so a retried task leaves no half file; part is the partition of the sort, start the ids of the part before the shard. Parquet compresses the documents' entries and counts further.

``encode`` uses the tokenizers library; texts are cut where the byte-level pattern has a border anyway, and each distinct
stretch of a slice is encoded once. Texts with special tokens in them are encoded whole.

Documents are dealt by ranges of ids (``ordered``), as many as the session shuffles to or the input has splits, so
parallelism follows the input and no group of equal or missing ids meets in one task.

Defined cases: a null text is empty and has the end id alone; documents of equal ids go by the beginning of the text,
then by a hash of it; a null id goes first; a
document longer than a shard has a shard of its own; an empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from srcloom.llm.common import arrow_ready, slices, text_bytes
from srcloom.llm.ordered import in_order

SHARD_TOKENS = 1 << 18
END_ID = 0
BLOCK = 512
MAGIC = b"WVM1"
HEAD = struct.Struct("<4sIQQ")
# Stretches of text in a generation of a worker's memo; it holds two at most.
MEMO = 300_000
# Bytes of text that are encoded at once.
SLICE = 8 << 20

SHARDS = StructType(
    [
        StructField("part", IntegerType()),
        StructField("shard", LongType()),
        StructField("start", LongType()),
        StructField("n_tokens", LongType()),
        StructField("data", BinaryType()),
    ]
)


def pack(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    """A shard file."""
    n, blocks = len(tokens), len(tokens) // BLOCK + 1
    zeros, counts, planes = [], [], []
    current = tokens
    for level in range(bits - 1, -1, -1):
        ones = (current & np.array(1 << level, current.dtype)).astype(bool)
        plane = np.packbits(ones, bitorder="little")
        filled = np.zeros(blocks * BLOCK // 8, np.uint8)
        filled[: len(plane)] = plane
        weight = np.bitwise_count(filled.view(np.uint64)).reshape(blocks, -1).sum(1, dtype=np.uint32)
        counts.append(np.concatenate([[0], np.cumsum(weight)[:-1]]).astype("<u4"))
        planes.append(plane)
        # Places found first: a mask as index takes four times as long where its bits are mixed.
        below = current[np.flatnonzero(~ones)]
        zeros.append(len(below))
        current = np.concatenate([below, current[np.flatnonzero(ones)]])
    firsts = np.cumsum([0, *lengths[:-1]]).astype("<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], np.uint8)
    parts = [HEAD.pack(MAGIC, bits, n, len(doc_ids)), known, firsts[: len(doc_ids)], missing, np.array(zeros, "<u8"), *counts, *planes]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard file opened for reading; nothing is unpacked before it is asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.n, docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        known, self.firsts, missing = take("<i8", docs), take("<u8", docs).astype(np.int64), take("u1", docs)
        self.doc_ids = [None if m else d for d, m in zip(known.tolist(), missing.tolist())]
        self.zeros = take("<u8", self.bits).astype(np.int64)
        blocks, size = self.n // BLOCK + 1, (self.n + 7) // 8
        self.counts = [take("<u4", blocks) for _ in range(self.bits)]
        self.planes = [take("u1", size) for _ in range(self.bits)]

    def _ones(self, level: int, place: int) -> int:
        """Ones in a plane before a place."""
        block = place // BLOCK
        start, stop = block * BLOCK // 8, place // 8
        found = int(self.counts[level][block]) + int(np.bitwise_count(self.planes[level][start:stop]).sum())
        if place % 8:
            found += (int(self.planes[level][stop]) & ((1 << place % 8) - 1)).bit_count()
        return found

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3]) >> (place & 7) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, place), self._ones(level, place)
            place = int(self.zeros[level]) + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, stop: int) -> tuple[int, int]:
        low, high = 0, stop
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, stop: int | None = None) -> int:
        """How often an id occurs before a place, or at all."""
        if token >> self.bits:
            return 0
        low, high = self._span(token, self.n if stop is None else min(max(stop, 0), self.n))
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of an id's occurrence number ``k``, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        place = self._span(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            zeros = int(self.zeros[level])
            one = token >> (self.bits - 1 - level) & 1
            wanted = place - zeros if one else place
            low, high = 0, self.n - 1
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > wanted:
                    high = mid
                else:
                    low = mid + 1
            place = low
        return place

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def tokens(self) -> np.ndarray:
        """All ids, plane by plane from the lowest: each puts its ids back where the plane above had them."""
        values = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            values[zeros:] |= np.array(1 << (self.bits - 1 - level), values.dtype)
            above = np.empty_like(values)
            above[np.flatnonzero(~ones)] = values[:zeros]
            above[np.flatnonzero(ones)] = values[zeros:]
            values = above
        return values


# Bytes that surely are no white space, whatever the library's tables say.
SOLID = np.zeros(256, bool)
SOLID[:0x80] = True
SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20]] = False


BLANK, LINE_END, ALNUM, MARK = 0x20, np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LINE_END[0x0A:0x0E] = True
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[0x21:0x7F] = ~ALNUM[0x21:0x7F]


def stretches(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Texts cut at borders of the byte-level pattern, and the number of the first stretch of each text (one entry more
    than texts).

    The pattern has a border in front of a blank if the character before it or behind it is no white space, in front of
    a line end behind such a character, behind a single line end between two, and between an ASCII letter or
    digit and an ASCII mark. Where none of this is sure the text stays together.
    """
    data, offsets = text_bytes(texts)
    cut = np.zeros(len(data), bool)
    if len(data):
        solid, blank, ended = SOLID[data], data == BLANK, LINE_END[data]
        cut[:-1] = blank[:-1] & solid[1:]
        cut[1:] |= solid[:-1] & (blank[1:] | ended[1:])
        cut[2:] |= solid[:-2] & ended[1:-1] & solid[2:]
        cut[1:] |= ALNUM[data[:-1]] & MARK[data[1:]]
        # What follows the last character of a text is another text.
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        sure = np.zeros(len(last), bool)
        inner = last > 0
        sure[inner] = solid[last[inner] - 1]
        cut[last[blank[last] & ~sure]] = False
        cut[offsets[offsets < len(data)]] = True
    first = np.flatnonzero(cut)
    bounds = np.append(first, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return found, np.searchsorted(first, offsets)


def _values(column: pa.BinaryArray) -> list[bytes]:
    """The values of a column without nulls, cut from its bytes; ``to_pylist`` makes an object more of each."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [b""] * len(column)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    held = data.slice(0, ends[-1]).to_pybytes()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Ids of texts, packed, by the library. Distinct stretches of a slice are encoded once; a memo of at most twice
    ``MEMO`` of them, in two generations, only saves time. New stretches that start with a blank and a solid character
    are encoded together, as one text: there is a border in front of each, whatever stands before, and the lengths of
    the tokens tell where it is."""

    def __init__(self, stored: str) -> None:
        self.tokenizer = Tokenizer.from_str(stored)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        # Tokens are written with one character for each byte.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.encode()) if i in added else len(token)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _together(self, new: list[bytes]) -> list[bytes]:
        if not new:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(new).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(s) for s in new])
        stops = np.searchsorted(ends, wanted)
        if stops[-1] >= len(ends) or (ends[stops] != wanted).any():
            return self._each([s.decode() for s in new])
        raw, size = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        borders = [0, *((stops + 1) * size).tolist()]
        return [raw[a:b] for a, b in zip(borders, borders[1:])]

    def _packed(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.known) >= MEMO:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for s in distinct:
            if s not in known:
                if (again := old.get(s)) is not None:
                    known[s] = again
                else:
                    new.append(s)
        joined = [s for s in new if len(s) > 1 and s[0] == 0x20 and SOLID[s[1]]]
        others = [s for s in new if not (len(s) > 1 and s[0] == 0x20 and SOLID[s[1]])]
        known.update(zip(joined, self._together(joined)))
        known.update(zip(others, self._each([s.decode() for s in others])))
        return [known[s] for s in distinct]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where those of each text start (one entry more than texts)."""
        pieces, firsts = stretches(texts)
        coded = pieces.dictionary_encode()
        packed = self._packed(_values(coded.dictionary))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        pool = pa.Array.from_buffers(
            pa.large_binary(), len(packed), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(b"".join(packed))]
        )
        # Arrow copies each stretch's ids to its places.
        _, ends, laid = pool.take(coded.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        size = np.dtype(self.kind).itemsize
        ids = np.frombuffer(laid, self.kind, int(ends[-1]) // size) if ends[-1] else np.empty(0, self.kind)
        starts = ends[firsts] // size
        special = [pc.match_substring(texts, s) for s in self.special]
        held = np.flatnonzero(np.logical_or.reduce([m.to_numpy(zero_copy_only=False) for m in special])) if special else []
        if not len(held):
            return ids, starts
        # Texts with special tokens in them are encoded whole.
        rows = np.split(ids, starts[1:-1])
        for i, raw in zip(held, self._each(texts.take(pa.array(held)).to_pylist())):
            rows[i] = np.frombuffer(raw, self.kind)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_loaded: list = [None, None]


def encoder(stored: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content."""
    if _loaded[0] != hash(stored):
        # One task, one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[:] = [hash(stored), Encoder(stored)]
    return _loaded[1]


def encode(stored: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text by the tokenizers library; ``stored`` is the tokenizer file's content."""
    ids, starts = encoder(stored).encode(pa.array(texts, pa.string()))
    return np.split(ids, starts[1:-1]) if texts else []


def _shards(rows: Iterator[tuple[int | None, np.ndarray]], bits: int) -> Iterator[tuple[int, bytes]]:
    doc_ids: list[int | None] = []
    held: list[np.ndarray] = []
    size = 0
    kind = np.uint32 if bits > 16 else np.uint16
    for doc_id, ids in rows:
        if held and size + len(ids) > SHARD_TOKENS:
            yield size, pack(doc_ids, np.array([len(h) for h in held]), np.concatenate(held), bits)
            doc_ids, held, size = [], [], 0
        doc_ids.append(doc_id)
        held.append(ids.astype(kind))
        size += len(ids)
    if held:
        yield size, pack(doc_ids, np.array([len(h) for h in held]), np.concatenate(held), bits)


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = END_ID) -> None:
    """Encode all documents, each with ``end_id`` behind it, and write the shard files. Texts are shuffled once."""
    spark = arrow_ready(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as file:
        stored = file.read()
    bits = max(1, (Tokenizer.from_str(stored).get_vocab_size() - 1).bit_length())
    shared = spark.sparkContext.broadcast(stored)
    ordered = in_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
                ids, starts = own.encode(batch.column(1))
                places = starts.tolist()
                for doc_id, a, b in zip(batch.column(0).to_pylist(), places, places[1:]):
                    yield doc_id, np.append(ids[a:b], own.kind(end_id))

        part, before = TaskContext.get().partitionId(), 0
        for k, (size, data) in enumerate(_shards(encoded(), bits)):
            columns = [pa.array([part], pa.int32()), *[pa.array([n]) for n in (k, before, size)], pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=SHARDS.names)
            before += size

    ordered.mapInArrow(run, SHARDS).write.parquet(folder)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the shard files alone; ids are little-endian
    unsigned 32-bit numbers, start the number of ids in all files and documents before."""
    spark = arrow_ready(shards.sparkSession)
    # One row per partition of the sort: small enough for one window and for every task.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part_start"))
    rows = shards.join(F.broadcast(starts), "part").select((F.col("_part_start") + F.col("start")).alias("base"), "data")
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("start", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids = shard.tokens().astype("<u4")
                ends = [*shard.firsts[1:].tolist(), shard.n]
                firsts = shard.firsts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array([base + f for f in firsts], pa.int64()),
                        pa.array([e - f for f, e in zip(firsts, ends)], pa.int64()),
                        pa.array([ids[f:e].tobytes() for f, e in zip(firsts, ends)], pa.binary()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, place) of every occurrence of an id, place counted within the document. Shards without it are passed
    over after one rank; in the others each occurrence is a select, and nothing is unpacked."""
    arrow_ready(shards.sparkSession)
    schema = StructType([StructField("doc_id", LongType()), StructField("place", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                places = np.array(shard.occurrences(token), np.int64)
                home = np.searchsorted(shard.firsts, places, side="right") - 1
                ids = [shard.doc_ids[h] for h in home.tolist()]
                columns = [pa.array(ids, pa.int64()), pa.array(places - shard.firsts[home])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return shards.select("data").mapInArrow(run, schema)
