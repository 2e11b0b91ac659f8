"""Chat formatting with a prefix tree: conversations that share their first turns share tokens.

Conversations are sorted by the hashes of their turns, so those with the same beginning stand together and their
order is a depth-first walk of the prefix tree. A task reads its range of them in order with the path to the
current turn on a stack; turns that go on from the path are written once, whatever the number of conversations
that share them. Turns are compared by role and text, not by hash.

The walk is cut into packs of at most ``PACK_CHARS`` code points and ``PACK_CONVERSATIONS`` conversations, or one
longer conversation. A pack is a training sequence of its own: it begins with an empty path, so the turns that a cut
or a task border goes through are written again behind it. That bounds memory and spreads a first turn, or a
whole conversation, that a third of all conversations share.

A pack has ``tokens`` (one code point each; a tokenizer may map nodes to its own), and for each node its
span, the position id of its first token, the span under the loss mask (assistant texts), and ``sees``: the spans
of its ancestors, adjoining ones merged, which its tokens attend to in addition to their own node up to
themselves. ``conversations`` names the last node of each conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Within texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``, so no control string can occur in them; in roles a line end becomes ``\\n``.

Defined cases: null texts and roles are empty; turns of a conversation go by turn, then role and text, null first;
repeated rows are repeated turns; rows with a null conv_id are one conversation; other columns are ignored.
A conversation must fit a row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from srcloom.llm.common import arrow_ready

PACK_CHARS = 1 << 18
PACK_CONVERSATIONS = 4096
LEARNED = "assistant"

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
PACK = StructType(
    [
        StructField("tokens", StringType()),
        StructField(
            "nodes",
            ArrayType(
                StructType(
                    [
                        StructField("start", LongType()),
                        StructField("stop", LongType()),
                        StructField("position", LongType()),
                        StructField("loss_start", LongType()),
                        StructField("loss_stop", LongType()),
                        StructField("sees", ArrayType(_SPAN)),
                    ]
                )
            ),
        ),
        StructField(
            "conversations",
            ArrayType(StructType([StructField("conv_id", LongType()), StructField("node", LongType())])),
        ),
    ]
)
READ = StructType(
    [
        StructField("conv_id", LongType()),
        StructField(
            "turns", ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
        ),
        StructField("learned", ArrayType(StringType())),
        StructField("formatted_chars", LongType()),
    ]
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class Pack:
    """A pack under construction; path: the (turn, node) pairs from the root to the last written turn."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []
        self.conversations: list[dict] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], texts: list[tuple[str, str]]) -> None:
        """texts: head and body of each turn, formatted."""
        kept = self.shared(turns)
        del self.path[kept:]
        for turn, (head, body) in zip(turns[kept:], texts[kept:]):
            above = self.nodes[self.path[-1][1]] if self.path else None
            sees = [] if above is None else [dict(s) for s in above["sees"]]
            if above is not None:
                if sees and sees[-1]["stop"] == above["start"]:
                    sees[-1]["stop"] = above["stop"]
                else:
                    sees.append({"start": above["start"], "stop": above["stop"]})
            start, loss = self.size, self.size + len(head)
            node = f"{head}{body}{END}\n"
            self.parts.append(node)
            self.size += len(node)
            self.nodes.append(
                {
                    "start": start,
                    "stop": self.size,
                    "position": 0 if above is None else above["position"] + above["stop"] - above["start"],
                    "loss_start": loss,
                    "loss_stop": loss + len(body) if turn[0] == LEARNED else loss,
                    "sees": sees,
                }
            )
            self.path.append((turn, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "node": self.path[-1][1]})

    def row(self) -> dict:
        return {"tokens": "".join(self.parts), "nodes": self.nodes, "conversations": self.conversations}


def packs_of(rows: Iterator[dict], most_chars: int, most_conversations: int) -> Iterator[dict]:
    """Packs of conversations that come in depth-first order."""
    pack = Pack()
    for row in rows:
        turns = [(t["role"], t["text"]) for t in row["turns"]]
        texts = [(f"{START}{escape_role(role)}\n", escape(text)) for role, text in turns]
        more = sum(len(h) + len(b) + len(END) + 1 for h, b in texts[pack.shared(turns) :])
        full = pack.size + more > most_chars or len(pack.conversations) >= most_conversations
        if pack.conversations and full:
            yield pack.row()
            pack = Pack()
        pack.add(row["conv_id"], turns, texts)
    if pack.conversations:
        yield pack.row()


def format_chats(
    conversations: DataFrame, most_chars: int = PACK_CHARS, most_conversations: int = PACK_CONVERSATIONS
) -> DataFrame:
    """Packs of all conversations (conv_id, turn, role, text)."""
    arrow_ready(conversations.sparkSession)
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    # Copies of a conversation have the same path, so the id goes into the range too.
    ordered = (
        whole.select("conv_id", "turns", path.alias("path"))
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .select("conv_id", "turns")
    )
    schema = to_arrow_schema(PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for pack in packs_of(rows, most_chars, most_conversations):
            yield pa.RecordBatch.from_pylist([pack], schema=schema)

    return ordered.mapInArrow(run, PACK)


def conversation(tokens: str, nodes: list[dict], last: int) -> tuple[list[dict], list[str], int]:
    """Turns of the conversation that ends in a node, the texts under its loss mask, and its length."""
    spans = [*nodes[last]["sees"], {"start": nodes[last]["start"], "stop": nodes[last]["stop"]}]
    text = "".join(tokens[s["start"] : s["stop"]] for s in spans)
    turns = [{"role": unescape_role(m[1]), "text": unescape(m[2])} for m in TURN.finditer(text)]
    # The nodes within the spans are the path.
    starts = [n["start"] for n in nodes]
    learned, position = [], 0
    for span in spans:
        at = span["start"]
        while at < span["stop"]:
            node = nodes[bisect_left(starts, at)]
            if node["position"] != position:
                raise ValueError(f"position {node['position']} of a node at {position}")
            if tokens[node["loss_start"] : node["loss_stop"]]:
                learned.append(unescape(tokens[node["loss_start"] : node["loss_stop"]]))
            position += node["stop"] - node["start"]
            at = node["stop"]
    return turns, learned, len(text)


def read_back(packs: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted_chars) of every conversation, from the packs alone."""
    arrow_ready(packs.sparkSession)
    schema = to_arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                rows: list[dict] = []
                known: dict[int, tuple] = {}
                size = 0
                for c in pack["conversations"]:
                    if c["node"] not in known:
                        known = {c["node"]: conversation(pack["tokens"], pack["nodes"], c["node"])}
                    turns, learned, chars = known[c["node"]]
                    rows.append({"conv_id": c["conv_id"], "turns": turns, "learned": learned, "formatted_chars": chars})
                    size += chars
                    if size > PACK_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packs.select("tokens", "nodes", "conversations").mapInArrow(run, READ)
