"""Chat formatting as a prefix tree: shared turns once, depth first, with ancestor attention.

Conversations that begin with the same turns share these turns' tokens. Sorted
by their turns' digests, a conversation stands next to those it shares most
with, so the nodes it adds to the tree are its turns beyond what it has in
common with the one before it, and the order of emission is depth first. One
segment of tokens is written per node; position ids count along the path from
the root, and a segment attends to the intervals of the packed stream that hold
its ancestors, besides itself.

No task sees a whole tree. Sorted conversations are worked on in pages, the
first of a page with the last of the page before; the path that is open where a
page begins is looked up by node, one small request per page and level. Equal
conversations are one before anything is sorted.

Text is formatted as ``<|im_start|>role`` newline ``text<|im_end|>`` newline.
In a text ``<``, any number of backslashes and ``|`` get one backslash more, so
that no text holds a control string and the escape can be taken back.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm.order import numbered
from textloom.plans.shared_dir import materialise

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of the template
TRAINED_ROLE = "assistant"
PAGE = 1024  # conversations
READ_TOKENS = 1 << 19  # of a group when the stream is read back

_KEY = 16  # bytes of a turn's or node's digest


# The template.


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role is one line without ``|``."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role, flags=re.S)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescaped_role(role), unescaped(text.removesuffix("\n").removesuffix(END))))
    return turns


class Tokens:
    """Byte-level token ids without loss; the control strings are the two ids behind the vocabulary."""

    _loaded: dict[str, Tokens] = {}

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.bytes = [b""] * (self.end + 1)
        for token, rank in pairs:
            self.bytes[int(rank)] = base64.b64decode(token)
        self.bytes[self.start], self.bytes[self.end] = START.encode(), END.encode()

    @classmethod
    def load(cls, path: str, ranks: str) -> Tokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path, ranks)
        return cls._loaded[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in ids.tolist()]).decode()


# The tree.


def _conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, conv, path``: digests of a conversation's turns, one after the other."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest")))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return turns.groupBy("conv_id", "conv").agg(ordered.alias("turns")).select("conv_id", "conv", path.alias("path"))


_NODES = "page bigint, rank bigint, k int, conv string, digest binary, node binary, ends boolean, carried boolean"


def _new_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes that each conversation of a page adds, and those open where the page begins."""
    rows, before = [], b""
    frame = frame.sort_values("rank")
    first = True
    for page, rank, conv, path, own in zip(frame["page"], frame["rank"], frame["conv"], frame["path"], frame["own"], strict=True):
        if own:
            shared = 0
            while shared < min(len(path), len(before)) // _KEY and path[shared * _KEY : (shared + 1) * _KEY] == before[shared * _KEY : (shared + 1) * _KEY]:
                shared += 1
            digest, n = hashlib.md5(), len(path) // _KEY
            for k in range(n):
                turn = path[k * _KEY : (k + 1) * _KEY]
                digest.update(turn)
                if k >= shared or first:
                    rows.append((page, rank, k, conv, turn, digest.digest(), k == n - 1, k < shared))
            first = False
        before = path
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])


def _segments(path: str, ranks: str, trained: str):
    """Token ids of turns; the interval of the text itself where it is to be learnt."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.load(path, ranks)
        newline = tokens.encode(["\n"])[0]
        for rows in source:
            roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
            heads = tokens.encode([escaped_role(r) + "\n" for r in roles])
            bodies = tokens.encode([escaped(t) for t in texts])
            ids = [[tokens.start, *h, *b, tokens.end, *newline] for h, b in zip(heads, bodies, strict=True)]
            begin = [1 + len(h) if r == trained else 0 for h, r in zip(heads, roles, strict=True)]
            stop = [1 + len(h) + len(b) if r == trained else 0 for h, b, r in zip(heads, bodies, roles, strict=True)]
            kept = [rows.column(c) for c in ("page", "rank", "k", "node", "ends")]
            new = [pa.array([len(i) for i in ids], pa.int64()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[c.split()[0] for c in _SEGMENTS.split(", ")])

    return work


_SEGMENTS = "page bigint, rank bigint, k int, node binary, ends boolean, length bigint, loss_start int, loss_end int, ids array<int>"

_INTERVALS = "array<struct<start:bigint,end:bigint>>"
_PLACES = f"rank bigint, k int, start bigint, position bigint, ancestors {_INTERVALS}"


def _places(frame: pd.DataFrame) -> pd.DataFrame:
    """Position and ancestor intervals of a page's segments, from the path that is open before each."""
    path: list[tuple[int, int, int, list[dict]]] = []  # start, length, position, ancestors: along the open path
    rows = []
    frame = frame.sort_values(["carried", "rank", "k"], ascending=[False, True, True])
    for carried, rank, k, start, length in zip(frame["carried"], frame["rank"], frame["k"], frame["start"], frame["length"], strict=True):
        del path[k:]
        position, ancestors = 0, []
        if path:
            above, size, begin, older = path[-1]
            position, ancestors = begin + size, older
            if ancestors and ancestors[-1]["end"] == above:
                ancestors = [*ancestors[:-1], {"start": ancestors[-1]["start"], "end": above + size}]
            else:
                ancestors = [*ancestors, {"start": above, "end": above + size}]
        path.append((start, length, position, ancestors))
        if not carried:
            rows.append((rank, k, start, position, ancestors))
    return pd.DataFrame(rows, columns=["rank", "k", "start", "position", "ancestors"])


def pack_tree(conversations: DataFrame, tokenizer: str, ranks: str, trained: str = TRAINED_ROLE) -> tuple[DataFrame, DataFrame]:
    """The packed stream of ``conversations(conv_id, turn, role, text)``, and where each conversation ends.

    The first table has a row per node, a turn after certain turns: ``start``
    (place of its first token in the stream, which has no gaps), ``length,
    position`` (id of its first token; the others follow), ``ancestors``
    (intervals of the stream to attend to), ``loss_start, loss_end`` (interval
    of its tokens under the loss mask), ``ids, node`` and ``ends`` (whether a
    conversation ends here). The second maps ``conv_id`` to ``node``.

    Turns stand in order of ``turn``, null first, equal ones by their digest.
    Null roles and texts are empty; a null ``conv_id`` is a conversation of its
    own. Repeated rows are repeated turns. ``trained`` is the role under the
    loss mask. ``tokenizer`` is a lossless byte-level model and ``ranks`` its
    vocabulary as bytes; both are files that every executor has. A
    conversation's digests, 16 bytes a turn, travel in one row. Other columns
    are ignored. Empty in, empty out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        digest.alias("digest"),
    )
    paths = materialise(_conversations(turns), "paths")
    distinct = paths.groupBy("path").agg(F.min("conv").alias("conv"))  # equal conversations are one
    ranked = numbered(distinct, [F.col("path")])
    page = F.floor(F.col("rank") / PAGE)
    last = (F.col("rank") + 1) % PAGE == 0
    dealt = ranked.select("*", F.explode(F.when(last, F.array(page, page + 1)).otherwise(F.array(page))).alias("page"))
    dealt = dealt.withColumn("own", F.floor(F.col("rank") / PAGE) == F.col("page"))
    nodes = materialise(dealt.groupBy("page").applyInPandas(_new_nodes, _NODES), "nodes")

    texts = turns.dropDuplicates(["conv", "digest"]).select("conv", "digest", "role", "text")
    found = nodes.where("NOT carried").join(texts, ["conv", "digest"])
    found = found.select("page", "rank", "k", "node", "ends", "role", "text").mapInArrow(_segments(tokenizer, ranks, trained), _SEGMENTS)
    segments = materialise(found, "segments")

    totals = segments.groupBy("page").agg(F.sum("length").alias("total"))
    base = totals.select("page", F.coalesce(F.sum("total").over(_before([], ["page"])), F.lit(0)).alias("base"))  # a row per page
    inside = F.coalesce(F.sum("length").over(_before(["page"], ["rank", "k"])), F.lit(0))
    placed = segments.select("page", "rank", "k", "node", "length", inside.alias("inside")).join(base, "page")
    placed = placed.select("page", "rank", "k", "node", "length", (F.col("base") + F.col("inside")).alias("start"))
    placed = materialise(placed, "placed")
    open_paths = nodes.where("carried").select("page", "rank", "k", "node").join(placed.select("node", "start", "length"), "node")
    both = placed.select("page", "rank", "k", "start", "length", F.lit(False).alias("carried"))
    both = both.unionByName(open_paths.select("page", "rank", "k", "start", "length", F.lit(True).alias("carried")))
    places = both.groupBy("page").applyInPandas(_places, _PLACES)
    packed = segments.join(places, ["rank", "k"])
    packed = packed.select("start", "length", "position", "ancestors", "loss_start", "loss_end", "ids", "node", "ends")
    return materialise(packed, "packed-tree"), paths.select("conv_id", F.unhex(F.md5("path")).alias("node"))


# Reading back.


_READ = "node binary, formatted string, trained string, turns array<struct<role:string,text:string>>"


def _read(path: str, ranks: str):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens.load(path, ranks)
        frame = frame.sort_values("start", ignore_index=True)
        starts, ids = frame["start"].to_numpy(), frame["ids"].tolist()
        loss = list(zip(frame["loss_start"].tolist(), frame["loss_end"].tolist(), strict=True))
        rows = []
        for at in np.flatnonzero((frame["own"] & frame["ends"]).to_numpy()).tolist():
            seen = []
            for part in frame["ancestors"].iloc[at]:
                seen += range(*np.searchsorted(starts, [part["start"], part["end"]]))
            seen.append(at)
            formatted = tokens.decode(np.concatenate([ids[i] for i in seen]))
            trained = "".join(unescaped(tokens.decode(ids[i][loss[i][0] : loss[i][1]])) for i in seen)
            turns = [{"role": r, "text": t} for r, t in parsed(formatted)]
            rows.append((frame["node"].iloc[at], formatted, trained, turns))
        return pd.DataFrame(rows, columns=["node", "formatted", "trained", "turns"])

    return work


def read_back(packed: DataFrame, tokenizer: str, ranks: str) -> DataFrame:
    """``node, formatted, trained, turns`` for every node of ``packed`` where a conversation ends.

    Only attention intervals lead from a segment to what stands before it.
    ``formatted`` is the template's text, ``trained`` what the loss mask holds,
    unescaped, and ``turns`` the roles and texts. A group reads a range of the
    stream and the segments of the path that is open where it begins.
    """
    rows = packed.withColumn("page", F.floor(F.col("start") / READ_TOKENS))
    first = rows.groupBy("page").agg(F.min_by("ancestors", "start").alias("open"))
    wanted = first.select(F.col("page").alias("to"), F.explode("open").alias("i")).select("to", "i.start", "i.end")
    covered = F.sequence(F.floor(F.col("start") / READ_TOKENS), F.floor((F.col("end") - 1) / READ_TOKENS))
    wanted = wanted.select("to", F.col("start").alias("from"), F.col("end").alias("till"), F.explode(covered).alias("page"))
    wanted = wanted.where(F.col("page") != F.col("to"))
    columns = ["start", "ancestors", "loss_start", "loss_end", "ids", "node", "ends"]
    older = rows.join(wanted, "page").where((F.col("start") >= F.col("from")) & (F.col("start") < F.col("till")))
    both = rows.select("page", *columns, F.lit(True).alias("own")).unionByName(older.select(F.col("to").alias("page"), *columns, F.lit(False).alias("own")))
    return both.groupBy("page").applyInPandas(_read(tokenizer, ranks), _READ)


def _before(within: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
