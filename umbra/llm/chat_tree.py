"""Chat formatting as a prefix tree.

Conversations that share their first turns share tree nodes. Every node's tokens are emitted once, in depth-first
order inside its tree, with the position id of its first token, counted from the conversation's start, and the
intervals of its ancestors, which are all it may attend to besides itself. Units are tokens of the given tokenizer
(head, text and end of a turn are encoded apart, so the loss mask falls on whole tokens), or characters without one.

A node is named by a chained hash of the turns that lead to it. The conversation with the smallest id through a
node owns it; a conversation's owners never decrease with depth, so the nodes it owns are one suffix of its path
(a segment), and sorting conversations by their runs of owners, longer runs first, is a depth-first walk. Offsets
are prefix sums over a range-partitioned sort, so a tree that holds a third of the table spreads over many tasks.

Nulls: a null text or role is an empty string, null turns come first, null conversation ids form one conversation
(reported with a null id, which -2**63 stands for inside). Ties in ``turn`` are ordered by role, then text; repeated
rows stay. A very long turn is one node, encoded in parts. An empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm import _tokens
from umbra.llm._common import checkpointed, code_key

OPEN, SHUT, END = "<|", "|>", "</s>"
_ESCAPE = {"\\": "\\\\", "<": "\\{", "[": "\\(", "|": "\\!"}
_PLAIN = {v[1]: k for k, v in _ESCAPE.items()}
_TABLE = str.maketrans(_ESCAPE)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|([^<|]*)\|>([^<]*)</s>", re.S)


def escape(text: str) -> str:
    """No control string can occur in the result: it holds neither ``<`` nor ``[`` nor ``|``."""
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    return f"{OPEN}{escape(role)}{SHUT}", escape(text), END


def format_turn(role: str, text: str) -> str:
    return "".join(turn_parts(role, text))


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; raises if anything lies between turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        at = m.end()
        turns.append((unescape(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


def _fold_schema(body: str) -> str:
    return f"ck long, depth int, node binary, body {body}, pos long, length long, loss_start long, loss_end long"


def _folding(tokenizer: str | None):
    """Chain hashes along each conversation; rows come sorted by conversation and turn."""
    kind = pa.list_(pa.int32()) if tokenizer else pa.string()

    def fold(batches):
        encode = _tokens.counter(tokenizer).ids if tokenizer else lambda x: x
        heads: dict = {}
        last, depth, pos, chain = None, 0, 0, b""
        for batch in batches:
            out = []
            for ck, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ck != last:
                    last, depth, pos, chain = ck, 0, 0, b""
                head, body, tail = turn_parts(role, text)
                chain = hashlib.blake2b(chain + f"{head}{body}{tail}".encode(), digest_size=16).digest()
                if len(heads) > 1000:
                    heads.clear()
                for x in (head, tail):
                    if x not in heads:
                        heads[x] = encode(x)
                said = encode(body)
                whole = heads[head] + said + heads[tail]
                size = len(whole)
                loss = (len(heads[head]), len(heads[head]) + len(said)) if role == "assistant" else (size, size)
                out.append((ck, depth, chain, whole, pos, size, *loss))
                depth, pos = depth + 1, pos + size
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), kind, *[pa.int64()] * 4)
                names = [x.split()[0] for x in _fold_schema("x").split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return fold


def _running(batches):
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        before = []
        for n in batch.column("seg_len").to_pylist():
            before.append(total)
            total += n
        yield batch.append_column("part", pa.array([part] * len(before), pa.int32())).append_column("before", pa.array(before, pa.int64()))


def prefix_tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths), in tokens or characters.

    nodes: one row a tree node: tree_id, start (offset in the tree's sequence), length, position (of its first unit),
    body (ids or text), loss_start and loss_end (inside body), ancestors (array of [start, end) in the sequence, in
    order; the node also attends to itself causally). paths: conv_id, ck, depth, tree_id, start of each turn.
    """
    rows = conversations.select(code_key("conv_id").alias("ck"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    folded = rows.repartition("ck").sortWithinPartitions("ck", "turn", "role", "text").select("ck", "role", "text")
    turns = checkpointed(folded.mapInArrow(_folding(tokenizer), _fold_schema("array<int>" if tokenizer else "string")))
    # on its own, so that a join can split a node that many conversations share
    owners = checkpointed(turns.groupBy("node").agg(F.min("ck").alias("owner")))
    path = turns.drop("body").join(owners, "node")
    # owners never decrease along a path: its runs are its distinct owners
    runs = path.groupBy("ck", "owner").agg(F.sum("length").alias("run_chars"), F.count("*").cast("int").alias("run"), F.min("pos").alias("run_pos"))
    keyed = runs.groupBy("ck").agg(
        F.sort_array(F.collect_list(F.struct("owner", (-F.col("run")).alias("shorter")))).alias("key"),
        F.sum(F.when(F.col("ck") == F.col("owner"), F.col("run_chars"))).alias("seg_len"),
        F.sum(F.when(F.col("ck") == F.col("owner"), F.col("run_pos"))).alias("seg_pos"),
    )
    segments = keyed.where("seg_len is not null").repartitionByRange("key").sortWithinPartitions("key").select("ck", F.col("key")[0]["owner"].alias("tree_id"), "seg_len", "seg_pos")
    placed = checkpointed(segments.mapInArrow(_running, "ck long, tree_id long, seg_len long, seg_pos long, part int, before long"))
    parts = placed.groupBy("part").agg(F.sum("seg_len").alias("part_len"))  # one row a task
    parts = parts.select("part", (F.sum("part_len").over(Window.orderBy("part")) - F.col("part_len")).alias("part_before"))
    placed = placed.join(parts, "part").select("ck", "tree_id", "seg_pos", (F.col("before") + F.col("part_before")).alias("at"))
    roots = placed.where("ck = tree_id").select("tree_id", F.col("at").alias("tree_at"))
    placed = placed.join(roots, "tree_id").select(F.col("ck").alias("owner"), "tree_id", (F.col("at") - F.col("tree_at") - F.col("seg_pos")).alias("shift"))
    placed = checkpointed(placed)
    # within a segment, offset = position + shift
    spans = runs.join(placed, "owner").groupBy("ck").agg(
        F.sort_array(F.collect_list(F.struct((F.col("run_pos") + F.col("shift")).alias("start"), (F.col("run_pos") + F.col("shift") + F.col("run_chars")).alias("end"), (F.col("owner") == F.col("ck")).alias("own")))).alias("spans")
    )
    own = turns.join(owners, "node").where("ck = owner").join(placed, "owner").join(spans, "ck")
    start = F.col("pos") + F.col("shift")
    before = F.expr("transform(filter(spans, s -> not s.own), s -> named_struct('start', s.start, 'end', s.end))")
    inside = F.expr("transform(filter(spans, s -> s.own and s.start < pos + shift), s -> named_struct('start', s.start, 'end', pos + shift))")
    nodes = own.select("tree_id", start.alias("start"), "length", F.col("pos").alias("position"), "body", "loss_start", "loss_end", F.concat(before, inside).alias("ancestors"))
    paths = path.join(placed, "owner").select("ck", "depth", "tree_id", (F.col("pos") + F.col("shift")).alias("start"))
    return nodes, paths


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_units long, attention_sha256 string, misplaced long"


class _Reader:
    """Digests of one conversation from the nodes on its path, in order."""

    def __init__(self, ck: int):
        self.ck, self.turns, self.loss_chars, self.chars, self.units, self.misplaced = ck, 0, 0, 0, 0, 0
        self.said, self.loss, self.attention = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.seen: list[list[int]] = []  # intervals of the path so far, touching ones joined

    @staticmethod
    def _join(spans: list[list[int]], a: int, b: int) -> None:
        if spans and spans[-1][1] == a:
            spans[-1][1] = b
        else:
            spans.append([a, b])

    def add(self, text: str, masked: str, start: int, length: int, position: int, ancestors: list[dict]) -> None:
        shown: list[list[int]] = []
        for x in ancestors:
            self._join(shown, x["start"], x["end"])
        self.misplaced += shown != self.seen or position != self.units
        self.attention.update(f"{position}:{','.join(f'{a}-{b}' for a, b in shown)}\n".encode())
        self._join(self.seen, start, start + length)
        for role, said in parse_turns(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        masked = unescape(masked)
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())
        self.chars += len(text)
        self.units += length

    def row(self) -> tuple:
        return None if self.ck == -(2**63) else self.ck, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.units, self.attention.hexdigest(), self.misplaced


def _digesting(tokenizer: str | None):
    """Read formatted turns back; rows come sorted by conversation and depth, digests are streamed."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def digest(batches):
        decode = _tokens.counter(tokenizer).text if tokenizer else lambda x: x
        reader = None
        for batch in batches:
            out = []
            for ck, body, a, b, start, length, position, ancestors in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if reader is None or reader.ck != ck:
                    if reader is not None:
                        out.append(reader.row())
                    reader = _Reader(ck)
                reader.add(decode(body), decode(body[a:b]), start, length, position, ancestors)
            if out:
                yield pack(out)
        if reader is not None:
            yield pack([reader.row()])

    return digest


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of every conversation, read from the emitted nodes that its path points to: turns and loss text decoded
    from the bodies, attention_sha256 over positions and ancestor intervals, and misplaced, the number of nodes whose
    position or intervals are not those of the path that leads to them (0)."""
    joined = paths.join(nodes, ["tree_id", "start"])
    rows = joined.repartition("ck").sortWithinPartitions("ck", "depth")
    return rows.select("ck", "body", "loss_start", "loss_end", "start", "length", "position", "ancestors").mapInArrow(_digesting(tokenizer), _DIGEST)
