"""Chat formatting as prefix trees: shared initial turns are emitted once, depth first.

Conversations are put in the order of their turns' hashes; in that order, a conversation's new turns are those
beyond what it shares with the one before it, so appending them gives the depth-first walk of the prefix tree.
The walk is cut into packs of bounded size.  A pack is one training sequence: a node holds its span, its first
position id (the length of its ancestors) and the spans that its tokens may attend to (ancestors and itself).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that the template or common chat formats give a meaning to; none survives inside a text.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<bos>", "<eos>", "<pad>")
#: Characters after which a pack ends, with the conversation that reaches it; each conversation counts as more.
PACK_CHARS, CONVERSATION_COST = 1 << 18, 64
_START = re.compile("|".join(f"(?={re.escape(c)})(?s:.)" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string; reversible."""
    return _START.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted string, and where its text lies in it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])
_PACK = pa.schema([("pack", pa.string()), ("text", pa.string()), ("nodes", pa.list_(_NODE)), ("conversations", pa.list_(_MEMBER))])
_PACK_DDL = "pack string, text string, nodes array<struct<parent: int, start: bigint, stop: bigint, position: bigint, loss_start: bigint, loss_stop: bigint, attends: array<struct<start: bigint, stop: bigint>>>>, conversations array<struct<conv_id: bigint, leaf: int>>"


class Packer:
    """Builds one pack from conversations that come in tree order."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[str, str, int]] = []  # role, text and node of the last conversation's turns

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][:2] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            parent = self.path[-1][2] if self.path else -1
            above = self.nodes[parent] if self.path else None
            formatted, lo, hi = render(role, text)
            start, stop = self.length, self.length + len(formatted)
            attends = [*above["attends"]] if above else []
            if attends and attends[-1]["stop"] == start:
                attends[-1] = {"start": attends[-1]["start"], "stop": stop}
            else:
                attends.append({"start": start, "stop": stop})
            taught = role == "assistant"
            self.nodes.append({"parent": parent, "start": start, "stop": stop, "position": above["position"] + above["stop"] - above["start"] if above else 0, "loss_start": start + lo if taught else start, "loss_stop": start + hi if taught else start, "attends": attends})
            self.path.append((role, text, len(self.nodes) - 1))
            self.parts.append(formatted)
            self.length = stop
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][2] if self.path else -1})

    def full(self) -> bool:
        return self.length + CONVERSATION_COST * len(self.members) >= PACK_CHARS

    def row(self, name: str) -> dict:
        return {"pack": name, "text": "".join(self.parts), "nodes": self.nodes, "conversations": self.members}


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Packs of ``conversations(conv_id, turn, role, text)``: ``pack, text, nodes, conversations``.

    Turns are ordered by ``turn``, then role and text (ties, repeats and null turns, first, stay as turns of
    their own).  Null roles and texts count as empty.  Only turns of role ``assistant`` are under the loss.
    Other columns are not read; no rows give no packs.  A tree with many conversations spans several packs, each
    with its own copy of the path to its first node, because tokens attend within a pack only; a range of the
    order with its ties broken by id goes to each task, so a common first turn does not gather in one.  One
    conversation's turns are held together, as one training example.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat_ws("\n", t["role"], t["text"]).cast("binary")), 1, 16)), "")
    whole = whole.select("conv_id", "turns", path.alias("path"))
    ordered = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").drop("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, packer = TaskContext.get().partitionId(), 0, Packer()
        for batch in batches:
            for at in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[at].as_py()]
                packer.add(batch.column("conv_id")[at].as_py(), turns)
                if packer.full():
                    yield pa.RecordBatch.from_pylist([packer.row(f"{task:06d}-{count:06d}")], _PACK)
                    count, packer = count + 1, Packer()
        if packer.members:
            yield pa.RecordBatch.from_pylist([packer.row(f"{task:06d}-{count:06d}")], _PACK)

    return ordered.mapInArrow(run, _PACK_DDL)


_TOKENS = "pack string, tokens array<int>, position_ids array<int>, loss_mask array<boolean>, nodes array<struct<parent: int, start: bigint, stop: bigint, attends: array<struct<start: bigint, stop: bigint>>>>, conversations array<struct<conv_id: bigint, leaf: int>>"


def token_packs(packs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Packs in token units: ``pack, tokens, position_ids, loss_mask, nodes, conversations``.

    ``tokenizer_path`` is a tokenizer file in JSON, read by Spark (so any store will do) and sent to the tasks; its
    size is that of one vocabulary.  Every node is tokenized by itself, so a shared turn has the same tokens under
    all of its continuations.  A token is under the loss if it covers a character of an assistant text.
    """
    spark = packs.sparkSession
    model = spark.read.text(tokenizer_path, wholetext=True).first()[0]
    sent = spark.sparkContext.broadcast(model)
    names = ["pack", "tokens", "position_ids", "loss_mask", "nodes", "conversations"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(sent.value)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        node_type = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("attends", pa.list_(span))])
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(node_type), pa.list_(_MEMBER))
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                tokens, positions, mask, nodes = [], [], [], []
                coded = tokenizer.encode_batch([row["text"][n["start"] : n["stop"]] for n in row["nodes"]], add_special_tokens=False)
                for node, code in zip(row["nodes"], coded):
                    above = nodes[node["parent"]] if node["parent"] >= 0 else None
                    first = above["first"] + above["stop"] - above["start"] if above else 0
                    start, stop = len(tokens), len(tokens) + len(code.ids)
                    lo, hi = node["loss_start"] - node["start"], node["loss_stop"] - node["start"]
                    attends = [*above["attends"]] if above else []
                    if attends and attends[-1]["stop"] == start:
                        attends[-1] = {"start": attends[-1]["start"], "stop": stop}
                    else:
                        attends.append({"start": start, "stop": stop})
                    tokens += code.ids
                    positions += range(first, first + len(code.ids))
                    mask += [lo < hi and a < hi and b > lo for a, b in code.offsets]
                    nodes.append({"parent": node["parent"], "start": start, "stop": stop, "attends": attends, "first": first})
                plain = [{k: n[k] for k in ("parent", "start", "stop", "attends")} for n in nodes]
                data = [[row["pack"]], [tokens], [positions], [mask], [plain], [row["conversations"]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names)

    return packs.select("pack", "text", "nodes", "conversations").mapInArrow(run, _TOKENS)


def read_back(packs: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from packs alone.

    A conversation is the text of the spans that its last turn attends to; its loss text is unescaped from the
    loss spans of the nodes on its path.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text, nodes, rows = batch.column("text")[at].as_py(), batch.column("nodes")[at].as_py(), []
                for member in batch.column("conversations")[at].as_py():
                    leaf, losses = member["leaf"], []
                    formatted = "".join(text[s["start"] : s["stop"]] for s in nodes[leaf]["attends"]) if leaf >= 0 else ""
                    while leaf >= 0:
                        node = nodes[leaf]
                        losses.append(unescape(text[node["loss_start"] : node["loss_stop"]]))
                        leaf = node["parent"]
                    loss, turns = "".join(reversed(losses)), parse(formatted)
                    digest = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((member["conv_id"], len(turns), digest, len(loss), sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """Formats, stores the packs, and reads the digests back from what was stored."""
    return read_back(stash(format_conversations(conversations), "chat-packs"))
