"""Chat formatting as a prefix tree: conversations that begin alike share the tokens of their common turns.

A turn is written ``### role: text</turn>`` with a new line behind. Inside roles and texts a backslash goes
before every backslash and ``#``, and between ``<`` and ``/turn>``; in roles also before ``:``. No control
string is left in them, and taking each backslash away from the character behind it gives the text back.

Conversations are dealt by ranges of their path (the chain of hashes of their turns), so that those with
common first turns lie next to each other; a hot beginning spreads over as many tasks as its range needs.
Each task walks its conversations in order and emits every node of the tree once, depth first, packed in
segments of bounded size, for a segment is one training sequence. A segment that begins inside a tree starts
with the nodes of the open path as context; these are marked as repeated, so that their texts, which another
segment has under its loss mask, are learned once. Without bounds, trees are dealt by their first turn and
stay whole, and no node is ever repeated; a tree must then fit a task. Tokens are code points.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
ASSISTANT = "assistant"
#: Defaults: a segment is closed once it holds this many code points, or this many conversations.
SEGMENT_CHARS, SEGMENT_CONVERSATIONS = 1 << 17, 1024

_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)

NODE = (
    "segment string, node int, parent int, depth int, repeated boolean, role string, formatted string, start long, position long, n_tokens long, "
    "attends array<struct<from: long, to: long>>, loss_from long, loss_to long, conv_ids array<{id}>"
)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("#", "\\#").replace(CLOSE, "<\\/turn>")
    return out.replace(":", "\\:") if role else out


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends."""
    head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _pack(most_chars: int | None, most_conversations: int | None):
    def run(batches):
        """Nodes of the prefix trees of conversations that come in path order."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        segment, nodes, path, chars, conversations, last = 0, [], [], 0, 0, []

        def frame() -> pd.DataFrame:
            return pd.DataFrame([n["row"] for n in nodes])

        for batch in batches:
            for conv, turns in zip(batch["conv_id"], batch["turns"]):
                key = [(t["role"], t["text"]) for t in turns]
                whole = most_chars is None and (not last or last[0] == key[0])
                if nodes and not whole and (chars >= (most_chars or 0) or conversations >= most_conversations):
                    yield frame()
                    segment, nodes, path, chars, conversations = segment + 1, [], [], 0, 0
                old = 0  # turns that an earlier segment of this task has emitted
                while old < min(len(last), len(key)) and last[old] == key[old]:
                    old += 1
                same, last = 0, key
                while same < min(len(path), len(key)) and path[same]["key"] == key[same]:
                    same += 1
                path = path[:same]
                for role, text in key[same:]:
                    formatted, a, b = turn(role, text)
                    up = path[-1] if path else None
                    attends = list(up["row"]["attends"]) if up else []
                    if up:
                        open_ = (up["row"]["start"], up["row"]["start"] + up["row"]["n_tokens"])
                        if attends and attends[-1]["to"] == open_[0]:
                            attends[-1] = {"from": attends[-1]["from"], "to": open_[1]}
                        else:
                            attends.append({"from": open_[0], "to": open_[1]})
                    loss = role == ASSISTANT
                    row = {
                        "segment": f"{task}-{segment}", "node": len(nodes), "parent": up["row"]["node"] if up else -1, "depth": len(path), "repeated": len(path) < old, "role": role, "formatted": formatted,
                        "start": chars, "position": up["row"]["position"] + up["row"]["n_tokens"] if up else 0, "n_tokens": len(formatted), "attends": attends,
                        "loss_from": a if loss else 0, "loss_to": b if loss else 0, "conv_ids": [],
                    }
                    path.append({"key": (role, text), "row": row})
                    nodes.append(path[-1])
                    chars += len(formatted)
                path[-1]["row"]["conv_ids"].append(conv)
                conversations += 1
        if nodes:
            yield frame()

    return run


def formatted_tree(conversations: DataFrame, segment_chars: int | None = SEGMENT_CHARS, segment_conversations: int | None = SEGMENT_CONVERSATIONS) -> DataFrame:
    """Packs conversations (conv_id, turn, role, text; a row for each turn) into prefix trees.

    Returns a row for each node, that is each turn at its place in a tree: segment; node, parent (-1: a root)
    and depth; repeated (the node is context that an earlier segment of the task has as well); role; formatted;
    start (of its tokens in the segment) and position (of its first token in each conversation through it: token
    k of the node has position id position + k); n_tokens; attends (intervals of the segment's tokens that all
    its tokens see, beside those before them in the node: its ancestors, merged where they touch); loss_from and
    loss_to (the part of the node under the loss mask, empty but for assistant texts; of repeated nodes it is to
    be left out in training); conv_ids (of the conversations that end here).

    A segment is closed after ``segment_chars`` code points or ``segment_conversations`` conversations, and the
    next one starts with the open path: shared turns stand once in each segment. With None for both, each tree,
    that is all conversations with one first turn, is one segment, and shared turns stand exactly once.
    Turns go by turn, then role, then text; nulls are empty, a null turn comes first; rows without a conv_id make
    one conversation. Repeated rows are repeated turns. An empty table gives an empty result; other columns are
    ignored. A conversation is the unit of output and must fit a task.
    """
    if (segment_chars is None) != (segment_conversations is None):
        raise ValueError("bound segments by characters and conversations, or by neither")
    fields = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    chain = F.aggregate("turns", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")), x["role"], x["text"]))))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = turns.withColumn("path", chain)
    dealt = turns.repartition(F.get("path", F.lit(0))) if segment_chars is None else turns.repartitionByRange("path", "conv_id")
    return dealt.sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInPandas(_pack(segment_chars, segment_conversations), NODE.format(id=kind))


def _read(group: pd.DataFrame) -> pd.DataFrame:
    at = {r.node: r for r in group.itertuples()}
    out = []
    for r in group.itertuples():
        if not len(r.conv_ids):
            continue
        path, up = [], r.node
        while up >= 0:
            path.append(at[up])
            up = at[up].parent
        path.reverse()
        formatted = "".join(n.formatted for n in path)
        said = parse(formatted)
        loss = "".join(unescape(n.formatted[n.loss_from : n.loss_to]) for n in path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        row = (len(said), sha("".join(f"{role}\n{text}\n" for role, text in said)), len(loss), sha(loss), len(formatted))
        out.extend((conv, *row) for conv in r.conv_ids)
    return pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(tree: DataFrame) -> DataFrame:
    """What the nodes of ``formatted_tree`` say of each conversation, from the formatted text alone."""
    kind = tree.schema["conv_ids"].dataType.elementType.simpleString()
    return tree.groupBy("segment").applyInPandas(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
