"""Chat formatting of reply trees.

Messages of a tree point at the message they answer.  Root-to-leaf paths are
found by iterative self-joins that double their reach: after round k a message
knows its ancestor 2**k above it and the scores on the way, so a path of 400
messages takes nine rounds.  Branches are ranked by the sum of their scores, and
the messages of the chosen ones are found by the same jumps, from far to near.

A path is formatted as turns::

    ### Role: text</turn>

with a line feed after each.  ``\\``, ``#``, ``<`` and ``:`` inside roles, and
``\\``, ``#`` and ``<`` inside texts, get a ``\\`` before them, so no text can
hold a control string, and removing one ``\\`` before each character gives the
text back.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelprism.llm.common import cut

__all__ = ["reply_paths", "format_paths", "format_turns", "parse_turns", "chains"]

HEAD, COLON, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, special: str) -> str:
    return re.sub(f"([{re.escape(special)}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the places of the assistant's texts in it, where the loss counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role, "\\#<:") + COLON, escape(text, "\\#<")
        parts += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``format_turns`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def chains(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as trees without branches: each row answers the one before it, by turn.

    Rows of one turn follow each other by role and text; null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    got = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return got.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, score, depth, node, role, text``: the messages of each tree's best ``branches`` root-to-leaf paths.

    ``messages`` has ``tree, node, parent, role, text, score``.  A parent that is
    not there makes a root.  Branches are ranked by the sum of their messages'
    scores (null: 0), ties by the smaller leaf.  Messages of a cycle hang on no
    root and are left out.  Of rows with one tree and node the first by parent,
    role, text and score counts; rows without a node count for nothing.  A null
    tree is a tree.  Other columns are ignored; an empty table gives an empty
    result.
    """
    first = F.min(F.struct("parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")
    # trees by a name that is never null
    name = F.when(F.col("tree").isNull(), "none").otherwise(F.concat(F.lit("tree "), F.col("tree").cast("string")))
    rows = messages.where("node is not null").withColumn("name", name).groupBy("name", "node").agg(first, F.first("tree").alias("tree")).select("name", "tree", "node", "m.*")
    rows = cut(rows)
    most = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1

    known = rows.select("name", F.col("node").alias("parent"), F.lit(True).alias("there"))
    jump = (rows.select("name", "node", "parent", "score").join(known, ["name", "parent"], "left")
            .select("name", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")))
    # round k: ``jump`` holds the messages that have an ancestor 2**k above them, ``done`` those that have reached their root
    jumps, done = [], None
    for _ in range(1 + math.ceil(math.log2(most + 1))):
        jump = cut(jump)
        jumps.append(jump.where("up is not null").select("name", "node", "up"))
        ended = jump.where("up is null").select("name", "node", "steps", "sum")
        done = ended if done is None else done.unionByName(ended)
        going = jump.where("up is not null")
        if going.isEmpty():
            break
        above = going.unionByName(done.withColumn("up", F.lit(None).cast(jump.schema["up"].dataType))).select("name", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        jump = going.join(above, ["name", "up"]).select(
            "name", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum"))
    # who never got there hangs on a cycle; ``steps`` of the others is their depth, ``sum`` their path's score
    whole = cut(done).select("name", "node", F.col("steps").alias("depth"), "sum")
    answered = rows.select("name", F.col("parent").alias("node")).distinct()
    rank = Window.partitionBy("name").orderBy(F.desc("sum"), "node")
    leaves = whole.join(answered, ["name", "node"], "left_anti").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= branches)

    path = leaves.select("name", F.col("node").alias("leaf"), "rank", F.col("sum").alias("score"), "node", "depth")
    for k in reversed(range(len(jumps))):
        further = path.join(jumps[k], ["name", "node"]).select("name", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = cut(path.unionByName(further))
    return path.join(rows.select("name", "tree", "node", "role", "text"), ["name", "node"]).select("tree", "name", "leaf", "rank", "score", "depth", "node", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """``tree, leaf, rank, score, n_turns, formatted, loss`` of each path.

    ``loss`` is ``array<struct<start, end>>`` in characters of ``formatted``.
    Null roles and texts are empty.  A path's text is one value, so its messages
    meet in one row.
    """
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = paths.groupBy("name", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"),
                                            F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for b in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in spans] for _, spans in done]
            yield pa.record_batch([*(b.column(k) for k in ("tree", "leaf", "rank", "score")), pa.array([len(t) for t in b.column("turns")], pa.int64()),
                                   pa.array([t for t, _ in done], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                  ["tree", "leaf", "rank", "score", "n_turns", "formatted", "loss"])

    kinds = dict(paths.dtypes)
    return got.select("tree", "leaf", "rank", "score", "turns").mapInArrow(
        run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, score double, n_turns long, formatted string, loss array<struct<start:long,end:long>>")
