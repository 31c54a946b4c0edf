"""Conversation repair as a lightest derivation, by Knuth's agenda.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Items are
``reach(i, q)``: the first ``i`` rows are dealt with and the roles written so far
end in state ``q`` (nothing, s, u or a).  Every row is an axiom that offers edits,
and a deduction makes ``reach(i + 1, r)`` from ``reach(i, q)`` and an edit of row
``i``; an insertion leads from ``reach(i, q)`` to ``reach(i, r)``; the goal follows
from an allowed last state.  A derivation weighs ``(cost, audit)``, the audit being
the letters of its edits; adding an edit raises both, so that items popped from the
agenda in order of weight are final, the goal's first pop is the answer, and equal
costs are settled by the least audit.

Rows get their places over all conversations from a range sort.  Rows of one
conversation in one block of ``BLOCK`` places are a *piece*: its agenda runs by
itself, from each state it may be entered in.  A conversation of several pieces is
joined in rounds, ``FAN`` pieces at a time, by the same agenda whose axioms are then
``piece(k, q, r)``.  So no task holds a long conversation's rows, only its weights.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import cut
from labelprism.operators.ordinal import sorted_ordinal

__all__ = ["lightest", "edits_of", "repair_conversations", "conversation_digests"]

#: States by what was written last: nothing, s, u, a.  What has to come next, and where the goal can be reached from.
NOTHING, S, U, A = range(4)
NEXT, GOALS = (U, U, A, U), (NOTHING, A)
ROLE = {U: "user", A: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK, FAN = 512, 8
WORD = r"[^\x20\x09-\x0D]"


@functools.lru_cache(maxsize=64)
def edits_of(initial: str, must_go: bool, truncated: bool) -> tuple:
    """A row's edits: for every state the ``(next state, cost, letter)`` to be had."""
    stay = TRUNCATED if truncated else 0
    out = []
    for q in (NOTHING, S, U, A):
        edits = [(q, DELETE, "D")]
        if not must_go:
            edits.append((NEXT[q], REROLE + stay, "R"))
            if initial == "s" and q == NOTHING:
                edits.append((S, stay, "K"))
            if initial == "ua"[NEXT[q] - U]:
                edits.append((NEXT[q], stay, "K"))
        out.append(tuple(edits))
    return tuple(out)


def lightest(axioms: list, start: int = NOTHING, insert: bool = True, goal: bool = True) -> dict:
    """Lightest derivations over a list of axioms from a state: ``{state: (cost, audit)}``.

    With ``goal`` insertions may follow the last axiom, the agenda stops as the goal
    is popped, and its weight is the only entry, under ``None``; without, every
    last state's weight is found.
    """
    n, final, done = len(axioms), {}, set()
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i > n:
            return {None: (cost, audit)}
        if i < n:
            for r, c, letters in axioms[i][q]:
                if (i + 1, r) not in done:
                    heapq.heappush(agenda, (cost + c, audit + letters, i + 1, r))
        elif goal:
            if q in GOALS:
                heapq.heappush(agenda, (cost, audit, n + 1, NOTHING))
        else:
            final[q] = (cost, audit)
            continue
        if insert and (i, NEXT[q]) not in done:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[q]))
    return final


#: A piece of a conversation: its weights, its pairs of rows that may not follow each other, its first and last initial.
PATHS = "array<struct<q:int,r:int,cost:long,audit:string>>"
PIECE = f"conv string, part long, lo long, paths {PATHS}, illegal long, first string, last string"
PATH_TYPE = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
PAIRS = {"su", "ua", "au"}


def piece_batch(rows: list) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), PATH_TYPE, pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv", "part", "lo", "paths", "illegal", "first", "last"])


def paths_from(axioms: list, starts, insert: bool) -> list[dict]:
    return [{"q": q, "r": r, "cost": c, "audit": a} for q in starts for r, (c, a) in lightest(axioms, q, insert, goal=False).items()]


def rows_to_pieces(block: int):
    """The agenda of every piece: insertions stand before a row of it; it may be entered in any state unless it begins within its block."""

    def run(batches):
        for b in batches:
            out = []
            for conv, part, found in zip(b.column("conv").to_pylist(), b.column("part").to_pylist(), b.column("found").to_pylist()):
                initials = [x["initial"] for x in found]
                axioms = [edits_of(x["initial"], x["must_go"], x["truncated"]) for x in found]
                lo = found[0]["pos"]
                starts = (NOTHING,) if lo % block else (NOTHING, S, U, A)
                out.append((conv, part, lo, paths_from(axioms, starts, True), sum(x + y not in PAIRS for x, y in zip(initials, initials[1:])), initials[0], initials[-1]))
            if out:
                yield piece_batch(out)

    return run


def join_pieces(batches):
    """Pieces in a row as one, by the agenda over their weights."""
    for b in batches:
        out = []
        for conv, part, found in zip(b.column("conv").to_pylist(), b.column("part").to_pylist(), b.column("found").to_pylist()):
            axioms = [[[(p["r"], p["cost"], p["audit"]) for p in x["paths"] if p["q"] == q] for q in range(4)] for x in found]
            starts = sorted({p["q"] for p in found[0]["paths"]})
            seams = sum(x["last"] + y["first"] not in PAIRS for x, y in zip(found, found[1:]))
            out.append((conv, part, found[0]["lo"], paths_from(axioms, starts, False), seams + sum(x["illegal"] for x in found), found[0]["first"], found[-1]["last"]))
        if out:
            yield piece_batch(out)


def goal_of(batches):
    """Whole conversations: the goal's weight."""
    for b in batches:
        best = []
        for paths in b.column("paths").to_pylist():
            ways = [(p["r"], p["cost"], p["audit"]) for p in paths if p["q"] == NOTHING]
            best.append(lightest([[ways, (), (), ()]])[None])
        yield pa.record_batch([b.column("conv"), b.column("lo"), b.column("illegal"), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())],
                              ["conv", "lo", "illegal", "cost", "audit"])


def written_rows(batches):
    """What an audit writes: ``conv, place``, the place of the row it comes from (null: inserted) and its role (null: the row's own)."""
    def batch(conv, rows):
        place, pos, role = zip(*rows)
        return pa.record_batch([pa.array([conv] * len(rows), pa.string()), pa.array(place, pa.int64()), pa.array(pos, pa.int64()), pa.array(role, pa.string())],
                               ["conv", "place", "pos", "new_role"])

    for b in batches:
        for conv, lo, audit in zip(*(b.column(c).to_pylist() for c in ("conv", "lo", "audit"))):
            rows, place, pos, q = [], 0, lo, NOTHING
            opens = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with s
            for letter in audit:
                if letter != "D":
                    q = S if opens and place == 0 else NEXT[q]
                    rows.append((place, None if letter == "I" else pos, None if letter == "K" else ROLE[q]))
                    place += 1
                pos += letter != "I"
                if len(rows) == 1 << 14:
                    yield batch(conv, rows)
                    rows = []
            if rows:
                yield batch(conv, rows)


def conversation_key(conv_id: Column) -> Column:
    """The conversation as a string without nulls."""
    return F.concat(F.when(conv_id.isNull(), "0").otherwise("1"), F.coalesce(conv_id.cast("string"), F.lit("")))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, tag, copy, pos`` and the faults of every row; ``pos`` counts all rows by conversation, turn, role and text.

    Equal rows are counted first and numbered from their count, so that many of
    them are dealt over tasks like others.
    """
    last = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    found = rows.withColumns({"blank": ~F.col("text").rlike(WORD), "cut": ~last}).groupBy("conv", "turn", "role", "tag", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    placed = sorted_ordinal(found, ["conv", "turn", "role", "tag", "copy"], "pos")
    again = placed.groupBy("conv", "role", "tag").agg(F.min("pos").alias("earliest"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    twice = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("earliest"), F.lit(False))
    got = placed.join(again, ["conv", "role", "tag"], "left").withColumn("twice", twice)
    return got.select("conv", "turn", "role", "tag", "copy", "pos", "blank", "twice", (~F.col("blank") & ~F.col("twice") & F.col("cut")).alias("truncated"))


def whole_conversations(pieces: DataFrame, fan: int) -> DataFrame:
    """Pieces joined until every conversation is one."""
    pieces = cut(pieces)
    parts = pieces.groupBy("conv").agg(F.min("part").alias("base"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rounds = math.ceil(math.log(parts.agg(F.max("n")).head()[0] or 1, fan) - 1e-9)
    if not rounds:
        return pieces
    several = pieces.join(parts, "conv").withColumn("part", F.col("part") - F.col("base")).select(*pieces.columns)
    for _ in range(rounds):
        fields = F.struct("part", "lo", "paths", "illegal", "first", "last")
        several = cut(several.groupBy("conv", F.floor(F.col("part") / fan).alias("part")).agg(F.sort_array(F.collect_list(fields)).alias("found")).mapInArrow(join_pieces, PIECE))
    return pieces.join(parts, "conv", "left_anti").unionByName(several)


def repair_conversations(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Repairs of conversations, and their repaired rows, of a table ``conv_id, turn, role, text``.

    The first has a row per conversation: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit``; the second ``conv_id, place, role, text``,
    with no rows for a conversation of which nothing is left.  Rows are taken by
    turn (null first), then role, then the text's SHA-256.  Null roles and texts
    count as one space; a role without a first letter (empty) or with another
    than s, u or a cannot be kept; null conversation ids are one conversation;
    repeated rows are duplicates of the first; other columns are ignored; an
    empty table gives two empty ones.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    tag = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    plain = rows.select("conv_id", conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    plain = plain.withColumn("tag", tag)
    ordered = cut(ordered_rows(plain.select("conv", "turn", "role", "tag", "text")))

    fault = F.struct("pos", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("twice")).alias("must_go"), "truncated")
    pieces = ordered.groupBy("conv", F.floor(F.col("pos") / block).alias("part")).agg(F.sort_array(F.collect_list(fault)).alias("found")).mapInArrow(rows_to_pieces(block), PIECE)
    solved = cut(whole_conversations(pieces, fan).mapInArrow(goal_of, "conv string, lo long, illegal long, cost long, audit string"))

    # turns are counted once each before they meet in their conversation
    per_turn = ordered.groupBy("conv", "turn").agg(*(F.count_if(c).alias(c) for c in ("blank", "twice", "truncated")))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = per_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "twice", "truncated")))
    ids = plain.groupBy("conv").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    repairs = ids.join(counts, "conv").join(solved, "conv").select("conv_id", "gaps", "blank", F.col("twice").alias("duplicate"), "truncated", "illegal", "cost", "audit")

    written = solved.select("conv", "lo", "audit").mapInArrow(written_rows, "conv string, place long, pos long, new_role string")
    own = plain.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("own"), F.col("tag").alias("g"), "text").dropDuplicates(["c", "t", "own", "g"])
    kept = written.where("pos is not null").join(ordered.select("pos", "turn", "role", "tag"), "pos")
    same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("own")) & (F.col("tag") == F.col("g"))
    filled = kept.join(own, same).select("conv", "place", F.coalesce("new_role", "role").alias("role"), "text")
    new = written.where("pos is null").select("conv", "place", F.col("new_role").alias("role"), F.lit("").alias("text"))
    repaired = filled.unionByName(new).join(ids, "conv").select("conv_id", "place", "role", "text")
    return repairs, repaired


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` (by :func:`conversation_key`) of the rows ``role:text``, joined by newlines.

    A conversation's rows pass through one task one after the other, as the digest
    asks for; none of them is held.
    """
    def run(batches):
        conv, digest = None, None
        for b in batches:
            out = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "role", "text"))):
                if c == conv:
                    digest.update(b"\n")
                else:
                    if conv is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            if out:
                yield digests(out)
        if conv is not None:
            yield digests([(conv, digest.hexdigest())])

    def digests(rows):
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], ["conv", "repaired_sha256"])

    rows = repaired.select(conversation_key(F.col("conv_id")).alias("conv"), "place", "role", "text")
    return rows.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, "conv string, repaired_sha256 string")
