"""Conversation repair: the agenda against all short edit sequences, the query against a plain dynamic program."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelprism.llm import queries, repair
from tests.conftest import SF_SMALL

WORD, LEGAL = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"(s?(ua)+)?")
SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()),
                     StructField("conv", StringType()), StructField("pos", StringType()), StructField("tag", StringType()), StructField("audit", StringType())])


def weight(rows, letters):
    """Cost of an audit, or None if it gives no legal conversation; rows are (initial, must_go, truncated)."""
    cost, out, i = 0, "", 0
    odd = sum(x != "D" for x in letters) % 2
    for letter in letters:
        if letter != "I":
            if i == len(rows):
                return None
            initial, must_go, truncated = rows[i]
            i += 1
            if letter == "D":
                cost += 2
                continue
            if must_go:
                return None
            cost += 5 * truncated + (letter == "R")
        else:
            cost += 5
        n = len(out)
        out += (initial or "-") if letter == "K" else "ua"[(n - odd) % 2]
    return cost if i == len(rows) and LEGAL.fullmatch(out) else None


def test_agenda_against_all_audits():
    rng = random.Random(0)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        every = ("".join(p) for n in range(len(rows) + 3) for p in itertools.product("DIKR", repeat=n))
        best = min((w, a) for a in every if (w := weight(rows, a)) is not None)
        assert repair.lightest([repair.edits_of(*r) for r in rows])[None] == best


def plain_edits(rows):
    """The cheapest, then least audit: all states row by row, with up to two insertions before each."""
    step = {"0": "u", "s": "u", "u": "a", "a": "u"}
    best = {"0": (0, "")}

    def with_insertions(best):
        out = dict(best)
        for _ in range(2):
            for q, (c, l) in list(out.items()):
                out[step[q]] = min(out.get(step[q], (10**9, "")), (c + 5, l + "I"))
        return out

    for initial, must_go, truncated in rows:
        new = {}
        for q, (c, l) in with_insertions(best).items():
            ways = [(q, 2, "D")]
            if not must_go:
                ways += [(step[q], 1 + 5 * truncated, "R")] + [(r, 5 * truncated, "K") for r in (step[q], "s") if initial == r and (r != "s" or q == "0")]
            for r, cost, letter in ways:
                new[r] = min(new.get(r, (10**9, "")), (c + cost, l + letter))
        best = new
    return min(w for q, w in with_insertions(best).items() if q in "0a")


def plain_query(rows):
    out, groups = [], {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        group = groups.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            group += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in group:
            letters = WORD.findall(text)
            kinds.append("blank" if not letters else "dup" if (role, text) in seen else "cut" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in group]
        turns = [t for t, _, _ in group if t is not None]
        cost, audit = plain_edits([(x, k in ("blank", "dup"), k == "cut") for x, k in zip(initials, kinds)])
        lines, i, odd = [], 0, sum(x != "D" for x in audit) % 2
        for letter in audit:
            role = ["user", "assistant"][(len(lines) - odd) % 2]
            if letter in "KR":
                lines.append(f"{group[i][1] if letter == 'K' else role}:{group[i][2]}")
            elif letter == "I":
                lines.append(f"{role}:")
            i += letter != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("dup"), kinds.count("cut"),
                    sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, monkeypatch, rows):
    frame = spark.createDataFrame([(*r, "c", "p", "t", "a") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "read", lambda *a: frame)
    return sorted(map(tuple, queries.op13_conversation_repair(spark, "").collect()), key=repr)


def odd_conversations():
    rng = random.Random(3)
    texts = [None, "", " \t", "One.", "Two!", "open end", "Ümlaut? ", "x" * 3000, "line\nline.", "nul \u0000.", ".", "a "]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "assistant", "user"]
    rows = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for conv in [*range(30), None, -5] for _ in range(rng.randint(1, 9))]
    rows += rows[:20]  # repeated rows
    rows += [(99, t, "user", "same text.") for t in range(60)] + [(98, None, "user", "no turns.")] * 3
    # a conversation all of whose rows are dropped
    gone = next(c for c in range(1000, 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Gone.")]


def test_odd_rows(spark, monkeypatch):
    rows = odd_conversations()
    assert run(spark, monkeypatch, rows) == plain_query(rows)
    assert run(spark, monkeypatch, []) == []


@pytest.mark.parametrize("block", [4, 512])
def test_long_conversation_in_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "repair_conversations", functools.partial(repair.repair_conversations, block=block, fan=3))
    rng = random.Random(block)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "user"]), f"Text {rng.randint(0, 900)}{rng.choice(['.', '!', ''])}") for t in range(block * 6)]
    rows += [(c, t, r, "Hi.") for c in range(40) for t, r in enumerate(["system", "user", "assistant"])]
    assert run(spark, monkeypatch, rows) == plain_query(rows)


def test_whole_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op13_conversation_repair(spark, SF_SMALL).collect()), key=repr)
    assert got == plain_query(rows)


def test_repaired_rows_are_legal(spark):
    rows = spark.createDataFrame([(*r, "c", "p", "t", "a") for r in odd_conversations()], SCHEMA)
    repairs, repaired = repair.repair_conversations(rows)
    by_conv = {}
    for r in repaired.collect():
        by_conv.setdefault(r.conv_id, []).append((r.place, r.role[:1]))
    assert all(LEGAL.fullmatch("".join(x for _, x in sorted(v))) and [p for p, _ in sorted(v)] == list(range(len(v))) for v in by_conv.values())
    assert len(by_conv) > 20 and repairs.count() == len({r[0] for r in odd_conversations()})
