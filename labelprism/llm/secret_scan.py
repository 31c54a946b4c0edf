"""Secret scan: plain patterns and sliding-window entropy, in DataFrame operations only.

Three patterns give the base spans.  Beyond them, candidate strings, runs of
letters of one character class, are scanned with a window: the Shannon entropy of
the letters in it is ``log2(W) - S / W`` with ``S`` the sum of ``c * log2(c)`` over
the letters' counts ``c``.  As the window moves, one letter leaves and one enters;
their two counts and ``S`` are brought up to date, nothing is counted anew.  Windows
of high entropy that overlap or touch are one span.  Candidates on the allow-list
(words without figures, dates, UUIDs, marked examples) are suppressed before.

``S`` is a sum of whole numbers (``c * log2(c)`` in units of 2**-20), so that equal
windows compare equally everywhere.  Everything happens within the row: no shuffle,
and arrays grow by bounded steps only (``PIECE`` windows, ``GROUP`` offsets), so a
long text takes time in proportion.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["CharClass", "CLASSES", "ALLOWED", "secret_spans", "span_list", "weight_limit", "WEIGHTS"]

KEY = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
#: Base patterns as matched, left to right.  A run of the last two that is too short holds no match that is long enough,
#: so their least length is in the pattern; an assignment's value is measured after the match.
ASSIGN = KEY + "[A-Za-z0-9+/_.=-]+"
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
LEAST_VALUE = 6


class CharClass(NamedTuple):
    """A class of candidate strings: its letters, the window, and the entropy in bits from which a window counts."""

    kind: str
    letters: str
    window: int
    bits: float


FIGURES, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Random hexadecimal figures have 3.3 bits in 20, random base-64 letters 4.2 bits in 24; words of a language rarely over 3.6.
CLASSES = (CharClass("entropy_hex", FIGURES + "abcdefABCDEF", 20, 3.0), CharClass("entropy_base64", FIGURES + SMALL + CAPITALS + "+/=_-", 24, 3.9))
#: Candidates that are no secrets: without figures, without letters, UUIDs, examples by name, rows of the alphabet.
ALLOWED = ("^[^0-9]+$", "^[^A-Za-z]+$", "^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
           "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx]{4}", "abcdefgh|ABCDEFGH|12345678")
#: Windows that one incremental pass lists, and offsets summed at once.
PIECE, GROUP = 1024, 256
UNIT = 1 << 20
#: c * log2(c) in units, for counts up to the longest window.
WEIGHTS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(65)]
NO_SPANS = "array<struct<start:int,end:int,s:string>>"


def weight_limit(kind: CharClass) -> int:
    """The greatest ``S`` of a window that counts."""
    return math.floor((math.log2(kind.window) - kind.bits) * kind.window * UNIT)


def letter_class(kind: CharClass) -> str:
    return "[" + "".join("\\" + x if x in "-]^\\" else x for x in kind.letters) + "]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def offsets(lengths: Column) -> Column:
    """Sums of all earlier values, for an array of lengths."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / GROUP).cast("int")), lambda g: F.slice(lengths, g * GROUP + 1, F.lit(GROUP)))
    zero = F.array(F.lit(0))
    add = lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
    sums = F.transform(groups, lambda x: F.aggregate(x, zero, add))

    def shifted(inner: Column) -> Column:
        bases = F.aggregate(F.transform(inner, lambda x: F.element_at(x, -1)), zero, add)
        both = F.arrays_zip(inner.alias("x"), F.slice(bases, F.lit(1), F.size(inner)).alias("base"))
        return F.flatten(F.transform(both, lambda z: F.transform(F.slice(z["x"], F.lit(1), F.size(z["x"]) - 1), lambda v: v + z["base"])))

    return F.when(F.size(lengths) > 0, let(sums, shifted)).otherwise(F.array().cast("array<int>"))


def places(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, s>>`` of a pattern's matches, from left to right; a match is never empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
        sizes = F.transform(found, lambda x: F.length(x))
        before = offsets(F.zip_with(gaps, sizes, lambda g, n: g + n))
        parts = F.arrays_zip(found.alias("s"), gaps.alias("gap"), sizes.alias("n"), before.alias("at"))
        return F.transform(parts, lambda p: F.struct((p["at"] + p["gap"]).alias("start"), (p["at"] + p["gap"] + p["n"]).alias("end"), p["s"].alias("s")))

    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast(NO_SPANS)))


def move(state: Column, event: Column) -> Column:
    """The window's counts after one letter entered (``by`` 1) or left (-1).

    ``counts`` has a letter of its own for each letter of the class: ``A`` for
    none in the window, ``B`` for one, and so on.
    """
    weights = F.array(*(F.lit(w) for w in WEIGHTS))

    def changed(c: Column) -> Column:
        s = state["s"] + F.element_at(weights, c + event["by"] + 1) - F.element_at(weights, c + 1)
        counts = F.overlay(state["counts"], F.char(c + event["by"] + 65), event["k"], F.lit(1))
        return F.struct(counts.alias("counts"), s.cast("long").alias("s"), F.when(event["full"], F.concat(state["all"], F.array(s.cast("long")))).otherwise(state["all"]).alias("all"))

    return let(F.ascii(F.substring(state["counts"], event["k"], F.lit(1))) - 65, changed)


def window_weights(letters: Column, kind: CharClass) -> Column:
    """``S`` of every window of an array of letter numbers, from left to right, by incremental counts."""
    w = kind.window
    enter = lambda x, i: F.struct(x.alias("k"), F.lit(1).alias("by"), (i >= w - 1).alias("full"))
    leave = lambda i: F.struct(F.get(letters, i - w).alias("k"), F.lit(-1).alias("by"), F.lit(False).alias("full"))
    events = F.flatten(F.transform(letters, lambda x, i: F.when(i < w, F.array(enter(x, i))).otherwise(F.array(leave(i), enter(x, i)))))
    start = F.struct(F.lit("A" * len(kind.letters)).alias("counts"), F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(events, start, move, lambda a: a["all"])


def hot_windows(candidate: Column, kind: CharClass) -> Column:
    """Starts of a candidate's windows of high entropy, in the text."""
    w, limit = kind.window, weight_limit(kind)
    parts = F.regexp_extract_all(candidate["s"], F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    # a piece goes on into the next by a window less one letter
    pieces = let(parts, lambda p: F.transform(F.arrays_zip(p.alias("a"), F.slice(p, F.lit(2), F.size(p)).alias("b")),
                                              lambda z: F.concat(z["a"], F.substring(F.coalesce(z["b"], F.lit("")), 1, w - 1))))
    weights = F.transform(pieces, lambda s: let(letter_numbers(s, kind), lambda k: window_weights(k, kind)))
    starts = F.transform(weights, lambda all_, j: F.filter(F.transform(all_, lambda s, i: F.when(s <= limit, candidate["start"] + j * PIECE + i)), lambda x: x.isNotNull()))
    return F.flatten(starts)


def hot_in(candidates: Column, kind: CharClass) -> Column:
    return F.flatten(F.transform(candidates, lambda x: hot_windows(x, kind)))


def letter_numbers(s: Column, kind: CharClass) -> Column:
    """The number of each letter of a string in the class, from 1."""
    return F.transform(F.filter(F.split(s, "", -1), lambda x: x != ""), lambda x: F.position(x, F.lit(kind.letters)))


def joined(starts: Column, width: int) -> Column:
    """Windows that overlap or touch, as ``array<struct<start, end>>``; starts are ascending."""
    def spans(at: Column) -> Column:
        none = F.array(F.lit(None).cast("int"))
        sides = F.arrays_zip(at.alias("x"), F.concat(none, at).alias("before"), F.slice(at, F.lit(2), F.size(at)).alias("after"))
        sides = F.slice(sides, F.lit(1), F.size(at))
        first = F.filter(sides, lambda z: z["before"].isNull() | (z["x"] > z["before"] + width))
        last = F.filter(sides, lambda z: z["after"].isNull() | (z["after"] > z["x"] + width))
        return F.zip_with(first, last, lambda a, z: F.struct(a["x"].alias("start"), (z["x"] + width).alias("end")))

    return let(starts, spans)


def secret_spans(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id, spans`` of every row: ``array<struct<start, place, kind, end>>`` in code points, by start, then kind.

    ``place`` is the kind's place in the list: assign, access, hex, then the
    classes.  Null and empty texts have no spans; null ids and repeated rows are
    rows like others; other columns are ignored; an empty table gives an empty
    result.
    """
    if any(c.window >= min(len(WEIGHTS), PIECE) for c in classes):
        raise ValueError(f"windows have at most {len(WEIGHTS) - 1} letters")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    patterns = [*BASE.values(), *(f"{letter_class(c)}{{{c.window},}}" for c in classes)]
    got = got.select("doc_id", *(places(F.col("t"), p).alias(f"f{k}") for k, p in enumerate(patterns)))
    value = lambda x: F.length(F.regexp_replace(x["s"], "^" + KEY, "")) >= LEAST_VALUE
    found = [F.filter("f0", value), F.col("f1"), F.col("f2")]
    for k, c in enumerate(classes, len(BASE)):
        candidates = F.filter(f"f{k}", lambda x: ~F.coalesce(*[F.when(x["s"].rlike(a), True) for a in allowed], F.lit(False)))
        found.append(joined(hot_in(candidates, c), c.window))
    kinds = [*BASE, *(c.kind for c in classes)]

    def named(spans: Column, place: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kinds[place]).alias("kind"), x["end"].alias("end")))

    return got.select("doc_id", F.array_sort(F.concat(*(named(x, k) for k, x in enumerate(found)))).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
