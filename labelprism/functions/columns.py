"""Reusable Spark column expressions.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen and is pushed through Catalyst like any other
expression.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WS_CLASS", "WORD_PATTERN", "word_tokens", "ws_tokens", "not_blank",
    "dot", "sq_norm", "l2_norm", "sq_dist", "argmax", "as_double_array",
    "hash_hex", "hash_uniform", "safe_key", "number_in_name", "rnd",
]

# Whitespace as Python's ``str.isspace`` sees it: ASCII controls 9-13, the
# file/group/record/unit separators 28-31, NEL, and every Unicode separator.
# Java's ``\s`` is ASCII-only and ``trim`` strips spaces only, so neither is used.
WS_CLASS = r"[\x09-\x0D\x1C-\x1F\x85\p{Z}]"

# A word token: a run of two or more letters, digits or underscores (the usual
# default token pattern of a count vectoriser, made Unicode-aware explicitly;
# Java's ``\w`` is ASCII-only).
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_tokens(col) -> Column:
    """Lower-case word tokens of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_PATTERN), 1)


def ws_tokens(col) -> Column:
    """Split on any run of whitespace, case kept, empty pieces dropped
    (``array_remove`` is generated code; a ``filter`` lambda would not be)."""
    return F.array_remove(F.split(_c(col), WS_CLASS + "+"), "")


def not_blank(col) -> Column:
    """True when the text has at least one non-whitespace character."""
    return _c(col).rlike("[^" + WS_CLASS[1:-1] + "]")


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, summed in double precision."""
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance, summed element by element in double."""
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def argmax(a) -> Column:
    """0-based index of the largest element; ties go to the lowest index."""
    arr = _c(a)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def hash_hex(key, seed: int = 42) -> Column:
    """md5 of ``'<seed>:<key>'`` — a reproducible per-row random source that
    survives recomputation (unlike ``rand()`` after an executor loss)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash_uniform(key, seed: int = 42) -> Column:
    """Uniform [0, 1) value from the first 32 bits of :func:`hash_hex`."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def safe_key(col) -> Column:
    """File-name-safe form of a label: space, slash, backslash, colon → '_'."""
    return F.translate(_c(col), " /\\:", "____")


def number_in_name(col) -> Column:
    """The first run of digits in a name (``Topic10`` → 10), 0 where there is
    none (``Default``) or the run is no 64-bit number."""
    return F.coalesce(F.regexp_extract(_c(col), r"(\d+)", 1).try_cast("bigint"), F.lit(0))


def rnd(col, places: int = 6) -> Column:
    return F.round(_c(col), places)
