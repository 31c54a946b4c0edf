"""Periodic runs of words: block convolutions at dyadic scales.

A run is a stretch of consecutive words with smallest period ``q`` and length of
at least ``max(least, powers * q)`` words that no neighbouring word extends.

* At scale ``B``, a power of two, the words are cut into blocks of ``B``.  A run
  with a period from ``B`` to ``2B - 1`` holds a whole block and the block's
  copy one period later.  The lowest scale also takes all shorter periods.
* The sum of squared differences of a block and every stretch of the window that
  follows is a convolution, taken by number-theoretic transforms for all blocks
  at once.  It is exact: as many primes are used as the largest possible sum
  asks for.  A sum of zero is an occurrence of the block, its distance a seed.
* A block can have such an occurrence only if each of its words comes again
  within the window; blocks for which that fails are not convolved.
* A seed is extended to both sides while words one distance apart are equal, by
  doubling steps over hashes of ranges; what comes out long enough is compared
  word by word.  Of the periods of one stretch the smallest stays.

The texts of a slice are one sequence here, with a word of its own after each
text, so that a transform serves many short texts.  Nothing is shuffled; a task
holds one slice, or one text if that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import bodies, edges, slices, words_of
from labelprism.llm.hashing import U, mix, powers

__all__ = ["squared_differences", "runs_in", "periodic_runs"]

#: Primes below 2**31 with a primitive root; transforms of up to 2**25 places (fixed values).
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Places that are transformed, and seeds that are extended, at once.
CELLS, SEEDS = 1 << 20, 1 << 18


def modulo(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // U(p) * U(p)


_ROOTS: dict[tuple[int, int, int], np.ndarray] = {}


def roots(p: int, root: int, half: int) -> np.ndarray:
    """Powers 0 to ``half - 1`` of a root of unity of order ``2 * half``."""
    if (p, root, half) not in _ROOTS:
        step = pow(root, (p - 1) // (2 * half), p)
        got = np.ones(1, U)
        while len(got) < half:
            got = np.concatenate((got, modulo(got * U(pow(step, len(got), p)), p)))
        _ROOTS[p, root, half] = got
    return _ROOTS[p, root, half]


def transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Number-theoretic transform along the first axis (a power of two long), in bit-reversed order."""
    n, columns = x.shape
    half = n // 2
    while half:
        v = x.reshape(n // (2 * half), 2, half, columns)
        a, b = v[:, 0], v[:, 1]
        w = roots(p, root, half)[None, :, None]
        x = np.stack((modulo(a + b, p), modulo((a + (U(p) - b)) * w, p)), axis=1).reshape(n, columns)
        half //= 2
    return x


def inverse(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The values of a transform in bit-reversed order."""
    n, columns = x.shape
    back, half = pow(root, p - 2, p), 1
    while half < n:
        v = x.reshape(n // (2 * half), 2, half, columns)
        a, b = v[:, 0], modulo(v[:, 1] * roots(p, back, half)[None, :, None], p)
        x = np.stack((modulo(a + b, p), modulo(a + (U(p) - b), p)), axis=1).reshape(n, columns)
        half *= 2
    return modulo(x * U(pow(n, p - 2, p)), p)


def squared_differences(block: np.ndarray, window: np.ndarray, p: int, root: int) -> np.ndarray:
    """Modulo ``p``: sum over k of (block[k] - window[d + k])**2, for every shift d (rows) and column.

    ``window`` is as long as the transform; shifts go up to its length less the
    block's, which the cyclic convolution does not wrap.
    """
    size, b = len(window), len(block)
    turned = np.zeros_like(window)
    turned[0] = block[0]
    turned[size - b + 1:] = block[:0:-1]  # the block backwards, so that the product is a correlation
    both = inverse(modulo(transform(turned, p, root) * transform(window, p, root), p), p, root)[: size - b + 1]
    square = np.zeros((size + 1, window.shape[1]), U)
    np.cumsum(modulo(window * window, p), axis=0, out=square[1:])
    own = modulo(modulo(block * block, p).sum(axis=0, dtype=U), p)
    around = modulo(square[b:] - square[: size - b + 1], p)
    return modulo(own[None, :] + around + U(2) * (U(p) - both), p)


def occurrences(codes: np.ndarray, starts: np.ndarray, b: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ``b`` words at ``starts`` that stand again ``shortest`` to ``2b - 1`` words on: starts and distances."""
    found = [(np.zeros(0, np.int64),) * 2]
    shifts = 2 * b - shortest
    size = 1 << (b + shifts - 2).bit_length()
    beyond = int(codes.max(initial=0)) + 1  # stands for places after the end; no block has it
    bound, primes = b * beyond ** 2, 1
    while np.prod([p for p, _ in PRIMES[:primes]], dtype=object) <= bound:
        primes += 1
        if primes > len(PRIMES):
            raise ValueError(f"blocks of {b} words with {beyond} different ones are beyond the exact range")
    step = max(1, CELLS // size)
    for k in range(0, len(starts), step):
        at = starts[k: k + step]
        places = at[None, :] + np.arange(shortest + size)[:, None]
        values = np.where(places < len(codes), codes[np.minimum(places, len(codes) - 1)], beyond).astype(U)
        hit = True
        for p, root in PRIMES[:primes]:
            hit = hit & (squared_differences(values[:b], values[shortest:], p, root)[:shifts] == 0)
        d, row = np.nonzero(hit)
        found.append((at[row], d + shortest))
    return tuple(np.concatenate(x) for x in zip(*found))


class Ranges:
    """Hashes of ranges of a sequence, to compare a range with the one some places on."""

    def __init__(self, codes: np.ndarray, salt: int):
        self.n = len(codes)
        self.up = powers(self.n)[0]
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(mix(codes.astype(U) + U(1 + (salt << 40))) * self.up[: self.n], out=self.sums[1:])

    def same(self, at: np.ndarray, length: int, shift: np.ndarray) -> np.ndarray:
        """Whether ``length`` values at ``at`` are those ``shift`` places on; false where that is outside."""
        ok = (at >= 0) & (at + length + shift <= self.n)
        a, d = np.where(ok, at, 0), np.where(ok, shift, 0)
        end = np.where(ok, a + length, 0)
        return ok & ((self.sums[end] - self.sums[a]) * self.up[d] == self.sums[end + d] - self.sums[a + d])

    def extended(self, at: np.ndarray, length: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around a place in which values ``shift`` apart are equal, the shift included."""
        left, right = at.copy(), at + length
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            right += np.where(self.same(right, step, shift), step, 0)
            left -= np.where(self.same(left - step, step, shift), step, 0)
            step >>= 1
        return left, right + shift


def next_distance(codes: np.ndarray) -> np.ndarray:
    """How far on each value comes again; nowhere: the sequence's length."""
    order = np.argsort(codes, kind="stable")
    gap = np.full(len(codes), len(codes), np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gap


def smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of ``start, end, period`` the smallest period of each stretch, by start and end."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate((np.ones(min(len(rows), 1), bool), (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)))]


def runs_in(codes: np.ndarray, texts: np.ndarray | None = None, least: int = 24, times: int = 3, salt: int = 0) -> np.ndarray:
    """Rows ``start, end, period`` of all runs of a sequence of small integers, by start and period.

    ``texts``: the number of each place's text, of several that end in a value of their own.
    """
    n = len(codes)
    texts = np.zeros(n, np.int64) if texts is None else texts
    longest = int(np.bincount(texts).max(initial=0))
    if least < 3 or times < 3:
        raise ValueError("a run has at least three periods and three words")
    found = [np.zeros((0, 3), np.int64)]
    b, shortest = 1 << ((least // 3).bit_length() - 1), 1
    gap, ranges = next_distance(texts * (codes.max(initial=0) + 1) + codes), None
    while longest >= max(least, times * shortest):
        whole = n // b * b
        starts = np.flatnonzero(np.maximum.reduceat(gap[:whole], np.arange(0, whole, b)) < 2 * b) * b
        at, distance = occurrences(codes, starts, b, shortest)
        if len(at) and ranges is None:
            ranges = Ranges(codes, salt)
        for k in range(0, len(at), SEEDS):
            d = distance[k: k + SEEDS]
            left, right = ranges.extended(at[k: k + SEEDS], b, d)
            found.append(smallest_periods(np.column_stack((left, right, d))[right - left >= np.maximum(least, times * d)]))
        b, shortest = 2 * b, 2 * b
    rows = smallest_periods(np.concatenate(found))
    if not all(np.array_equal(codes[s: e - d], codes[s + d: e]) for s, e, d in rows.tolist()):
        return runs_in(codes, texts, least, times, salt + 1)  # other ranges had one hash: again, with other hashes
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, text`` of every row.

    ``runs`` is ``array<struct<start, length, period>>`` by start, then period;
    words are counted from 0.  ``text`` has the words that no run repeats (of a
    run its first ``period`` words stay, unless another run drops them), joined by
    one space.  Null and empty texts have no words, no runs and an empty text;
    null ids and repeated rows are rows like others; other columns are ignored;
    an empty table gives an empty result.
    """

    def run(batches):
        for b in slices(batches):
            words = words_of(b.column("body"))
            start = edges(words.per_text)
            k = np.arange(len(words.per_text))
            codes = np.empty(len(words.codes) + len(k), np.int64)
            own = np.repeat(k, words.per_text)
            codes[np.arange(len(words.codes)) + own] = words.codes
            codes[start[1:] + k] = len(words.distinct) + k  # ends each text, like no other word
            rows = runs_in(codes, np.repeat(k, words.per_text + 1), least, times)
            text = np.searchsorted(start[1:] + k, rows[:, 0])
            rows = rows - np.array([1, 1, 0]) * text[:, None]  # places in the words alone
            change = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 1], -1)
            kept = np.cumsum(change)[:-1] == 0
            left = edges(np.bincount(own[kept], minlength=len(k)))
            parts = pa.ListArray.from_arrays(left.astype(np.int32), words.distinct.take(pa.array(words.codes[kept])))
            found = pa.StructArray.from_arrays([pa.array(x) for x in (rows[:, 0] - start[text], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(RUN))
            per_text = edges(np.bincount(text, minlength=len(k))).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.array(words.per_text), pa.ListArray.from_arrays(per_text, found), pc.binary_join(parts, " ")],
                                  ["doc_id", "n_words", "runs", "text"])

    return bodies(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def longest_power(runs: F.Column) -> F.Column:
    """The run with the greatest ``length / period`` (compared exactly; the first of equal ones); null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))
