"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of the corpus.

A word is a duplicate if a window of ``window`` words covers it whose sequence
also starts earlier in the corpus.  Comparing every window with every other
would move a row per word, so a document is factored against reference blocks
through sparse anchors:

* Every window names one anchor: the first lowest hash among its runs of
  ``ANCHOR`` words.  Equal windows name equal anchors at equal offsets.  Windows
  in a row that name the same anchor make an *anchored stretch* of words, one to
  ``window`` words apart; a corpus has about a seventh as many as words.
* A map task takes a block of documents as reference block and indexes its
  stretches.  A stretch that stands earlier in the same block is a factor of it
  at once; only the first of each kind leaves the task, so a passage that a
  third of all documents share leaves each block once.
* The block indexes meet by anchor hash.  Sorted there, a stretch that an
  earlier document holds whole is a factor of that one.  Stretches around one
  anchor that differ somewhere (ends of a shared passage, edits) may still have
  windows in common: these *boundaries* are checked window by window, which
  needs the words of those places alone.
  A task remembers what its earlier blocks sent and makes factors of it at once,
  so that an anchor of a third of all documents is sent about once per task.
* A document's touching factors with one source and one shift are merged into
  the longest ones.  The parse goes from left to right: at a place that factors
  cover, the one that reaches furthest is the next phrase, elsewhere a word stands
  for itself.  The phrases' words are the duplicates.

Stretches and windows are compared by two independent 64-bit hashes (of the
anchor and of the whole words).  Earlier means: smaller ``doc_id`` (null first),
then the smaller hash of the text for rows that share an id, then the earlier
place.  Rows with equal id and equal text are one document.  The places carry a
64-bit ``mark`` of the text, whose seed is one under which no two texts of one id
have the same mark (checked over all rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import cut, keys, slices
from labelprism.llm.hashing import U, mix, powers

__all__ = ["substring_dedup"]

ANCHOR = 8
#: Words of a reference block, and how far into a long document a task looks at once.
BLOCK = 1 << 19
#: Stretches of earlier blocks that a task remembers.
KNOWN = 1 << 19


class Hashes:
    """Hashes of any range of a sequence of words from sums over its prefixes."""

    def __init__(self, words: list[bytes]):
        from xxhash import xxh64_intdigest

        n = len(words)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(np.fromiter(map(xxh64_intdigest, words), U, n) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def first_lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first lowest value among each ``width`` values in a row."""
    at, covered = np.arange(len(x)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        covered += step
    return at


def stretches(words: list[bytes], ends: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Anchored stretches of documents that end at ``ends`` in ``words``: place, words, anchor's offset, both hashes."""
    n = len(words)
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("at", "n", "o", "key", "ctx")}
    anchor = min(ANCHOR, window)
    h = Hashes(words)
    low = np.arange(n - anchor + 1)
    grams = h.of(low, low + anchor)
    at = first_lowest(grams, window - anchor + 1)
    doc = np.searchsorted(ends, np.arange(n), "right")
    real = np.flatnonzero(doc[: n - window + 1] == doc[window - 1:])
    if not len(real):
        return stretches([], ends, window)
    named = at[real]
    new = np.concatenate(([True], (np.diff(named) != 0) | (np.diff(real) != 1)))
    first = real[new]
    last = real[np.concatenate((new[1:], [True]))]
    words_in = last - first + window
    offset = named[new] - first
    ctx = mix(h.of(first, first + words_in) + U(2) * offset.astype(U) + U(1) + U(1 << 32) * words_in.astype(U))
    return {"at": first, "n": words_in, "o": offset, "key": grams[named[new]], "ctx": ctx}


def blocks(batches: Iterator[pa.RecordBatch], window: int, size: int):
    """Documents in blocks of about ``size`` words: lists of ``(id, mark, offset, words)``; long ones in overlapping parts."""
    block, held = [], 0
    for b in slices(batches):
        for i, mark, body in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("body").to_pylist()):
            words = body.split()
            for at in range(0, max(len(words) - window + 1, 0), size):
                part = words[at: at + size + window - 1]
                block.append((i, mark, at, part))
                held += len(part)
                if held >= size:
                    yield block
                    block, held = [], 0
    if block:
        yield block


#: A found place. ``o`` < 0: a factor, with its source; else a first stretch, to be judged, whose anchor is at ``at + o``.
PLACE = "key long, ctx long, id long, mark long, at int, n int, o int, ref_id long, ref_at int"
PLACE_TYPES = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64(), pa.int32()]
PLACE_NAMES = [x.split()[0] for x in PLACE.split(", ")]


def place_batch(*columns) -> pa.RecordBatch:
    arrays = []
    for c, t in zip(columns, PLACE_TYPES):
        c = np.asarray(c)
        arrays.append(pa.array(c.view(np.int64) if c.dtype == U else c).cast(t))
    return pa.record_batch(arrays, PLACE_NAMES)


class Known:
    """What earlier blocks of a task sent: of each class of stretches the earliest place, the most useful ones kept."""

    def __init__(self, most: int):
        self.most = most
        self.rows = np.zeros((0, 6), np.int64)  # key, ctx, id, mark, at, last use
        self.hashes = np.zeros(0, U)
        self.block = 0

    def sources(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows ``key, ctx, id, mark, at`` of different classes: which have an earlier place, and what it is."""
        self.block += 1
        h = mix(first[:, 0].view(U) ^ mix(first[:, 1].view(U)))
        near = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        have = np.zeros(len(h), bool) if not len(self.hashes) else (self.rows[near, :2] == first[:, :2]).all(axis=1)
        known = self.rows[near[have]]
        later = np.zeros(len(h), bool)
        later[have] = [tuple(a) > tuple(b) for a, b in zip(first[have, 2:].tolist(), known[:, 2:5].tolist())]
        self.rows[near[have], 5] = self.block
        sources = self.rows[near[later]][:, 2:5]
        renewed = have & ~later
        self.rows[near[renewed], 2:5] = first[renewed, 2:]
        self.add(first[~have], h[~have])
        return later, sources

    def add(self, first: np.ndarray, h: np.ndarray) -> None:
        rows = np.concatenate((self.rows, np.column_stack((first, np.full(len(first), self.block - 1)))))
        hashes = np.concatenate((self.hashes, h))
        if len(rows) > self.most:  # the latest used stay
            keep = np.argsort(-rows[:, 5], kind="stable")[: self.most]
            rows, hashes = rows[keep], hashes[keep]
        order = np.argsort(hashes, kind="stable")
        self.rows, self.hashes = rows[order], hashes[order]


def index_blocks(window: int, size: int, most: int = KNOWN):
    """Map tasks' part: index each block, factor it against itself and what is known, send on what is first."""

    def run(batches):
        known = Known(most)
        for block in blocks(batches, window, size):
            ids, marks, offsets, parts = zip(*block)
            ends = np.cumsum([len(p) for p in parts])
            s = stretches([w for p in parts for w in p], ends, window)
            if not len(s["at"]):
                continue
            doc = np.searchsorted(ends, s["at"], "right")
            i, mark = np.array(ids, np.int64)[doc], np.array(marks, np.int64)[doc]
            at = s["at"] - (ends - [len(p) for p in parts])[doc] + np.array(offsets, np.int64)[doc]
            order = np.lexsort((at, mark, i, s["ctx"], s["key"]))
            key, ctx, i, mark, at, n, o = (x[order] for x in (s["key"], s["ctx"], i, mark, at, s["n"], s["o"]))
            new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(ctx) != 0)))
            starts = np.flatnonzero(new)
            head = np.column_stack((key.view(np.int64), ctx.view(np.int64), i, mark, at))[starts]
            later, sources = known.sources(head)
            head[later, 2:] = sources
            send = starts[~later]
            none = np.full(len(send), -1)
            yield place_batch(key[send], ctx[send], i[send], mark[send], at[send], n[send], o[send], none, none)
            source = head[np.cumsum(new) - 1, 2:]
            f = np.flatnonzero((i != source[:, 0]) | (mark != source[:, 1]) | (at != source[:, 2]))  # others are the place itself, or copies of the row
            if len(f):
                yield merged_places(i[f], mark[f], at[f], n[f], source[f, 0], source[f, 2])

    return run


def merged_places(i, mark, at, n, ref_id, ref_at) -> pa.RecordBatch:
    """Factors with overlaps of one source and one shift merged; keyed by document, so that they pass the anchors' exchange evenly."""
    order = np.lexsort((at, ref_at - at, ref_id, mark, i))
    i, mark, at, n, ref_id, ref_at = (x[order] for x in (i, mark, at, n, ref_id, ref_at))
    shift = ref_at - at
    same = (np.diff(i) == 0) & (mark[1:] == mark[:-1]) & (np.diff(ref_id) == 0) & (np.diff(shift) == 0) & (at[1:] <= (at + n)[:-1])
    new = np.concatenate(([True], ~same))
    starts = np.flatnonzero(new)
    n = np.maximum.reduceat(at + n, starts) - at[starts]
    keep = [x[starts] for x in (i, mark, at)]
    minus = np.full(len(starts), -1)
    return place_batch(mix(keep[0].astype(U) ^ U(0x5851F42D4C957F2D)), np.zeros(len(starts), np.int64), *keep, n, minus, ref_id[starts], ref_at[starts])


def judge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk stretches sorted by anchor, words, document and place, holding one class at a time.

    A stretch after the first of its class is a factor of that one.  The first
    of a class passes on as boundary (``o`` >= 0) if its anchor has other
    classes.  Factors that came ready pass through.
    """
    head = None  # the last class: key, ctx, id, mark, at, n, o of its first row
    sent = False  # whether it went on as boundary
    for b in batches:
        cols = [np.asarray(b.column(k)) for k in range(7)]
        ready = cols[6] < 0
        if ready.any():
            yield b.filter(pa.array(ready))
        cols = [c[~ready] for c in cols]
        if not len(cols[0]):
            continue
        if head is not None:
            cols = [np.concatenate(([v], c)).astype(c.dtype) for v, c in zip(head, cols)]
        key, ctx, i, mark, at, n, o = cols
        new_key = np.concatenate(([True], np.diff(key) != 0))
        new = new_key | np.concatenate(([True], np.diff(ctx) != 0))
        row = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new, row, 0))
        # a class is a boundary if it is not alone with its key; the last may learn that from the next batch
        starts = np.flatnonzero(new)
        alone_left = new_key[starts]
        alone_right = np.concatenate((new_key[starts[1:]], [True]))
        boundary = starts[~(alone_left & alone_right)]
        if head is not None and sent:
            boundary = boundary[boundary > 0]
        last_sent = not alone_left[-1] or (sent and starts[-1] == 0)
        factor = np.flatnonzero((i != i[first]) | (mark != mark[first]) | (at != at[first]))
        if len(boundary):
            none = np.full(len(boundary), -1)
            yield place_batch(*(c[boundary] for c in cols), none, none)
        if len(factor):
            f = first[factor]
            yield merged_places(i[factor], mark[factor], at[factor], n[factor], i[f], at[f])
        head = [c[starts[-1]] for c in cols]
        sent = bool(last_sent)


#: What a document's row gathers.
FOUND = "array<struct<at:int,n:int,o:int,key:long,ref_id:long,ref_at:int>>"


def condensed(batches):
    """Merge a document's factors again, now from all blocks, and pack them as flat numbers."""
    for b in batches:
        factors, open_places = [], []
        for found in b.column("found"):
            at, n, o, key, ref_id, ref_at = (np.asarray(found.values.field(k)) for k in range(6))
            ready = o < 0
            factors.append(merge_factors(at[ready], n[ready], ref_id[ready], ref_at[ready]))
            judged = np.unique(np.column_stack((at, n, o, key))[~ready].astype(np.int64), axis=0)
            open_places.append(judged.ravel().tolist())
        yield pa.record_batch([b.column("id"), b.column("mark"), pa.array(factors, pa.list_(pa.int64())), pa.array(open_places, pa.list_(pa.int64()))],
                              ["id", "mark", "factors", "boundaries"])


def merge_factors(at, n, ref_id, ref_at) -> list[int]:
    """``at, n, ref_id, ref_at`` of the longest factors, flat."""
    if not len(at):
        return []
    at, n, ref_id, ref_at = (x.astype(np.int64) for x in (at, n, ref_id, ref_at))
    shift = ref_at - at
    order = np.lexsort((at, shift, ref_id))
    at, n, ref_id, shift = at[order], n[order], ref_id[order], shift[order]
    out: list[list[int]] = []
    for a, k, r, s in zip(at.tolist(), n.tolist(), ref_id.tolist(), shift.tolist()):
        if out and out[-1][2] == r and out[-1][3] == s and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + k - out[-1][0])
        else:
            out.append([a, k, r, s])
    return [x for a, k, r, s in out for x in (a, k, r, a + s)]


def parse(factors: list[int], n_words: int) -> tuple[list[dict], np.ndarray]:
    """Greedy parse of flat ``at, n, ref_id, ref_at``: the phrases that are copies, from left to right, and which words they have.

    At each place the phrase is what is left of the factor that reaches furthest
    from there (of equal ones the first by source).
    """
    rows = sorted((factors[k: k + 4] for k in range(0, len(factors), 4)), key=lambda f: (f[0], f[2], f[3]))
    phrases, gone = [], np.zeros(n_words, bool)
    place, k, end, shift, ref = 0, 0, 0, 0, 0
    while True:
        while k < len(rows) and rows[k][0] <= place:
            at, n, ref_id, ref_at = rows[k]
            if at + n > end:
                end, shift, ref = at + n, ref_at - at, ref_id
            k += 1
        if end > place:
            phrases.append({"at": place, "n": end - place, "ref_id": ref, "ref_at": place + shift})
            gone[place: end] = True
            place = end
        elif k < len(rows):
            place = rows[k][0]
        else:
            return phrases, gone


def boundary_windows(window: int):
    """All windows of a document's boundary stretches: anchor, offset and hash of the words."""

    def run(batches):
        for b in slices(batches):
            out = [[] for _ in range(6)]
            for i, mark, body, places in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "body", "boundaries"))):
                words = body.split()
                for k in range(0, len(places), 4):
                    at, n, o, key = places[k: k + 4]
                    h = Hashes(words[at: at + n])
                    start = np.arange(n - window + 1)
                    for column, value in zip(out, (np.full(len(start), key), o - start, h.of(start, start + window).view(np.int64),
                                                   np.full(len(start), i), np.full(len(start), mark), at + start)):
                        column.append(value)
            if out[0]:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.record_batch([pa.array(np.concatenate(c)).cast(t) for c, t in zip(out, types)], ["key", "o", "words", "id", "mark", "at"])

    return run


def marked_bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, id, tag, mark, body``: ``mark`` tells the texts of one id apart in 64 bits.

    The first seed is taken under which no two texts of an id have one mark.
    None of the join columns is nullable, so that all joins share one exchange.
    """
    key = keys()
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    seed = 0
    while True:
        mark = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), body)
        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["id"].alias("id"), key["tag"].alias("tag"), mark.alias("mark"), body.alias("body"))
        marks = got.groupBy("id", "mark", "tag").agg(F.lit(1).alias("one")).groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"))
        if marks.where("n > 1").isEmpty():
            return got
        seed += 1


def substring_dedup(docs: DataFrame, window: int = 20, block: int = BLOCK) -> DataFrame:
    """``doc_id, id, tag, n_words, n_removed, text, factors`` of every row: its text without words that were seen before.

    ``text`` has the kept words joined by one space; ``factors`` are the
    phrases of the greedy parse, ``array<struct<at, n, ref_id, ref_at>>`` in words.  Texts that are
    null, empty or shorter than ``window`` lose nothing (null gives an empty
    text).  Repeated rows with one id are one document and keep their words
    alike; other columns are ignored; an empty table gives an empty result.
    """
    source = marked_bodies(docs)
    found = (source.select("id", "mark", "body").mapInArrow(index_blocks(window, block), PLACE)
             .repartition("key").sortWithinPartitions("key", "ctx", "id", "mark", "at")
             .mapInArrow(judge_sorted, PLACE)
             .groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n", "o", "key", "ref_id", "ref_at")).alias("found"))
             .mapInArrow(condensed, "id long, mark long, factors array<long>, boundaries array<long>"))
    found = cut(found)

    # the texts meet their factors and boundaries in one exchange, which both uses of the join share
    joined = source.join(found, ["id", "mark"], "left")
    windows = joined.where(F.size("boundaries") > 0).mapInArrow(boundary_windows(window), "key long, o int, words long, id long, mark long, at int")
    same = ["key", "o", "words"]
    first = windows.groupBy(*same).agg(F.min(F.struct("id", "mark", "at")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    late = (windows.join(first, same).where(F.struct("id", "mark", "at") != F.col("first"))
            .groupBy("id", "mark").agg(F.collect_list(F.struct("at", F.col("first.id").alias("ref_id"), F.col("first.at").alias("ref_at"))).alias("late")))

    def finish(batches):
        for b in slices(batches):
            cols = [[], [], [], []]
            for body, factors, extra in zip(*(b.column(c).to_pylist() for c in ("body", "factors", "late"))):
                words = body.split()
                flat = list(factors or [])
                for x in extra or []:
                    flat += [x["at"], window, x["ref_id"], x["ref_at"]]
                a = np.array(flat, np.int64).reshape(-1, 4)
                chosen, gone = parse(merge_factors(*a.T) if len(a) else [], len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for column, value in zip(cols, (len(words), len(words) - len(kept), b" ".join(kept), chosen)):
                    column.append(value)
            factor = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("ref_id", pa.int64()), ("ref_at", pa.int64())])
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "id", "tag")), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                   pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.list_(factor))],
                                  ["doc_id", "id", "tag", "n_words", "n_removed", "text", "factors"])

    ready = joined.join(late, ["id", "mark"], "left")
    return ready.select("doc_id", "id", "tag", "body", "factors", "late").mapInArrow(
        finish, "doc_id long, id long, tag string, n_words long, n_removed long, text string, factors array<struct<at:long,n:long,ref_id:long,ref_at:long>>")
