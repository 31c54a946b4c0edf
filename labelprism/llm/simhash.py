"""Near-duplicates by SimHash fingerprints and Golay-code keys.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits.  The
binary Golay code of length 23 is perfect: every 23-bit word lies within three
bits of exactly one of its 4096 code words, whose index is the word's key.  The
keys of a segment and of its one-bit neighbours, six at most, are its key set;
of two segments that differ in one bit or none, each one's key is in the
other's key set.

Three differing bits fall on three segments in one of two ways:

* some segment is equal.  Of the other two, one differs in one bit at most, so
  some ordered pair (equal segment, key of another one) agrees;
* every segment differs in one bit.  Then the three keys agree, one side giving
  its key sets for the first two segments and the other for the third.

So fingerprints at most three bits apart meet in a bucket, with key space 2**33
and 2**36.  Equal fingerprints are one class from the start: buckets hold
distinct fingerprints only, 8 bytes each.  A bucket is searched breadth first:
each fingerprint is compared with those not reached yet, and only the links of a
spanning forest go on, so a large bucket gives no more links than members.  A
bucket of more than ``SPLIT`` members is cut into blocks by a hash, and every pair
of blocks is searched in a task of its own.
Components join buckets by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import cut, keyed_bodies, slices

__all__ = ["fingerprints", "golay_links", "components", "simhash_components", "one_of_each"]

WIDTHS = (22, 21, 21)
#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1 generates the code (a fixed value).
GENERATOR = 0b110001110101
SEED = 42
#: Shingles hashed at once, which bounds memory in long texts.
PART = 1 << 16
#: Members of a bucket that one task searches; a larger one goes block by block.
SPLIT = 1 << 12


def fingerprint(body: bytes, shingle: int) -> int:
    """Majority of the bits of all shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    length = list(map(len, words))
    ends = [e + k for k, e in enumerate(accumulate(length))]
    starts = [e - n for e, n in zip(ends, length)]
    ends = ends[shingle - 1:] or ends[-1:]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(ends), PART):
        h = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k: k + PART], ends[k: k + PART])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, id, tag, fp long`` of every row; null and empty texts get 0."""

    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(x, shingle) for x in b.column("body").to_pylist()]
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "id", "tag")), pa.array(fps, pa.int64())], ["doc_id", "id", "tag", "fp"])

    return keyed_bodies(docs).mapInArrow(run, "doc_id long, id long, tag string, fp long")


_DECODER: list[np.ndarray] = []


def decoder() -> np.ndarray:
    """Index of the nearest code word of every 23-bit word, built from the generator."""
    if not _DECODER:
        index = np.arange(4096, dtype=np.int64)
        code = np.zeros(4096, np.int64)
        for k in range(12):
            code ^= np.where(index >> k & 1, GENERATOR << k, 0)
        errors = [0] + [sum(1 << p for p in ps) for n in (1, 2, 3) for ps in _choose(23, n)]
        table = np.empty(1 << 23, np.int16)
        for e in errors:
            table[code ^ e] = index
        _DECODER.append(table)
    return _DECODER[0]


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def key_sets(x: np.ndarray, width: int) -> np.ndarray:
    """Rows ``place, key``: the keys of each value and of its one-bit neighbours, each once."""
    flips = np.array([0] + [1 << p for p in range(width)], np.int64)
    keys = np.sort(decoder()[x[:, None] ^ flips].astype(np.int64), axis=1)
    new = np.column_stack((np.ones(len(x), bool), np.diff(keys, axis=1) != 0))
    place, column = np.nonzero(new)
    return np.column_stack((place, keys[place, column]))


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints and the places of the fingerprints they belong to."""
    fp = fps.view(np.uint64)
    segment, at = [], 0
    for w in WIDTHS:
        segment.append((fp >> np.uint64(at)).astype(np.int64) & (1 << w) - 1)
        at += w
    own = [decoder()[s].astype(np.int64) for s in segment]
    sets = [key_sets(s, w) for s, w in zip(segment, WIDTHS)]
    everyone = np.arange(len(fp))
    keys, places = [], []

    def add(kind, place, high, low):
        keys.append(np.int64(kind) << 58 | high << 12 | low)
        places.append(place)

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, everyone, segment[i], own[j])
                place, key = sets[j].T
                add(kind, place, segment[i][place], key)
                kind += 1
    place, key = sets[2].T
    add(kind, place, own[0][place] << 12 | own[1][place], key)
    # all pairs of keys of the first two segments, fingerprint by fingerprint
    n0, n1 = (np.bincount(s[:, 0], minlength=len(fp)) for s in sets[:2])
    first0, first1 = (np.cumsum(n) - n for n in (n0, n1))
    place = np.repeat(everyone, n0 * n1)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(n0 * n1) - n0 * n1, n0 * n1)
    a = sets[0][first0[place] + nth // n1[place], 1]
    b = sets[1][first1[place] + nth % n1[place], 1]
    add(kind, place, a << 12 | b, own[2][place])
    keys, places = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((places, keys))  # a fingerprint may give one key twice, as its own and in its set
    keys, places = keys[order], places[order]
    new = np.concatenate(([True], (np.diff(keys) != 0) | (np.diff(places) != 0)))[: len(keys)]
    return keys[new], places[new]


def forest(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of members at most ``most`` bits apart."""
    links = []
    left = members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= most
            reached = left[near]
            if len(reached):
                links += [(int(at), x) for x in reached.tolist()]
                queue.extend(reached)
                left = left[~near]
    return links


def golay_links(distinct: DataFrame, max_bits: int = 3, split: int = SPLIT) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` that hold together all within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find up to 3 differing bits")

    def spread(batches):
        for b in batches:
            fps = np.asarray(b.column("fp"))
            for k in range(0, len(fps), 1 << 14):
                part = fps[k: k + (1 << 14)]
                keys, places = bucket_keys(part)
                yield pa.record_batch([pa.array(keys), pa.array(part[places])], ["bucket", "fp"])

    def search(batches):
        """Links of small buckets; members of large ones go on (``a`` the bucket, ``b`` the member, ``large``)."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        large = None  # a bucket some of whose members have gone on
        for b in batches:
            keys = np.concatenate((held[0], np.asarray(b.column("bucket"))))
            fps = np.concatenate((held[1], np.asarray(b.column("fp"))))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            on = np.zeros(len(keys), bool)
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            size = np.diff(np.append(starts, len(keys)))
            on[np.repeat((size > split) | (keys[starts] == large), size)] = True
            yield members(keys[on], fps[on])
            large = keys[-1] if on[-1] else None
            rest = ~on
            rest[last:] = False
            yield links_of(keys[rest], fps[rest])
            held = (keys[last:], fps[last:]) if not on[-1] else (keys[:0], fps[:0])
        yield links_of(*held)

    def members(keys, fps):
        return pa.record_batch([pa.array(keys), pa.array(fps), pa.array(np.ones(len(keys), bool))], ["a", "b", "large"])

    def search_blocks(batches):
        """Links within a pair of blocks of a large bucket."""
        held, name = [], None
        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in ("bucket", "low", "high"))))
            fps = np.asarray(b.column("fp"))
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e > s:
                    if names[s] != name and held:
                        yield forest_links(np.concatenate(held))
                        held = []
                    name = names[s]
                    held.append(fps[s:e])
        if held:
            yield forest_links(np.concatenate(held))

    def forest_links(fps):
        got = np.array(forest(fps, max_bits), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(np.minimum(got[:, 0], got[:, 1])), pa.array(np.maximum(got[:, 0], got[:, 1]))], ["a", "b"])

    def links_of(keys, fps):
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= max_bits
        a, b = [fps[two[near]]], [fps[two[near] + 1]]
        for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            if links := forest(fps[s: s + n], max_bits):
                more = np.array(links, np.int64)
                a.append(more[:, 0])
                b.append(more[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0).reshape(-1, 2)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(pairs), bool))], ["a", "b", "large"])

    # fingerprints are small rows that give some sixty keys each: spread over tasks first
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(distinct.repartition(parts, "fp").mapInArrow(spread, "bucket long, fp long").repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(search, "a long, b long, large boolean").distinct())
    links = found.where(~F.col("large")).select("a", "b")
    crowded = found.where("large").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
    if crowded.isEmpty():
        return links
    # a large bucket in blocks: each pair of blocks is a group of its own, of two blocks' members at most
    blocks = crowded.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    paired = crowded.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = paired.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    more = paired.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(search_blocks, "a long, b long")
    return links.unionByName(more).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node: ``root`` is the smallest node of its component.

    Alternating large-star and small-star rounds; each halves long chains, so
    the number of rounds grows with the logarithm of the component size.  Every
    round's links replace the last one's in the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        star = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).head()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, id, tag, fp, root, component_id`` of every row.

    ``root`` is the component's smallest fingerprint, ``component_id`` its
    smallest ``doc_id``.

    Words are lower-cased in A-Z and cut at ASCII white space.  Fewer words than
    ``shingle`` are one shingle; no words (or null) give fingerprint 0, which
    links like any other.  Null ids never name a component unless it has no
    other.  Repeated rows give repeated rows; other columns are ignored; an
    empty table gives an empty result.
    """
    members = cut(fingerprints(docs, shingle))
    classes = cut(members.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(golay_links(classes.select("fp"), max_bits))
    classes = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "root", "component_id")
    return members.join(classes, "fp").select("doc_id", "id", "tag", "fp", "root", "component_id")


def one_of_each(found: DataFrame) -> DataFrame:
    """``id, tag`` of the first document, by id and tag, of each component of ``simhash_components``."""
    return found.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("first")).select("first.*")
