"""Language-model scores from a subword lattice.

A text is a row of words and an end.  A word, with the mark of a word's start
before it, is spelled by pieces of an existing vocabulary; every way to spell it
has the product of its pieces' probabilities, and the word's probability is the
sum over all ways, found by a forward recursion in log space.  As no piece holds
white space, the text's probability is the product of its words' and the end's.

The vocabulary's own scores rank its pieces; they set the starting
probabilities.  Rounds of expectation maximisation then fit the probabilities to
the training words: forward and backward recursions over every distinct word,
weighted by its count in the corpus, give the expected count of each piece.

All of it runs on a table of distinct words with their counts, which grows with
the corpus.  The most frequent words (a bounded number) are broadcast with their
scores, and a document's other words fetch theirs by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelprism.llm.common import add_counts, edges, keyed_bodies, lower_ascii, one_array, place_in, shared_folder, slices, words_of
from labelprism.llm.hashing import U, PrefixHashes, mix

__all__ = ["Vocabulary", "sentencepiece_scores", "lm_scores", "training_row"]

START = "▁"
#: Words whose scores are broadcast: how many, their bytes together, and the longest of them (others meet in a join that is split where skewed).
HOT_WORDS, HOT_BYTES, LONGEST_HOT = 1 << 18, 32 << 20, 4 << 20
#: Characters from which a word is walked by itself.
LONG = 256
#: Distinct words a task counts before it sends what it has.
COUNTED = 1 << 19
ROUNDS = 2
#: What each piece's expected count gets added.
SMOOTHING = 0.1
#: Words of one length that are scored at once.
CHUNK = 1 << 13


def training_row() -> Column:
    """Rows to learn from: crc32 of ``doc_id`` as text, modulo 7, is not 2 (null ids count as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def sentencepiece_scores(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and log probabilities that follow their ranks: the scores of a merge vocabulary are minus the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    real = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    rank = np.array([min(max(-sp.get_score(i), 0.0), n) for i in real])
    weight = 1 / (rank + 3)
    return [sp.id_to_piece(i) for i in real], np.log(weight / weight.sum())


@dataclass
class Vocabulary:
    """Pieces by the hash of their characters, and the lattice recursions.

    A character that is no piece is spelled by its UTF-8 bytes, each at
    ``byte_logp``.
    """

    pieces: list[str]
    logp: np.ndarray
    byte_logp: float
    order: np.ndarray = field(init=False)
    hashes: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        h = np.array([PrefixHashes(points(p)[None, :]).of(0, len(p))[0] if p else 0 for p in self.pieces], np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self.longest = max(map(len, self.pieces), default=1)

    def edges(self, words: np.ndarray):
        """``start, end, rows, ids, logp``: the words with a piece from ``start`` to ``end``, short ones first at each end."""
        n, length = words.shape
        prefix = PrefixHashes(words)
        for end in range(1, length + 1):
            for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
                h = prefix.of(start, end)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                if end - start == 1:
                    c = words[:, start]
                    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                    ids = np.where(known, self.order[at], -1 - size)
                    yield start, end, np.arange(n), ids, np.where(known, self.logp[ids], size * self.byte_logp)
                else:
                    rows = np.flatnonzero(known)
                    if len(rows):
                        ids = self.order[at[rows]]
                        yield start, end, rows, ids, self.logp[ids]

    def forward(self, words: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log probability of every prefix, one column per end; ``kept`` gets the edges."""
        total = np.full((words.shape[1] + 1, words.shape[0]), -np.inf)  # an end's values side by side
        total[0] = 0
        for start, end, rows, ids, logp in self.edges(words):
            total[end, rows] = np.logaddexp(total[end, rows], total[start, rows] + logp)
            if kept is not None:
                kept.append((start, end, rows, ids, logp))
        return total.T

    def long_edges(self, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """``start, end, id, logp`` of one word, by end: all places at once for each length of a piece."""
        n = len(word)
        prefix = PrefixHashes(word[None, :])
        sums, down = prefix.sums[:, 0], prefix.down
        out = []
        for size in range(1, min(self.longest, n) + 1):
            start = np.arange(n - size + 1)
            h = mix((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1] + U(size))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            if size == 1:
                width = 1 + (word >= 0x80) + (word >= 0x800) + (word >= 0x10000)
                ids = np.where(known, self.order[at], -1 - width)
                out.append((start, start + 1, ids, np.where(known, self.logp[ids], width * self.byte_logp)))
            else:
                start, ids = start[known], self.order[at[known]]
                out.append((start, start + size, ids, self.logp[ids]))
        start, end, ids, logp = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], ids[order], logp[order]

    def long_forward(self, word: np.ndarray) -> float:
        """Log probability of one long word: the recursion over its places, in plain numbers."""
        start, end, _, logp = self.long_edges(word)
        return walked(start.tolist(), end.tolist(), logp.tolist(), len(word))[-1]

    def long_expected(self, word: np.ndarray, weight: float, counts: np.ndarray) -> None:
        """Add the expected counts of the pieces of one long word, bytes last."""
        n = len(word)
        start, end, ids, logp = self.long_edges(word)
        up = np.array(walked(start.tolist(), end.tolist(), logp.tolist(), n))
        # the same walk from the other side
        order = np.argsort(-start, kind="stable")
        down = np.array(walked((n - end[order]).tolist(), (n - start[order]).tolist(), logp[order].tolist(), n))[::-1]
        share = weight * np.exp(up[start] + logp + down[end] - up[-1])
        piece = ids >= 0
        np.add.at(counts, ids[piece], share[piece])
        counts[-1] += (share * (-1 - ids))[~piece].sum()

    def expected(self, words: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected counts of the pieces, bytes last, over words of one length."""
        kept: list = []
        up = self.forward(words, kept).T
        down = np.full_like(up, -np.inf)
        down[-1] = 0
        for start, end, rows, ids, logp in sorted(kept, key=lambda e: -e[1]):
            down[start, rows] = np.logaddexp(down[start, rows], logp + down[end, rows])
        for start, end, rows, ids, logp in kept:
            share = weight[rows] * np.exp(up[start, rows] + logp + down[end, rows] - up[-1, rows])
            piece = ids >= 0
            np.add.at(counts, ids[piece], share[piece])
            if not piece.all():
                counts[-1] += (share * (-1 - ids))[~piece].sum()


def walked(start: list, end: list, logp: list, n: int) -> list:
    """Log sums over all ways from 0 to each place along edges sorted by end; every place has an edge to the next."""
    total = [0.0] + [-math.inf] * n
    k, edges_ = 0, len(start)
    exp, log = math.exp, math.log
    while k < edges_:
        e = end[k]
        best = total[start[k]] + logp[k]
        k += 1
        if k == edges_ or end[k] != e:
            total[e] = best
            continue
        ways = [best]
        while k < edges_ and end[k] == e:
            ways.append(total[start[k]] + logp[k])
            k += 1
        best = max(ways)
        total[e] = best + log(sum([exp(x - best) for x in ways]))
    return total


def points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and characters of words of equal length, a bounded number at once."""
    length = np.array(list(map(len, words)), np.int64)
    order = np.argsort(length, kind="stable")
    starts = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(words)]):
        step = max(1, min(CHUNK, (CHUNK << 4) // (int(length[order[a]]) + 1)))
        for k in range(a, b, step):
            places = order[k: min(k + step, b)]
            text = "".join(START + words[i] for i in places.tolist())
            yield places, points(text).reshape(len(places), -1)


def word_counts(source: DataFrame) -> DataFrame:
    """``word, c, n`` of every distinct word: its count in training rows and in all rows."""

    def count(batches):
        seen = None
        for b in slices(batches):
            words = words_of(lower_ascii(b.column("body")))
            train = np.repeat(np.asarray(b.column("train")), words.per_text)
            c, n = (np.bincount(codes, minlength=len(words.distinct)) for codes in (words.codes[train], words.codes))
            real = n > 0
            seen = add_counts(seen, words.distinct.filter(pa.array(real)), c=c[real], n=n[real])
            if seen.num_rows > COUNTED:
                yield from seen.to_batches()
                seen = None
        if seen is not None:
            yield from seen.to_batches()

    # as many parts as the session deals, so that the words' work is spread whatever their bytes
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = source.select("body", "train").mapInArrow(count, "word string, c long, n long").repartition(parts, "word")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fitted(vocabulary: Vocabulary, words: DataFrame, ends: int, rounds: int) -> tuple[Vocabulary, float]:
    """The vocabulary with probabilities fitted to ``words`` (``word, c``), and the end's log probability."""
    sc = words.sparkSession.sparkContext
    size = len(vocabulary.pieces) + 1
    end_logp = math.log(1e-3)
    for _ in range(rounds):
        shared = sc.broadcast(vocabulary)

        def expected(batches, shared=shared):
            counts = np.zeros(size)
            for b in batches:
                c = np.asarray(b.column("c")).astype(float)
                for places, text in by_length(b.column("word").to_pylist()):
                    if text.shape[1] < LONG:
                        shared.value.expected(text, c[places], counts)
                    else:
                        for place, word in zip(places, text):
                            shared.value.long_expected(word, c[place], counts)
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["piece", "x"])

        # one row per piece: as many as the vocabulary has
        found = words.where("c > 0").select("word", "c").mapInArrow(expected, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
        counts = np.full(size + 1, SMOOTHING)
        counts[np.asarray(found["piece"])] += np.asarray(found["x"])
        counts[-1] += ends
        logp = np.log(counts / counts.sum())
        # a byte is one of 256
        vocabulary = Vocabulary(vocabulary.pieces, logp[:-2], float(logp[-2]) - math.log(256))
        end_logp = float(logp[-1])
    return vocabulary, end_logp


def lm_scores(docs: DataFrame, pieces: list[str], logp: np.ndarray, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Words are lower-cased in A-Z and cut at ASCII white space; the end counts as
    a token, so null and empty texts have one.  ``base_score`` is the add-one
    word model's and ``score`` the lattice's log10 probability of the text.
    Repeated rows count and are scored each; other columns are ignored; an empty
    table gives an empty result, and without training rows the pieces keep the
    smoothing alone.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    source = keyed_bodies(docs).withColumn("train", training_row()).withColumn("body", F.col("body").cast("string"))

    folder = shared_folder(spark, "lm-words")
    word_counts(source).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("word string, c long, n long").parquet(f"{folder}/counts")
    ends = source.where("train").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).head()
    train_tokens, kinds = total + ends, distinct + (ends > 0)
    vocabulary, end_logp = fitted(Vocabulary(pieces, np.asarray(logp), float(np.min(logp))), counts, ends, rounds)
    model = sc.broadcast(vocabulary)

    def score_words(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for places, text in by_length(b.column("word").to_pylist()):
                out[places] = model.value.forward(text)[:, -1] if text.shape[1] < LONG else [model.value.long_forward(word) for word in text]
            yield pa.record_batch([*b.columns, pa.array(out)], [*b.schema.names, "lp"])

    counts.mapInArrow(score_words, "word string, c long, n long, lp double").write.parquet(f"{folder}/scores")
    words = spark.read.schema("word string, c long, n long, lp double").parquet(f"{folder}/scores")

    by_use = words.where(F.octet_length("word") <= LONGEST_HOT).orderBy(F.desc("n"), "word")
    sizes = by_use.limit(hot_words).select(F.octet_length("word").alias("size")).toArrow()["size"]  # a number per hot word
    fitting = int((np.cumsum(np.asarray(sizes), dtype=np.int64) <= HOT_BYTES).sum())
    frequent = by_use.limit(fitting).select("word", "c", "lp").toArrow()
    hot = sc.broadcast((one_array(frequent["word"]), np.asarray(frequent["c"]), np.asarray(frequent["lp"])))

    def of_slice(b):
        words = words_of(lower_ascii(b.column("body")))
        return words, place_in(words.distinct, hot.value[0])[words.codes]

    def frequent_part(batches):
        _, c, lp = hot.value
        c, lp = np.append(c, 0), np.append(lp, 0.0)  # the last stands for words that are not here
        for b in slices(batches):
            words, at = of_slice(b)
            ends = edges(words.per_text)

            def summed(x, ends=ends):
                return np.diff(np.concatenate((np.zeros(1), np.cumsum(x, dtype=np.float64)))[ends])

            known = np.diff(edges(c[at] > 0)[ends])
            columns = [*(b.column(k) for k in ("doc_id", "id", "tag", "train")), pa.array(np.ones(b.num_rows, np.int64)), pa.array(words.per_text), pa.array(known),
                       pa.array(summed(np.log10(c[at] + 1.0))), pa.array(summed(lp[at]))]
            yield pa.record_batch(columns, NAMES)

    def rare_part(batches):
        for b in slices(batches):
            words, at = of_slice(b)
            rare = at < 0
            text = pa.array(np.repeat(np.arange(b.num_rows), words.per_text)[rare])
            yield pa.record_batch([b.column("id").take(text), b.column("tag").take(text), words.distinct.take(pa.array(words.codes[rare]))], ["id", "tag", "word"])

    whole = source.mapInArrow(frequent_part, PARTS)
    rare = (source.select("id", "tag", "body").mapInArrow(rare_part, "id long, tag string, word string").join(words, "word")
            .select(F.lit(None).cast("long").alias("doc_id"), "id", "tag", F.lit(None).cast("boolean").alias("train"), F.lit(0).cast("long").alias("copies"),
                    F.lit(0).cast("long").alias("n"), (F.col("c") > 0).cast("long").alias("known"), F.log10(F.col("c") + F.lit(1.0)).alias("logc"), "lp"))
    # copies of a document add up to as many times its sums, and come out as many times
    both = whole.unionByName(rare).groupBy("id", "tag").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"),
                                                           *(F.sum(k).alias(k) for k in ("copies", "n", "known", "logc", "lp")))
    share = {k: F.col(k) / F.col("copies") for k in ("n", "known", "logc", "lp")}
    n_tokens = share["n"].cast("long") + 1
    base = share["logc"] + F.lit(math.log10(ends + 1)) - n_tokens * F.lit(math.log10(train_tokens + kinds + 1))
    return both.select("doc_id", (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"),
                       (share["known"].cast("long") + F.lit(int(ends > 0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
                       base.alias("base_score"), ((share["lp"] + end_logp) / math.log(10)).alias("score"),
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


PARTS = "doc_id long, id long, tag string, train boolean, copies long, n long, known long, logc double, lp double"
NAMES = [x.split()[0] for x in PARTS.split(", ")]
