"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  Every node has a failure link, to the node that is
reached when the pieces that end before it have been cut off, and the number of
those pieces.  A word is then read once, character by character, without
backing up and without building pieces.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelprism.llm.common import bodies, slices

__all__ = ["LongestMatch", "token_counts"]

#: Mark of a word's start in the vocabulary (a fixed value of its format).
START = "▁"
#: Words whose counts a Python worker remembers at most.
REMEMBERED = 1 << 19


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation.

    A character that starts no piece counts as its UTF-8 bytes with
    ``byte_pieces``, else as one unknown piece.
    """

    def __init__(self, vocabulary, byte_pieces: bool = True):
        self.single = (lambda c: len(c.encode("utf-8", "replace"))) if byte_pieces else (lambda c: 1)
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                step = self.next[at].get(c)
                if step is None:
                    step = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = step
            whole[at] = at > 0
        self.link = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    self.popped[node] = 1
                elif parent == 0:
                    self.popped[node] = self.single(c)
                else:
                    self.popped[node], self.link[node] = self._move(self.link[parent], c, self.popped[parent])

    def _move(self, at: int, c: str, count: int) -> tuple[int, int]:
        """Pieces so far and the node after reading ``c`` at node ``at``."""
        while c not in self.next[at]:
            if at == 0:
                return count + self.single(c), 0
            count += self.popped[at]
            at = self.link[at]
        return count, self.next[at][c]

    def count(self, word: str) -> int:
        nxt, at, count = self.next, 0, 0
        for c in word:
            step = nxt[at].get(c)
            if step is None:
                count, at = self._move(at, c, count)
            else:
                at = step
        while at:
            count += self.popped[at]
            at = self.link[at]
        return count


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a model file: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


_AUTOMATA: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, vocabulary: list[str], byte_pieces: bool = True) -> DataFrame:
    """``doc_id, n_words long, n_pieces long`` for every row of ``docs``.

    Words are the parts between ASCII white space of the whole text, read with
    the start mark before them.  Null and empty texts have no words and no
    pieces.  Rows stand for themselves, repeated ones too; other columns are
    ignored; an empty table gives an empty result.  Each task works row by row
    with no shuffle and remembers the counts of a bounded number of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_pieces))
    key = uuid.uuid4().hex

    def count(batches):
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = LongestMatch(*shared.value), {}
        match, known = _AUTOMATA[key]
        for b in slices(batches):
            n_words, n_pieces = [], []
            for body in b.column("body").to_pylist():
                words = body.split()
                for w in set(words).difference(known):
                    known[w] = match.count(START + w.decode("utf-8", "replace"))
                n_words.append(len(words))
                n_pieces.append(sum(map(known.__getitem__, words)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_pieces, np.int64))],
                                  ["doc_id", "n_words", "n_pieces"])

    return bodies(docs).mapInArrow(count, "doc_id long, n_words long, n_pieces long")
