"""BPE encoding and decoding through a distinct-word table.

The tokenizer never joins text across ASCII white space: its normaliser maps
white space to white space and its pre-tokeniser drops it.  So a document's ids
are the ids of its words one after the other, and a word needs encoding once in
the whole corpus.  The word table has two parts:

* the ``hot_words`` most frequent words (a bounded table, encoded once and
  broadcast) stand for nearly all positions; a document travels as the ranks of
  its words, one to three bytes each, with a gap for any other word;
* every other word goes, with its document's key and its place, to the partition of
  its hash.  There the equal words stand together, each distinct one is encoded
  once, and its ids join the document again by position.

Which words are hot decides what moves, never the result.  Lower-casing A-Z
first merges words that the tokenizer would lower-case itself; texts that hold
``<|`` are left as they are, since special tokens match before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelprism.llm.common import Words, add_counts, edges, load_tokenizer, lower_ascii, one_array, place_in, read_text, slices, words_of

__all__ = ["bpe_encode", "bpe_decode"]

#: Words of the broadcast part and their bytes together, and what a task may send as candidates for it (with as many bytes).
HOT_WORDS, HOT_BYTES, LOCAL_TOP = 1 << 19, 32 << 20, 1 << 17
#: Bytes from which a word that is not hot is dealt over ``SALTS`` tasks, each of which encodes it once.
LONG_WORD, SALTS = 1 << 12, 16
#: Distinct words that a task counts before it forgets the rarer half.
COUNTED = 1 << 18
#: Rows decoded at once.
DECODED = 512


def bpe_words(texts: pa.Array) -> Words:
    """Words as the encoder tells them apart.

    A-Z are in lower case but in texts that may hold special tokens, and a last
    mark after a letter or digit is a word of its own: the pre-tokeniser cuts it
    off too.  Both make words that differ only so one.
    """
    special = pc.match_substring(texts, "<|")
    lower = pc.if_else(special, texts, lower_ascii(texts)) if pc.any(special).as_py() else lower_ascii(texts)
    return words_of(pc.replace_substring_regex(lower, LAST_MARK, r"\1 \2\3"))


#: Characters that stand alone after letters (fixed values); the last character below which letters are looked at here.
ALONE, LATIN = ".,;:!?", "\u024F"
LAST_MARK = r"([0-9a-z])([.,;:!?])([\t\n\f\r ]|$)"


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers' letter of each byte: itself where printable, else the next free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def word_ids(tok, words: list[str]) -> list[list[int]]:
    """Ids of each word.

    Most words are lower-case Latin letters, perhaps with one punctuation mark
    after them.  The normaliser leaves those alone and the pre-tokeniser cuts off
    the mark, so the letters go straight to the library's BPE model, which takes
    a fifth of the time; all others take the library's whole way.
    """
    tokenize, letters = tok.model.tokenize, byte_letters()
    marks = {m: tok.encode(m, add_special_tokens=False).ids for m in ALONE}
    out: list = []
    others = []
    for w in words:
        core, mark = (w[:-1], marks[w[-1]]) if w[-1:] in marks else (w, None)
        if core.isalpha() and core.islower():
            if core.isascii():
                ids = [t.id for t in tokenize(core)]
                out.append(ids + mark if mark else ids)
                continue
            if max(core) <= LATIN and is_normalized("NFC", core):
                ids = [t.id for t in tokenize(core.encode().decode("latin-1").translate(letters))]
                out.append(ids + mark if mark else ids)
                continue
        others.append(len(out))
        out.append(None)
    run = getattr(tok, "encode_batch_fast", tok.encode_batch)
    for k, e in zip(others, run([words[k] for k in others], add_special_tokens=False)):
        out[k] = e.ids
    return out


def encode_words(tok, words: list[str]) -> pa.ListArray:
    return pa.array(word_ids(tok, words), pa.list_(pa.int32()))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = None
    for b in slices(batches):
        words = bpe_words(b.column("body"))
        counts = add_counts(counts, words.distinct, n=np.bincount(words.codes, minlength=len(words.distinct)))
        if counts.num_rows > COUNTED:
            counts = top(counts, COUNTED // 2)
    if counts is not None:
        counts = top(counts, LOCAL_TOP)
        size = pc.binary_length(counts["word"])
        counts = counts.filter(pc.and_(pc.greater(counts["n"], 1), pc.and_(pc.greater(size, 0), pc.less_equal(size, HOT_BYTES // 16)))).sort_by([("n", "descending")])
        yield from counts.slice(0, within(counts["word"])).to_batches()


def within(words: pa.ChunkedArray) -> int:
    """How many of the first words have ``HOT_BYTES`` together."""
    return int((np.cumsum(np.asarray(pc.binary_length(words)), dtype=np.int64) <= HOT_BYTES).sum())


def top(counts: pa.Table, most: int) -> pa.Table:
    return counts.take(pc.select_k_unstable(counts, most, [("n", "descending")])) if counts.num_rows > most else counts


def to_bytes(ranks: np.ndarray, per_doc: np.ndarray) -> list[bytes]:
    """Ranks as base-128 numbers (low digits first, high bit: more follow), cut into documents of ``per_doc`` numbers."""
    size = 1 + (ranks >= 1 << 7).astype(np.int64) + (ranks >= 1 << 14) + (ranks >= 1 << 21)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.uint8)
    for k in range(4):
        has = size > k
        out[at[:-1][has] + k] = (ranks[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    ends = at[np.concatenate(([0], np.cumsum(per_doc)))]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]


def from_bytes(data: bytes) -> np.ndarray:
    """The numbers that ``to_bytes`` wrote."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        has = last - first >= k
        out[has] |= (b[first[has] + k] & 127) << 7 * k
    return out


def packed(ids: pa.ListArray, width: int) -> pa.Array:
    """Lists of ids as bytes, ``width`` for each."""
    flat = np.asarray(ids.flatten()).astype(f"<u{width}")
    ends = (np.asarray(ids.offsets) - ids.offsets[0].as_py()) * width
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def unpacked(data: pa.Array, width: int) -> pa.ListArray:
    """What ``packed`` wrote; no nulls."""
    size = np.asarray(pc.binary_length(data)) // width
    flat = np.frombuffer(b"".join(data.to_pylist()), f"<u{width}").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges(size), pa.int32()), pa.array(flat))


def short_keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, body``: ``key`` is 16 bytes of the SHA-256 of a row's id and text together.

    Each rare word takes the key along twice, so it stands for id and text at once;
    rows of one id and one text share it, null ids are an id of their own.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), body).cast("binary"), 256)
    return docs.select(doc_id.alias("doc_id"), F.unhex(F.substring(digest, 1, 32)).alias("key"), body.alias("body"))


def halves(key: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each 16-byte key."""
    both = np.frombuffer(b"".join(key.to_pylist()), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def bpe_encode(docs: DataFrame, tokenizer_path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``docs``, as the tokenizer encodes its whole text.

    Null and empty texts get an empty array.  Repeated rows each get their own
    result row; an empty table gives an empty result.  Other columns of ``docs``
    are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    spec = sc.broadcast(read_text(tokenizer_path))
    source = short_keyed(docs)

    def encode_rows(batches):
        tok = load_tokenizer(spec.value)
        for b in batches:
            yield pa.record_batch([b.column("word"), encode_words(tok, b.column("word").to_pylist())], ["word", "ids"])

    frequent = (source.select("body").mapInArrow(_frequent, "word string, n long")
                .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(hot_words))
    # as many of the most frequent as have HOT_BYTES together; a window over ``hot_words`` rows at most
    so_far = Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frequent = frequent.withColumn("size", F.sum(F.octet_length("word")).over(so_far)).where(F.col("size") <= HOT_BYTES)
    table = frequent.select("word").mapInArrow(encode_rows, "word string, ids array<int>").toArrow().combine_chunks()
    hot = sc.broadcast(one_array(table["word"]))
    hot_ids = sc.broadcast(one_array(table["ids"]))
    width = 2 if load_tokenizer(spec.value).get_vocab_size(True) <= 1 << 16 else 4

    def ranks(words: Words) -> np.ndarray:
        """Rank of every place's word, 0 for a rare one."""
        return (place_in(words.distinct, hot.value) + 1).astype(np.int64)[words.codes]

    def coded(batches):
        for b in slices(batches):
            words = bpe_words(b.column("body"))
            codes = to_bytes(ranks(words), words.per_text)
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, halves(b.column("key"))), pa.array(codes, pa.binary())], ["doc_id", "key1", "key2", "codes"])

    def gaps(batches):
        for b in slices(batches):
            words = bpe_words(b.column("body"))
            rare = ranks(words) == 0
            text = np.repeat(np.arange(b.num_rows), words.per_text)[rare]
            n = np.bincount(text, minlength=b.num_rows)
            seq = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch([*(pa.array(k[text]) for k in halves(b.column("key"))), pa.array(seq), words.distinct.take(pa.array(words.codes[rare]))],
                                  ["key1", "key2", "place", "word"])

    def encode_once(batches):
        """Equal words follow each other, so a batch's first word may be the one encoded last."""
        tok = load_tokenizer(spec.value)
        word, ids = None, pa.array([], pa.list_(pa.int32()))
        for b in batches:
            column = b.column("word").dictionary_encode()
            distinct = column.dictionary.to_pylist()
            known = distinct[:1] == [word]
            new = encode_words(tok, distinct[known:])
            got = pa.concat_arrays([ids, new]) if known else new
            if distinct:
                last = column.indices[-1].as_py()
                word, ids = distinct[last], got.slice(last, 1)
            yield pa.record_batch([*(b.column(k) for k in ("key1", "key2", "place")), packed(got.take(column.indices), width)], ["key1", "key2", "place", "ids"])

    coded_docs = source.mapInArrow(coded, "doc_id long, key1 long, key2 long, codes binary")
    rare = (source.mapInArrow(gaps, "key1 long, key2 long, place long, word string")
            .repartition("word", F.when(F.octet_length("word") >= LONG_WORD, F.pmod(F.xxhash64("key1", "key2"), F.lit(SALTS))).otherwise(0)).sortWithinPartitions("word")
            .mapInArrow(encode_once, "key1 long, key2 long, place long, ids binary"))
    # dealt out row by row: a task holds few words of a document, so gathering them there first would only add
    rest = (rare.repartition("key1", "key2")
            .groupBy("key1", "key2").agg(F.collect_list(F.struct("place", "ids")).alias("rest")))
    joined = coded_docs.join(rest, ["key1", "key2"], "left").select("doc_id", "codes", "rest")

    def fill(batches):
        for b in slices(batches, "codes"):
            numbers = [from_bytes(c) for c in b.column("codes").to_pylist()]
            per_text = np.array([len(x) for x in numbers], np.int64)
            rank = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            rest = b.column("rest")
            found = rest.flatten()
            text = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(rest), 0)))
            # a document's rare words in their order; copies of the document give each one again
            _, order = np.unique(text << 32 | np.asarray(found.field("place")), return_index=True)
            pieces = pa.concat_arrays([hot_ids.value, unpacked(found.field("ids").take(pa.array(order)), width)])
            at = rank - 1
            at[rank == 0] = len(hot_ids.value) + np.arange(len(order))
            words = pieces.take(pa.array(at))
            ends = np.asarray(words.offsets)[edges(per_text)] - words.offsets[0].as_py()
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.flatten())], ["doc_id", "ids"])

    return joined.mapInArrow(fill, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (with ``ids array<int>``) and a column ``decoded``: the pieces of its ids.

    The id-to-piece table has as many rows as the vocabulary, so it is broadcast
    and joined in the map task.  The tokenizer has no decoder: its pieces stand
    side by side with a space between, and ids without a piece are left out.
    Null ids give a null text, no ids an empty one.
    """
    tok = load_tokenizer(read_text(tokenizer_path))
    if tok.decoder is not None:
        raise ValueError("only tokenizers without a decoder are supported")
    vocab = tok.get_vocab(with_added_tokens=True)
    table = sorted((i, p) for p, i in vocab.items())
    pieces = encoded.sparkSession.sparkContext.broadcast((pa.array([i for i, _ in table], pa.int32()), pa.array([p for _, p in table], pa.string())))
    schema = [f for f in encoded.schema.fields if f.name != "decoded"]

    def look_up(batches):
        for b in batches:
            for k in range(0, b.num_rows, DECODED):
                part = b.slice(k, DECODED)
                ids = part.column("ids")
                known = np.isin(np.asarray(ids.flatten()), np.asarray(pieces.value[0]))
                place = np.repeat(np.arange(len(ids)), np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))[known]
                found = pc.index_in(ids.flatten().filter(pa.array(known)), pieces.value[0])
                lists = pa.ListArray.from_arrays(pa.array(edges(np.bincount(place, minlength=len(ids))), pa.int32()), pieces.value[1].take(found))
                texts = pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), None)
                keep = [n for n in part.schema.names if n != "decoded"]
                yield pa.record_batch([*(part.column(n) for n in keep), texts], [*keep, "decoded"])

    return encoded.mapInArrow(look_up, StructType([*schema, StructField("decoded", StringType())]))
