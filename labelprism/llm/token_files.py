"""Token ids in Arrow IPC files of equal-length sequences.

Documents in ascending ``doc_id`` order make one stream of ids, an end id after
each.  The stream is cut into files at document ends and, inside a file, into
sequences of ``length`` ids.  One row of a file is one sequence::

    ids   fixed_size_list<uint16 or uint32>[length]   the ids, 0 after the last
    mask  fixed_size_list<bool>[length]               true where ids are real
    docs  list<struct<doc_id, at, n>>                 documents that start here

The two fixed-size lists lie uncompressed in the file, in record batches of
``BATCH_ROWS`` sequences: a memory map gives any sequence or mask without copying,
and over a remote store one sequence costs one batch.  Files are written under a name of their own
for each attempt and count only if the task that wrote them reports them, so a
task that is run again leaves no half file in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelprism.llm.bpe import bpe_words, encode_words
from labelprism.llm.common import bodies, edges, load_tokenizer, one_array, place_in, read_text, slices

__all__ = ["write_token_files", "read_token_files", "read_sequence"]

#: Words whose ids a Python worker remembers at most.
REMEMBERED = 1 << 20
FILES = "path string, part int, file int, n_docs long, n_tokens long"
#: Documents read at once; sequences of a record batch.
READ, BATCH_ROWS = 1024, 256
#: Characters of a text that the dealing of rows with one id looks at.
BEGINNING = 64
_ENCODERS: dict[int, "Encoder"] = {}


def file_schema(length: int, width: int) -> pa.Schema:
    """``width``: bytes of an id."""
    doc = pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)),
                      ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(doc))])


def sequences(doc_ids: pa.Array, n: np.ndarray, stream: np.ndarray, length: int, width: int) -> pa.RecordBatch:
    """One file's rows: documents of ``n`` ids each, one after the other in ``stream``."""
    start = np.cumsum(n) - n
    rows = -(-len(stream) // length)
    ids = np.zeros(rows * length, np.uint16 if width == 2 else np.uint32)
    ids[: len(stream)] = stream
    schema = file_schema(length, width)
    first = np.searchsorted(start, np.arange(rows + 1) * length)
    starts = pa.StructArray.from_arrays([doc_ids, pa.array((start % length).astype(np.int32)), pa.array(n)], fields=list(schema.field("docs").type.value_type))
    return pa.record_batch([
        pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
        pa.FixedSizeListArray.from_arrays(pa.array(np.arange(rows * length) < len(stream)), length),
        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), starts)], schema=schema)


class Encoder:
    """Ids of texts through the ids of their words, remembered in two columns up to a bound."""

    def __init__(self, tok):
        self.tok = tok
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and how many each text has."""
        words = bpe_words(texts)
        if len(self.words) > REMEMBERED:
            self.forget()
        place = place_in(words.distinct, self.words).astype(np.int64)
        new = place < 0
        if new.any():
            unknown = words.distinct.filter(pa.array(new))
            place[new] = len(self.words) + np.arange(len(unknown))
            self.words = pa.concat_arrays([self.words, unknown])
            self.ids = pa.concat_arrays([self.ids, encode_words(self.tok, unknown.to_pylist())])
        pieces = pa.concat_arrays([self.ids, pa.array([[end_id]], pa.list_(pa.int32()))])
        places = np.insert(place[words.codes], edges(words.per_text)[1:], len(self.ids))
        found = pieces.take(pa.array(places))
        ends = np.asarray(found.offsets)[edges(words.per_text + 1)]
        return np.asarray(found.flatten()), np.diff(ends).astype(np.int64)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, length: int = 1024,
                      file_tokens: int = 1 << 22) -> DataFrame:
    """Write ``docs`` to ``folder`` and return the files: ``path, part, file, n_docs, n_tokens, start``.

    ``folder`` must be on storage that driver and executors share; any place
    that pyarrow's file systems reach will do.  ``start`` is the number of ids
    in all earlier files.  A null or empty text is its end id alone.  Rows with
    the same ``doc_id`` stay apart, in the order of their text; null ids come
    first.  Very many rows of one id are dealt over tasks by the beginnings of
    their texts.  An empty table gives no file.  Other columns are ignored.  The driver sees a row per
    file, one for ``file_tokens`` ids, and numbers the files.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = read_text(tokenizer_path)
    width = 2 if max(load_tokenizer(text).get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
    spec = sc.broadcast(text)
    filesystem, root = pa.fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)

    def flush(part: int, file: int, held: list[tuple]) -> pa.RecordBatch:
        ids, n, stream = (pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2)))
        batch = sequences(ids, n, stream, length, width)
        fs, at = pa.fs.FileSystem.from_uri(folder)
        path = f"{at}/part-{part:06d}-{file:06d}-{uuid.uuid4().hex}.arrow"
        with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, batch.schema) as out:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                out.write_batch(batch.slice(k, BATCH_ROWS))
        return pa.record_batch([[path.rsplit("/", 1)[-1]], pa.array([part], pa.int32()), pa.array([file], pa.int32()),
                                pa.array([len(n)], pa.int64()), pa.array([len(stream)], pa.int64())], [x.split()[0] for x in FILES.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(load_tokenizer(spec.value))
        part, file, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in slices(batches, size=4 * file_tokens):
            stream, n = _ENCODERS[key].encode(b.column("body"), end_id)
            held.append((b.column("doc_id"), n, stream.astype(np.uint16 if width == 2 else np.uint32)))
            size += len(stream)
            if size >= file_tokens:
                yield flush(part, file, held)
                file, held, size = file + 1, [], 0
        if held:
            yield flush(part, file, held)

    # runs once: the rows that the successful tasks send back, one per file, are the list of files
    source = bodies(docs).withColumn("body", F.col("body").cast("string"))
    ordered = source.repartitionByRange("doc_id", F.substring("body", 1, BEGINNING)).sortWithinPartitions("doc_id", "body")
    files = spark.createDataFrame(ordered.mapInArrow(write, FILES).toArrow().to_pandas(), FILES)
    order = Window.orderBy("part", "file")
    return files.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))


def opened(fs: pa.fs.FileSystem, path: str):
    """A file to read from: mapped where the store is a local one."""
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


def read_sequence(folder: str, path: str, k: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of the file's sequence ``k``, as views of its record batch."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    batch = pa.ipc.open_file(opened(fs, f"{root}/{path}")).get_batch(k // BATCH_ROWS)
    return tuple(batch.column(c).slice(k % BATCH_ROWS, 1).flatten() for c in ("ids", "mask"))


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, ids array<int>`` of every document, from the files alone.

    A task takes some of the files, maps them one by one (on a local store; reads
    them elsewhere) and goes through their record batches; ``start`` counts all
    ids of earlier documents.  No files give no rows.
    """

    def documents(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with opened(fs, f"{root}/{path}") as source:
                    table = pa.ipc.open_file(source).read_all()
                    length = table.schema.field("ids").type.list_size
                    flat = pa.chunked_array([c.flatten() for c in table["ids"].chunks], table.schema.field("ids").type.value_type)
                    lists = one_array(table["docs"])
                    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                    docs = lists.flatten()
                    start = row * length + np.asarray(docs.field("at"))
                    n = np.asarray(docs.field("n"))
                    for k in range(0, len(n), READ):
                        lo, hi = int(start[k]), int((start + n)[min(k + READ, len(n)) - 1])
                        ends = np.concatenate((start[k: k + READ], [hi])) - lo
                        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one_array(flat.slice(lo, hi - lo).cast(pa.int32())))
                        yield pa.record_batch([docs.field("doc_id").slice(k, READ), pa.array(before + start[k: k + READ]), ids], ["doc_id", "start", "ids"])

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.select("path", "start").mapInArrow(documents, "doc_id long, start long, ids array<int>")
