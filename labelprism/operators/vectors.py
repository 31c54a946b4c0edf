"""Vector-column operators: width check, conversion, L2 normalisation,
similarity top-k, keyword rules, exact k nearest neighbours, arg-max,
centroids and nearest-centroid assignment.

Vectors live as ``array<float>``/``array<double>`` columns; higher-order
functions (``transform``, ``zip_with``, ``aggregate``) compute on them inside
codegen.  Model inputs (query vectors, centroids: k × d numbers) are collected
behind a size check and broadcast; rows are scored batch by batch with matrix
products, in a narrow map — no join, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType
from pyspark.ml.functions import array_to_vector

from labelprism.operators.ordinal import join_null_safe
from labelprism.functions.columns import argmax, as_double_array, l2_norm
from labelprism.session import settled

__all__ = ["vector_width", "to_vector", "l2_normalise", "collect_matrix", "batch_matrix",
           "semantic_topk", "rule_score", "knn", "dominant", "centroids", "centroids_long",
           "assign_clusters"]

MAX_MODEL_CELLS = 64_000_000   # k × d numbers (0.5 GB) we agree to broadcast


def vector_width(df: DataFrame, col: str) -> int:
    """The common width of a vector column; fails on ragged or empty input."""
    r = df.agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if r is None or r["lo"] is None:
        raise ValueError(f"no vectors in column {col!r}")
    if r["lo"] != r["hi"]:
        raise ValueError(f"vectors in {col!r} have unequal widths {r['lo']}..{r['hi']}")
    return int(r["lo"])


def to_vector(df: DataFrame, col: str, out: str | None = None, check: bool = True) -> DataFrame:
    """P10: array column → ml ``Vector`` (values widened to float32 first)."""
    if check:
        vector_width(df, col)
    return df.withColumn(out or col, array_to_vector(F.col(col).cast("array<float>")))


def l2_normalise(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Divide each vector by its L2 norm; a zero vector is left unchanged."""
    norm = l2_norm(col)
    arr = as_double_array(col)
    return df.withColumn(out or col, F.when(norm > 0, F.transform(arr, lambda x: x / norm)).otherwise(arr))


def collect_matrix(df: DataFrame, id_col: str, vec: str) -> tuple[list, np.ndarray]:
    """A model's vectors (centres, queries) with their ids, sorted by id.

    They are broadcast, so their size is counted first; a table of more than
    ``MAX_MODEL_CELLS`` numbers is no model."""
    size = df.agg(F.sum(F.size(vec).cast("long"))).first()[0] or 0
    if size > MAX_MODEL_CELLS:
        raise ValueError(f"{size} numbers are too many to broadcast")
    rows = sorted(df.select(id_col, vec).collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], np.float64)


def batch_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``width`` numbers of an Arrow list column, and the rows they stand in."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    flat = column.filter(pa.array(fits)).flatten()
    return np.asarray(pc.cast(flat, pa.float64())).reshape(-1, width), np.flatnonzero(fits)


def semantic_topk(df: DataFrame, key: str, vec: str, queries: DataFrame, qid: str, qvec: str,
                  k: int = 10, metric: str = "cosine") -> DataFrame:
    """For each query vector, the ``k`` rows closest to it, best first.

    ``(qid, key, score, rank)``; score is cosine similarity (or raw dot product
    with ``metric='dot'``); ties by key; rows without a vector of the queries'
    width take no part.  The queries are broadcast; each Arrow batch is scored
    in one matrix product and sends its best ``k`` rows per query, so the only
    shuffle carries queries × k rows per batch.
    """
    ids, matrix = collect_matrix(queries, qid, qvec)
    if metric == "cosine" and len(ids):
        length = np.sqrt((matrix ** 2).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, length, out=matrix.copy(), where=length > 0)
    model = df.sparkSession.sparkContext.broadcast(matrix)
    unit = metric == "cosine"

    def best(batches):
        for b in batches:
            b = b.take(pc.sort_indices(b.column("key")))  # so that a stable sort by score breaks ties by key
            x, rows = batch_matrix(b.column("vec"), model.value.shape[1])
            score = np.einsum("ij,kj->ki", x, model.value)
            if unit:
                length = np.sqrt((x ** 2).sum(axis=1))
                score = np.divide(score, length, out=np.zeros_like(score), where=length > 0)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            keys = b.column("key").take(pa.array(rows[top.ravel()]))
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(top)), top.shape[1]), pa.int32()), keys,
                                   pa.array(np.take_along_axis(score, top, axis=1).ravel())], ["q", "key", "score"])

    kind = df.schema[key].dataType.simpleString()
    if not ids:
        return df.sparkSession.createDataFrame([], f"{qid} {queries.schema[qid].dataType.simpleString()}, {key} {kind}, score double, rank int")
    found = df.select(F.col(key).alias("key"), F.col(vec).alias("vec")).mapInArrow(best, f"q int, key {kind}, score double")
    names = F.array(*[F.lit(i) for i in ids])
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(key).asc())
    return (found.select(F.col("key").alias(key), names[F.col("q")].alias(qid), "score")
                 .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def rule_score(df: DataFrame, key: str, tokens: str, rules: list[tuple[list[str], float]],
               out: str = "score") -> DataFrame:
    """Points per matched rule; a rule matches when all its terms occur.

    Rules are a short parameter list, inlined as ``array_contains`` tests —
    a narrow projection, no join and no shuffle.
    """
    toks = F.col(tokens)
    total = F.lit(0.0)
    for terms, pts in rules:
        cond = F.lit(True)
        for t in terms:
            cond = cond & F.array_contains(toks, F.lit(t))
        total = total + F.when(cond, F.lit(float(pts))).otherwise(F.lit(0.0))
    return df.select(key, total.alias(out))


def dominant(df: DataFrame, vec: str, out: str = "dominant") -> DataFrame:
    """Arg-max index of each vector, ties → lowest index (narrow)."""
    return df.withColumn(out, argmax(vec))


def centroids(df: DataFrame, group: str, vec: str, out: str = "centroid") -> DataFrame:
    """A09 (n-dim): mean vector per group, NaN and null elements ignored.

    Elements are exploded with their position and averaged per (group, dim):
    partial aggregation keeps the shuffle to groups × dims rows per task.
    """
    long = centroids_long(df, group, vec)
    return (long.groupBy(group)
                .agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("_s"))
                .select(group, F.transform("_s", lambda s: s["mean"]).alias(out)))


def centroids_long(df: DataFrame, group: str, vec: str) -> DataFrame:
    """A09 in long form: ``(group, dim, mean)``."""
    ex = df.select(group, F.posexplode(as_double_array(vec)).alias("dim", "_x"))
    x = F.when(F.isnan("_x"), F.lit(None)).otherwise(F.col("_x"))
    return ex.groupBy(group, "dim").agg(F.avg(x).alias("mean"))


def assign_clusters(df: DataFrame, vec: str, centers: DataFrame, cid: str, cvec: str,
                    out: str = "cluster") -> DataFrame:
    """Nearest centre by squared Euclidean distance, ties → lowest id.

    The centres are broadcast; an Arrow batch is measured against all of them
    at once, in a narrow map.  Rows without a vector of the centres' width get
    a null.
    """
    ids, matrix = collect_matrix(centers, cid, cvec)
    model = df.sparkSession.sparkContext.broadcast(matrix)
    kind = centers.schema[cid].dataType
    names = [c for c in df.columns if c != out]
    no_centre = not ids

    def nearest(batches):
        for b in batches:
            place = np.full(b.num_rows, -1, np.int64)
            if not no_centre:
                x, rows = batch_matrix(b.column(vec), model.value.shape[1])
                step = max(1, 4_000_000 // model.value.size)
                for s in range(0, len(x), step):
                    diff = x[s:s + step, None, :] - model.value[None, :, :]
                    place[rows[s:s + step]] = np.einsum("ijk,ijk->ij", diff, diff).argmin(axis=1)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(place, mask=place < 0).cast(pa.int32())], [*names, "_place"])

    schema = StructType([*(df.schema[c] for c in names), StructField("_place", IntegerType())])
    found = df.select(*names).mapInArrow(nearest, schema)
    label = F.array(*[F.lit(i) for i in ids]).cast(ArrayType(kind))[F.col("_place")] if ids else F.lit(None).cast(kind)
    return found.select(*names, label.alias(out))


# ------------------------------------------------------------------ kNN
BLOCK_ROWS, BLOCK_CELLS = 32_768, 4_000_000   # a block of the exact search: rows, numbers (32 MB)
TILE = 512, 2048                              # rows and candidates of one matrix product


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, from their differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        np.einsum("ijk,ijk->ij", diff, diff, out=out[s:s + step])
    return out


def squared_of(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs ``a[i], b[j]``, from their differences."""
    out, step = np.empty(len(i)), max(1, 4_000_000 // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        diff = a[i[s:s + step]] - b[j[s:s + step]]
        np.einsum("ij,ij->i", diff, diff, out=out[s:s + step])
    return out


def first_copies(y: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among a row's ``k`` nearest at all: of equal rows, ``k`` of each of the first ``k + 1`` names.

    The rows are in the order of their names, so the others tie with earlier ones, whatever single name is left out.
    """
    y = np.ascontiguousarray(y + 0.0)  # no negative zeros
    _, which = np.unique(y.view(np.dtype((np.void, y.dtype.itemsize * y.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    which, names = which[order], names[order]
    group = np.concatenate(([True], which[1:] != which[:-1]))
    name = group | np.concatenate(([True], names[1:] != names[:-1]))
    at, nth = np.arange(len(y)), np.cumsum(name)
    rank = nth - np.maximum.accumulate(np.where(group, nth, 0))
    copy = at - np.maximum.accumulate(np.where(name, at, 0))
    return np.sort(order[(rank <= k) & (copy < k)])


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` nearest rows of ``y`` for each row of ``x``, ties to the earlier: places in ``x``, in ``y``, squared distances.

    Matrix products choose: a pair whose product distance exceeds the ``k``-th so far
    by more than rounding can explain is dropped.  What is left is measured from its
    differences.  With ``own``, names of the rows of both, a row meets no row of its name.
    """
    width = x.shape[1]
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    most = float(yy.max(initial=0))
    by_product = np.isfinite(4 * (float(xx.max(initial=0)) + most))
    rounding = 32 * (width + 8) * np.finfo(float).eps * (xx + most) if by_product else np.zeros(len(x))
    left, right = np.column_stack((-2 * x, xx, np.ones(len(x)))), np.column_stack((y, np.ones(len(y)), yy)).T
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    room = np.empty(TILE[0] * TILE[1])
    for s in range(0, len(x), TILE[0]):
        rows = np.arange(s, min(s + TILE[0], len(x)))
        slack, worst, best = rounding[rows], np.full(len(rows), np.inf), out[0]
        for c in range(0, len(y), TILE[1]):
            cols = slice(c, min(c + TILE[1], len(y)))
            a = room[: len(rows) * (cols.stop - c)].reshape(len(rows), -1)
            if by_product:
                np.matmul(left[s: s + len(rows)], right[:, cols], out=a)
            else:
                a[:] = squared(x[rows], y[cols])
            if own is not None:
                a[own[0][rows, None] == own[1][None, cols]] = np.nan
            # a later row that ties does not come in, so after ``k`` equal rows nothing can
            limit = np.where(worst > 0, worst + slack, -np.inf)
            if a.shape[1] > k and np.isinf(worst).any():
                limit = np.fmin(limit, np.partition(a, k - 1, axis=1)[:, k - 1] + 2 * slack)
            i, j = np.divmod(np.flatnonzero(a <= limit[:, None]), a.shape[1])
            if not len(i):
                continue
            d = squared_of(x, rows[i], y, c + j)
            i, j, d = (np.concatenate(z) for z in zip(best, (i[np.isfinite(d)], c + j[np.isfinite(d)], d[np.isfinite(d)])))
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            worst[i[nth == k - 1]] = d[nth == k - 1]
            best = i[nth < k], j[nth < k], d[nth < k]
        out.append((s + best[0], *best[1:]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _block_knn(k: int, exclude_self: bool):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["_role"] == 0]
        c = pdf[pdf["_role"] == 1].sort_values("_key", kind="stable")  # so that ties go to the lower key
        qk, ck = q["_key"].to_numpy(), c["_key"].to_numpy()
        a = b = np.zeros(0, np.int64)
        d = np.zeros(0)
        if len(q) and len(c):
            qx = np.stack(q["_v"].to_numpy()).astype(np.float64)
            cx = np.stack(c["_v"].to_numpy()).astype(np.float64)
            # rows with a number that is not finite are at no finite distance
            q_at, c_at = (np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (qx, cx))
            names, _ = pd.factorize(np.concatenate((ck, qk)))
            if qx.shape[1] and len(c_at):
                c_at = c_at[first_copies(cx[c_at], names[c_at], k)]
            # a key has one block, so only a block beside itself holds rows of the same key
            own = (names[len(ck):][q_at], names[c_at]) if exclude_self and pdf["_i"].iloc[0] == pdf["_j"].iloc[0] else None
            a, b, d = nearest_rows(qx[q_at], cx[c_at], k, own)
            a, b = q_at[a], c_at[b]
        found = pd.DataFrame({"_key": qk[a], "_nbr": ck[b], "_d": d})
        found["_part"] = pdf["_part"].iloc[0]
        return found
    return fn


QUERY_ROWS = 4096   # rows that one task of the exact search asks for


def packed_blocks(rows: DataFrame, n: int) -> RDD:
    """``(block, data)``: the rows ``_key, _v`` dealt by key into ``n`` blocks, each one Arrow table sorted by key, written."""
    def run(batches):
        held: dict = {}
        for b in batches:
            block = np.asarray(b.column("_blk"))
            for i in np.unique(block):
                held.setdefault(int(i), []).append(b.filter(pa.array(block == i)).select(["_key", "_v"]))
        for i in sorted(held):
            table = pa.Table.from_batches(held.pop(i)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_blk", "data"])

    dealt = rows.select(F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int").alias("_blk"), "_key", "_v").repartition(n, "_blk").sortWithinPartitions("_blk", "_key")
    return settled(dealt.mapInArrow(run, "_blk int, data binary")).rdd.map(tuple)


def unpacked(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of a block, without the rows whose vector is not finite."""
    rows = pa.ipc.open_stream(bytes(data)).read_all().combine_chunks()
    column = rows["_v"].chunk(0)
    x, at = batch_matrix(column, len(column[0]))
    if len(at) < len(column):
        raise ValueError("vectors have unequal widths")
    finite = np.flatnonzero(np.isfinite(x).all(axis=1))
    return rows["_key"].chunk(0).take(pa.array(finite)), x[finite]


def _search(k: int, exclude_self: bool, n_blocks: int):
    """Pairs of a block of rows that ask and a block of candidates to each row's ``k`` nearest so far and what ties with them."""
    def run(items):
        name, held = None, None

        def found():
            if held is None or not len(held[2]):
                return
            keys, i, j, d = held
            sink = pa.BufferOutputStream()
            table = pa.table([keys.take(pa.array(i)), j, pa.array(d)], ["_key", "_nbr", "_d"])
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield (sink.getvalue().to_pybytes(),)

        for (asked, queries), (block, candidates) in items:
            if asked != name:
                yield from found()
                name = asked
                q_keys, x = unpacked(queries)
                held = q_keys, np.zeros(0, np.int64), q_keys.slice(0, 0), np.zeros(0)
            c_keys, y = unpacked(candidates)
            if not (len(x) and len(y) and x.shape[1]):
                continue
            if x.shape[1] != y.shape[1]:
                raise ValueError("vectors have unequal widths")
            codes = pa.chunked_array([c_keys, q_keys]).dictionary_encode().unify_dictionaries()
            names = np.concatenate([np.asarray(c.indices) for c in codes.chunks])
            some = first_copies(y, names[:len(y)], k)
            # a key has one block, so only blocks of the same hash hold rows of the same key
            own = (names[len(y):], names[:len(y)][some]) if exclude_self and asked % n_blocks == block else None
            a, b, d = nearest_rows(x, y[some], k, own)
            i, j, d = np.concatenate((held[1], a)), pa.concat_arrays([held[2], c_keys.take(pa.array(some[b]))]), np.concatenate((held[3], d))
            order = np.lexsort((d, i))
            rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            far = np.full(len(x), np.inf)
            far[i[order][rank == k - 1]] = d[order][rank == k - 1]
            near = np.flatnonzero(d <= far[i])
            held = q_keys, i[near], j.take(pa.array(near)), d[near]
        yield from found()
    return run


def _knn_blocks(base: DataFrame, k: int, block_rows: int | None, exclude_self: bool, kinds: str) -> DataFrame:
    """``_key, _nbr, _d``: every row's nearest rows of all blocks.  A vector is written once, and once more if it asks."""
    spark = base.sparkSession
    n, asking, width = base.agg(F.count(F.lit(1)), F.count_if("_q"), F.max(F.size("_v"))).head()
    rows = block_rows or min(max(-(-n // 8), 4096), BLOCK_ROWS, -(-BLOCK_CELLS // max(width or 1, 1)))
    n_blocks = max(1, -(-n // rows))
    # blocks that ask are smaller, so that there are tasks for all cores; a multiple, so that equal keys are in blocks of equal remainders
    most = min(QUERY_ROWS, -(-asking // (2 * spark.sparkContext.defaultParallelism)) or 1)
    n_asking = n_blocks * max(1, -(-asking // (n_blocks * max(most, 256))))
    candidates, queries = packed_blocks(base, n_blocks), packed_blocks(base.where("_q"), n_asking)
    parts = queries.getNumPartitions()
    # the blocks that meet are read where they are written; all that a block of rows asks is one task
    found = queries.cartesian(candidates).coalesce(parts).mapPartitions(_search(k, exclude_self, n_blocks))

    def rows_of(batches):
        for b in batches:
            for data in b.column("x").to_pylist():
                yield from pa.ipc.open_stream(data)

    return spark.createDataFrame(found, "x binary", verifySchema=False).mapInArrow(rows_of, kinds)


def knn(df: DataFrame, key: str, vec: str, k: int = 5, partition: str | None = None,
        block_rows: int | None = None, exclude_self: bool = True, query_flag: str | None = None) -> DataFrame:
    """V05 (exact): the ``k`` nearest rows of every row by squared Euclidean
    distance, ``(key, nbr, dist, rank)``, ties by neighbour key.

    Rows are hashed into blocks of about ``block_rows`` (by default an eighth of
    the rows, but 4096 to ``BLOCK_ROWS`` and at most ``BLOCK_CELLS`` numbers),
    which are searched by matrix products in tiles (:func:`nearest_rows`).
    Without ``partition`` the blocks are written once, in the vectors' own type, and
    a task reads one after the other for its rows (``QUERY_ROWS`` at most), so
    vectors are not exchanged and the results are those of all blocks already.
    With ``partition`` (SMOTE stays inside a class) every pair of blocks of a
    partition is one group; a vector travels twice per block, and only each
    query's best k per block leave the task.  The final top-k per row is a partial
    window limit.  Work is quadratic in rows (exact search is); memory per task is
    bounded by the block.  With ``query_flag`` only rows where that boolean
    column is true are searched for (every row is still a candidate).
    Rows with a null key or a null vector take no part (they cannot be named
    or placed).
    """
    flag = [F.col(query_flag).alias("_q")] if query_flag else [F.lit(True).alias("_q")]
    key_type = df.schema[key].dataType.simpleString()
    if not partition:
        # float vectors stay half as large; a task widens them as the column would be
        kind = df.schema[vec].dataType
        own = F.col(vec) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else as_double_array(vec)
        base = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("_key"), own.alias("_v"), *flag)
        w = Window.partitionBy("_key").orderBy(F.col("_d").asc(), F.col("_nbr").asc())
        near = _knn_blocks(base, k, block_rows, exclude_self, f"_key {key_type}, _nbr {key_type}, _d double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return near.select(F.col("_key").alias(key), F.col("_nbr").alias("nbr"), F.col("_d").alias("dist"), "rank")
    pcols = [partition]
    base = (df.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
              .select(*pcols, F.col(key).alias("_key"), as_double_array(vec).alias("_v"), *flag))
    n = F.count(F.lit(1))
    rows = F.lit(block_rows) if block_rows else F.least(F.greatest(n / 8, F.lit(4096)), F.lit(BLOCK_ROWS), F.ceil(BLOCK_CELLS / F.greatest(F.max(F.size("_v")), F.lit(1))))
    blocks = F.ceil(n / rows).cast("int").alias("_nb")
    # blocks per partition, from its size (a null partition is one too)
    sized = join_null_safe(base, base.groupBy(partition).agg(blocks), [partition])
    blk = F.pmod(F.xxhash64("_key"), F.col("_nb")).cast("int")
    sized = sized.withColumn("_blk", blk)
    others = F.sequence(F.lit(0), F.col("_nb") - 1)
    queries = sized.where(F.col("_q")).select(*pcols, "_key", "_v", F.col("_blk").alias("_i"),
                                              F.explode(others).alias("_j"), F.lit(0).alias("_role"))
    cands = sized.select(*pcols, "_key", "_v", F.explode(others).alias("_i"), F.col("_blk").alias("_j"),
                         F.lit(1).alias("_role"))
    both = queries.unionByName(cands).withColumnRenamed(partition, "_part")
    schema = f"_key {key_type}, _nbr {key_type}, _d double, _part {df.schema[partition].dataType.simpleString()}"
    pairs = both.groupBy("_part", "_i", "_j").applyInPandas(_block_knn(k, exclude_self), schema).withColumnRenamed("_part", partition)
    w = Window.partitionBy(*pcols, "_key").orderBy(F.col("_d").asc(), F.col("_nbr").asc())
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select(*pcols, F.col("_key").alias(key), F.col("_nbr").alias("nbr"),
                         F.col("_d").alias("dist"), "rank"))
