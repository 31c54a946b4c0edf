"""Dimension reduction and clustering of vector columns.

:func:`reduce` is PCA (spark.ml), a linear projection, with the d × d covariance as
the only driver-side object.  :func:`eigenmaps` is the non-linear one: the lowest
eigenvectors of the neighbour graph's Laplacian, by orthogonal iteration on a table
of rows.  :func:`kmeans_restarts` runs all restarts of k-means in the same scans.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelprism.functions.columns import as_double_array, hash_hex, hash_uniform
from labelprism.operators.neighbours import knn_approximate
from labelprism.operators.vectors import batch_matrix, to_vector
from labelprism.session import ensure_checkpoint_dir, forget, kept, release_shuffles, settled

__all__ = ["fit_reducer", "reduce", "eigenmaps", "graph_edges", "fit_kmeans", "cluster", "kmeans_restarts", "Restarts"]


def fit_reducer(df: DataFrame, vec: str, k: int) -> PCAModel:
    """M06 fit: PCA to ``k`` components on an array or ml-vector column."""
    data = to_vector(df, vec, "_features") if dict(df.dtypes)[vec].startswith("array") \
        else df.withColumnRenamed(vec, "_features")
    return PCA(k=k, inputCol="_features", outputCol="_reduced").fit(data.select("_features"))


def reduce(df: DataFrame, vec: str, k: int, out: str | None = None,
           model: PCAModel | None = None) -> tuple[DataFrame, PCAModel]:
    """Project ``vec`` to ``k`` dimensions; returns (frame with ``out``
    as array<double>, fitted model).  The projection is a narrow map."""
    model = model or fit_reducer(df, vec, k)
    data = to_vector(df, vec, "_features", check=False) if dict(df.dtypes)[vec].startswith("array") \
        else df.withColumn("_features", F.col(vec))
    res = model.transform(data).withColumn(out or f"{vec}_{k}d", vector_to_array("_reduced"))
    return res.drop("_features", "_reduced"), model


def fit_kmeans(df: DataFrame, vec: str, k: int = 10, seed: int = 42, max_iter: int = 300,
               n_init: int = 10, tol: float = 1e-4, parallelism: int = 4) -> KMeansModel:
    """K-means (k-means|| initialisation) run from ``n_init`` seeds
    (seed, seed+1, …); the fit with the lowest training cost wins (ties → the
    earlier seed).  The input is persisted once; restarts are submitted from
    ``parallelism`` driver threads so their small jobs share the cluster."""
    from concurrent.futures import ThreadPoolExecutor
    data = to_vector(df, vec, "_features").select("_features").persist()

    def fit(s):
        return KMeans(k=k, seed=s, maxIter=max_iter, tol=tol, featuresCol="_features",
                      predictionCol="_cluster").fit(data)
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            models = list(pool.map(fit, range(seed, seed + n_init)))
    finally:
        data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def cluster(df: DataFrame, vec: str, model: KMeansModel, out: str = "cluster") -> DataFrame:
    """Assign each row to the fitted model's nearest centre (narrow map)."""
    data = to_vector(df, vec, "_features", check=False)
    return model.transform(data).withColumn(out, F.col("_cluster").cast("int")).drop("_features", "_cluster")


# ------------------------------------------------------------------ k-means, all restarts together
TASK_CELLS = 2_000_000  # numbers of a scan's task


class Restarts(NamedTuple):
    """Centres ``[restart, centre, dimension]``, the cost and the steps of each restart, scans of the data, and the best restart."""

    centres: np.ndarray
    costs: np.ndarray
    steps: np.ndarray
    scans: int

    @property
    def best(self) -> int:
        return int(self.costs.argmin())


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of each row and its squared distance."""
    d = np.maximum((x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)[None], 0)
    at = d.argmin(axis=1)
    diff = x - centres[at]
    return at, (diff ** 2).sum(axis=1)


def numbers(data: DataFrame, width: int) -> RDD:
    """The column ``_v`` as one matrix per batch of rows, so that a scan is one stage of matrices."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([batch_matrix(b.column("_v"), width)[0].tobytes()], pa.binary())], ["x"])

    return data.select("_v").mapInArrow(run, "x binary").rdd.map(lambda r: np.frombuffer(r["x"]).reshape(-1, width))


def added(blocks: RDD, run):
    """The sum of ``run``'s arrays over all blocks, added up in a tree."""
    return blocks.mapPartitions(lambda xs: [sum(map(run, xs), 0)]).treeReduce(lambda a, b: a + b)


def scan(blocks: RDD, width: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One pass for all restarts: per restart the sums and counts of its centres' rows, and its cost."""
    model = blocks.context.broadcast(centres)

    def run(x):
        out = []
        for c in model.value.values():
            at, d = nearest(x, c)
            out.append(np.array([np.bincount(at, v, len(c)) for v in (*x.T, np.ones(len(x)), d)]).T)
        return np.concatenate(out)

    total = added(blocks, run) + np.zeros((sum(map(len, centres.values())), width + 2))
    out = dict(zip(centres, np.split(total, np.cumsum([len(c) for c in centres.values()])[:-1])))
    return {r: (t[:, :width], t[:, width], float(t[:, width + 1].sum())) for r, t in out.items()}


def drawn(data: DataFrame, width: int, centres: dict[int, np.ndarray], costs: dict[int, float], share: float, seed: int, turn: int) -> dict[int, np.ndarray]:
    """Rows drawn as new candidates, for all restarts in one pass: with probability ``share * distance / cost``."""
    model = data.sparkSession.sparkContext.broadcast((centres, costs))

    def run(batches):
        for b in batches:
            x, rows = batch_matrix(b.column("_v"), width)
            u = np.asarray(b.column("_u"))[rows]
            cells, whose = [], []
            for r, c in model.value[0].items():
                _, d = nearest(x, c)
                # another uniform number per restart and turn, from the row's own
                mine = (u + (1 + r) * 0.6180339887498949 + turn * 0.7548776662466927) % 1.0
                hit = mine < share * d / max(model.value[1][r], 1e-300)
                cells += x[hit].tolist()
                whose += [r] * int(hit.sum())
            yield pa.record_batch([pa.array(whose, pa.int32()), pa.array(cells, pa.list_(pa.float64()))], ["restart", "x"])

    out: dict[int, list] = {r: [] for r in centres}
    for row in data.select("_v", "_u").mapInArrow(run, "restart int, x array<double>").collect():  # about ``share`` rows per restart
        out[row["restart"]].append(row["x"])
    return {r: np.array(sorted(x)).reshape(-1, width) for r, x in out.items()}


def weighted_start(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the candidates by k-means++ on their weights, moved by a few weighted steps."""
    rng = np.random.default_rng(seed)
    order = np.lexsort(candidates.T[::-1])
    x, w = candidates[order], np.maximum(weights[order], 1e-12)
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < k:
        _, d = nearest(x, np.array(centres))
        p = w * d
        if p.sum() <= 0:
            break
        centres.append(x[rng.choice(len(x), p=p / p.sum())])
    centres = np.array(centres)
    for _ in range(30):
        at, _ = nearest(x, centres)
        n = np.bincount(at, w, len(centres))
        moved = np.array([np.bincount(at, w * x[:, j], len(centres)) for j in range(x.shape[1])]).T
        centres = np.where(n[:, None] > 0, moved / np.maximum(n, 1e-300)[:, None], centres)
    return centres


def kmeans_restarts(df: DataFrame, key: str, vec: str, k: int = 10, seed: int = 42, max_iter: int = 300, n_init: int = 10, tol: float = 1e-4, rounds: int = 2) -> Restarts:
    """K-means from ``n_init`` starts (k-means||), all of them in the same scans.

    Every scan broadcasts the centres of the restarts that still move and adds up
    sums by (restart, centre); a restart drops out when no centre moves further
    than ``tol``.  Draws are hashes of seed and key.  Rows without a vector of the
    common width take no part; with fewer different rows than ``k`` there are fewer
    centres.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    data = kept = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("_k"), as_double_array(vec).alias("_v"), hash_uniform(key, seed).alias("_u")).persist()
    try:
        width, n_rows = data.agg(F.max(F.size("_v")), F.count(F.lit(1))).head()
        if width is None:
            raise ValueError(f"no vectors in column {vec!r}")
        # every scan starts a task per partition: as many as the cores or the numbers ask for
        data = data.coalesce(max(spark.sparkContext.defaultParallelism, -(-n_rows * width // TASK_CELLS)))
        blocks = numbers(data, width).persist()
        first = data.where(F.size("_v") == width).agg(*(F.min_by("_v", hash_hex("_k", seed + 1000 + r)).alias(f"r{r}") for r in range(n_init))).head()
        candidates = {r: np.array([first[r]], np.float64) for r in range(n_init)}
        scans = 1
        for turn in range(rounds):
            costs = {r: found[2] for r, found in scan(blocks, width, candidates).items()}
            new = drawn(data, width, candidates, costs, 2.0 * k, seed, turn)
            candidates = {r: np.unique(np.concatenate((c, new[r])), axis=0) for r, c in candidates.items()}
            scans += 2
        weights = {r: found[1] for r, found in scan(blocks, width, candidates).items()}
        scans += 1
        centres = {r: weighted_start(candidates[r], weights[r], k, seed + r) for r in range(n_init)}
        costs, steps, moving = np.zeros(n_init), np.zeros(n_init, int), set(range(n_init))
        for _ in range(max_iter):
            found = scan(blocks, width, {r: centres[r] for r in moving})
            scans += 1
            for r in sorted(moving):
                sums, n, cost = found[r]
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[r])
                far = float(((new - centres[r]) ** 2).sum(axis=1).max())
                centres[r], costs[r], steps[r] = new, cost, steps[r] + 1
                if far <= tol ** 2:
                    moving.discard(r)
            if not moving:
                break
        # the cost of the centres as they are now
        for r, (_, _, cost) in scan(blocks, width, centres).items():
            costs[r] = cost
        scans += 1
        blocks.unpersist()
    finally:
        kept.unpersist()
    most = max(len(c) for c in centres.values())
    out = np.full((n_init, most, width), np.nan)
    for r, c in centres.items():
        out[r, : len(c)] = c
    return Restarts(out, costs, steps, scans)


def centres_table(spark, found: Restarts) -> DataFrame:
    """``cluster, centre`` of the best restart, clusters in the order of their centres."""
    best = found.centres[found.best]
    best = best[~np.isnan(best).any(axis=1)]
    best = best[np.lexsort(best.T[::-1])]
    return spark.createDataFrame([(int(i), [float(v) for v in c]) for i, c in enumerate(best)], "cluster int, centre array<double>")


# ------------------------------------------------------------------ Laplacian eigenmaps
LINKS = 1_000_000  # links of a block
ROUND_BYTES = 512 << 20  # that the products of a round may exchange before their files are removed


def graph_edges(df: DataFrame, key: str, vec: str, k: int = 15, seed: int = 42, exact: bool = False) -> DataFrame:
    """``src, dst, w`` of the symmetric neighbour graph: a link if either row has the other among its ``k`` nearest.

    ``w`` is ``1 / sqrt(degree(src) * degree(dst))``, so the largest eigenvalue of the matrix is 1.
    """
    from labelprism.operators.vectors import knn
    links = knn(df, key, vec, k=k) if exact else knn_approximate(df, key, vec, k=k, seed=seed)
    one = links.select(F.col(key).alias("src"), F.col("nbr").alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    ends = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    return ends.select("src", "dst", (1 / F.sqrt(F.col("n") * F.col("m"))).alias("w"))


def linked(rows: DataFrame, edges: DataFrame, parts: int) -> tuple[DataFrame, RDD]:
    """The rows' places ``src, block, pos, ...`` in ``parts`` blocks, and each block's number, links and first columns ``t``.

    The links of a block, ``(at, w, starts, to, pos)``: rows ``at`` of the block times ``w``,
    added up over stretches that begin at ``starts``, go to the rows ``pos`` of block ``c``
    for each ``(c, from, to)`` of ``to``.
    """
    place = rows.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int"))
    place = place.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("src")) - 1).checkpoint(eager=True)
    ends = edges.join(place.select("src", F.col("block").alias("home"), F.col("pos").alias("at")), "src") \
                .join(place.select(F.col("src").alias("dst"), F.col("block").alias("to"), "pos"), "dst")

    def build(own: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        first = np.stack(own.sort_values("pos")["t"].to_numpy())
        at, to, pos, w = (out[c].to_numpy() for c in ("at", "to", "pos", "w"))
        order = np.lexsort((pos, to))
        at, to, pos, w = at[order], to[order], pos[order], w[order]
        starts = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (to[1:] != to[:-1]))))
        to, pos = to[starts], pos[starts]
        new = np.concatenate((np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))), [len(to)]))
        links = at, w, starts, [(int(to[i]), int(i), int(j)) for i, j in zip(new[:-1], new[1:])], pos
        return pd.DataFrame({"block": own["block"].iloc[:1], "state": [pickle.dumps((links, first))]})

    found = place.select("block", "pos", "t").groupBy("block").cogroup(ends.select("home", "at", "to", "pos", "w").groupBy("home")).applyInPandas(build, "block int, state binary")
    return place, found.rdd.map(lambda r: (r["block"], pickle.loads(r["state"])))


def owed(m: int):
    """A block's part of the product with its last ``m`` columns, to the blocks that it has links to."""
    def run(item):
        _, (links, t) = item
        at, w, starts, to, pos = links
        sums = np.add.reduceat(w[:, None] * t[at, -m:], starts, axis=0)
        for c, i, j in to:
            yield c, (pos[i:j], sums[i:j])
    return run


def sent(m: int):
    """A block to itself, and what it owes to others."""
    def run(item):
        yield item
        yield from owed(m)(item)
    return run


def received(m: int):
    """Blocks with ``m`` more columns: the next Chebyshev polynomial of the matrix times the first ones."""
    def run(items):
        states, parts = {}, {}
        for block, (a, b) in items:
            if isinstance(a, tuple):
                states[block] = a, b
            else:
                parts.setdefault(block, []).append((a, b))
        for block, (links, t) in states.items():
            total = np.zeros((len(t), m))
            for pos, sums in parts[block]:
                total[pos] += sums
            yield block, (links, np.hstack((t, total if t.shape[1] == m else 2 * total - t[:, -2 * m:-m])))
    return run


def columns_by_block(items) -> tuple[dict, list]:
    """Of a partition's items, per block the links and columns ``{-1: links, n: the n-th m columns}``, and what blocks were sent."""
    states, parts = {}, []
    for block, (a, b) in items:
        if isinstance(a, int):
            states.setdefault(block, {})[a] = b
        else:
            parts.append((block, (a, b)))
    return states, parts


def product(links: RDD, columns: list[RDD], m: int, parts: int) -> tuple[RDD, RDD]:
    """The next ``block, (n, m columns)`` after ``columns``, and the sums that blocks owe each other for it.

    Links and columns stay where they are; only the sums are exchanged.
    """
    n = len(columns)

    def send(items):
        for block, of in columns_by_block(items)[0].items():
            yield from owed(m)((block, (of[-1], of[n - 1])))

    def receive(items):
        states, came = columns_by_block(items)
        held = [(block, ((), np.hstack([of[c] for c in sorted(of)]))) for block, of in states.items()]
        for block, (_, t) in received(m)([*held, *came]):
            yield block, (n, t[:, -m:])

    sums = links.union(columns[-1]).mapPartitions(send).partitionBy(parts, int)
    last = columns[-1] if n == 1 else columns[-2].union(columns[-1])
    return last.union(sums).mapPartitions(receive, preservesPartitioning=True), sums


def side_by_side(columns: list[RDD]) -> RDD:
    """``block, (n, columns)`` of all steps as ``block, ((), all columns)``."""
    def run(items):
        for block, of in columns_by_block(items)[0].items():
            yield block, ((), np.hstack([of[c] for c in sorted(of)]))

    every = columns[0]
    for c in columns[1:]:
        every = every.union(c)
    return every.mapPartitions(run, preservesPartitioning=True)


def eigenmaps(df: DataFrame, key: str, vec: str, dims: int = 2, k: int = 15, seed: int = 42, max_rounds: int = 12, steps: int = 8, tol: float = 1e-4,
              exact: bool = False, out: str = "map") -> tuple[DataFrame, np.ndarray, float]:
    """M06 (non-linear): ``key, out array<double>[dims]`` from the neighbour graph, the eigenvalues, and the largest residual.

    The coordinates are the eigenvectors of the normalised Laplacian after the
    constant one.  A round takes ``dims + 4`` columns, multiplies them ``steps + 1``
    times by the graph's matrix in Chebyshev polynomials and keeps the best
    combinations of all columns that arose (Rayleigh-Ritz); only products of columns
    come to the driver.  Rows and links are dealt into blocks, arrays of a task each,
    which stay where they are: a product is one exchange of the sums that blocks owe
    each other (:func:`product`), and as many products as exchange ``ROUND_BYTES`` are one
    job, after which their files are removed.  Coordinates are
    divided by the square root of the degree; of each, the row with the largest
    entry is positive.  Rows without a neighbour are left out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    edges = settled(graph_edges(df, key, vec, k, seed, exact))
    m = dims + 4
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    n_links = edges.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_links // LINKS))
    place, found = linked(degree.withColumn("t", F.array(*(hash_uniform("src", seed + j) - 0.5 for j in range(m)))), edges, parts)
    dealt = found.partitionBy(parts, int)
    whole_blocks = kept(dealt)
    release_shuffles(dealt)
    forget(edges)
    links, y = whole_blocks.mapPartitions(lambda items: ((b, (-1, s[0])) for b, s in items), True), whole_blocks.mapPartitions(lambda items: ((b, (0, s[1])) for b, s in items), True)
    # a row's links lead to each block once at most
    at_once = max(1, ROUND_BYTES // max(1, min(n_links, place.count() * parts) * (8 * m + 8)))
    whole = m * (steps + 2)
    # the matrix times all columns but the last block, in terms of the columns: A T0 = T1, A Tj = (Tj+1 + Tj-1) / 2
    shift = np.zeros((whole, whole - m))
    for j in range(steps + 1):
        for c in range(m):
            if j == 0:
                shift[m + c, c] = 1
            else:
                shift[m * (j + 1) + c, m * j + c] = shift[m * (j - 1) + c, m * j + c] = 0.5
    values, residual, last = np.zeros(m), np.inf, None
    for _ in range(max_rounds):
        columns, exchanged = [y.persist(StorageLevel.MEMORY_AND_DISK)], []
        for n in range(steps + 1):
            new, sums = product(links, columns, m, parts)
            columns.append(new.persist(StorageLevel.MEMORY_AND_DISK))
            exchanged.append(sums)
            if len(exchanged) == at_once:
                columns[-1].count()
                while exchanged:
                    release_shuffles(exchanged.pop())
        table = side_by_side(columns).persist(StorageLevel.MEMORY_AND_DISK)
        table.checkpoint()
        g = added(table, lambda item: item[1][1].T @ item[1][1])
        inner = whole - m
        basis, vectors = np.linalg.eigh(g[:inner, :inner])
        good = basis > basis.max() * 1e-12
        to = vectors[:, good] / np.sqrt(basis[good])
        b = to.T @ (g[:inner] @ shift) @ to
        found, mix = np.linalg.eigh((b + b.T) / 2)
        order = np.argsort(-found)[:m]
        values, by = found[order], to @ mix[:, order]
        # squared length of A y - value * y
        ay = shift @ by
        square = np.einsum("ij,ik,kj->j", ay, g, ay) - values ** 2
        residual = float(np.sqrt(np.maximum(square[: dims + 1], 0)).max())
        mix = np.zeros((whole, m))
        mix[:inner, :by.shape[1]] = by
        y = table.mapValues(lambda state, mix=mix: (0, state[1] @ mix))
        for c in columns:
            c.unpersist()
        for sums in exchanged:
            release_shuffles(sums)
        if last is not None:
            forget(last)
        last = table
        if residual < tol:
            break
    rows = y.flatMap(lambda item: ((item[0], pos, t) for pos, t in enumerate(item[1][1].tolist())))
    y = df.sparkSession.createDataFrame(rows, "block int, pos int, t array<double>").join(place.select("block", "pos", "src", "n"), ["block", "pos"])
    y = settled(y)
    if last is not None:
        forget(last)
    shown = [F.col("t")[j + 1] for j in range(dims)]
    signs = y.agg(*(F.max_by(F.signum(c), F.struct(F.round(F.abs(c), 9), hash_hex("src", seed))) for c in shown)).head()
    scaled = y.select(F.col("src").alias(key), F.array(*(c * float(s or 1.0) / F.sqrt("n") for c, s in zip(shown, signs))).alias(out))
    return scaled, values[: dims + 1], residual
