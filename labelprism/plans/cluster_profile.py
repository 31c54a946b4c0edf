"""Entry 3 — cluster an embedding table and profile labels against clusters.

L2 normalise (V01) → reduce to 10-D (M06) → k-means, best of n_init (M07), all
restarts in shared scans → cluster id per row (M08) → reduce to 2-D for a map (M06) → output table without
the vector (P06) → cluster × label counts re-indexed to every cluster (A03),
row %, deviation from the global label share (A05), label centroids on the
map (A09), and counts by (label, cluster) / label / cluster (A08).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelprism.operators import assoc, cluster, vectors


def run(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label",
        k: int = 10, dims: int = 10, seed: int = 42, max_iter: int = 300, n_init: int = 10, nonlinear: bool = False) -> dict:
    """``nonlinear`` reduces by the neighbour graph's eigenvectors instead of PCA: up
    to four rounds, with the residual that they leave in ``models``."""
    spark = df.sparkSession
    vectors.vector_width(df, vec)
    unit = vectors.l2_normalise(df.select(key, label, vec), vec).persist()
    if nonlinear:
        ten, values, residual = cluster.eigenmaps(unit, key, vec, dims, seed=seed, max_rounds=4, tol=1e-3, out="_r10")
        red, first = unit.join(ten, key), {"eigenvalues": values, "residual": residual}
    else:
        red, first = cluster.reduce(unit, vec, dims, "_r10")
    found = cluster.kmeans_restarts(red, key, "_r10", k, seed, max_iter, n_init)
    centres = cluster.centres_table(spark, found)
    assigned = vectors.assign_clusters(red, "_r10", centres, "cluster", "centre", "cluster")
    if nonlinear:
        # the first two coordinates are the 2-D map of the same graph
        mapped, second = assigned.withColumn("_r2", F.slice("_r10", 1, 2)), first
    else:
        mapped, second = cluster.reduce(assigned, vec, 2, "_r2")
    table = (mapped.withColumn("dim1", F.col("_r2")[0].cast("float"))
                   .withColumn("dim2", F.col("_r2")[1].cast("float"))
                   .drop("_r2", "_r10", vec))
    domain = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    dev = assoc.deviation(table, "cluster", label, domain)
    return {
        "table": table,
        "models": {"reduce10": first, "kmeans": found, "reduce2": second},
        "deviation": dev,
        "centroids": table.groupBy(label).agg(
            F.avg(F.when(F.isnan("dim1"), None).otherwise(F.col("dim1"))).alias("centroid_x"),
            F.avg(F.when(F.isnan("dim2"), None).otherwise(F.col("dim2"))).alias("centroid_y")),
        "counts": assoc.label_cluster_counts(table, label, "cluster"),
        "max_abs_deviation": assoc.max_abs(dev, "deviation"),
    }
