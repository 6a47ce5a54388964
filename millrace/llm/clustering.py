"""Centroid clustering with built-in expressions: no Python in the tasks.

Vectors become integers, so that sums and distances are exact and results don't depend on partitioning. A round is
one pass: ``zip_with`` and ``aggregate`` give the distance to each centroid, which stand in the plan as literal
arrays, ``array_min`` of structs picks the nearest, and one column sum for each component makes up the next centroids. Sums
are taken in each task first, so a cluster with most of the vectors moves no more rows than any other. Only k rows
of dims + 2 numbers reach the driver in a round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise


@dataclass(frozen=True)
class ClusterParams:
    """``scale``: a component x becomes floor(scale * x). ``k`` and ``dims`` bound what the driver holds and what
    the plan spells out: k * dims numbers."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: int = 2


def whole_vectors(vectors: DataFrame, params: ClusterParams, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors with ``dims`` components, none null or non-finite, as integers.

    An integer so large that a squared distance might leave the range of a long fails the job.
    """
    most = 1 << ((62 - (params.dims - 1).bit_length()) // 2 - 1)
    message = F.lit(f"a component is not below {most} after scaling: distances could overflow")

    def whole(x: Column) -> Column:
        value = F.floor(F.lit(float(params.scale)) * x.cast("double"))
        return F.when(F.abs(value) < most, value).otherwise(F.raise_error(message).cast("bigint"))

    finite = F.forall("e", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("e"))
    return rows.where((F.size("e") == params.dims) & finite).select("id", F.transform("e", whole).alias("v"))


def _literal(values, suffix: str = "L") -> str:
    return f"array({','.join(f'{x}{suffix}' for x in values)})"


def nearest(vector: str, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number where two are as near."""
    distance = "aggregate(zip_with({}, {}, (a, b) -> a - b), 0L, (total, d) -> total + d * d)"
    found = [f"named_struct('distance', {distance.format(vector, _literal(c))}, 'cluster', {i})" for i, c in enumerate(centroids)]
    return F.expr(f"array_min(array({', '.join(found)}))")


def first_centroids(rows: DataFrame, params: ClusterParams) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, by hash; then by vector where an id is repeated."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("id").cast("string")), 256)
    found = rows.where("id IS NOT NULL").orderBy(key, "v").limit(params.k).select("v").collect()
    return [list(r["v"]) for r in found]


def moved_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by floor(sum / count) of the vectors nearest to it; one without vectors stays."""
    dims = range(len(centroids[0]))
    near = rows.select(nearest("v", centroids)["cluster"].alias("cluster"), "v")
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(v[{i}]) AS s{i}") for i in dims])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in dims]
    return out


def cluster_vectors(vectors: DataFrame, params: ClusterParams = ClusterParams(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each whole vector.

    Rows with a null vector, of another length, or with a null or non-finite component are left out. Rows
    of one id are vectors of their own; one without an id takes part but is no first centroid. Where fewer
    than k vectors have an id, there are as many clusters; without any, or with an empty table, there are no rows. Other
    columns are ignored, whatever their names. Vectors have a fixed length, so none is very long.
    """
    rows = materialise(whole_vectors(vectors, params, id_column, vector_column), "vectors")
    centroids = first_centroids(rows, params)
    if not centroids:
        return rows.where("false").select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(params.rounds):
        centroids = moved_centroids(rows, centroids)
    assigned = materialise(rows.select("id", nearest("v", centroids).alias("near")).select("id", "near.*"), "assigned")
    inertia = dict.fromkeys(range(len(centroids)), 0)
    for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect():
        inertia[r["cluster"]] = int(r["total"])
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        F.col("id").alias(id_column), "cluster", "distance",
        F.get(F.expr(_literal(inertia.values())), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(F.expr(_literal([f"'{d}'" for d in digests], "")), F.col("cluster")).alias("centroid_sha256"))
