"""Centroid clustering with ns-bounds: exact k-means that recalls where every centroid has been.

Vectors become integers, so distances, sums and ties are exact. A stored row holds its vector, its cluster and,
per centroid, the last squared distance that was counted and the round it belongs to. The centroids of all
rounds are kept. A stored distance is loosened by the norm of that centroid's total displacement since its own
round, not by the sum of the drifts of the rounds between, which is never less. Where the loosened bounds
leave one nearest centroid, nothing is counted; elsewhere the own distance is counted first, then the distances
whose bounds still fail. So every round assigns as a full scan would, ties to the smaller number.

Each round maps the stored rows to new ones without a shuffle and reduces them to one row of sums a cluster.
The driver holds centroids only. A round's rows are written to the shared folder; those of the round before are
deleted once the next are there, so two copies exist at most, and a lost executor re-reads files.

Defined cases: vectors with another number of components, or with a null or non-finite one, are left out, as is
a null vector; repeated rows are clustered each; a null id counts as an empty one in the seeding order, and equal
ids are ordered by their vector; fewer vectors than clusters give fewer centroids; an empty cluster keeps its
centroid; an empty table gives an empty result. A component of 2^17 or more cannot be squared and added
exactly in a long and raises an error. Only the two named columns are read, so other columns never clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import scratch_path

SCALE, LIMIT = 1024, 1 << 17
SEED = "3:"
MARGIN = 1e-9  # of a bound: more than the rounding of a root


def integers(vectors: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """vec_id and x: the whole vectors of ``dims`` finite components, as floor(1024 * component)."""
    doubles = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    whole = F.coalesce((F.size(doubles) == dims) & F.forall(doubles, finite), F.lit(False))
    too_large = F.raise_error(F.lit(f"a vector component is {LIMIT} or more")).cast("int")
    as_int = lambda v: F.when(F.abs(v) < LIMIT, F.floor(v * SCALE).cast("int")).otherwise(too_large)
    return vectors.filter(whole).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(doubles, as_int).alias("x"))


def displacement(history: np.ndarray) -> np.ndarray:
    """(round, centroid): the norm of how far a centroid has come since that round."""
    moved = history[-1][None] - history
    return np.array([[math.sqrt(int((v * v).sum())) for v in row] for row in moved])


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, cluster: np.ndarray, counted: np.ndarray, since: np.ndarray, history: np.ndarray, every: bool = False) -> int:
    """Bring ``cluster``, ``counted`` and ``since`` up to the last round of ``history``; how many distances that took.

    A row with cluster -1 is new: all its distances are counted. ``every`` counts the own distance of every row.
    """
    now, k = len(history) - 1, history.shape[1]
    far, moved, column = np.sqrt(counted.astype(np.float64)), displacement(history), np.arange(k)
    loose = moved[since, column]
    lower = (far - loose) - MARGIN * (1 + far + loose)
    own = np.maximum(cluster, 0)
    row = np.arange(len(x))
    upper = (far + loose)[row, own] * (1 + MARGIN) + MARGIN
    fails = lower <= upper[:, None]
    fails[row, own] = False
    fails[cluster < 0] = True
    unsure = np.flatnonzero(fails.any(axis=1) | every)
    cost = len(unsure)
    for j in range(k):  # the own distance first: it may settle the others
        at = unsure[own[unsure] == j]
        counted[at, j], since[at, j] = squared(x[at], history[-1, j]), now
    upper[unsure] = np.sqrt(counted[unsure, own[unsure]].astype(np.float64)) * (1 + MARGIN) + MARGIN
    fails[unsure] &= (lower[unsure] <= upper[unsure][:, None]) | (cluster[unsure] < 0)[:, None]
    fails[row, own] = False
    for j in range(k):
        at = np.flatnonzero(fails[:, j])
        counted[at, j], since[at, j] = squared(x[at], history[-1, j]), now
        cost += len(at)
    known = np.where(since[unsure] == now, counted[unsure], np.iinfo(np.int64).max)
    cluster[unsure] = known.argmin(axis=1)
    return cost


def moved_rows(rows: DataFrame, history: list[list[list[int]]], every: bool) -> DataFrame:
    """``rows`` assigned to the last centroids of ``history``."""
    past, fresh = np.array(history, np.int64), "cluster" not in rows.columns
    _, k, dims = past.shape

    def run(batches):
        import pyarrow as pa

        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * k), pa.array(a.ravel()))
        table = lambda batch, name, width: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for batch in batches:
            n = batch.num_rows
            x = table(batch, "x", dims).astype(np.int64)
            if fresh:
                cluster, counted, since = np.full(n, -1, np.int32), np.zeros((n, k), np.int64), np.zeros((n, k), np.int32)
            else:
                cluster, counted, since = batch.column("cluster").to_numpy(zero_copy_only=False).copy(), table(batch, "counted", k).copy(), table(batch, "since", k).copy()
            assign(x, cluster, counted, since, past, every)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster), lists(counted), lists(since)], names=["vec_id", "x", "cluster", "counted", "since"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, x array<int>, cluster int, counted array<bigint>, since array<int>")


def stored(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """``df`` from a fresh path of the shared folder; the path ``before``, which it was made from, is deleted."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ns-kmeans")
    df.write.parquet(path)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(path), path


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10) -> DataFrame:
    """vec_id, cluster, x, distance (squared) and centroid per whole vector, after ``rounds`` rounds and a last assignment."""
    rows, path = stored(integers(vectors, vec_id, vector, dims))
    mark = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = rows.select("x", mark.alias("mark")).orderBy("mark", "x").limit(k).collect()
    result = "vec_id", "cluster", "x", "distance", "centroid"
    if not seeds:
        return rows.selectExpr("vec_id", "0 cluster", "x", "0L distance", "x centroid")
    history = [[[int(v) for v in r["x"]] for r in seeds]]
    for turn in range(rounds + 1):
        rows, path = stored(moved_rows(rows, history, turn == rounds), path)
        if turn < rounds:
            sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(dims)]).collect()
            following = list(history[-1])
            for r in sums:
                following[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
            history.append(following)
    centroids = F.array(*[F.array(*map(F.lit, c)) for c in history[-1]])
    return rows.withColumns({"distance": F.get("counted", F.col("cluster")), "centroid": F.get(centroids, F.col("cluster"))}).select(*result)


def inertia(clustered: DataFrame) -> DataFrame:
    """``clustered`` with cluster_inertia and inertia: squared distances added up over a cluster and over all; their number is bounded by k."""
    per = {r["cluster"]: r["d"] for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = F.get(F.array(*[F.lit(per.get(j, 0)).cast("long") for j in range(max(per, default=0) + 1)]), F.col("cluster"))
    return clustered.withColumns({"cluster_inertia": own, "inertia": F.lit(sum(per.values())).cast("long")})


def comparison_sql(dims: int = 64, k: int = 8, rounds: int = 10) -> str:
    """Plain k-means over all distances, for comparison."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
 FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        "vx AS MATERIALIZED (SELECT row, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v)",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM
 (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM v) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d, c)) AS best FROM (SELECT row, c, CAST(sum((vx.x - m.x) * (vx.x - m.x)) AS BIGINT) AS d FROM vx JOIN c{r} m USING (i) GROUP BY row, c) GROUP BY row)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN
 (SELECT best.c AS c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM vx JOIN a{r} USING (row) GROUP BY best.c, i) n ON n.c = o.c AND n.i = o.i)""")
    return "WITH " + ",\n".join(parts) + f""",
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM v JOIN a{rounds} USING (row) JOIN h ON h.c = best.c"""
