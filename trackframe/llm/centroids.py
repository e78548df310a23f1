"""Centroid clustering by progressive search in Walsh-Hadamard coefficients.

Vectors become integers; their transform, exact in integers, is written once. As the transform keeps squared
distances but for a fixed factor, centroids are compared by coefficients, coarse to fine: the first coefficients give
every centroid a partial distance, which can only grow. One centroid, the best so far, is measured in full, and those
whose partial distance is already above that are strictly worse and leave. What stays is measured over all coefficients,
so assignments and distances are those of a full search. Rows are never grouped by vector: a task adds up
its own rows by centroid, and sums of (centroid, coefficient) are all that is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import materialize

#: Ends of the blocks of coefficients, coarse to fine, as shares of all; rows searched at once.
STEPS, ROWS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1), 4096
#: Integer components beyond this bound, like those that are no numbers, keep a vector out: 2**30 bounds every coefficient.
LIMIT = 1 << 24
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def sequency(size: int) -> np.ndarray:
    """The order of a Walsh-Hadamard transform's coefficients by their functions' sign changes: coarse to fine."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")


def butterflies(rows: np.ndarray) -> np.ndarray:
    """The transform of integer rows whose length is a power of two, in its own order."""
    n, size = rows.shape
    out, step = rows.astype(np.int64), 1
    while step < size:
        pair = out.reshape(n, -1, 2, step)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Coefficients of integer rows, coarse to fine."""
    return butterflies(rows)[:, sequency(rows.shape[1])]


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The rows that `transform` was given; exact for sums of rows too."""
    plain = np.empty_like(coefficients)
    plain[:, sequency(coefficients.shape[1])] = coefficients
    return butterflies(plain) // coefficients.shape[1]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance in coefficients) of every row (one at least); of equal ones the smaller number."""
    n, k = len(rows), len(centroids)
    row, cent, part = np.repeat(np.arange(n), k), np.tile(np.arange(k), n), np.zeros(n * k, np.int64)
    bound, low = np.full(n, np.iinfo(np.int64).max), 0
    for share in STEPS:
        high = int(share * rows.shape[1])
        d = rows[row, low:high] - centroids[cent, low:high]
        part += np.einsum("ij,ij->i", d, d)
        # The best so far, measured in full: nothing above it can be the nearest.
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        hit = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, first), np.diff(np.r_[first, len(part)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        if high == rows.shape[1]:
            return cent[hit], part[hit]
        d = rows - centroids[cent[hit]]
        bound = np.minimum(bound, np.einsum("ij,ij->i", d, d))
        stay = part <= bound[row]
        row, cent, part, low = row[stay], cent[stay], part[stay], high
    raise AssertionError("the last step takes all coefficients")


def _coefficients(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, coefficients of the vectors of exactly `size` components, each as integer floor(scale * x).

    Rows whose vector is null, has another length, or a component that is null, not finite or beyond LIMIT after scaling
    are left out.
    """
    x = lambda e: e.cast("double") * scale
    sound = (F.size("embedding") == size) & F.forall("embedding", lambda e: F.coalesce(F.abs(x(e)) <= LIMIT, F.lit(False)))
    whole = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.floor(x(e)).cast("int")).alias("whole"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                out = transform(_coefficients(b.column(1))).astype(np.int32)
                ends = pa.array(np.arange(b.num_rows + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], ["vec_id", "coefficients"])

    return whole.mapInArrow(run, "vec_id long, coefficients array<int>")


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of rows(vec_id, coefficients); distances are of the integer vectors."""
    held = rows.sparkSession.sparkContext.broadcast(transform(centroids))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = _coefficients(b.column(1))
            for at in range(0, len(x), ROWS):
                cluster, far = nearest(x[at : at + ROWS], held.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(cluster)), pa.array(cluster, pa.int32()), pa.array(far // x.shape[1])], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "coefficients").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors averaged, rounded down componentwise; a centroid without vectors stays."""
    held, (k, size) = rows.sparkSession.sparkContext.broadcast(transform(centroids)), centroids.shape

    def run(batches):
        import pyarrow as pa

        total = np.zeros((k, size + 1), np.int64)  # the last column counts
        for b in batches:
            x = _coefficients(b.column(0))
            for at in range(0, len(x), ROWS):
                own = x[at : at + ROWS]
                cluster, _ = nearest(own, held.value)
                order = np.argsort(cluster, kind="stable")
                at_first = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
                total[cluster[order][at_first], :size] += np.add.reduceat(own[order], at_first, axis=0)
                total[:, size] += np.bincount(cluster, minlength=k)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(total[c, i])], ["cluster", "at", "total"])

    sums = rows.select("coefficients").mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k, size + 1), np.int64)
    for c, i, n in sums:
        total[c, i] = n
    out, has = centroids.copy(), total[:, size] > 0
    out[has] = restore(total[has, :size]) // total[has, size:]
    return out


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of vectors(vec_id, embedding).

    The vectors are those of `integer_vectors`; others have no row in the result. The centroids start as the
    `clusters` vectors (all, if there are fewer) whose sha256 of `seed:vec_id` comes first, in that order; rows of one
    vec_id come in the order of their coefficients, rows without vec_id start no centroid. Each of `rounds` rounds assigns all vectors
    to the nearest centroid and moves every centroid to the mean of its vectors, rounded down; then all are assigned once more.
    Repeated rows and equal vectors count each for itself; rows without vec_id are assigned like others; other
    columns are ignored; an empty table gives none, as does one in which no vector has an id. `clusters` and `size` (a power of two)
    are parameters, so what goes to the driver and to the tasks, clusters * (size + 1) numbers, does not grow with the table.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, size, scale), "coefficients")
    start = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "coefficients").limit(clusters).select("coefficients").collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    at = restore(np.array([r[0] for r in start], np.int64))
    for _ in range(rounds):
        at = moved(rows, at)
    done = materialize(assigned(rows, at), "clusters")
    inertia = dict(done.groupBy("cluster").agg(F.sum("distance")).collect())
    every = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(at.tolist())]
    own = spark.createDataFrame(every, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(own), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def _oracle() -> str:
    """DuckDB SQL for cluster() as its query runs it: every round is a pair of steps."""
    steps = []
    for r in range(4):
        steps.append(
            f"pair{r} AS MATERIALIZED (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM kept, centroid{r}), "
            f"near{r} AS MATERIALIZED (SELECT * FROM pair{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
        )
        if r < 3:
            steps.append(
                f"mean{r} AS (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM near{r}) GROUP BY cluster, i) GROUP BY cluster), "
                f"centroid{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c)::BIGINT[] AS c FROM centroid{r} LEFT JOIN mean{r} USING (cluster))"
            )
    return (
        "WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "centroid0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, v AS c FROM kept QUALIFY cluster < 16), "
        + ", ".join(steps)
        + " SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM near3 JOIN (SELECT cluster, c FROM centroid3) USING (cluster)"
    )


ORACLE = _oracle()
