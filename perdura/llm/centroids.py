"""Centroid clustering on whole numbers, screened by float32 products with rigorous error bounds.

Vectors and centroids are whole numbers, so a round's result is one exact clustering, the
same on any partitioning and after any retry. Products of vectors and centroids are done
in float32; from the norms follows an interval that surely holds each exact distance.
Centroids whose interval begins below the lowest end are the shortlist: mostly one, else
they are compared by exact whole-number distances, and ties go to the smaller number.

A round is one narrow pass over the vectors; each task gives sums per centroid, and only
those are shuffled. What the driver holds is the centroids: their number times the width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import map_rows, record_batch, to_arrow

WIDTH, SCALE, ROUNDS, CENTROIDS = 64, 1024, 10, 8
#: Squared distances of whole numbers up to this fit a long: 64 * (2 * 2**27)**2 < 2**63.
LARGEST = 1 << 27
#: Distances that are held at once: vectors by centroids.
CELLS = 4_000_000
#: Unit roundoffs; single has room for the conversion of both factors and any order of summation.
SINGLE, DOUBLE = 2.0**-24, 2.0**-53


def whole_vectors(b: pa.RecordBatch, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that are kept, and their vectors as whole numbers: width components, none null or non-finite."""
    lists = b.column("vector")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    x = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(x[good] * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: squared distances would not fit a long")
    return rows[good], x.astype(np.int64)


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |x - c|^2 - |x|^2 for all pairs, from one float32 product.

    A float32 dot product of n terms differs from the exact one by at most g * |x| * |c|
    with g = k u / (1 - k u), k = n + 2 roundings (n sums and products, in any order or fused,
    and the conversions). Norms are exact whole numbers; the rest is done in double.
    """
    k = x.shape[1] + 2
    gamma = k * SINGLE / (1 - k * SINGLE)
    square = np.einsum("ij,ij->i", centroids, centroids).astype(float)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))[:, None] * np.sqrt(square)[None, :] * (1 + 8 * DOUBLE)
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(float)
    middle = square - 2 * dot
    wide = 2 * gamma * norms + 8 * DOUBLE * (square + 2 * np.abs(dot) + norms)
    return middle - wide, middle + wide


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each vector; of equally near ones the smallest."""
    out = np.empty(len(x), dtype=np.int32)
    step = max(1, CELLS // max(1, len(centroids)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        low, high = intervals(part, centroids)
        short = low <= high.min(axis=1, keepdims=True)
        best = short.argmax(axis=1)
        open_rows = short.sum(axis=1) > 1
        i, j = np.nonzero(short & open_rows[:, None])
        if len(i):
            d = exact(part[i], centroids[j])
            order = np.lexsort((j, d, i))
            first = order[np.diff(i[order], prepend=-1) > 0]
            best[i[first]] = j[first]
        out[at : at + step] = best
    return out


def first_centroids(vectors: DataFrame, count: int, width: int) -> np.ndarray:
    """The kept vectors with the smallest hashes of their ids; of equal ids, by their components. A bounded list."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)

    def batch(b: pa.RecordBatch) -> dict:
        rows, x = whole_vectors(b, width)
        return {"key": b.column("key").take(pa.array(rows)), "x": list(x)}

    chosen = map_rows(vectors.withColumn("key", key), "key string, x array<long>", batch).orderBy("key", "x").limit(count)
    return np.array([r.x for r in chosen.collect()], dtype=np.int64).reshape(-1, width)


def totals(vectors: DataFrame, centroids: np.ndarray, inertia: bool) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors, their number and the exact sums of their components, or of their distances.

    Each task adds up its own vectors; sums of tasks are added as decimals, so no number of rows overflows.
    """
    width = centroids.shape[1]
    schema = "cluster int, n long, sums array<long>"
    target = to_arrow(vectors.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = whole_vectors(b, width)
            if not len(x):
                continue
            near = nearest(x, centroids)
            values = exact(x, centroids[near])[:, None] if inertia else x
            order = np.argsort(near, kind="stable")
            found, start = np.unique(near[order], return_index=True)
            yield record_batch({"cluster": found, "n": np.diff(start, append=len(near)), "sums": list(np.add.reduceat(values[order], start, axis=0))}, target)

    parts = vectors.mapInArrow(run, schema)
    sums = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(1 if inertia else width)]
    return {r.cluster: (r.n, [int(v) for v in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()}


def fit(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> np.ndarray:
    """Centroids after all rounds; an empty cluster keeps its centroid. Fewer vectors than count: as many centroids."""
    centroids = first_centroids(vectors, count, width)
    for _ in range(rounds if len(centroids) else 0):
        for k, (n, sums) in totals(vectors, centroids, inertia=False).items():
            centroids[k] = [s // n for s in sums]
    return centroids


def cluster_vectors(embeddings: DataFrame, column: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors with width components, none null or non-finite; without one, no rows.
    Repeated rows, equal vectors and null ids (whose hash is that of '3:') each get their row;
    columns beyond vec_id and the vector's are ignored. Components up to 131,072 are handled;
    beyond, squared distances would not fit a long and the job fails with that message.
    """
    vectors = embeddings.select("vec_id", F.col(column).alias("vector"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = fit(vectors, count, rounds, width)
    own = np.zeros(len(centroids), dtype=np.int64)
    for k, (_, sums) in (totals(vectors, centroids, inertia=True) if len(centroids) else {}).items():
        own[k] = sums[0]
    whole = sum(map(int, own))
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], dtype=object)

    def batch(b: pa.RecordBatch) -> dict:
        rows, x = whole_vectors(b, width)
        near = nearest(x, centroids) if len(x) else np.zeros(0, dtype=np.int32)
        return {"vec_id": b.column("vec_id").take(pa.array(rows)), "cluster": near, "distance": exact(x, centroids[near]), "cluster_inertia": own[near], "inertia": np.full(len(x), whole, dtype=np.int64), "centroid_sha256": list(digests[near])}

    return map_rows(vectors, f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string", batch)
