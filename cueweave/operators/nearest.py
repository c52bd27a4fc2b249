"""Nearest vectors of given queries: brute force in blocks, with a top-k per task before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a, b):  # noqa: ANN001, ANN201
    """Squared Euclidean distance of two arrays; smaller is nearer."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_to_one(vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """vec_id, score of the k vectors nearest to one: a distributed top-k (ties by id)."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("vec_id", squared_distance(F.col("embedding"), target).alias("score")).orderBy("score", "vec_id").limit(k)


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each list of (vec_id, embedding), read from the buffers."""
    offsets, rows = column.offsets.to_numpy(), column.values
    ids, vectors = rows.field("vec_id").to_numpy(zero_copy_only=False), rows.field("embedding")
    at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield ids[a:b], flat[at[a] : at[b]].reshape(b - a, -1).astype(np.float64)


def nearest_to_each(vectors: DataFrame, every: int = 50, k: int = 6, block: int = 2048) -> DataFrame:
    """query_id, vec_id, score, rank: exactly the k nearest of every vector whose id is divisible by `every`, against all rows, itself left out.

    Queries come in blocks; each block meets each slice of vectors once, as matrices, and only k rows per query and task are shuffled.
    """
    vectors = vectors.where("embedding is not null")
    rows = max(1, vectors.count())
    query_blocks, slices = -(-rows // (every * block)), -(-rows // (8 * block))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.struct("vec_id", "embedding")
    # a group of the grid is a block of queries and a slice of vectors, both of bounded size
    q = vectors.where(F.col("vec_id") % every == 0).select(at(query_blocks).alias("b"), row.alias("row")).withColumn("s", each(slices))
    v = vectors.select(at(slices).alias("s"), row.alias("row")).withColumn("b", each(query_blocks))
    grid = q.groupBy("b", "s").agg(F.collect_list("row").alias("qs")).join(v.groupBy("b", "s").agg(F.collect_list("row").alias("vs")), ["b", "s"])
    met = grid.select("qs", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (qi, q), (vi, v) in zip(_blocks(batch.column("qs")), _blocks(batch.column("vs"))):
                d = (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None]
                d[qi[:, None] == vi[None]] = np.inf
                n = min(k, d.shape[1])
                at = np.argpartition(d, n - 1, axis=1)[:, :n]
                score = np.take_along_axis(d, at, 1)
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)[keep.ravel()], pa.int64()), pa.array(vi[at][keep], pa.int64()), pa.array(score[keep], pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
