"""Exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of query vectors that go to the tasks at once; more queries are taken in slices of this size.
SLICE_BYTES = 64 << 20


def block_knn(vectors: DataFrame, queries: DataFrame, k: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) by cosine, ties by id; null vectors and vectors of zero length never match.

    The queries' size is measured first and cut into slices of a bounded number of bytes. A slice is a broadcast matrix;
    each task reads its vectors once, batch by batch, keeps the k best of every query, and only those are shuffled.
    """
    asked = queries.where("query is not null")
    size = asked.agg(F.sum(F.size("query") * 8 + 8)).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    of = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    local = None
    for n in range(slices):
        part = _local(vectors, asked.where(of == n) if slices > 1 else asked, k)
        local = part if local is None else local.unionByName(part)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _local(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each task."""
    rows = asked.select("query_id", "query").toPandas()
    by_size = {}
    for n, group in rows.groupby(rows["query"].map(len)) if len(rows) else ():
        q = np.array(group["query"].to_list(), float)
        norm = np.linalg.norm(q, axis=1)
        by_size[n] = (group["query_id"].to_numpy()[norm > 0], q[norm > 0] / norm[norm > 0].reshape(-1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}  # of each size of vector: the nearest ids and their distances, a row a query
        for batch in batches:
            sizes = batch.embedding.map(len)
            for n, (ids, q) in shared.value.items():
                some = batch[sizes == n]
                if not len(ids) or not len(some):
                    continue
                m = np.array(some.embedding.to_list(), float)
                norm = np.linalg.norm(m, axis=1)
                good = norm > 0
                d = np.round(1 - q @ (m[good] / norm[good].reshape(-1, 1)).T, 6)
                found = np.broadcast_to(some.id.to_numpy()[good], d.shape)
                if n in best:
                    found, d = np.hstack([best[n][0], found]), np.hstack([best[n][1], d])
                order = np.lexsort((found, d), axis=1)[:, :k]
                best[n] = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
        for n, (found, d) in best.items():
            ids = shared.value[n][0]
            keep = ~np.isnan(d.ravel())
            yield pd.DataFrame({"query_id": np.repeat(ids, d.shape[1])[keep], "id": found.ravel()[keep], "distance": d.ravel()[keep]})

    return vectors.where("embedding is not null").select("id", "embedding").mapInPandas(near, "query_id long, id long, distance double")
