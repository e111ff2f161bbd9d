"""Exact top-k search by inner product: tiled matrix products, partial selection in each tile, tree merging of the lists.

Queries go to the executors in batches of bounded size; the vectors stay where they are, and are read once a batch. A tile
of queries and a tile of vectors meet in a matrix product and a partial selection, and a partition of vectors keeps one
list of k for each query. The partitions' lists meet in a tree: FAN_IN of them are merged at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut

SCALE = 1024
TOP = 10
#: Rows of a tile.
VECTOR_BLOCK = 8192
QUERY_BLOCK = 1024
#: Bytes of a batch of queries, about.
BATCH = 32 << 20
FAN_IN = 16


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor(scale * x) as double); without null vectors, null or non-finite components or null ids.

    Rows with one id count once: the least vector stays."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", v.alias("v")).where(good)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers; beyond the long range they stop at its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return np.rint(q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _by_length(ids: np.ndarray, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length the ids and the rows."""
    offsets = vectors.offsets.to_numpy()
    flat, lens = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    out = {}
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        out[n] = ids[at], flat[(offsets[at] - offsets[0])[:, None] + np.arange(n)]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the least id, in order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        ties = np.flatnonzero(score == least)
        above = np.flatnonzero(score > least)
        at = np.concatenate((above, ties[np.argsort(ids[ties], kind="stable")][: k - len(above)]))
        score, ids = score[at], ids[at]
    order = np.lexsort((ids, ~score))
    return score[order], ids[order]


def _search(shared, k: int, vector_block: int, query_block: int):
    """Over a partition of vectors, a list of k for each query of the batch."""

    def run(batches):
        from pyspark import TaskContext

        queries = shared.value
        lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, (ids, v) in _by_length(batch.column("vec_id").to_numpy(), batch.column("v")).items():
                asked, q = queries.get(n, ((), ()))  # only vectors of one length meet
                for i in range(0, len(asked), query_block):
                    for j in range(0, len(ids), vector_block):
                        scores, tile = _product(q[i : i + query_block], v[j : j + vector_block]), ids[j : j + vector_block]
                        for row, query in zip(scores, asked[i : i + query_block].tolist()):
                            score, found = _best(row, tile, k + 1)  # one more, for the query itself
                            other = found != query
                            old = lists.get((n, query))
                            score, found = (score[other], found[other]) if old is None else (np.concatenate((old[0], score[other])), np.concatenate((old[1], found[other])))
                            lists[n, query] = _best(score, found, k)
        out = [(query, i, x) for (_, query), (score, ids) in lists.items() for x, i in zip(score.tolist(), ids.tolist())]
        cols = list(zip(*out)) or [(), (), ()]
        block = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([block] * len(out), pa.int64())], names=["query_id", "vec_id", "score", "block"])

    return run


def topk_search(embeddings: DataFrame, query_ids=lambda i: i % 100 == 0, k: int = TOP, scale: int = SCALE, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, batch: int = BATCH) -> DataFrame:
    """For each query its k highest scores: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    embeddings: vec_id, embedding (extra columns are ignored). query_ids: Column -> Column, which rows are queries. A
    query meets every row but those with its own id. Null ids, null vectors and vectors with null or non-finite
    components take no part; rows with one id count once, with the least vector; vectors meet only others of their length;
    an empty table gives no rows, a query without candidates none."""
    spark = embeddings.sparkSession
    vectors = cut(usable(embeddings, scale), "vectors")
    queries = vectors.where(query_ids(F.col("vec_id")))
    n_batches = max(1, math.ceil((queries.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0) / batch))
    partitions = (vectors.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    lists = None
    for i in range(n_batches):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_batches)) == i).toArrow()  # of bounded size
        asked = _by_length(part.column("vec_id").to_numpy(), part.column("v").combine_chunks()) if part.num_rows else {}
        found = vectors.mapInArrow(_search(spark.sparkContext.broadcast(asked), k, vector_block, query_block), "query_id long, vec_id long, score long, block long")
        lists = found if lists is None else lists.union(found)
    order = [F.col("score").desc(), F.col("vec_id")]
    while partitions > FAN_IN:
        partitions = math.ceil(partitions / FAN_IN)
        lists = lists.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
