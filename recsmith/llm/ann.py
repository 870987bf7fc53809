"""Operator 8: approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, sample_order

#: Vectors the lists are fitted on at most; every vector is indexed.
MAX_FIT_ROWS = 65_536
#: Vectors of a list on average, and centroids at most (they stay in every task's memory).
LIST_ROWS = 32
MAX_LISTS = 16_384
#: Queries compared with every vector to find how many lists the wanted recall takes.
CALIBRATION_QUERIES = 512
#: A task compares at most about so many vectors of a list with so many queries.
SHARD_ROWS = 4_096
QUERY_BLOCK = 4_096
#: Centroids the graph search keeps in view at least.
LEAST_WIDTH = 48


class Index(NamedTuple):
    """Unit centroids and their neighbour graph (one row of neighbours per centroid)."""

    centroids: np.ndarray
    graph: np.ndarray


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (which changes no digit), so that no square under- or overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5, refine: int = 1) -> np.ndarray:
    """Centroids of ``lists`` clusters: the largest is halved at the median until there are enough, then refined."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    parts = [(-len(x), 0, rng.permutation(len(x)))]
    lists = max(1, min(lists, len(x)))
    while len(parts) < lists:
        _, name, p = heapq.heappop(parts)
        v, half = x[p], len(p) // 2
        pair = v[rng.choice(len(v), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(v @ (pair[0] - pair[1]), kind="stable")
            pair = np.stack([v[order[half:]].mean(axis=0), v[order[:half]].mean(axis=0)])
        for half_name, q in ((name, p[order[half:]]), (len(parts) + 1, p[order[:half]])):
            heapq.heappush(parts, (-len(q), half_name, q))
    parts = [p for _, _, p in parts]
    centers = np.stack([x[p].mean(axis=0) for p in parts])
    centers /= np.maximum(np.sqrt((centers**2).sum(axis=1, keepdims=True)), 1e-12)
    for _ in range(refine):
        near = np.concatenate([(x[at : at + 2048] @ centers.T).argmax(axis=1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centers)
    return centers


def neighbour_graph(centers: np.ndarray, degree: int = 16) -> np.ndarray:
    """Each centroid's nearest others, the last places by a ring so the graph hangs together."""
    n = len(centers)
    if n == 1:
        return np.zeros((1, 1), np.int32)
    near = np.empty((n, min(degree, n - 1)), np.int32)
    for at in range(0, n, 512):
        s = centers[at : at + 512] @ centers.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        near[at : at + 512] = np.argsort(-s, axis=1, kind="stable")[:, : near.shape[1]]
    ring = (np.arange(n)[:, None] + np.array([1, max(1, n // 2)])) % n
    return np.hstack([near, ring.astype(np.int32)])


def graph_search(index: Index, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph for a block of unit vectors.

    Returns list numbers and distances, nearest first, ``width`` for each query (-1 and
    infinity where fewer were reached).
    """
    n, b = len(index.centroids), len(queries)
    width = min(width, n)
    starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
    seen = np.zeros((b, n), bool)
    seen[:, starts] = True
    score = queries @ index.centroids[starts].T
    node = np.broadcast_to(starts, score.shape).copy()
    opened = np.zeros(score.shape, bool)
    rows = np.arange(b)[:, None]
    while True:
        waiting = np.where(opened | (node < 0), -np.inf, score)
        pick = waiting.argmax(axis=1)
        live = np.nonzero(waiting[np.arange(b), pick] > -np.inf)[0]
        if not len(live):
            break
        opened[live, pick[live]] = True
        step = index.graph[node[live, pick[live]]]
        fresh = ~seen[live[:, None], step]
        seen[live[:, None], step] = True
        found = np.where(fresh, np.einsum("bkd,bd->bk", index.centroids[step], queries[live]), -np.inf)
        more_node, more_score = np.full((b, step.shape[1]), -1), np.full((b, step.shape[1]), -np.inf)
        # a graph row may name a centroid twice: only its first place counts
        order = np.argsort(step, axis=1, kind="stable")
        ordered = np.take_along_axis(step, order, axis=1)
        twice = np.zeros(step.shape, bool)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        found = np.where(twice, -np.inf, found)
        more_node[live], more_score[live] = np.where(np.isneginf(found), -1, step), found
        node, score = np.hstack([node, more_node]), np.hstack([score, more_score])
        opened = np.hstack([opened, np.zeros(more_score.shape, bool)])
        keep = np.argsort(-score, axis=1, kind="stable")[:, :width]
        node, score, opened = node[rows, keep], score[rows, keep], opened[rows, keep]
    distance = np.where(node < 0, np.inf, np.sqrt(np.maximum(0, 2 - 2 * score)))
    return node, distance


def usable(vector: Column) -> Column:
    """Vectors that have a direction: no null, NaN or infinite component and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit_index(vectors: DataFrame, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, max_rows: int = MAX_FIT_ROWS) -> Index | None:
    """Fit centroids on at most ``max_rows`` vectors (``id, v``) in a fixed pseudo-random order; None if there are none."""
    n = vectors.count()
    sample = vectors.orderBy(*sample_order("id"), "v").limit(max_rows).toArrow()
    if not n:
        return None
    centers = balanced_centroids(_unit(_matrix(sample["v"])), min(max_lists, max(1, n // list_rows)))
    return Index(centers, neighbour_graph(centers))


def _choose(index: Index, unit: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Lists of unit vectors, nearest first, and which of them stand within ``ratio`` of the nearest (distance-ratio pruning)."""
    lists, distance = (x[:, :width] for x in graph_search(index, unit, max(width, LEAST_WIDTH)))
    chosen = np.isfinite(distance) & (distance <= np.maximum(distance[:, :1] * ratio, 1e-9))
    chosen[:, 0] = True
    return lists, chosen


def _to_lists(vectors: DataFrame, index: Index, width: int, ratio: float, block: int = 1024) -> DataFrame:
    """A row ``list, id, v`` for each list that a vector belongs to or searches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists, chosen = _choose(index, _unit(_matrix(part["v"])), width, ratio)
                row, col = np.nonzero(chosen)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, col], pa.int32()), taken["id"], taken["v"]], names=["list", "id", "v"])

    return vectors.mapInArrow(run, "list int, id bigint, v array<double>")


def nearest_by_scan(vectors: DataFrame, qid: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``q, id, score, v``: the ``k`` nearest of a bounded set of unit queries among all vectors; a task keeps ``k`` for each."""
    held = vectors.sparkSession.sparkContext.broadcast((qid, queries))

    def run(batches):
        own, asked = held.value
        best = np.full((len(own), 0), -np.inf)
        ids, rows = np.zeros(best.shape, np.int64), np.zeros((*best.shape, asked.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                some, x = part["id"].to_numpy(), _matrix(part["v"])
                near = asked @ _unit(x).T
                near[own[:, None] == some] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                best = np.hstack([best, np.take_along_axis(near, top, axis=1)])
                ids, rows = np.hstack([ids, some[top]]), np.concatenate([rows, x[top]], axis=1)
                keep = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, ids = np.take_along_axis(best, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
                rows = np.take_along_axis(rows, keep[:, :, None], axis=1)
        q, col = np.nonzero(best > -np.inf)
        if len(q):
            flat = pa.array(list(rows[q, col]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[q, col]), pa.array(best[q, col]), flat], names=["q", "id", "score", "v"])

    found = vectors.select("id", "v").mapInArrow(run, "q int, id bigint, score double, v array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def calibrate(vectors: DataFrame, asked: DataFrame, index: Index, k: int, replicas: int, replica_ratio: float, recall: float, sample: int = CALIBRATION_QUERIES) -> tuple[int, float]:
    """Lists a query must search, and how far they may lie against its nearest one, for the wanted share of its true neighbours.

    At most ``sample`` queries are compared with all vectors; the lists that hold their true neighbours tell both figures.
    """
    some = asked.orderBy(*sample_order("id"), "v").limit(sample).toArrow()
    unit = _unit(_matrix(some["v"]))
    true = nearest_by_scan(vectors, some["id"].to_numpy(), unit, k).toArrow() if len(some) else some
    if not true.num_rows:
        return 1, 1.0
    lists, chosen = _choose(index, _unit(_matrix(true["v"])), replicas, replica_ratio)
    distance = np.sqrt(np.maximum(0, 2 - 2 * unit @ index.centroids.T))
    order = np.argsort(distance, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    q = true["q"].to_numpy()
    at = np.where(chosen, place[q[:, None], lists], order.shape[1])
    width = int(np.sort(at.min(axis=1))[min(len(at), int(np.ceil(recall * len(at)))) - 1]) + 1
    least = distance.min(axis=1)[q]
    far = np.take_along_axis(distance[q], np.take_along_axis(lists, at.argmin(axis=1)[:, None], axis=1), axis=1)[:, 0]
    within = (at.min(axis=1) < width) & (least > 1e-6)
    return width, float((far[within] / least[within]).max(initial=1.0)) + 1e-9


def _nearest(k: int):
    def run(key, posted: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if posted.num_rows and asked.num_rows:
            ids, x = posted["id"].to_numpy(), _scaled(_matrix(posted["v"]))
            qid, q = asked["id"].to_numpy(), _scaled(_matrix(asked["v"]))
            x_size, q_size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for at in range(0, len(q), 256):
                rough = (q[at : at + 256] @ x.T) / (q_size[at : at + 256, None] * x_size)
                rough[qid[at : at + 256, None] == ids] = -np.inf
                for row, i in zip(rough, range(at, at + 256)):
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    near = np.nonzero((row >= least - 1e-9) & (row > -np.inf))[0]
                    # the same sum for the same vector whatever stands beside it, so ties stay ties
                    score = (x[near] * q[i]).sum(axis=1) / (q_size[i] * x_size[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    out_q += [qid[i]] * len(best)
                    out_v += ids[near[best]].tolist()
                    out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest_neighbours(
    df: DataFrame, queries: Column, k: int = 5, replicas: int = 4, replica_ratio: float = 1.25, probes: int | None = None, probe_ratio: float | None = None,
    recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", **fit_options,
) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row for which ``queries`` holds.

    Lists are fitted on a bounded sample by halving at medians, which keeps them balanced; every
    row goes to its nearest list and, near a boundary, to up to ``replicas`` lists (those within
    ``replica_ratio`` of the nearest distance).  A query searches its ``probes`` nearest lists as far as they
    stand within ``probe_ratio`` of the nearest.  Where these are not given they are measured: a bounded
    number of queries is compared with all rows, and the figures are those that find the share ``recall`` of
    their true neighbours.  Lists are found in the in-memory centroid graph.  A vector
    is sent only to the blocks of queries that search its list; a list with more than ``SHARD_ROWS`` rows (many
    equal vectors) is dealt over shards and one that more than ``QUERY_BLOCK`` queries search over blocks.

    Returns ``query_id, rank, vec_id, score``: the cosine of the original vectors in
    double precision, nearest first, ties to the smaller id.  Null ids and vectors that
    are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part.  Rows repeating an id count as one candidate with their
    best score.  An empty table, or no other row, gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    found = searched_pairs(df, queries, k, replicas, replica_ratio, probes, probe_ratio, recall, id_col, vector_col, **fit_options)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    posted, asked = found
    found = posted.groupBy(*_TASK).cogroup(asked.groupBy(*_TASK)).applyInArrow(_nearest(k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most probes * k rows of a query and shard
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_TASK = ("list", "shard", "block")


def searched_pairs(
    df: DataFrame, queries: Column, k: int, replicas: int, replica_ratio: float, probes: int | None, probe_ratio: float | None, recall: float, id_col: str, vector_col: str, **fit_options
) -> tuple[DataFrame, DataFrame] | None:
    """Posted vectors and queries by ``list, shard, block``; those of equal keys are compared.  None without vectors."""
    asks = F.coalesce(queries, F.lit(False)).alias("asks")
    vectors = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    vectors = vectors.where(F.size("v") == (lengths["n"] if lengths else 0))
    index = fit_index(vectors.select("id", "v"), **fit_options)
    if index is None:
        return None
    wanted = vectors.where("asks").select("id", "v").distinct()
    if probes is None or probe_ratio is None:
        width, ratio = calibrate(vectors, wanted, index, k, replicas, replica_ratio, recall)
        probes, probe_ratio = probes or width, probe_ratio or ratio
    posted = cut_lineage(_to_lists(vectors.select("id", "v"), index, replicas, replica_ratio))
    asked = cut_lineage(_to_lists(wanted, index, probes, probe_ratio))
    # one row for each list: bounded by the number of centroids
    shards = posted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("shards"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    deal = shards.join(blocks, "list")  # lists that nobody searches go
    posted, asked = (x.join(F.broadcast(deal), "list") for x in (posted, asked))
    of_id = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.withColumn("shard", of_id("shards")).withColumn("block", every("blocks"))
    asked = asked.withColumn("block", of_id("blocks")).withColumn("shard", every("shards"))
    return posted.select(*_TASK, "id", "v"), asked.select(*_TASK, "id", "v")
