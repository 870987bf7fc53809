"""Capacity-bounded assignment: prices, then min-cost flow on the codes' residual graph.

The items stay in Spark.  A code is a node; the edge from code a to code b costs what the
cheapest item of a would pay for moving to b.  Tasks keep the few cheapest items of
each pair of codes, so K x K short lists reach the driver, whose size does not
follow the number of items.  Cheapest paths on this graph move single items until every size
is inside its bounds and no chain of moves can lower the cost any more.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Bytes of the listed items' distances on the driver at most, and items listed for a pair at most.
LIST_BYTES = 128 << 20
LIST_ITEMS = 64
#: Rows (and bytes of their vectors) from which prices are foreseen, for tables of more than twice as many.
PRICE_ROWS = 8192
PRICE_BYTES = 32 << 20


def matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def costs(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to every centre."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centers.T) + (centers * centers).sum(axis=1)[None, :], 0.0)


class ResidualFlow:
    """Shortest augmenting paths between ``k`` codes over lists of each pair's cheapest items.

    ``listed`` has ``(a, b) -> [item, ...]`` in rising cost of the move, ``code`` and
    ``dist`` each listed item's code and distances, ``complete`` the pairs whose list
    holds all items of a.  A run stops early when a list runs out that is not complete: the
    moves made so far are still the cheapest, and new lists go on from there.
    """

    def __init__(self, sizes, lo: int, hi: int, listed: dict, code: np.ndarray, dist: np.ndarray, complete: set):
        self.k, self.lo, self.hi = len(sizes), lo, hi
        self.size = np.array(sizes, dtype=np.int64)
        self.code, self.dist, self.complete = code.copy(), dist, complete
        self.heap = [[[] for _ in range(self.k)] for _ in range(self.k)]
        self.left = np.zeros((self.k, self.k), np.int64)
        for (a, b), items in listed.items():
            self.heap[a][b] = [(dist[i, b] - dist[i, a], i, True) for i in items]
            heapq.heapify(self.heap[a][b])
            self.left[a, b] = len(items)
        self.weight = np.full((self.k, self.k), np.inf)
        self.stale = False
        self.tol = 1e-12 * max(1.0, float(np.abs(dist).max()) if dist.size else 1.0)
        for a in range(self.k):
            self._refresh(a)

    def _refresh(self, a: int) -> None:
        for b in range(self.k):
            if a == b:
                continue
            heap = self.heap[a][b]
            while heap and self.code[heap[0][1]] != a:
                self.left[a, b] -= heapq.heappop(heap)[2]
            if not self.left[a, b] and (a, b) not in self.complete and self.size[a]:
                self.stale = True
            self.weight[a, b] = heap[0][0] if heap else np.inf

    def _path(self, sources: np.ndarray, sinks: np.ndarray) -> tuple[float, list[int]]:
        """Cheapest path from any source to any sink that is none itself at cost 0 (Bellman-Ford on K nodes)."""
        dist = np.where(sources, 0.0, np.inf)
        before = np.full(self.k, -1)
        for _ in range(self.k):
            via = dist[:, None] + self.weight
            best, arg = via.min(axis=0), via.argmin(axis=0)
            better = best < dist - self.tol
            if not better.any():
                break
            dist[better], before[better] = best[better], arg[better]
        reach = np.where(sinks & (before >= 0), dist, np.inf)
        end = int(reach.argmin())
        if not np.isfinite(reach[end]):
            return np.inf, []
        path = [end]
        while before[path[-1]] >= 0 and len(path) <= self.k:
            path.append(int(before[path[-1]]))
        return float(reach[end]), path[::-1]

    def _push(self, path: list[int]) -> None:
        steps = [(a, b, self.heap[a][b][0][1]) for a, b in zip(path, path[1:])]
        for a, b, i in steps:
            self.code[i] = b
            for c in range(self.k):
                if c != b:
                    heapq.heappush(self.heap[b][c], (self.dist[i, c] - self.dist[i, b], i, False))
        self.size[path[0]] -= 1
        self.size[path[-1]] += 1
        for a in set(path):
            self._refresh(a)

    def run(self) -> bool:
        """Push until sizes are in bounds at the least cost (True) or a list has run out (False)."""
        while not self.stale:
            over, under = self.size > self.hi, self.size < self.lo
            if over.any():
                cost, path = self._path(over, self.size < self.hi)
            elif under.any():
                cost, path = self._path(self.size > self.lo, under)
            else:
                cost, path = self._path(self.size > self.lo, self.size < self.hi)
                if cost >= -self.tol:
                    return True
            if not path:
                return True
            self._push(path)
        return False


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column as one matrix, without Python objects if all are of one length."""
    sizes = pc.list_value_length(column)
    if column.null_count or pc.count_distinct(sizes).as_py() != 1:
        return matrix(column.to_pylist())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _coded(data: DataFrame, bc, prices: np.ndarray, key: str, vec: str) -> DataFrame:
    """Every row with the code of least distance plus price (the first on ties)."""
    schema = T.StructType([data.schema[key], data.schema[vec], T.StructField("code", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = (costs(_vectors(batch.column(1)), bc.value) + prices).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32())], names=[key, vec, "code"])

    return data.select(key, vec).mapInArrow(run, schema)


def _sizes(data: DataFrame, bc, prices: np.ndarray, vec: str) -> np.ndarray:
    """How many rows each code would get: a task passes on K numbers, never its rows."""

    def run(batches):
        size = np.zeros(len(prices), np.int64)
        for batch in batches:
            if batch.num_rows:
                size += np.bincount((costs(_vectors(batch.column(0)), bc.value) + prices).argmin(axis=1), minlength=len(prices))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(prices)), pa.int32()), pa.array(size)], names=["code", "size"])

    found = data.select(vec).mapInArrow(run, "code int, size bigint").groupBy("code").agg(F.sum("size").alias("size")).collect()  # K rows
    size = np.zeros(len(prices), np.int64)
    for r in found:
        size[r["code"]] = r["size"]
    return size


def price_sample(data: DataFrame, n: int, key: str, vec: str) -> np.ndarray | None:
    """At most ``PRICE_ROWS`` vectors in a fixed pseudo-random order, or None for a table of less than twice as many.

    They only foresee how sizes follow prices; sizes themselves are always counted over all rows.
    """
    if n <= 2 * PRICE_ROWS:
        return None
    width = data.select(F.max(F.size(vec))).first()[0]
    few = max(1, min(PRICE_ROWS, PRICE_BYTES // (8 * max(1, width))))
    return matrix(r[0] for r in data.orderBy(F.xxhash64(key), key).limit(few).select(vec).collect())


def _soft_shares(d: np.ndarray, prices: np.ndarray, heat: float) -> tuple[np.ndarray, float]:
    s = -(d + prices) / heat
    top = s.max(axis=1, keepdims=True)
    w = np.exp(s - top)
    total = w.sum(axis=1, keepdims=True)
    return w / total, float(-heat * (top + np.log(total)).mean())


def _prices_for(d: np.ndarray, share: np.ndarray, prices: np.ndarray, heat: float) -> np.ndarray:
    """Prices at which softened codes of the rows with distances ``d`` have these shares (Newton on the concave dual)."""
    k = d.shape[1]
    w, value = _soft_shares(d, prices, heat)
    for _ in range(60):
        gap = w.mean(axis=0) - share
        if np.abs(gap).max() < 1e-7:
            break
        bend = (np.diag(w.mean(axis=0)) - w.T @ w / len(d)) / heat + np.eye(k) * 1e-9 / heat
        step = np.linalg.solve(bend, gap)
        length, slope = 1.0, float(gap @ step)
        while length > 1e-6:
            tried = prices + length * step
            new_w, new_value = _soft_shares(d, tried, heat)
            if new_value - share @ tried >= value - share @ prices + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        prices, w, value = tried - tried.mean(), new_w, new_value - float(tried.mean())
    return prices


def _foreseen(sample: np.ndarray, centers: np.ndarray, prices: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Better prices from the sizes that all rows gave at ``prices``: the sample tells how much sizes move, and what
    it got wrong at ``prices`` is added to what it is asked for."""
    k, n = len(centers), size.sum()
    d = costs(sample, centers)
    near = np.partition(d, 1, axis=1) if k > 1 else d
    heat = 0.05 * float(np.median(near[:, min(1, k - 1)] - near[:, 0])) or 1e-6 * max(1.0, float(d.max()))
    wrong = size / n - _soft_shares(d, prices, heat)[0].mean(axis=0)
    share = np.full(k, 1 / k)
    if np.abs(size * k / n - 1).max() < 0.5:  # near enough for the error to hold
        share = np.maximum(share - wrong, 0.2 / k)
        share /= share.sum()
    return _prices_for(d, share, prices, heat)


def _lists(coded: DataFrame, bc, key: str, vec: str, m: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The ``m`` cheapest items of every pair of codes (``a, b, delta, key``) and these items' vectors."""
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("delta", T.DoubleType()), coded.schema[key]])

    def run(batches):
        c = bc.value
        held: dict[int, tuple] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            d, code, keys = costs(matrix(pdf[vec]), c), pdf["code"].to_numpy(), pdf[key].to_numpy()
            for a in np.unique(code):
                rows = np.nonzero(code == a)[0]
                delta = d[rows] - d[rows, a][:, None]
                name = np.repeat(keys[rows][:, None], len(c), axis=1)
                if a in held:
                    delta, name = np.concatenate([held[a][0], delta]), np.concatenate([held[a][1], name])
                if len(delta) > m:
                    best = np.argpartition(delta, m - 1, axis=0)[:m]
                    delta, name = np.take_along_axis(delta, best, axis=0), np.take_along_axis(name, best, axis=0)
                held[a] = (delta, name)
        for a, (delta, name) in held.items():
            for b in range(len(c)):
                if a != b:
                    yield pd.DataFrame({"a": np.int32(a), "b": np.int32(b), "delta": delta[:, b], key: name[:, b]})

    cheap = coded.mapInPandas(run, schema)
    rank = Window.partitionBy("a", "b").orderBy("delta", key)  # at most m rows of each task
    cheap = cheap.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= m).drop("_r")
    cheap = cheap.toPandas().sort_values(["a", "b", "delta", key])  # at most K x K x m rows
    chosen = coded.sparkSession.createDataFrame([(v,) for v in cheap[key].unique().tolist()], T.StructType([coded.schema[key]]))
    return cheap, coded.join(F.broadcast(chosen), key, "left_semi").select(key, vec).toPandas()


def balanced_assign(data: DataFrame, centers: np.ndarray, n: int, key: str, vec: str, prices: np.ndarray | None = None, price_rounds: int = 8,
                    sample: np.ndarray | None = None):
    """Rows with a code each, sizes inside ``[max(1, n//k - 1), n//k + 1]``, at the least sum of squared distances.

    Prices (K numbers) first even out demand while more items are misplaced than the lists could move;
    any prices do, for the flow ends at the least cost from each start.  With a ``sample`` (``price_sample``) the
    next prices are foreseen from it, so that few rounds leave few items to move however many rows there are.
    Returns the coded rows and the prices.
    """
    spark = data.sparkSession
    k = len(centers)
    lo, hi = max(1, n // k - 1), n // k + 1
    bc = spark.sparkContext.broadcast(centers)  # a codebook: bounded by its caller
    m = int(max(1, min(LIST_ITEMS, LIST_BYTES // (8 * k**3))))
    prices = np.zeros(k) if prices is None else prices
    step, best = None, None
    for turn in range(price_rounds + 1):
        size = _sizes(data, bc, prices, vec)
        misplaced = np.maximum(size - hi, 0).sum() + np.maximum(lo - size, 0).sum()
        if best is None or sample is None or misplaced < best[0]:
            best = (misplaced, prices, size)
        if misplaced <= k * m or turn == price_rounds:
            break
        if sample is not None:
            prices = _foreseen(sample, centers, prices, size)
            continue
        if step is None:
            spread = np.sort(((centers[:, None] - centers[None]) ** 2).sum(axis=2), axis=1)
            step = float(spread[:, min(1, k - 1)].mean()) or 1.0
        prices = prices + step * np.clip(size * k / n - 1, -1, 1)
        step *= 0.7
    _, prices, size = best
    coded = cut_lineage(_coded(data, bc, prices, key, vec))
    while True:
        cheap, vectors = _lists(coded, bc, key, vec, m)
        place = {v: i for i, v in enumerate(vectors[key].tolist())}
        dist = costs(matrix(vectors[vec]), centers) if len(vectors) else np.zeros((0, k))
        code = np.zeros(len(vectors), dtype=np.int64)
        listed: dict[tuple, list] = {}
        for a, b, name in zip(cheap["a"].tolist(), cheap["b"].tolist(), cheap[key].tolist()):
            listed.setdefault((a, b), []).append(place[name])
            code[place[name]] = a
        complete = {(a, b) for a in range(k) for b in range(k) if len(listed.get((a, b), ())) == size[a]}
        flow = ResidualFlow(size, lo, hi, listed, code, dist, complete)
        done = flow.run()
        moved = np.nonzero(flow.code != code)[0]
        if len(moved):
            names = vectors[key].to_numpy()[moved].tolist()
            rows = list(zip(names, flow.code[moved].tolist()))  # at most the listed items
            to = spark.createDataFrame(rows, T.StructType([data.schema[key], T.StructField("_to", T.IntegerType())]))
            coded = coded.join(F.broadcast(to), key, "left").select(key, vec, F.coalesce("_to", "code").cast("int").alias("code"))
            coded = cut_lineage(coded)
            size = flow.size
        if done:
            return coded, prices
