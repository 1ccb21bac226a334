"""Approximate nearest neighbours with an inverted multi-index.

Two codebooks quantise the two halves of a vector; a pair of centroids is a cell.  A query walks the cells in order of
summed distance with a heap until it has met enough vectors, and the vectors of those cells are ranked by exact distance.
How many are enough is measured: a bounded number of the queries is answered by brute force over all vectors, and the
walk is made as long as the wanted recall of those answers takes.  Equal vectors are one entry with its least ids, which
is all that a result of k rows can hold.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Table

#: The codebooks are fitted on about so many vectors, those whose id's hash is least.
SAMPLE = 20_000
#: Queries that are answered by brute force to find the walk's length, those whose id's hash is least; and the recall it aims at.
TRIALS = 100
RECALL = 0.97
#: Entries that a task ranks together, about; and queries, which cost a few hundred bytes each.
BLOCK = 4_096
QUERIES = 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids, from distinct points far apart with likelihood (k-means++)."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.RandomState(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    if not k:
        return x
    centers = x[rng.randint(len(x))][None]
    d = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k and d.sum() > 0:
        centers = np.concatenate((centers, x[rng.choice(len(x), p=d / d.sum())][None]))
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, x[:, j], len(centers)) for j in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers**2).sum(axis=1), 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centers).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def walk(d1: np.ndarray, d2: np.ndarray, size: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) with entries in order of d1[i] + d2[j], until they hold ``enough`` entries: the multi-sequence algorithm."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, out, met = [(d1[a[0]] + d2[b[0]], 0, 0)], [], 0
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(d2) + int(b[j])
        if size[cell]:
            out.append(cell)
            met += int(size[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (d1[a[i]] + d2[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (d1[a[i + 1]] + d2[b[0]], i + 1, 0))
    return out


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, candidates: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row for which ``queries`` holds, the query's own id left out.

    score is the Euclidean distance in double precision; ties go to the smaller id.  A row takes no part when its id or vector is
    null, when the vector is empty, zero, or holds a null or non-finite component, or when its
    length is not the commonest (of several the least).  A repeated row counts once.  A walk ends when its cells hold ``candidates``
    entries; without that number it is found by TRIALS brute-force answers so that ``recall`` of them is met.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    half = dim // 2
    rows = rows.where(F.size("v") == dim)

    def combine(batches):
        """Each distinct vector of a partition with its least k + 1 ids."""
        held: dict[bytes, list[int]] = {}

        def out():
            items = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in items], pa.binary()), pa.array([sorted(set(i))[: k + 1] for _, i in items], pa.list_(pa.int64()))], names=["vec", "ids"])

        for batch in batches:
            x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), dtype="<f8").reshape(-1, dim) + 0.0  # no negative zeros
            for one, i in zip(x, batch.column("id").to_pylist()):
                ids = held.setdefault(one.tobytes(), [])
                ids.append(i)
                if len(ids) > 8 * k:
                    ids[:] = sorted(set(ids))[: k + 1]
            if len(held) > 20_000:
                yield out()
        if held:
            yield out()

    entries = rows.select("id", "v").mapInArrow(combine, "vec binary, ids array<long>").groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = Table(entries, "vectors")
    n = entries.df.count()
    part = F.shiftrightunsigned(F.xxhash64("vec"), 1) < int(2**63 * sample / n) if n > sample else F.lit(True)
    taken = entries.df.where(part).select("vec").toArrow().column("vec").combine_chunks()
    x = _matrix(taken if len(taken) else entries.df.limit(1).select("vec").toArrow().column("vec"), dim)
    size = max(2, min(256, int(n**0.5 / 2)))
    books = (kmeans(x[:, :half], size), kmeans(x[:, half:], size))  # a vector of one component has an empty first half
    shared = spark.sparkContext.broadcast(books)

    def assign(batches):
        one, two = shared.value
        for batch in batches:
            m = _matrix(batch.column("vec"), dim)
            cell = nearest(m[:, :half], one) * len(two) + nearest(m[:, half:], two)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("vec"), batch.column("ids")], names=["cell", "vec", "ids"])

    index = Table(entries.df.mapInArrow(assign, "cell long, vec binary, ids array<long>"), "multi-index")
    entries.drop()
    sizes = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in index.df.groupBy("cell").count().collect():  # at most 256 * 256 cells
        sizes[r["cell"]] = r["count"]
    asked = rows.where("q").select("id", "v").distinct()
    n_asked = asked.count()
    if candidates is None:
        candidates = _walk_length(asked, n_asked, index.df, books, sizes, dim, k, recall)
    candidates = max(candidates, k + 1)  # with the query's own entry, k rows at least
    layout = spark.sparkContext.broadcast(sizes)
    shards = max(1, -(-n // BLOCK))

    def shard_of(cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return ((spread.astype(np.int64) + salt) % shards).astype(np.int32)

    def probe(batches):
        one, two = shared.value
        size_ = layout.value
        for batch in batches:
            m = _queries(batch, dim)
            d1, d2 = distances(m[:, :half], one), distances(m[:, half:], two)
            for i, q in enumerate(batch.column("id").to_pylist()):
                cells = np.array(walk(d1[i], d2[i], size_, candidates), dtype=np.int64)
                parts = -(-size_[cells] // BLOCK)  # a large cell lies in several shards
                cell = np.repeat(cells, parts)
                shard = shard_of(cell, np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts))
                order = np.argsort(shard, kind="stable")
                at, first = np.unique(shard[order], return_index=True)
                lists = [c.tolist() for c in np.split(cell[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([q] * len(at), pa.int64()), pa.array([m[i].tobytes()] * len(at), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["shard", "query", "qvec", "cells"])

    probes = Table(asked.mapInArrow(probe, "shard int, query long, qvec binary, cells array<long>"), "probes")
    # The queries that come to a shard are dealt to turns, and only a shard that many come to is copied, once for each turn.
    turns = Table(probes.df.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")), "turns").df

    def deal(batches):
        size_ = layout.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            salt = batch.column("mark").to_numpy() % np.maximum(-(-size_[cell] // BLOCK), 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(cell, salt), pa.int32()), batch.column("cell"), batch.column("vec"), batch.column("ids")], names=["shard", "cell", "vec", "ids"])

    stored = index.df.withColumn("mark", F.pmod(F.xxhash64("vec"), F.lit(1 << 30))).mapInArrow(deal, "shard int, cell long, vec binary, ids array<long>")
    stored = stored.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    dealt = probes.df.join(turns, "shard").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).drop("turns")

    def rank(key, left, right):
        ids, cell = left.column("ids").to_pylist(), left.column("cell").to_numpy()
        out: list[tuple[int, int, float]] = []
        if ids and right.num_rows:
            m = _matrix(left.column("vec").combine_chunks(), dim)
            for q, x, cells in zip(right.column("query").to_pylist(), _matrix(right.column("qvec").combine_chunks(), dim), right.column("cells").to_pylist()):
                near = np.flatnonzero(np.isin(cell, cells))
                d = np.sqrt(((m[near] - x) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    close = d <= np.partition(d, k)[k]
                    near, d = near[close], d[close]
                out += [(q, i, dist) for dist, i in sorted((dist, i) for dist, e in zip(d.tolist(), near.tolist()) for i in ids[e] if i != q)[:k]]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    best = stored.groupBy("shard", "turn").cogroup(dealt.groupBy("shard", "turn")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), dtype="<f8").reshape(-1, dim) + 0.0


def _walk_length(asked: DataFrame, n_asked: int, index: DataFrame, books, sizes: np.ndarray, dim: int, k: int, recall: float) -> int:
    """Entries that walks must meet so that ``recall`` of the true neighbours of the trial queries lie in the cells met."""
    share = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1)
    trial = asked if n_asked <= TRIALS else asked.where(share < int(2**63 * TRIALS / n_asked))
    batches = trial.toArrow().combine_chunks().to_batches()
    if not batches or not batches[0].num_rows:
        return 1
    q = _queries(batches[0], dim)
    shared = index.sparkSession.sparkContext.broadcast(q)

    def brute(batches):
        for batch in batches:
            m, cell = _matrix(batch.column("vec"), dim), batch.column("cell").to_numpy()
            for i, x in enumerate(shared.value):
                d = ((m - x) ** 2).sum(axis=1)
                near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i)), pa.array(d[near]), pa.array(cell[near])], names=["trial", "d", "cell"])

    found = index.select("vec", "cell").mapInArrow(brute, "trial long, d double, cell long")
    order = Window.partitionBy("trial").orderBy("d", "cell")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("trial", "cell").toPandas()  # k + 1 rows a trial
    half, need = dim // 2, []
    d1, d2 = distances(q[:, :half], books[0]), distances(q[:, half:], books[1])
    for i, cells in true.groupby("trial")["cell"]:
        wanted, met = set(cells.tolist()), 0
        per = cells.value_counts().to_dict()
        for c in walk(d1[i], d2[i], sizes, int(sizes.sum())):
            met += int(sizes[c])
            if c in wanted:
                need += [met] * per[c]
    return int(np.quantile(need, recall, method="higher"))
