"""Exact top-k search by tiled matrix products.

Vectors are packed where they are read, into shards of a bounded number of rows, queries into blocks. Every block is sent to every shard (queries are the small side),
and each pair of a block and a shard is a tile: one matrix product, of which the k best columns per row are selected. The per-query lists are merged in a
tree, FAN_IN lists at a time, until one is left, so no merge grows with the table.

A product is made in doubles where these hold every sum exactly, else in 64-bit integers, and where these don't in Python's; large and small vectors of a tile are told apart for that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

SHARD = 8_192
BLOCK = 512
FAN_IN = 16
_NONE = np.iinfo(np.int64).min


def _rows(batch: pa.RecordBatch):
    """(positions, components) of the rows of a batch that take part, for each length that occurs; components are the vectors' own, as doubles."""
    lists = batch.column("embedding")
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero((sizes == dim) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False))
        x = flat[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1)
        yield at[good], x[good]


def _batch(block: list[int], dim: int, ids: np.ndarray, row: np.ndarray, marked: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    parts = [[x.tobytes()] for x in (ids, row, marked, data)]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(marked.sum())], pa.int64()), *[pa.array(x, pa.binary()) for x in parts]], names=["block", "dim", "n", "n_marked", "ids", "row", "marked", "data"])


_PACKED = "block long, dim int, n long, n_marked long, ids binary, row binary, marked binary, data binary"


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """block, dim, n, n_marked, ids, row (a number that no other row has), marked (whether a query), data: the rows of vectors (vec_id, embedding, q), at most size of one length to a block; ids ascend within."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        block = TaskContext.get().partitionId() << 20

        def out(dim: int, least: int):
            nonlocal block
            ids, marked, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            whole = len(ids) // least * least if least > 1 else len(ids)
            if whole < len(ids):
                held[dim] = [(ids[whole:], marked[whole:], x[whole:])]
            for at in range(0, whole, size):
                part = slice(at, min(whole, at + size))
                order = np.argsort(ids[part], kind="stable")
                yield _batch([block], dim, ids[part][order], (block << 13) + np.arange(len(order)), marked[part][order], x[part][order])
                block += 1

        for batch in batches:
            ids, marked = batch.column("vec_id").fill_null(0).to_numpy(), batch.column("q").fill_null(False).to_numpy(zero_copy_only=False)
            for at, x in _rows(batch):
                dim = x.shape[1]
                held.setdefault(dim, []).append((ids[at], marked[at], x))
                if sum(len(c[0]) for c in held[dim]) >= size:
                    yield from out(dim, size)
        for dim in list(held):
            yield from out(dim, 1)

    return vectors.mapInArrow(run, _PACKED)


def _queries(base: DataFrame, size: int) -> DataFrame:
    """dim, q_ids, q_row, q_data: the marked rows of packed ones, put together into blocks of up to size, or of one packed block's if these are more."""

    def run(batches):
        held: dict[int, list[tuple]] = {}

        def out(dim: int):
            ids, row, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (ids, row, x)]], names=["dim", "q_ids", "q_row", "q_data"])

        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                ids, row, marked, x = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("ids", np.int64), ("row", np.int64), ("marked", bool), ("data", np.float64)))
                held.setdefault(dim, []).append((ids[marked], row[marked], x.reshape(-1, dim)[marked]))
                if sum(len(c[0]) for c in held[dim]) >= size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return base.select("dim", "ids", "row", "marked", "data").mapInArrow(run, "dim int, q_ids binary, q_row binary, q_data binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of floor(256 x) over the rows of a and b, as 64-bit integers; beyond these the nearest one."""
    with np.errstate(over="ignore"):
        sides = [np.floor(256 * x) for x in (a, b)]
    most = [float(np.abs(x).max(initial=0)) for x in sides]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 2**53:
        return (sides[0] @ sides[1].T).astype(np.int64)
    limit = math.sqrt(2**53 / a.shape[1])
    for axis, x in enumerate(sides):
        large = np.abs(x).max(axis=1) > limit
        if large.any() and not large.all():
            out = np.empty((len(a), len(b)), np.int64)
            for some in (large, ~large):
                at = (some, slice(None)) if axis == 0 else (slice(None), some)
                out[at] = _product(a[some], b) if axis == 0 else _product(a, b[some])
            return out
    if bound < 2**62:
        return sides[0].astype(np.int64) @ sides[1].astype(np.int64).T
    whole = [np.array([[math.floor(256 * v) if abs(v) < 2.0**1000 else 256 * int(v) for v in row] for row in x.tolist()], object) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, _NONE + 1, -_NONE - 1).astype(np.int64)


def _best(scores: np.ndarray, row: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores; columns ascend by id, so of equal scores the first columns are taken."""
    scores[own[:, None] == row[None, :]] = _NONE
    n = scores.shape[1]
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
        above, level = scores > edge, scores == edge
        room = k - above.sum(axis=1, keepdims=True)
        take = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        take = np.ones(scores.shape, bool)
    return np.nonzero(take & (scores > _NONE))


def _tiles(pairs: DataFrame, k: int) -> DataFrame:
    """query, query_id, vec_id, score, shard: the k best of every query of a tile."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                dim, shard = (batch.column(c)[at].as_py() for c in ("dim", "shard"))
                ids, row, q_ids, own = (np.frombuffer(batch.column(c)[at].as_buffer(), np.int64) for c in ("ids", "row", "q_ids", "q_row"))
                data, q_data = (np.frombuffer(batch.column(c)[at].as_buffer(), np.float64).reshape(-1, dim) for c in ("data", "q_data"))
                product = _product(q_data, data)
                r, c = _best(product, row, own, k)
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (own[r], q_ids[r], ids[c], product[r, c])], pa.array(np.full(len(r), shard, np.int64))], names=["query", "query_id", "vec_id", "score", "shard"])

    return pairs.mapInArrow(run, "query long, query_id long, vec_id long, score long, shard long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of vectors (vec_id, embedding) for which is_query holds, the k rows of highest integer inner product of floor(256 x).

    Ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part. Rows are rows: several under one vec_id are candidates
    each (also for each other), and queries each, with a list of its own. Vectors meet those of the same length. Scores are exact; one beyond 64 bits counts as the largest or least of these.
    Queries with fewer candidates return all. Other columns are ignored; an empty table gives an empty result. shard_rows is 8192 at most.
    """
    base = saved(_packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")), min(shard_rows, SHARD)))
    shards, marked = base.agg(F.count("*"), F.coalesce(F.sum("n_marked"), F.lit(0))).first()
    shards, blocks = max(1, shards), max(1, math.ceil(marked / block_rows))
    queries = _queries(base.filter("n_marked > 0").repartition(blocks, "block"), block_rows)
    queries = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).select("shard", "dim", "ids", "row", "data")
    lists, groups = _tiles(dealt.join(queries, ["shard", "dim"]), k), shards
    while True:
        groups = math.ceil(groups / FAN_IN)
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best")
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("query", "query_id", "shard").agg(best)
        if groups == 1:
            break
        lists = lists.select("query", "query_id", "shard", F.inline("best")).withColumn("score", -F.col("minus"))
    best = lists.select("query_id", F.posexplode("best"))
    return best.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.minus")).alias("score"))


def op5_exact_topk(spark, sf_dir):
    """The five nearest rows of every vec_id that 50 divides."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
      FROM v AS q JOIN v ON v.k <> q.k AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
