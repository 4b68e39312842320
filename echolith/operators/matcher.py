"""Ranking of stored checkpoints by their agreement with query sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import scoring

#: Checkpoints meet the queries in packs of so many hashes (or one longer sequence), so a pack's size is bounded in bytes.
PACK_HASHES = 1 << 18
#: Up to so many hashes of all queries together (8 bytes each) are broadcast; more are dealt to the packs by a join.
BROADCAST_HASHES = 1 << 21
FAN_IN = 16


def packed(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows put together, up to most hashes: lists of the keys, the sizes of the sequences and their hashes one after another. Rows without hashes (null), or with anything but unsigned 32-bit words among them, take no part."""
    names = [*keys, "sizes", "flat"]

    def run(batches):
        held, n = [], 0

        def out():
            table = pa.Table.from_batches(held)
            lists = [table.column(k).combine_chunks() for k in keys]
            hashes = table.column("hashes").combine_chunks()
            sizes = hashes.value_lengths().to_numpy().astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([*[one(x) for x in lists], one(pa.array(sizes)), one(hashes.flatten())], names=names)

        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column("hashes").value_lengths().to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + most - n, "right")))
                held.append(batch.slice(at, end - at))
                n, at = n + int(sizes[end - 1] - before), end
                if n >= most or at < batch.num_rows:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    kinds = ", ".join(f"{k} array<{rows.schema[k].dataType.simpleString()}>" for k in keys)
    return rows.select(*keys, "hashes").filter(scoring.words_sound(F.col("hashes"))).mapInArrow(run, f"{kinds}, sizes array<int>, flat array<bigint>")


def with_queries(packs: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Each of packs with each pack of the queries: lists of the keys, q_sizes and q_flat. Either side has packs of bounded bytes; the queries are the stated set that all checkpoints are held against."""
    size = queries.agg(F.coalesce(F.sum(F.size("hashes").cast("long")), F.lit(0)).alias("n"), F.count("*").alias("m")).first()
    parts = max(1, math.ceil((size["n"] + size["m"]) / BROADCAST_HASHES))
    q = packed(queries.select(*keys, "hashes").repartition(parts), keys, BROADCAST_HASHES).select(*keys, F.col("sizes").alias("q_sizes"), F.col("flat").alias("q_flat"))
    return packs.crossJoin(F.broadcast(q)) if parts == 1 else packs.crossJoin(q)


def _blocks(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Sequences of like length (twice as long at most), the shortest first, so many together that they fill no more cells of two hashes than that."""
    order = np.argsort(sizes, kind="stable")
    sizes, at = sizes[order].astype(np.int64), 0
    while at < len(order):
        end = int(np.searchsorted(sizes, max(1, 2 * sizes[at]), "right"))
        full = (np.arange(1, end - at + 1) * ((sizes[at:end] + 1) // 2)) > cells
        end = at + max(1, int(full.argmax()) if full.any() else end - at)
        yield order[at:end]
        at = end


def _paired(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A column for each sequence, a row for every two positions (the earlier one in the low half), filled up with zeros."""
    width = (int(sizes.max(initial=0)) + 1) // 2 * 2
    out = np.zeros((len(sizes), width), np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.view(np.uint64).T)


class _Block:
    """Checkpoints that a query is compared with at once."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.rows = sizes, _paired(flat.astype(np.uint32), sizes)
        self.least, self.width = int(sizes.min(initial=0)), int(sizes.max(initial=0))
        self.xor, self.ones = np.empty_like(self.rows), np.empty(self.rows.shape, np.uint8)
        self.shapes = {}

    def shape(self, n: int, o: int) -> tuple:
        """How many positions a query of n hashes shares with each at an offset, the bits in them, where in the query each ends, and those without any."""
        if (n, o) not in self.shapes:
            if len(self.shapes) >= 1_024:
                self.shapes.clear()
            counts = np.maximum(np.minimum(n - max(o, 0), self.sizes - max(-o, 0)), 0)
            none = np.flatnonzero(counts == 0)
            self.shapes[n, o] = counts, np.maximum(counts, 1) * 32.0, max(o, 0) + counts, none if len(none) else None
        return self.shapes[n, o]

    def scores(self, own: np.ndarray, ones: np.ndarray, o: int) -> np.ndarray:
        """The scores at an offset; ones tells how many bits are set in the query before each of its positions, and in all."""
        n = len(own)
        counts, bits, ends, none = self.shape(n, o)
        low, high = max(0, -o), min(self.width, n - o)
        if high <= low:
            return np.zeros(len(counts), np.float32)
        first, end = low // 2, (high + 1) // 2
        # The query at the checkpoint's positions, and which of the first and last two it has.
        mine = np.zeros(2 * (end - first), np.uint32)
        mine[low - 2 * first : high - 2 * first] = own[low + o : high + o]
        xor, found = self.xor[: end - first], self.ones[: end - first]
        np.bitwise_xor(self.rows[first:end], mine.view(np.uint64)[:, None], out=xor)
        if low % 2:
            xor[0] &= np.uint64(0xFFFFFFFF00000000)
        if high % 2:
            xor[-1] &= np.uint64(0xFFFFFFFF)
        # Behind a checkpoint's end stand zeros, so the query's own bits were counted there.
        agree = ones[high + o] - ones[ends]
        agree -= np.bitwise_count(xor, out=found).sum(axis=0, dtype=np.uint16 if end - first < 1024 else np.int64)
        if self.width >= 524_288:
            return scoring.scores_of(32 * counts + agree, counts)
        score = ((bits + agree) / bits).astype(np.float32)
        if none is not None:
            score[none] = 0
        return score


#: Cells of two hashes (17 bytes each while they are compared) in a block: they stay in a core's cache.
BLOCK_CELLS = 1 << 16


def compare_all(q: np.ndarray, q_sizes: np.ndarray, c: np.ndarray, c_sizes: np.ndarray, drift: int, k: int, order: np.ndarray, best) -> None:
    """Give best(query, checkpoints, scores, offsets) the k best checkpoints of every query, by score and then order (a rank of the checkpoints), block by block, and some more.

    A block of checkpoints lies in a matrix of padded columns; for each query and offset all its columns are compared at once. What scores less than k that were given before is left out.
    """
    q_starts, c_starts = np.cumsum(q_sizes) - q_sizes, np.cumsum(c_sizes) - c_sizes
    kept = np.full((len(q_sizes), max(k, 0)), -1, np.float32)
    q = q.astype(np.uint32)
    q_ones = np.append(0, np.cumsum(np.bitwise_count(q), dtype=np.int64))
    for picked in _blocks(c_sizes, BLOCK_CELLS):
        sizes = c_sizes[picked].astype(np.int64)
        block = _Block(np.concatenate([np.zeros(0, np.int64), *[c[c_starts[i] : c_starts[i] + c_sizes[i]] for i in picked]]), sizes)
        for i in range(len(q_sizes)):
            own, ones = q[q_starts[i] : q_starts[i] + q_sizes[i]], q_ones[q_starts[i] : q_starts[i] + q_sizes[i] + 1]
            score, offset = block.scores(own, ones, 0), np.zeros(len(picked), np.int32)
            for o in scoring.offsets(min(drift, len(own), block.width))[1:]:
                new = block.scores(own, ones, o)
                better = new > score
                if block.least < abs(o):
                    better &= sizes >= abs(o)
                np.copyto(score, new, where=better)
                np.copyto(offset, o, where=better)
            if not k:
                continue
            take = np.flatnonzero(score >= kept[i].min())
            if len(take) > k:
                take = take[np.lexsort((order[picked[take]], -score[take]))[:k]]
            if len(take):
                kept[i] = np.sort(np.append(kept[i], score[take]))[-k:]
                best(i, picked[take], score[take], offset[take])


def total_order(timestamps: np.ndarray) -> np.ndarray:
    """Integers in the total order of floats: -0.0 before 0.0, NaN with its sign first or last of all (a null counts as NaN)."""
    bits = timestamps.astype(np.float32).view(np.int32)
    return bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))


@dataclass(frozen=True)
class Matcher:
    """An immutable set of checkpoints (ckpt_seq long, timestamp float, duration float, hashes array of long) with a drift."""

    checkpoints: DataFrame
    max_drift: int = 0

    def with_drift(self, max_drift: int) -> Matcher:
        return replace(self, max_drift=max_drift)

    def add(self, more: DataFrame) -> Matcher:
        """With further checkpoints; their ckpt_seq must come after those that are there."""
        return replace(self, checkpoints=self.checkpoints.unionByName(more))

    def clear(self) -> Matcher:
        return replace(self, checkpoints=self.checkpoints.limit(0))

    def count(self) -> DataFrame:
        return self.checkpoints.agg(F.count("*").alias("n"))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, timestamp, score, best_offset: the k best checkpoints of each query (query_id, hashes), by score, then timestamp (in total_order), then ckpt_seq.

        Every query is compared with every checkpoint. Checkpoints are packed by bytes where they lie, and each pack meets the queries, in packs too; of their lists the first k are taken in two steps.
        """
        drift = self.max_drift
        c = packed(self.checkpoints.select("ckpt_seq", "timestamp", "hashes"), ["ckpt_seq", "timestamp"], PACK_HASHES).withColumn("pack", F.monotonically_increasing_id())
        pairs = with_queries(c, queries, ["query_id"])

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    of = {name: batch.column(name)[at].values.to_numpy(zero_copy_only=False) for name in ("ckpt_seq", "timestamp", "sizes", "flat", "q_sizes", "q_flat")}
                    order = np.empty(len(of["sizes"]), np.int64)
                    keys = total_order(of["timestamp"])
                    order[np.lexsort((of["ckpt_seq"], keys))] = np.arange(len(order))
                    found = []
                    compare_all(of["q_flat"], of["q_sizes"], of["flat"], of["sizes"], drift, k, order, lambda i, c, s, o: found.append((np.full(len(c), i), c, s, o)))  # noqa: B023
                    i, c, s, o = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
                    keep = np.lexsort((order[c], -s, i))
                    first = np.searchsorted(i[keep], i[keep])
                    keep = keep[np.arange(len(keep)) - first < k]
                    ids = batch.column("query_id")[at].values.take(pa.array(i[keep]))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in (of["ckpt_seq"][c[keep]], of["timestamp"][c[keep]].astype(np.float32), keys[c[keep]], s[keep].astype(np.float32), o[keep].astype(np.int32))], pa.array(np.full(len(keep), batch.column("pack")[at].as_py(), np.int64))], names=["query_id", "ckpt_seq", "timestamp", "order_key", "score", "best_offset", "pack"])

        kind = queries.schema["query_id"].dataType.simpleString()
        lists = pairs.mapInArrow(run, f"query_id {kind}, ckpt_seq long, timestamp float, order_key int, score float, best_offset int, pack long")
        # Each task that holds lists keeps the k best of a query before anything is sent; sorted, so no list is held whole.
        best = [F.desc("score"), "order_key", "ckpt_seq"]
        for groups in (FAN_IN * FAN_IN, 1):
            first = Window.partitionBy("query_id", "pack").orderBy(*best)
            lists = lists.withColumn("pack", F.pmod("pack", F.lit(groups))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        return lists.select("query_id", "rank", "timestamp", "score", "best_offset")
