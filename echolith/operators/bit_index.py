"""An index of checkpoints by parts of their hashes, for searches that need not compare a query with every checkpoint.

A hash is cut into parts of like width (11, 11 and 10 bits, if three), and every checkpoint is filed under each part at its
position. Two hashes that share m of b parts differ in b - m bits at least, so two sequences that share M parts over n positions
agree in a share of 1 - b / 32 + M / (32 n) of their bits at most. By this bound the search knows which checkpoints it must compare
and, where the k-th best score lies above 1 - b / 32, that none is missing: a checkpoint that shares no part can't come so far.
Queries of which this is not so are held against all checkpoints, so the result is that of Matcher.top.

Checkpoints lie in packs, each with postings of its own. Every pack meets the queries, counts the parts that they share with each of its checkpoints, and gives only those
whose bound is high enough: pairs that share a part by chance, which grow with the square of the table, stay within a task and are never written or sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolith.functions import scoring
from echolith.operators.matcher import Matcher, packed, total_order, with_queries
from echolith.sources.shared import kept

#: The counts of up to so many keys (some 100 bytes each) are broadcast; more meet the keys of queries by shuffle.
BROADCAST_KEYS = 1 << 19
#: So many pairs of a pack are put out together, about.
LOT = 1 << 20
#: A pack has so many hashes (or one longer sequence), with 4 bytes for each posting and 12 for each different key.
INDEX_HASHES = 1 << 19
#: A posting that is read costs as much as so many hashes that are compared without the index.
POSTING_COST = 64
#: Scores are rounded to single precision; bounds are held against them with this margin.
MARGIN = 1e-6


def _keys(position: Column, word: Column, parts: int) -> Column:
    """One key for each part of a hash at a position: (position, part) above 32 bits for the part's value."""
    edges = [32 * i // parts for i in range(parts + 1)]
    value = lambda low, high: F.shiftright(word, low).bitwiseAND((1 << (high - low)) - 1)
    return F.array(*[F.shiftleft(position.cast("long") * parts + i, 32) + value(edges[i], edges[i + 1]) for i in range(parts)])


@F.pandas_udf(T.IntegerType())
def _order_key(timestamp: pd.Series) -> pd.Series:
    return pd.Series(total_order(timestamp.to_numpy(np.float32, na_value=np.nan)))


def _ranked(rows: DataFrame, k: int, *best: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k)


def _keys_of(position: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    """The same keys as _keys() makes, one row for each hash."""
    edges = [32 * i // parts for i in range(parts + 1)]
    values = np.stack([(word >> low) & ((1 << (high - low)) - 1) for low, high in zip(edges[:-1], edges[1:], strict=True)], axis=-1)
    return ((position[..., None] * parts + np.arange(parts)) << 32) + values


def _filed(packs: DataFrame, parts: int) -> DataFrame:
    """ckpt_seq, sizes, and the postings of each pack: its keys in order, where those of each end, and the number in the pack of each checkpoint that has them."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, flat = (batch.column(c)[at].values.to_numpy().astype(np.int64) for c in ("sizes", "flat"))
                place = np.repeat(np.arange(len(sizes)), sizes)
                all_keys = _keys_of(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), flat, parts).ravel()
                order = np.argsort(all_keys, kind="stable")
                keys, counts = np.unique(all_keys, return_counts=True)
                columns = [keys.astype("<i8"), np.cumsum(counts).astype("<i4"), np.repeat(place, parts)[order].astype("<i4")]
                yield pa.RecordBatch.from_arrays([batch.column("ckpt_seq").slice(at, 1), batch.column("sizes").slice(at, 1), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["ckpt_seq", "sizes", "keys", "ends", "places"])

    return packs.mapInArrow(run, "ckpt_seq array<bigint>, sizes array<int>, keys binary, ends binary, places binary")


def _bounds(own: np.ndarray, drift: int, parts: int, sizes: np.ndarray, keys: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which checkpoints of a pack share a part with a query at an offset, and by how much the best of their bounds is above that of others."""
    offset = np.arange(-drift, drift + 1)
    position = np.arange(len(own)) - offset[:, None]
    mine, there = _keys_of(position, np.broadcast_to(own, position.shape), parts), position >= 0
    wanted, at_offset = mine[there].ravel(), np.repeat(np.nonzero(there)[0], parts)
    at = np.searchsorted(keys, wanted)
    held = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.zeros(0, np.int64)
    at, at_offset = at[held], at_offset[held]
    begin = np.where(at > 0, ends[at - 1], 0).astype(np.int64)
    counts = ends[at] - begin
    index = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    cell = np.repeat(at_offset * len(sizes), counts) + places[index]
    shared = np.bincount(cell, minlength=len(offset) * len(sizes)).reshape(len(offset), len(sizes))
    some = np.flatnonzero(shared.any(axis=0))
    n = np.minimum(len(own) - np.maximum(offset, 0)[:, None], sizes[some] - np.maximum(-offset, 0)[:, None])
    return some, (shared[:, some] / (32 * np.maximum(n, 1))).max(axis=0, initial=0)


@dataclass(frozen=True)
class CheckpointIndex:
    """Three tables in a folder: checkpoints, packs of these with their postings, and counts (key, n)."""

    spark: SparkSession
    folder: str
    parts: int = 3

    @classmethod
    def build(cls, checkpoints: DataFrame, folder: str, parts: int = 3) -> CheckpointIndex:
        """The index of checkpoints (ckpt_seq, timestamp, hashes; other columns are not kept), written to a new folder that driver and executors share.

        ckpt_seq are not null and differ; a null timestamp counts as NaN. Checkpoints without hashes (null), or with anything but unsigned 32-bit words among them, take no part, as in Matcher.top.
        """
        if not 1 <= parts <= 32:
            raise ValueError("a hash has 1 to 32 parts")
        index = cls(checkpoints.sparkSession, folder.rstrip("/"), parts)
        checkpoints.select("ckpt_seq", F.coalesce(F.col("timestamp").cast("float"), F.lit(float("nan")).cast("float")).alias("timestamp"), "hashes").filter(scoring.words_sound(F.col("hashes"))).write.parquet(f"{index.folder}/checkpoints")
        _filed(packed(index.checkpoints, ["ckpt_seq"], INDEX_HASHES), parts).write.parquet(f"{index.folder}/packs")
        words = index.checkpoints.select(F.posexplode("hashes").alias("position", "word"))
        words.select(F.explode(_keys(F.col("position"), F.col("word"), parts)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).write.parquet(f"{index.folder}/counts")
        return index

    @property
    def checkpoints(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/checkpoints")

    @property
    def packs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/packs")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/counts")

    @property
    def blind(self) -> float:
        """The best score that a checkpoint may have which shares no part with the query."""
        return 1 - self.parts / 32

    def _query_keys(self, queries: DataFrame, drift: int) -> DataFrame:
        """query_id, q_size, offset, key: where each hash of a query would lie in a checkpoint, for every offset."""
        words = queries.select("query_id", F.size("hashes").alias("q_size"), F.posexplode("hashes").alias("at", "word"))
        moved = words.withColumn("offset", F.explode(F.sequence(F.lit(-drift), F.lit(drift)))).filter(F.col("at") >= F.col("offset"))
        return moved.select("query_id", "q_size", "offset", F.explode(_keys(F.col("at") - F.col("offset"), F.col("word"), self.parts)).alias("key"))

    def _costly(self, keys: DataFrame, drift: int) -> DataFrame:
        """query_id of those whose postings would cost more than comparing them with all checkpoints."""
        words = self.checkpoints.agg(F.coalesce(F.sum(F.size("hashes").cast("long")), F.lit(0))).first()[0]
        if self.counts.count() <= BROADCAST_KEYS:
            reads = keys.join(F.broadcast(self.counts), "key")
        else:
            uses = keys.groupBy("query_id", "key").agg(F.count("*").alias("uses"))
            reads = uses.join(self.counts, "key").withColumn("n", F.col("n") * F.col("uses"))
        return reads.groupBy("query_id").agg(F.sum("n").alias("reads")).filter(F.col("reads") * POSTING_COST > words * (2 * drift + 1)).select("query_id")

    def _shared(self, queries: DataFrame, drift: int, k: int | None = None) -> DataFrame:
        """query_id, ckpt_seq, bound of every two that share a part at an offset: of each pack the k of the highest bounds, or without k all whose bound comes up to the query's `least`.

        queries: query_id, hashes, least.
        """
        parts, blind = self.parts, self.blind
        met = with_queries(self.packs, queries.withColumn("least", F.col("least").cast("double")), ["query_id", "least"])

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    seq, sizes, q_sizes, q_flat, least = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ckpt_seq", "sizes", "q_sizes", "q_flat", "least"))
                    keys, ends, places = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("keys", "<i8"), ("ends", "<i4"), ("places", "<i4")))
                    ids, held, n, q_ends = batch.column("query_id")[row].values, [], 0, np.cumsum(q_sizes, dtype=np.int64)
                    for i in range(len(q_sizes)):
                        some, above = _bounds(q_flat[q_ends[i] - q_sizes[i] : q_ends[i]], drift, parts, sizes.astype(np.int64), keys, ends, places)
                        if k is None:
                            keep = np.flatnonzero(blind + above >= least[i] - MARGIN)
                        elif len(some) > k:
                            keep = np.flatnonzero(above >= np.partition(above, len(some) - k)[len(some) - k])
                            keep = keep[np.lexsort((seq[some[keep]], -above[keep]))[:k]]
                        else:
                            keep = np.arange(len(some))
                        held.append((np.full(len(keep), i), seq[some[keep]], blind + above[keep]))
                        n += len(keep)
                        if n >= LOT or i == len(q_sizes) - 1:
                            of, found, bound = (np.concatenate(x) for x in zip(*held, strict=True))
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(found), pa.array(bound)], names=["query_id", "ckpt_seq", "bound"])
                            held, n = [], 0

        kind = queries.schema["query_id"].dataType.simpleString()
        return met.mapInArrow(run, f"query_id {kind}, ckpt_seq long, bound double")

    def _compared(self, pairs: DataFrame, queries: DataFrame, drift: int) -> DataFrame:
        c = self.checkpoints.withColumnRenamed("hashes", "c_hashes")
        both = pairs.join(queries, "query_id").join(c, "ckpt_seq")
        return both.select("query_id", "ckpt_seq", "timestamp", F.inline(F.array(scoring.drift_comparison(F.col("hashes"), F.col("c_hashes"), drift))))

    def top(self, queries: DataFrame, k: int, max_drift: int = 0, exact: bool = True) -> DataFrame:
        """query_id, rank, timestamp, score, best_offset: the k best checkpoints of each query (query_id, hashes), as by Matcher.top.

        query_id are not null and differ. A query's k candidates of the highest bounds are compared first; those whose bound comes up to the
        least of their scores follow. Queries with fewer candidates, with a k-th score that a checkpoint without a shared part could have, or whose
        parts are so frequent that the index would be dearer, are held against all checkpoints. With exact=False only the last of
        these are, and a query's result may lack checkpoints whose score is not above `blind`.
        """
        drift = max(0, max_drift)
        queries = kept(queries.select("query_id", "hashes").filter(scoring.words_sound(F.col("hashes"))))
        costly = kept(self._costly(self._query_keys(queries, drift), drift))
        cheap = queries.join(costly, "query_id", "left_anti")
        best = _ranked(self._shared(cheap.withColumn("least", F.lit(0.0)), drift, k), k, F.desc("bound"), "ckpt_seq")
        first = self._compared(best.select("query_id", "ckpt_seq"), queries, drift)
        least = kept(first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("query_id", "least"))
        proven = least.filter(F.col("least") > self.blind + MARGIN)
        if exact:
            known, rest = cheap.join(proven, "query_id"), queries.join(proven, "query_id", "left_anti")
        else:
            known, rest = cheap.join(least, "query_id", "left"), queries.join(costly, "query_id", "left_semi")
        near = self._compared(self._shared(known.withColumn("least", F.coalesce("least", F.lit(0.0))), drift).select("query_id", "ckpt_seq"), queries, drift)
        found = _ranked(near.withColumn("order_key", _order_key(F.col("timestamp"))), k, F.desc("score"), "order_key", "ckpt_seq")
        columns = ["query_id", "rank", "timestamp", "score", "best_offset"]
        return found.select(*columns).unionByName(Matcher(self.checkpoints, drift).top(kept(rest), k).select(*columns))
