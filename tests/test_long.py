"""Sequences in segments against whole ones, the checkpoint store, unsound words, and the order of matches."""

import random
import struct

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from echolith import sql
from echolith.functions import scoring
from echolith.operators import segments
from echolith.operators.matcher import Matcher, total_order
from echolith.operators.numbering import numbered, numbered_as_read
from echolith.operators.store import CheckpointStore

PAIR = "pair_id long, a string, b string"


def sequences(seed):
    rng = random.Random(seed)
    long = [rng.randrange(1 << 32) for _ in range(3_000)]
    return {
        "long": long, "later": long[37:], "earlier": [5] * 12 + long, "other": [rng.randrange(1 << 32) for _ in range(2_111)],
        "edge": long[:1_024], "over": long[:1_025], "one": [4294967295], "none": [], "same": [7] * 2_500,
    }


@pytest.mark.parametrize("drift, uses", [(0, 256), (1, 256), (40, 3), (1_500, 256), (5_000, 256)])
def test_segments_equal_whole(spark, monkeypatch, drift, uses):
    monkeypatch.setattr(segments, "USES", uses)
    all_of = sequences(drift)
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in all_of for b in all_of) if drift < 1_000 or (i % 7 == 0)]
    rows = spark.createDataFrame([(k, v) for k, v in all_of.items()], "id string, hashes array<long>")
    got = segments.compare(spark.createDataFrame(pairs, PAIR), segments.segments_of_arrays(rows), drift).collect()
    whole = spark.createDataFrame([(i, all_of[a], all_of[b]) for i, a, b in pairs], "pair_id long, a array<long>, b array<long>")
    want = whole.select("pair_id", F.inline(F.array(scoring.drift_comparison(F.col("a"), F.col("b"), drift)))).collect()
    assert sorted(got) == sorted(want)


def test_segments_of_rows(spark):
    all_of = {k: v for k, v in sequences(3).items() if v}
    rows = [(k, i, h) for k, v in all_of.items() for i, h in enumerate(v)] + [(None, 0, 9)]
    random.Random(1).shuffle(rows)
    found = segments.segments_of(spark.createDataFrame(rows, "id string, at long, hash long").repartition(5), ["at"]).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.seg):
        got.setdefault(r.id, []).extend(np.frombuffer(r.words, "<u4").tolist())
    assert got == all_of | {None: [9]}
    assert all(len(r.words) <= 4 * segments.SEGMENT for r in found)
    with pytest.raises(Exception, match="unsigned 32-bit"):
        segments.segments_of(spark.createDataFrame([("a", 0, None)], "id string, at long, hash long"), ["at"]).collect()


def test_segments_odd(spark):
    """Unknown, null and empty sequences, repeated pairs, null ids of pairs, empty tables."""
    rows = spark.createDataFrame([("a", [1, 2]), ("none", []), ("null", None), ("holes", [1, None]), ("wide", [1 << 32])], "id string, hashes array<long>")
    seg = segments.segments_of_arrays(rows)
    pairs = [(1, "a", "a"), (1, "a", "a"), (None, "a", "none"), (2, "a", "unknown"), (3, None, "a"), (4, "null", "a"), (5, "a", "holes"), (6, "wide", "a")]
    got = segments.compare(spark.createDataFrame(pairs, PAIR), seg, 4).collect()
    missing = (None,) * 4
    want = [(1, 1.0, 0, 2, 64), (1, 1.0, 0, 2, 64), (None, 0.0, 0, 0, 0), *[(i, *missing) for i in (2, 3, 4, 5, 6)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert segments.compare(spark.createDataFrame([], PAIR), seg, 4).count() == 0
    assert segments.compare(spark.createDataFrame(pairs, PAIR), seg.limit(0), 4).filter("score is null").count() == len(pairs)


def test_numbers(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "x" if i % 3 == 1 else "y", (i * 7) % 400) for i in range(400)], "k string, at long").repartition(6)
    got = numbered(rows, "n", ["k"], ["at"]).collect()
    for k in (None, "x", "y"):
        own = sorted((r.at, r.n) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(len(own)))
    lain = rows.coalesce(3).cache()
    assert [r["at"] for r in numbered_as_read(lain, "n").orderBy("n").collect()] == [r["at"] for r in lain.collect()]
    assert numbered(rows.limit(0), "n", [], ["at"]).count() == 0


def test_store(spark, tmp_path):
    kind = "timestamp float, duration float, hashes array<long>, tag string"
    rows = spark.createDataFrame([(float(i), 1.0, [i], "x") for i in range(50)], kind)
    store = CheckpointStore(spark, str(tmp_path / "store"))
    assert store.count() == 0 and store.checkpoints().count() == 0
    lain = [r.timestamp for r in rows.collect()]
    store.add(rows).add(rows, ["timestamp"])
    again = CheckpointStore(spark, str(tmp_path / "store"))  # another session
    got = again.checkpoints().orderBy("ckpt_seq").collect()
    assert [r.ckpt_seq for r in got] == list(range(100)) and [r.timestamp for r in got] == lain + sorted(lain) and again.count() == 100
    again.clear()
    assert store.count() == 0 and store.as_of(1).count() == 100 and store.as_of(0).checkpoints().count() == 50
    store.add(rows.limit(3)).add(rows.limit(0))
    assert sorted(r.ckpt_seq for r in store.checkpoints().collect()) == [100, 101, 102] and store.count() == 3
    with pytest.raises(ValueError):
        store.as_of(1).clear()
    with pytest.raises(AnalysisException):
        store._commit(1, "clear", 0, 0, None)  # a version of another session
    query = spark.createDataFrame([(1, [2])], "query_id long, hashes array<long>")
    assert store.matcher().top(query, 5).count() == 3


def test_store_ties_by_insertion(spark, tmp_path):
    """Equal scores and timestamps: what was added first comes first, over additions."""
    store = CheckpointStore(spark, str(tmp_path / "store"))
    for d in range(3):
        store.add(spark.createDataFrame([(0.0, float(10 * d + i), [1, 2]) for i in range(4)], "timestamp float, duration float, hashes array<long>").coalesce(1))
    assert [r.duration for r in store.checkpoints().orderBy("ckpt_seq").collect()] == [float(10 * d + i) for d in range(3) for i in range(4)]


def test_unsound_words(spark):
    """A null among the words, a negative or a wide one: null, wherever sequences are compared; such checkpoints are never found."""
    sql.register(spark)
    bad = [[1, None], [-1, 2], [1 << 32], None]
    rows = spark.createDataFrame([(i, b, [1, 2]) for i, b in enumerate([*bad, [1, 2]])], "id long, a array<long>, b array<long>")
    got = rows.select("id", scoring.similarity(F.col("a"), F.col("b")), scoring.drift_similarity(F.col("a"), F.col("b"), 1), scoring.drift_similarity(F.col("b"), F.col("a"), 1), F.expr("sig_similarity(a, b)"), F.expr("sig_similarity_drift(b, a, 1)")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(None,) * 5] * 4 + [(1.0,) * 5]
    stored = rows.select(F.col("id").alias("ckpt_seq"), F.lit(0.0).cast("float").alias("timestamp"), F.lit(0.0).cast("float").alias("duration"), F.col("a").alias("hashes"))
    found = Matcher(stored).top(rows.select(F.col("id").alias("query_id"), F.col("b").alias("hashes")), 9).collect()
    assert len(found) == 5 and all(r.score == 1.0 for r in found)


def test_batches_are_cut(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [i] * (i % 9), [3] * (i % 7)) for i in range(60)], "id long, a array<long>, b array<long>").coalesce(1).toPandas()
    drift = rows.id % 4
    whole = scoring.compare_columns(rows.a, rows.b, drift)
    monkeypatch.setattr(scoring, "CUT_HASHES", 10)
    assert scoring.compare_columns(rows.a, rows.b, drift).equals(whole) and len(whole) == 60


def test_order_of_timestamps(spark):
    nan = float("nan")
    minus_nan = struct.unpack("<f", struct.pack("<I", 0xFFC00000))[0]
    times = [nan, 1.0, 0.0, -0.0, -1.0, float("inf"), float("-inf"), minus_nan]
    keys = total_order(np.array(times, np.float32))
    assert np.argsort(keys).tolist() == [7, 6, 4, 3, 2, 1, 5, 0]
    stored = spark.createDataFrame([(i, t, 1.0, [1]) for i, t in enumerate(times[:7])], "ckpt_seq long, timestamp float, duration float, hashes array<long>").repartition(3)
    got = Matcher(stored).top(spark.createDataFrame([(1, [1])], "query_id long, hashes array<long>"), 7).orderBy("rank").collect()
    assert [str(r.timestamp) for r in got] == ["-inf", "-1.0", "-0.0", "0.0", "1.0", "inf", "nan"]


@pytest.mark.parametrize("k", [0, 1, 4])
def test_top_equals_pairs(spark, k):
    """Many packs, cut to k in two steps, against every comparison."""
    rng = random.Random(k)
    stored = [(i, float(i % 3), 1.0, [rng.randrange(4) for _ in range(rng.randrange(6))]) for i in range(60)]
    queries = [(i, [rng.randrange(4) for _ in range(5)]) for i in range(5)]
    got = Matcher(spark.createDataFrame(stored, "ckpt_seq long, timestamp float, duration float, hashes array<long>").repartition(12), 2).top(spark.createDataFrame(queries, "query_id long, hashes array<long>"), k).collect()
    want = []
    for q, h in queries:
        a, n = np.concatenate([h] * len(stored)), np.full(len(stored), len(h))
        b, m = np.concatenate([np.zeros(0), *[s[3] for s in stored]]).astype(np.int64), np.array([len(s[3]) for s in stored])
        scores = scoring.compare_flat(a.astype(np.int64), n, b, m, np.full(len(stored), 2))[0]
        order = sorted(range(len(stored)), key=lambda i: (-scores[i], stored[i][1], i))[:k]
        want += [(q, rank + 1, stored[i][1], float(scores[i])) for rank, i in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.timestamp, r.score) for r in got) == sorted(want)
