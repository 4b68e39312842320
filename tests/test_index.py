"""The checkpoint index against the full comparison, and the ranking table function."""

import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from echolith import sql
from echolith.functions import scoring
from echolith.operators import bit_index, matcher
from echolith.operators.bit_index import CheckpointIndex
from echolith.operators.matcher import Matcher

CKPT, QUERY = "ckpt_seq long, timestamp float, hashes array<long>", "query_id string, hashes array<long>"


def changed(rng, hashes, bits):
    return [h ^ sum(1 << b for b in rng.sample(range(32), bits)) for h in hashes]


def corpus(seed, n=150):
    """Sequences, near copies of some (also moved), a common one in many copies, and odd ones."""
    rng = random.Random(seed)
    rows = [[rng.randrange(1 << 32) for _ in range(rng.randrange(1, 25))] for _ in range(n)]
    rows += [changed(rng, rows[i], 1 + i % 5) for i in range(0, n, 3)] + [[7, *rows[i]] for i in range(0, n, 10)]
    rows += [[0] * 12] * 40 + [[], None, [1, None], [1 << 32], [-1]]
    stamps = [None if i % 11 == 0 else -0.0 if i % 2 else 0.0 for i in range(len(rows))]
    queries = [(f"q{i}", changed(rng, rows[i], i % 4)) for i in range(0, n, 7)]
    queries += [("zeros", [0] * 12), ("empty", []), ("null", None), ("unsound", [1, 1 << 40]), ("far", [rng.randrange(1 << 32) for _ in range(9)])]
    return [(i, t, h) for i, (t, h) in enumerate(zip(stamps, rows, strict=True))], queries


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.select("query_id", "rank", "timestamp", "score", "best_offset").collect())


@pytest.mark.parametrize("parts, k, drift, broadcast", [(1, 1, 0, 1 << 19), (3, 1, 2, 1 << 19), (3, 4, 1, 0), (8, 2, 0, 0)])
def test_exact_equals_all(spark, tmp_path, monkeypatch, parts, k, drift, broadcast):
    monkeypatch.setattr(bit_index, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(bit_index, "LOT", 5)
    c, q = corpus(parts)
    c, q = spark.createDataFrame(c, CKPT), spark.createDataFrame(q, QUERY)
    got = CheckpointIndex.build(c, str(tmp_path / "index"), parts).top(q, k, drift)
    want = rows_of(Matcher(c, drift).top(q, k))
    assert len(want) > 20 and rows_of(got) == want


def test_recall_and_what_is_compared(spark, tmp_path, monkeypatch):
    """Near copies are found without a full pass: at least nine tenths of the best matches, here of queries with up to three bits of each hash changed."""
    monkeypatch.setattr(bit_index, "POSTING_COST", 0)  # none is held against all
    c, q = corpus(5, 400)
    c, q = spark.createDataFrame(c, CKPT), spark.createDataFrame([x for x in q if x[0].startswith("q")], QUERY)
    index = CheckpointIndex.build(c, str(tmp_path / "index"))
    monkeypatch.setattr(matcher, "compare_all", None)
    got = rows_of(index.top(q, 1, exact=False))
    monkeypatch.undo()
    want = rows_of(Matcher(c).top(q, 1))
    assert len(want) == 58 and len(set(got) & set(want)) >= 0.9 * len(want)


def test_frequent_parts_go_to_the_full_pass(spark, tmp_path):
    c = spark.createDataFrame([(i, 0.0, [0] * 8) for i in range(500)], CKPT)
    q = spark.createDataFrame([("zeros", [0] * 8), ("rare", [(1 << 32) - 1] * 8)], QUERY)
    index = CheckpointIndex.build(c, str(tmp_path / "index"))
    assert [r.query_id for r in index._costly(index._query_keys(q, 0), 0).collect()] == ["zeros"]
    assert rows_of(index.top(q, 2)) == rows_of(Matcher(c).top(q, 2))


def test_empty(spark, tmp_path):
    none, q = spark.createDataFrame([], CKPT), spark.createDataFrame([("a", [1])], QUERY)
    assert CheckpointIndex.build(none, str(tmp_path / "none")).top(q, 3).collect() == []
    one = CheckpointIndex.build(spark.createDataFrame([(1, 0.0, [1])], CKPT), str(tmp_path / "one"))
    assert one.top(q.limit(0), 3).collect() == [] and rows_of(one.top(q, 3)) == [("a", "1", "0.0", "1.0", "0")]
    with pytest.raises(ValueError, match="parts"):
        CheckpointIndex.build(none, str(tmp_path / "bad"), 33)


PACKED = """WITH r AS (SELECT pmod(hash(ckpt_seq), 3) AS pack, CAST(NULL AS STRING) AS query_id, ckpt_seq, timestamp, hashes FROM c_of_test
UNION ALL SELECT explode(sequence(0, 2)), query_id, NULL, NULL, hashes FROM q_of_test)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, order_key, ckpt_seq) AS rank FROM sig_top_matches(TABLE(SELECT * FROM r), {k}, {drift})) WHERE rank <= {k}"""


@pytest.mark.parametrize("k, drift", [(1, 0), (5, 2)])
def test_table_function(spark, k, drift):
    sql.register(spark)
    c, q = corpus(9)
    c, q = spark.createDataFrame(c, CKPT), spark.createDataFrame(q, QUERY)
    c.createOrReplaceTempView("c_of_test")
    q.createOrReplaceTempView("q_of_test")
    assert rows_of(spark.sql(PACKED.format(k=k, drift=drift))) == rows_of(Matcher(c, drift).top(q, k))


def test_table_function_in_blocks():
    """Many small blocks give what one does."""
    c, q = corpus(11)

    def run(size):
        f, held = sql.SigTopMatches(), matcher.PACK_HASHES
        matcher.PACK_HASHES = size
        for i, h in q:
            f.eval({"query_id": i, "ckpt_seq": None, "timestamp": None, "hashes": h}, 3, 1)
        for s, t, h in c:
            f.eval({"query_id": None, "ckpt_seq": s, "timestamp": t, "hashes": h}, 3, 1)
        matcher.PACK_HASHES = held
        return str(list(f.terminate()))

    assert run(1) == run(1 << 18)


@pytest.mark.parametrize("call, says", [("TABLE(SELECT 1 AS pack), 1, 0", "no column query_id"), ("TABLE(SELECT 1 AS pack, 1 AS query_id, 1L AS ckpt_seq, 0F AS timestamp, array(1L) AS hashes), 0, 0", "1 or more"), ("1, 1, 0", "TABLE")])
def test_table_function_arguments(spark, call, says):
    sql.register(spark)
    with pytest.raises(AnalysisException, match=says):
        spark.sql(f"SELECT * FROM sig_top_matches({call})")


def test_two_hashes_are_compared_at_once(monkeypatch):
    """Scores and offsets are those of single comparisons, at even and odd offsets and lengths; and half as many cells as hashes are looked at."""
    rng, cells, count = np.random.default_rng(2), [], np.bitwise_count
    sizes = rng.integers(40, 60, 80).astype(np.int32)
    c, q_sizes = rng.integers(0, 1 << 32, sizes.sum()), np.array([0, 1, 45, 58], np.int32)
    q = np.concatenate([c[:1], c[60:105], c[:58]])
    found = {i: [] for i in range(4)}
    monkeypatch.setattr(np, "bitwise_count", lambda x, **how: cells.append(x.size) or count(x, **how))
    matcher.compare_all(q, q_sizes, c, sizes, 3, 5, np.arange(80)[::-1].copy(), lambda i, *x: found[i].extend(zip(*x, strict=True)))
    monkeypatch.undo()
    assert sum(cells) < 0.75 * 7 * sum(int(np.minimum(sizes, n).sum()) for n in q_sizes) + 200
    starts, q_starts = np.cumsum(sizes) - sizes, np.cumsum(q_sizes) - q_sizes
    for i, n in enumerate(q_sizes):
        of = [q[q_starts[i] : q_starts[i] + n]] * 80, [c[a : a + m] for a, m in zip(starts, sizes, strict=True)]
        score, offset, *_ = scoring.compare_flat(np.concatenate(of[0]), np.full(80, n), np.concatenate(of[1]), sizes.astype(np.int64), np.full(80, 3))
        best = np.lexsort((-np.arange(80), -score))[:5]
        got = sorted(found[i], key=lambda x: (-x[1], -x[0]))[:5]
        assert [(int(j), float(s), int(o)) for j, s, o in got] == [(int(j), float(score[j]), int(offset[j])) for j in best]


def test_chance_matches_are_not_written(spark, tmp_path, monkeypatch):
    """Pairs that share a part by chance, most of all pairs here, stay in their tasks: what is kept grows with the queries only."""
    rng, rows = random.Random(6), []
    c = [(i, 0.0, [rng.randrange(1 << 32) for _ in range(60)]) for i in range(300)]
    q = [(f"q{i}", [h ^ 1 for h in c[5 * i][2]]) for i in range(60)]
    write = bit_index.kept
    monkeypatch.setattr(bit_index, "kept", lambda df: (lambda out: rows.append(out.count()) or out)(write(df)))
    monkeypatch.setattr(bit_index, "INDEX_HASHES", 2_000)
    monkeypatch.setattr(bit_index, "POSTING_COST", 0)
    c, q = spark.createDataFrame(c, CKPT), spark.createDataFrame(q, QUERY)
    index = CheckpointIndex.build(c, str(tmp_path / "index"))
    got = rows_of(index.top(q, 1, 1))
    assert max(rows) <= 60 and got == rows_of(Matcher(c, 1).top(q, 1)) and len(got) == 60
    assert index.packs.count() >= 9
