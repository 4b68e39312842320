"""Substring dedup against brute force: copies, shared passages, periodic texts, null and equal ids, empty and long texts, several shards."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.llm import phrases

DOCS = "doc_id long, text string"


def brute(rows, n=phrases.WORDS):
    split = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, split, strict=True):
        for s in range(len(w) - n + 1):
            if d is not None:
                key = tuple(w[s : s + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - n + 1):
            if d is not None and first[tuple(w[s : s + n])] < d:
                gone |= set(range(s, s + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    prose = lambda k: [word() for _ in range(k)]
    passages = [prose(rng.choice((12, 13, 14, 20, 60))) for _ in range(8)]
    rows, pool = [], []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and pool:
            w = list(rng.choice(pool))
        elif kind == 1 and pool:
            w = list(rng.choice(pool))
            for _ in range(rng.randrange(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = word()
        elif kind == 2:
            w = prose(rng.randrange(3)) + rng.choice(passages) + prose(rng.randrange(30)) + rng.choice(passages)[2:]
        elif kind == 3:
            w = ["a", "b"][: rng.randrange(1, 3)] * rng.randrange(1, 30)
        else:
            w = prose(rng.randrange(60))
        pool.append(w)
        rows.append((rng.randrange(1_000), "".join(x + rng.choice((" ", "\n", " \t ")) for x in w)))
    return rows


def result(spark, rows, n_words=phrases.WORDS):
    df = spark.createDataFrame(rows, DOCS)
    for c in ("d", "h", "t", "w", "f", "first", "last", "own", "row", "gone", "n_words", "kept", "shard", "salt", "kind", "id", "places"):
        df = df.withColumn(c, F.lit("x"))
    out = phrases.without(df, n_words).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # many shards and salts
        monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
        monkeypatch.setattr(phrases, "SHARD_DOCS", 3)
        monkeypatch.setattr(phrases, "PHRASE_WORDS", 4)
    rows = texts(seed)
    got = result(spark, rows)
    assert got == brute(rows) and sum(r[2] for r in got) > 500


def test_odd_rows(spark):
    long = " ".join(f"w{i * i % 9_973}" for i in range(30_000))
    one = " ".join(f"x{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long + " more"), (5, long + " more"), (None, long), (None, None), (6, "head " + one), (7, one + " tail"), (7, one), (8, one.upper()), (-3, one), (9, "é ß 漢字 " + one)]
    assert result(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("n_words", [1, 3, 5])
def test_short_windows(spark, n_words):
    rows = texts(5, 40)
    assert result(spark, rows, n_words) == brute(rows, n_words)


def test_windows_must_be_countable(spark):
    with pytest.raises(ValueError):
        phrases.dedup(spark.createDataFrame([], DOCS), 0)


def test_phrases_are_cut_where_neighbours_differ():
    hashes = np.array([5, 6, 7, 9, 6, 7], np.int64)
    own = np.array([5, 6, 7], np.int64)
    always, never = np.ones(3, bool), np.zeros(3, bool)
    assert phrases.phrases_of(hashes, own, always, always) == [(0, 2), (4, 5)]
    assert phrases.phrases_of(hashes, own, never, always) == [(0, 0), (1, 1), (2, 2)]
    assert phrases.phrases_of(hashes, own[:0], never[:0], always[:0]) == []


def test_automaton_gives_every_occurrence():
    found = phrases.Phrases()
    found.add(b"a b a", 1)
    found.add(b"b a", 2)
    assert sorted(found.occurrences(b"x a b a b a")) == [(1, 4, 1), (2, 4, 2), (3, 6, 1), (4, 6, 2)]
    assert list(phrases.Phrases().occurrences(b"a b")) == []
    assert phrases.united([(5, 7), (1, 3), (3, 4), (6, 6)]) == [{"start": 1, "end": 4}, {"start": 5, "end": 7}]
