"""Ranked lexical search against brute force: ties, nulls, repeated rows and items, several blocks, trees, tasks and levels of merging."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.llm import ranked

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    found = [(d, Counter(split(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in found:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def result(spark, docs, items, k=10):
    frames = []
    for rows, schema in ((docs, DOCS), (items, ITEMS)):
        df = spark.createDataFrame(rows, schema)
        for c in ("d", "n", "terms", "tf", "item", "rank", "score", "part", "minus", "best"):
            df = df.withColumn(c, F.lit("x"))
        frames.append(df)
    return sorted((tuple(r) for r in ranked.search(*frames, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300, vocabulary=60):
    rng = random.Random(seed)
    word = lambda: f"t{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(25)))) for k in range(n)]
    docs += [(n + k, docs[rng.randrange(n)][1]) for k in range(n // 5)]  # ties
    return docs, [(k, " ".join(word() for _ in range(rng.randrange(1, 12)))) for k in range(15)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in (("BLOCK_TERMS", 25), ("TASK_DOCS", 12), ("TREE_CELLS", 1), ("LEAF_DOCS", 3), ("FAN_IN", 3)):
            monkeypatch.setattr(ranked, name, value)
    docs, items = corpus(3)
    assert result(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "Alpha BETA"), (4, "Alpha BETA"), (5, "alpha-beta gamma"), (None, "alpha beta"), (6, "É é ß 漢字 Alpha\U0001f600"), (7, "alpha " * 50_000), (8, "x\x7fy\x00z `{|} [\\]^_ :@ 09AZaz")]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "É alpha alpha beta"), (None, "y Z 09azaz"), (6, "alpha\U0001f600 é")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, items, 2) == brute(docs, items, 2)


def test_no_rows(spark):
    assert result(spark, [], [(1, "a")]) == [] and result(spark, [(1, "a")], []) == []


def test_tree_skips_what_cannot_enter(spark):
    """A tree's lists equal those of a full pass, and most nodes stay closed when one branch has all the best."""
    rng = np.random.default_rng(7)
    tf = np.where(rng.random((600, 40)) < 0.1, rng.integers(1, 4, (600, 40)), 0)
    tf[100:120, 3] = 50
    lists = [np.flatnonzero(row).astype(np.int32) for row in tf]
    order = sorted(range(600), key=lambda i: (lists[i].tolist(), i))
    m = rng.integers(25, 200, 600)
    tree = ranked.Tree(np.array(order), m[order], [lists[i] for i in order], [tf[i][lists[i]] for i in order], 40, 8)
    columns, weights = np.array([3, 30]), np.array([5_000, 100])
    every = ranked.Tree._scores(tf[:, columns], m, weights)
    best = []
    opened = tree.search(columns, weights, best, 10)
    assert best == sorted((-int(s), i) for i, s in enumerate(every) if s > 0)[:10]
    assert opened < len(tree.spans) / 2
    assert all(a == tree.spans[c[0]][0] and b == tree.spans[c[-1]][1] for (a, b), c in zip(tree.spans, tree.children, strict=True) if c)
