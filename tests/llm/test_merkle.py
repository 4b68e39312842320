"""The Merkle manifest against trees built in memory: nulls, ties, repeated rows, groups of one, runs of several lengths, empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from echolith.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", None), (3, " \n\t ", None, None, 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, "ONE\ntwo", "en", None, 7),
    (None, "one two", "en", "a", 27), (None, None, None, None, None), (7, "long " * 20_000, "de", "b", 100_000), (9, "é ß 漢字 \U0001f600", "Z", "c", 9), (4, "another", "en", "a", 25), (11, "x", "", "a", 1),
    *[(k, f"text {k}", "fr", "a", k) for k in range(20, 57)],
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_tree(digests, fan_out):
    """The root, and each leaf's siblings by level as (before, after)."""
    level, of, found = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for leaf, i in enumerate(of):
            first = i - i % fan_out
            found[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + fan_out])))
        of = [i // fan_out for i in of]
        level = [sha(*level[k : k + fan_out]) for k in range(0, len(level), fan_out)]
    return level[0], found


def brute(rows, fan_out=2):
    out, groups = [], {}
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        leaf, now = (sha(*map(field, (d, source, lang, m, text))) for m in (n, n + 1 if hit and n is not None else n))
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, now, d))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])], fan_out) for g in langs}
    root, tops = brute_tree([trees[g][0] for g in langs], fan_out)
    for g, top in zip(langs, tops, strict=True):
        for (_, _, leaf, now, d), own in zip(sorted(groups[g]), trees[g][1], strict=True):
            digest = now
            for before, after in own + top:
                digest = sha(before, digest, after)
            out.append((d, leaf, trees[g][0], root, sha(*[b + a for b, a in own + top]), digest, digest == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def of_table(spark, folder, rows):
    df = spark.createDataFrame(rows, DOCS)
    for c in ("g", "i", "n", "digest", "path", "own", "block"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, str(folder)).select(*COLUMNS).collect()), key=repr)


def test_odd_rows(spark, tmp_path):
    got = of_table(spark, tmp_path, ODD)
    assert got == brute(ODD)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, tmp_path, n):
    rows = ODD[3 : 3 + n]
    assert of_table(spark, tmp_path, rows) == (brute(rows) if rows else [])


@pytest.mark.parametrize("fan_out", [2, 3, 5])
def test_longer_runs(spark, fan_out, monkeypatch):
    """Several blocks of levels, a large group and a small one."""
    monkeypatch.setattr(merkle, "BLOCK_NODES", 9)
    groups = {"=a": 83, "=b": 1, "": 7}
    rows = [(g, k, sha(g, str(k))) for g, n in groups.items() for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "g string, k long, leaf string"), ["k"], fan_out).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    trees = {g: brute_tree([r[2] for r in rows if r[0] == g], fan_out) for g in sorted(groups)}
    root, tops = brute_tree([trees[g][0] for g in sorted(groups)], fan_out)
    want = {(g, k): trees[g][1][k] + top for g, top in zip(sorted(groups), tops, strict=True) for k in range(groups[g])}
    assert {(r.g, r.k): [tuple(s) for s in r.path] for r in got} == want
    assert {r.root for r in got} == {root} == {r.again for r in got} and {(r.g, r.subroot) for r in got} == {(g, t[0]) for g, t in trees.items()}


def test_runs_of_one_node(spark):
    with pytest.raises(ValueError):
        merkle.tree(spark.createDataFrame([], "g string, i long, n long, digest string"), 1)
