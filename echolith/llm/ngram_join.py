"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct five-word shingles; two documents link when 100 * |intersection| >= 80 * |union|.

1. Documents of equal sets are one class. All that follows is between classes.
2. Two documents that link share at least m of the first n - ceil(0.8 n) + m shingles of each (n - ceil(8 n / 9) + m for the smaller of the two), in any order that is the same for all. In an order that puts
   shingles held by a single class first, a class with n - ceil(0.8 n) + 1 of them has no link. Shingles of low hash are counted for all classes; whoever has as many own ones among these alone is closed. Of the
   rest (LOW is somewhat more than the prefix's fifth, so these are classes with something in common with others) the sets are made, once.
3. Open classes that share two of their minhashes are compared with one of them. The links found make preliminary components, so that a large group of near copies is known as one before anything is
   enumerated: two members of one component need no further comparison, and a shingle held by one component alone is an own one. So more classes are closed, again by shingles of low hash first.
4. The shingles that several components hold are ordered by how many classes hold them, then by hash. Each class picks the m of least estimated cost (places to read, and candidates to verify), and so
   lengthens its prefix; a pair is verified only if it shares the lesser m of the two in their prefixes. Pairs whose own shingles and parity bitmaps show that they differ too much are left out.
5. For each shingle in prefixes, every document is compared with one that is drawn from another component, some rounds long; what is linked thus is one component from then on. Then all pairs of different
   components that share enough are verified on their whole sets. All links give the components.

Shingles and sets are known by 64-bit hashes: of ten thousand million different sets some three pairs may be taken for equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, table
from .hashing import mix, runs_hash, text_groups, word_hashes

WORDS = 5
SEEDS = 4
#: The estimated cost of verifying a candidate, in places read; and the longest prefix tried.
VERIFY_COST, MOST_MATCHES = 8, 8
#: Rounds in which every document is compared with drawn ones only.
ROUNDS = 3
#: Longs of 64 buckets in a parity bitmap; sets of some thousand shingles and more fill it, and it tells nothing of them.
BITMAP = 4
#: Where the low hashes end: a quarter of all.
LOW = 1 << 62
#: Up to so many rows of two or three longs are broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 150_000


def _small(df: DataFrame) -> DataFrame:
    """df (already computed), to be broadcast if it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_length(n, matches=1):
    """How many of n shingles, in any common order, hold the first matches of those shared with a document that links."""
    return n - (4 * n + 4) // 5 + matches


def short_prefix_length(n, matches=1):
    """The same for the smaller document of a pair."""
    return n - (8 * n + 8) // 9 + matches


def shingle_sets(column: pa.Array):
    """The sorted shingle hashes of each text."""
    for _, offsets, data in text_groups(column):
        hashes, owner, _, _ = word_hashes(offsets, data, lower=True)
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        full = runs_hash(hashes, WORDS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(full[a : b - WORDS + 1])
            else:
                yield mix(runs_hash(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    """d, h, text: the row's id (a null one is the least long), its text's hash, its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "text")


def _sketches(rows: DataFrame) -> DataFrame:
    """d, h, c (class: a hash of the set; null for an empty one), n, mh (minhashes), least (the shingles of low hash)."""
    kinds = [("c", pa.int64()), ("n", pa.int64()), ("mh", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))]

    def run(batches):
        salts = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) % (1 << 64)) for j in range(SEEDS)]
        for batch in (part for whole in batches for part in slices(whole)):
            out = {k: [] for k, _ in kinds}
            for s in shingle_sets(batch.column("text")):
                mixed = [mix(s ^ salt) for salt in salts]
                empty = not len(s)
                whole = mix(mixed[0].sum(keepdims=True) + mixed[1].sum(keepdims=True) * np.uint64(3) + np.uint64(len(s)))
                out["c"].append(None if empty else int(whole[0].view(np.int64)))
                out["n"].append(len(s))
                out["mh"].append([] if empty else [int(m.min().view(np.int64)) for m in mixed])
                out["least"].append(s[: np.searchsorted(s, np.uint64(LOW))].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), *[pa.array(out[k], t) for k, t in kinds]], names=["d", "h", *out])

    return rows.mapInArrow(run, "d long, h long, c long, n long, mh array<long>, least array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, n, shingles (the whole set, as bytes), n_low (how many are low) of each wanted class (c, n, d, h), from one document of it."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = list(shingle_sets(batch.column("text")))
            low = [int(np.searchsorted(x, np.uint64(LOW))) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(low, pa.int64())], names=["c", "n", "shingles", "n_low"])

    rows = _keyed(docs).join(_small(wanted), ["d", "h"]).select("c", "n", "text")
    return rows.mapInArrow(run, "c long, n long, shingles binary, n_low long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; already computed) of classes that link. The class that is in many pairs should be a: its set is read once for them."""

    def run(batches):
        for batch in batches:
            keep, large, last = [], None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    large, last = np.frombuffer(x.as_buffer(), np.uint64), a
                small = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
                shared = int((large[at] == small).sum())
                keep.append(100 * shared >= 80 * (len(small) + len(large) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    centres = sets.join(_small(saved(pairs.select(F.col("a").alias("c")).distinct())), "c", "left_semi").select(F.col("c").alias("a"), F.col("shingles").alias("x"))
    both = sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")).join(_small(pairs), "b").join(centres, "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """c, label: the least class of the component of every class that has a link (a, b).

    In each round a class takes the least label among its neighbours, then the label of its label, until nothing changes; long chains shorten by half a round.
    """
    edges = saved(links.union(links.select("b", "a")).distinct())
    labels = saved(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        new = labels.join(near, "c").select("c", F.least("label", "near").alias("to"), "label")
        new = new.join(labels.select(F.col("c").alias("to"), F.col("label").alias("next")), "to").select("c", F.least("to", "next").alias("label"), (F.least("to", "next") != F.col("label")).alias("moved"))
        new = saved(new)
        labels = new.select("c", "label")
        if new.filter("moved").isEmpty():
            return labels


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    return classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))


def _close(a: Column, b: Column) -> Column:
    """Whether sizes are near enough for a link."""
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def _starred(classes: DataFrame) -> DataFrame:
    """a, b: every class with one of those that share two minhashes with it: the one that it meets most often, as each pair of minhashes draws its own."""
    two = F.array(*[F.xxhash64(F.lit(i * SEEDS + j), F.col("mh")[i], F.col("mh")[j]) for i in range(SEEDS) for j in range(i + 1, SEEDS)])
    keys = saved(classes.select("c", "n", F.explode(two).alias("v")))
    centres = keys.groupBy("v").agg(F.min(F.struct(F.xxhash64("v", "c").alias("draw"), "c", "n")).alias("s"), F.count("*").alias("m")).filter("m > 1")
    centres = saved(centres.select("v", F.col("s.c").alias("a"), F.col("s.n").alias("m")))
    pairs = keys.join(_small(centres), "v").filter((F.col("c") != F.col("a")) & _close(F.col("n"), F.col("m"))).groupBy("c", "a").agg(F.count("*").alias("k"))
    return pairs.groupBy(F.col("c").alias("b")).agg(F.max(F.struct("k", "a")).alias("best")).select("best.a", "b")


def _prefixes(rows: DataFrame) -> DataFrame:
    """token, c, n, label, bits, own, m, rank for the shared shingles in each class's prefix, with the m that costs least; own counts the others, which no other component holds.

    bits has a bit for each bucket of hashes: whether an odd number of the class's shared shingles fall into it.

    rows: c, n, label and shared (the class's shingles that other components hold, as structs of df and token, ascending); all others come before these in the order.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            flat, ends = batch.column("shared").values, batch.column("shared").offsets.to_numpy()
            df, token = (flat.field(k).to_numpy() for k in ("df", "token"))
            ns, picked, best, ranks, owns, bits = batch.column("n").to_pylist(), [], [], [], [], []
            for n, a, b in zip(ns, ends[:-1], ends[1:], strict=True):
                before, read = n - (b - a), np.concatenate([[0], np.cumsum(df[a:b])])
                ms = np.arange(1, min(MOST_MATCHES, (4 * n + 4) // 5) + 1)
                inside = np.clip(prefix_length(n, ms) - before, 0, b - a)
                m = int(np.argmin(read[inside] * (1 + VERIFY_COST / ms)))
                picked.append(np.arange(a, a + inside[m]))
                best.append(m + 1)
                owns.append(before)
                odd = np.bincount(token[a:b] & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                ranks.append(before + np.arange(inside[m]))
            row = np.repeat(np.arange(len(ns)), [len(x) for x in picked])
            at = np.concatenate([np.zeros(0, np.int64), *picked]).astype(np.int64)
            own = [batch.column(k).take(pa.array(row)) for k in ("c", "n", "label")] + [pa.array(bits, pa.list_(pa.int64())).take(pa.array(row))]
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), *own, pa.array(np.array(owns, np.int64)[row]), pa.array(np.array(best, np.int64)[row]), pa.array(np.concatenate([np.zeros(0, np.int64), *ranks]).astype(np.int64))], names=["token", "c", "n", "label", "bits", "own", "m", "rank"])

    return rows.mapInArrow(run, "token long, c long, n long, label long, bits array<long>, own long, m long, rank long")


def _unpacked(sets: DataFrame, low: int, high: int) -> DataFrame:
    """c, label, token of the shingles with low <= hash < high."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for s in batch.column("shingles"):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                found.append(x[np.searchsorted(x, np.uint64(low)) : np.searchsorted(x, np.uint64(high - 1), "right")].view(np.int64))
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column("c").take(row), batch.column("label").take(row), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["c", "label", "token"])

    return sets.select("c", "label", "shingles").mapInArrow(run, "c long, label long, token long")


def _open(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose own low shingles don't fill their prefix."""
    held = sketch.filter("c is not null").select("c", F.explode("least").alias("token")).groupBy("token").agg(F.min("c").alias("c"), F.max("c").alias("other"))
    own = held.filter("c = other").groupBy("c").agg(F.count("*").alias("own"))
    return classes.join(own, "c", "left").filter(_needs_more(F.col("n"), F.coalesce("own", F.lit(0)))).drop("own")


def _needs_more(n: Column, own: Column) -> Column:
    return own < n - F.floor((4 * n + 4) / 5) + 1


def _held(sets: DataFrame, low: int, high: int) -> DataFrame:
    """c, shared: of every class with any, the shingles in the range that several components hold, each with how many classes (of sets: c, label, shingles) hold it."""
    held = _unpacked(sets, low, high)
    shared = held.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("one"), F.max("label").alias("other")).filter("one < other").select("token", "df")
    return saved(held.join(_small(saved(shared)), "token").groupBy("c").agg(F.collect_set(F.struct("df", "token")).alias("shared")))


def _prefix_rows(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of _prefixes() for the classes that may have a link to another component."""
    labelled = _labelled(sets, labels)
    low = _held(labelled, 0, LOW)
    left = labelled.select("c", "n", "n_low", "label").join(low, "c", "left")
    left = saved(left.filter(_needs_more(F.col("n"), F.col("n_low") - F.when(F.col("shared").isNull(), 0).otherwise(F.size("shared")))).drop("n_low"))
    high = _held(labelled.join(_small(left.select("c")), "c", "left_semi"), LOW, 1 << 64)
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    mine = left.join(high.withColumnRenamed("shared", "more"), "c", "left").select("c", "n", "label", F.sort_array(F.concat(F.coalesce("shared", none), F.coalesce("more", none))).alias("shared"))
    return saved(_prefixes(mine.filter(F.size("shared") > 0)))


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    """Whether so many shared shingles make sets of n and m link."""
    return 9 * overlap >= 4 * (n + m)


def _alike(a: str, b: str) -> Column:
    """Whether two rows of different components may link, as far as own shingles and bitmaps tell.

    The own shingles of both, and one shingle for each bucket in whose parity they differ, are in one set only; of n and m shingles at most (n + m) / 9 may be.
    """
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITMAP)), F.col(f"{a}.own") + F.col(f"{b}.own"))
    return 9 * apart <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _drawn(rows: DataFrame, salt: int) -> DataFrame:
    """a, b: every row of a token that more than one component holds, with one row from another component: first the one of fewest own shingles, which is in the middle of its like, later one drawn at random."""
    order = F.struct(F.col("own") if salt == 0 else F.lit(0), F.xxhash64("token", "c", F.lit(salt)).alias("draw"), "c", "n", "label", F.col("own").alias("o"), "bits")
    centres = rows.groupBy("token").agg(F.min(order).alias("s"), F.min("label").alias("one"), F.max("label").alias("other"))
    centres = saved(centres.filter("one < other").select("token", "s"))
    a, b = centres.select("token", "s.c", "s.n", "s.label", F.col("s.o").alias("own"), "s.bits"), rows
    fits = _enough(F.least(F.col("b.n") - F.col("b.own"), F.col("a.n") - F.col("a.own")), F.col("b.n"), F.col("a.n"))
    met = b.alias("b").join(_small(a).alias("a"), F.col("a.token") == F.col("b.token")).filter((F.col("a.label") != F.col("b.label")) & _close(F.col("b.n"), F.col("a.n")) & fits & _alike("a", "b"))
    return met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()


def _candidates(rows: DataFrame) -> DataFrame:
    """a, b: pairs of classes of different components that share enough of their prefixes.

    With l the overlap that two sets of n and m need, and k the lesser of their numbers of matches, k of the first n - l + k shingles of one are among the first m - l + k of the other.
    A pair of places at which no overlap of the size needed fits any more (what comes before both, but for own shingles, and what follows both) is left out.
    """
    a, b = rows.alias("a"), rows.alias("b")
    n, m, i, j = (F.col(x) for x in ("a.n", "b.n", "a.rank", "b.rank"))
    less = F.least("a.m", "b.m") - F.floor((4 * (n + m) + 8) / 9)
    smaller = (F.struct("a.n", "a.c") < F.struct("b.n", "b.c")) & (F.col("a.label") != F.col("b.label")) & _close(n, m) & (i < n + less) & (j < m + less) & _alike("a", "b")
    fits = _enough(F.least(i - F.col("a.own"), j - F.col("b.own")) + F.least(n - i, m - j), n, m)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller & fits)
    met = met.groupBy(F.col("a.c").alias("a"), F.col("b.c").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("a.m", "b.m")).alias("m"))
    return met.filter("k >= m").select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """d, h, n_shingles, component (the least d of it), class_size, n_verified and label (the component's own number; null without words) of every row of docs (doc_id, text).

    d is doc_id with the least long for null, h the hash of the text; n_verified counts the links of the row's class that were verified, which suffice to connect the component.
    A text of fewer than five words is one shingle; one without words has none, links with nothing (nor with another such text), and is its own component.
    Repeated rows are equal texts and so one class. Other columns are ignored; an empty table gives an empty result.
    """
    sketch = saved(_sketches(_keyed(docs)))
    classes = sketch.filter("c is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("mh").alias("mh"), F.min(F.struct("d", "h")).alias("r"), F.count("*").alias("size"))
    classes = saved(classes.select("c", "n", "mh", "r.d", "r.h", "size"))
    open_ = saved(_open(sketch, classes))
    sets = saved(_sets(docs, open_.select("c", "n", "d", "h")))
    # A document that stands several times gave its class as many rows.
    repeated = saved(sets.groupBy("c").count().filter("count > 1").select("c"))
    if not repeated.isEmpty():
        sets = saved(sets.join(_small(repeated), "c", "left_anti").unionByName(sets.join(_small(repeated), "c", "left_semi").dropDuplicates(["c"])))
    links = saved(_verified(saved(_starred(open_)), sets))
    labels = components(links)
    rows = _prefix_rows(sets, labels)
    for salt in range(ROUNDS):
        found = saved(_verified(saved(_drawn(rows, salt)), sets))
        if found.isEmpty():
            break
        links = saved(links.unionByName(found))
        labels = components(links)
        rows = saved(_labelled(rows.drop("label"), labels))
    links = saved(links.unionByName(_verified(saved(_candidates(rows)), sets)))
    labels = components(links)
    counts = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("c")).agg(F.count("*").alias("n_verified"))
    of_class = _labelled(classes.select("c", "n", "size", "d"), labels)
    least = of_class.groupBy("label").agg(F.min("d").alias("component"))
    of_class = of_class.join(least, "label").join(counts, "c", "left").select("c", "label", "component", F.col("size").alias("class_size"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    out = sketch.select("d", "h", "c", F.col("n").alias("n_shingles")).join(of_class, "c", "left")
    return out.select("d", "h", "n_shingles", F.coalesce("component", "d").alias("component"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"), "label")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component: of the least doc_id (then text hash). Texts without words all stay.

    Of rows equal in doc_id and text one stays; if they differ elsewhere, the one of the least hash.
    """
    found = saved(join(docs.select("doc_id", "text")).select("d", "h", "n_shingles", "label"))
    some = found.filter("n_shingles > 0")
    first = some.groupBy("label").agg(F.min(F.struct("d", "h")).alias("r"))
    gone = _small(saved(some.join(first, "label").filter(F.struct("d", "h") != F.col("r")).select("d", "h").distinct()))
    again = saved(some.groupBy("d", "h").count().filter("count > 1").select("d", "h"))
    d, h = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(docs["text"])
    kept = docs.join(gone, (d == gone["d"]) & (h == gone["h"]), "left_anti")
    if again.isEmpty():
        return kept
    again = _small(again)
    same, row = (d == again["d"]) & (h == again["h"]), F.struct(*[docs[c] for c in docs.columns])
    one = kept.join(again, same).groupBy(again["d"], again["h"]).agg(F.min_by(row, F.xxhash64(*[docs[c] for c in docs.columns])).alias("row"))
    return kept.join(again, same, "left_anti").unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op1_ngram_join(spark, sf_dir):
    """Every document with the size of its set and its component."""
    d = F.when(F.col("d") == -(1 << 63), None).otherwise(F.col("d"))
    component = F.when(F.col("component") == -(1 << 63), None).otherwise(F.col("component"))
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select(d.alias("doc_id"), "n_shingles", component.alias("component_id"), "class_size")


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
k AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, md5(list_sort(s)::VARCHAR) AS k, s FROM s),
c AS (SELECT k, min(doc_id) AS id, any_value(n_shingles) AS n, any_value(s) AS s, count(*) AS class_size FROM k WHERE n_shingles > 0 GROUP BY k),
t AS (SELECT id, n, unnest(s) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM t AS a JOIN t AS b ON a.t = b.t AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS to_id FROM c UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.to_id),
m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT k.doc_id, k.n_shingles, coalesce(m.component_id, k.doc_id) AS component_id, coalesce(c.class_size, 1)::BIGINT AS class_size
FROM k LEFT JOIN c ON c.k = k.k AND k.n_shingles > 0 LEFT JOIN m ON m.id = c.id"""
