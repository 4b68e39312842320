"""Ranked lexical search over trees of documents.

Documents are restricted to the terms of the items asked for. Terms are numbered by how many documents hold them, most first, and each document is the ascending list of its terms: in their common
order, documents that begin alike stand together and share a path of a prefix tree. The order is made over the whole table by ranges, and every range is cut into trees. A subtree knows for each term the
highest tf below it, and its least m: together they bound every score below it. Each item goes through each tree depth first, the most promising branch first, and skips what cannot enter its list
any more; the list goes on from tree to tree within a task. Lists of tasks are merged sixteen at a time.

Items are the stated queries: they pass the driver in blocks of bounded vocabulary, and every block is ranked over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, table

#: A block of items has so many different terms (or one item of more), and so many items, at most.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 14, 4_096
#: Documents of a task; cells (documents times terms, 4 bytes each) of a tree; documents of a leaf.
TASK_DOCS, TREE_CELLS, LEAF_DOCS = 8_192, 1 << 22, 32
FAN_IN = 16
#: Stands for a null id, which comes before all others.
_NULL = -(1 << 63)

#: ASCII characters that end a term become spaces, A-Z become a-z; other bytes stay.
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, object, Counter]]]:
    """(row number, item_id, terms) of items that have terms, in blocks."""
    block, seen = [], set()
    for at, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        of = Counter(terms(row["text"]))
        if block and (len(block) >= BLOCK_ITEMS or len(seen | of.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        if of:
            block.append((at, row["item_id"], of))
            seen |= of.keys()
    if block:
        yield block


def _vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """d, n (its terms with repeats), terms, tf of every document with a term: of those numbered, ascending."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            keep, n, ids, tfs = [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                found = terms(text)
                if found:
                    of = Counter(map(numbers.get, found))
                    of.pop(None, None)
                    order = sorted(of)
                    keep.append(at)
                    n.append(len(found))
                    ids.append(order)
                    tfs.append([of[k] for k in order])
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["d", "n", "terms", "tf"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), "text").mapInArrow(run, "d long, n long, terms array<int>, tf array<int>")


def _shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many leading terms each list shares with the one before it; -1 for the first."""
    out = np.full(len(lists), -1, np.int64)
    for i in range(1, len(lists)):
        a, b = lists[i - 1], lists[i]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        out[i] = differ[0] if len(differ) else n
    return out


class Tree:
    """A prefix tree over documents (d, m, terms, tf; their terms ascending, in the order of the lists).

    Nodes are ranges of documents. Neighbouring small subtrees are one leaf; leaves and inner nodes have the highest tf of every term, the least m and the least id below them.
    """

    def __init__(self, d: np.ndarray, m: np.ndarray, lists: list[np.ndarray], tfs: list[np.ndarray], width: int, leaf_docs: int = LEAF_DOCS):
        self.d, self.m = d, m
        self.tf = np.zeros((len(d), width), np.int32)
        sizes = [len(x) for x in lists]
        if sum(sizes):
            self.tf[np.repeat(np.arange(len(d)), sizes), np.concatenate(lists)] = np.concatenate(tfs)
        self.children: list[list[int]] = []
        self.spans: list[tuple[int, int]] = []
        self._grow(_shared(lists), leaf_docs)
        starts = np.array([a for a, _ in self.spans])
        ends = np.array([b for _, b in self.spans])
        self.most = np.stack([self.tf[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)])
        self.least_m = np.array([m[a:b].min() for a, b in self.spans])
        self.least_d = np.array([d[a:b].min() for a, b in self.spans])

    def _node(self, a: int, b: int) -> int:
        self.spans.append((a, b))
        self.children.append([])
        return len(self.spans) - 1

    def _grow(self, shared: np.ndarray, leaf_docs: int) -> None:
        todo = [self._node(0, len(shared))]
        while todo:
            node = todo.pop()
            a, b = self.spans[node]
            if b - a <= leaf_docs:
                continue
            # The branches of the deepest node that holds the whole range: they part where the shared prefix is shortest.
            inner = shared[a + 1 : b]
            cuts = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
            begin = a
            for left, right in zip(cuts[:-1], cuts[1:], strict=True):
                # Small neighbours together, as long as they fit a leaf.
                if right - begin > leaf_docs and left > begin:
                    self.children[node].append(self._node(begin, left))
                    begin = left
            self.children[node].append(self._node(begin, b))
            if len(self.children[node]) == 1:  # one branch, or equal lists: halves
                middle = (a + b) // 2
                self.spans.pop()
                self.children.pop()
                self.children[node] = [self._node(a, middle), self._node(middle, b)]
            todo += self.children[node]

    @staticmethod
    def _scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(axis=1)

    def search(self, columns: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put the tree's documents into best, the ascending list of the k best (-score, d) so far. The number of nodes that were opened."""
        opened, todo = 0, [(0, int(self._scores(self.most[:1, columns], self.least_m[:1], weights)[0]))]
        while todo:
            node, bound = todo.pop()
            if bound <= 0 or (len(best) == k and (-bound, int(self.least_d[node])) > best[-1]):
                continue
            opened += 1
            below = self.children[node]
            if below:
                bounds = self._scores(self.most[np.ix_(below, columns)], self.least_m[below], weights)
                todo += [(below[i], int(bounds[i])) for i in np.argsort(bounds, kind="stable")]
                continue
            a, b = self.spans[node]
            scores = self._scores(self.tf[a:b, columns], self.m[a:b], weights)
            least = max(1, -best[-1][0]) if len(best) == k else 1
            new = [(-int(scores[i]), int(self.d[a + i])) for i in np.flatnonzero(scores >= least)]
            if new:
                best[:] = sorted(best + new)[:k]
        return opened


def _ranked(vectors: DataFrame, order: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, minus (score), d, part: the k best documents of each item (number, columns, weights) in each task. vectors come in the order of their lists."""
    width = max(1, len(order))
    tree_docs = max(2 * LEAF_DOCS, TREE_CELLS // width)

    def run(batches):
        best = [[] for _ in items]
        held: list[tuple] = []

        def search():
            d, n, lists, tfs = zip(*held, strict=True)
            tree = Tree(np.array(d, np.int64), np.array([25 + 75 * x * n_docs // n_terms for x in n], np.int64), list(lists), list(tfs), width)
            for (_, columns, weights), own in zip(items, best, strict=True):
                tree.search(columns, weights, own, k)
            held.clear()

        for batch in batches:
            lists, tfs = (batch.column(c) for c in ("terms", "tf"))
            ends, flat, tf = lists.offsets.to_numpy(), lists.values.to_numpy(), tfs.values.to_numpy()
            for at, (d, n) in enumerate(zip(batch.column("d").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                held.append((d, n, flat[ends[at] : ends[at + 1]].copy(), tf[ends[at] : ends[at + 1]].copy()))
                if len(held) >= tree_docs:
                    search()
        if held:
            search()
        rows = [(items[i][0], minus, d) for i, own in enumerate(best) for minus, d in own]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)] + [pa.array([part] * len(rows), pa.int64())], names=["item", "minus", "d", "part"])

    return vectors.mapInArrow(run, "item long, minus long, d long, part long")


def _of_block(docs: DataFrame, block: list[tuple[int, object, Counter]], k: int) -> DataFrame:
    """item, rank, d, score of a block of items."""
    vocabulary = sorted(set().union(*[of.keys() for _, _, of in block]))
    vectors = saved(_vectors(docs, {t: i for i, t in enumerate(vocabulary)}))
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a block's terms at most
        df[r["t"]] = r["count"]
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    items = []
    number = {t: i for i, t in enumerate(vocabulary)}
    for at, _, of in block:
        at_terms = np.array([number[t] for t in of])
        items.append((at, place[at_terms], np.array([c * weight(n_docs, int(df[number[t]])) for t, c in of.items()], np.int64)))
    parts = max(1, math.ceil(n_docs / TASK_DOCS))
    kept = _renumbered(vectors.filter(F.size("terms") > 0), place)
    # Documents that begin alike come together; many equal ones are split by their ids.
    kept = kept.repartitionByRange(parts, "terms", "d", "n").sortWithinPartitions("terms", "d", "n")
    lists = _ranked(kept, order, items, n_docs, n_terms, k)
    while True:
        parts = math.ceil(parts / FAN_IN)
        lists = lists.groupBy("item", F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct("minus", "d"))), 1, k).alias("best"))
        if parts <= 1:
            break
        lists = lists.select("item", "part", F.inline("best"))
    # The last step may still have several parts where tasks were more than planned.
    lists = lists.select("item", F.inline("best")).groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("minus", "d"))), 1, k).alias("best"))
    return lists.select("item", F.posexplode("best").alias("at", "b")).select("item", (F.col("at") + 1).alias("rank"), "b.d", (-F.col("b.minus")).alias("score"))


def _renumbered(vectors: DataFrame, place: np.ndarray) -> DataFrame:
    """vectors with the terms numbered by their place in the order, ascending."""

    def run(batches):
        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tf")
            ends = lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            now = place[lists.values.to_numpy()[ends[0] : ends[-1]]]
            by = np.lexsort((now, row))
            offsets = pa.array((ends - ends[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("n"), pa.ListArray.from_arrays(offsets, pa.array(now[by], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs.values.to_numpy()[ends[0] : ends[-1]][by], pa.int32()))], names=["d", "n", "terms", "tf"])

    return vectors.mapInArrow(run, "d long, n long, terms array<int>, tf array<int>")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text) with a score above 0, equal scores by ascending id.

    Null and empty texts have no terms: such documents do not count, and such items have no rows. Rows are rows: several of one id are ranked each. Null ids come first. Other columns are ignored; empty tables
    give an empty result.
    """
    out = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in _blocks(items):
        names = docs.sparkSession.createDataFrame([(at, name) for at, name, _ in block], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = saved(_of_block(docs, block, k)).join(F.broadcast(names), "item")
        out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("d") != _NULL, F.col("d")).alias("doc_id"), "score"))
    return out


def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS.format('text')} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0),
i AS (SELECT r, item_id, term, count(*)::BIGINT AS c FROM (SELECT r, item_id, unnest({_TERMS.format('text')}) AS term FROM (SELECT row_number() OVER () AS r, * FROM benchmark)) GROUP BY ALL),
t AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, nd),
m AS (SELECT k, doc_id, 25 + (75 * len(terms)::BIGINT * nd) // nt AS m FROM d, s WHERE len(terms) > 0),
x AS (SELECT i.r, i.item_id, m.k, m.doc_id, sum(i.c * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score FROM i JOIN t ON t.term = i.term JOIN w ON w.term = i.term JOIN m ON m.k = t.k GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM q WHERE rank <= 10"""
