"""Toxicity: bags of subwords, averaged into a linear softmax.

A word is a bag of its character n-grams, hashed to rows of an embedding table; a passage is the average of the embeddings of all its
words' n-grams, and a two-class softmax over that average gives its toxicity. Table and softmax are trained jointly in numpy, so a misspelling that
was never seen is placed by the n-grams that it shares with words that were. A text is scored by its worst passage of a fixed number of
words, and trained by it as well: of a toxic text the passage that scores highest learns, of a clean text the worst and another. So a few words in
a long text are not averaged away.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

#: The classifier learns from so many labelled texts of either label at most, those with the lowest hash of their id, and from these whole; scoring has no limit.
SAMPLE = 1_500
PASSAGE = 40
#: A passage with fewer n-grams is averaged as if padded to so many with neutral ones, so that a few words weigh alike in short and long texts.
LEAST = 400
BUCKETS = 1 << 16
DIM = 12
#: How much further an embedding steps than the softmax; its gradient is spread over the n-grams of a passage.
STEP = 40.0
LENGTHS = (3, 4, 5)
MEMO = 60_000
#: Texts are scored together until they have so many words, and their n-grams and passages so many code points or words at a time.
TOGETHER = 1 << 17
RUN = 1 << 15

#: A word begins and ends with neither white space nor a common mark; digits and symbols inside or in place of letters belong to it.
_word = re.compile(r"[^\s.,;:!?\"'()|]+(?:[.,:;!?|()\"']+[^\s.,;:!?\"'()|]+)*")


def subwords(word: str) -> list[int]:
    """Rows of the table for the n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in LENGTHS for i in range(max(1, len(marked) - n + 1))]


def passages_of(text: str) -> Iterator[set[str]]:
    """The different words of a text, lower-cased, PASSAGE words at a time, each passage starting half a passage after the one before."""
    found = _word.findall(text.lower())
    for at in range(0, max(1, len(found) - PASSAGE // 2), PASSAGE // 2):
        yield set(found[at : at + PASSAGE])


#: CRC32 registers after one byte, from an empty register.
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: What the first byte of a code point of so many UTF-8 bytes is marked with.
_LEADS = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)


def gram_registers(points: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """n and the CRC32 of the n code points from each place on, as UTF-8, for n up to length; the last length - 1 places begin none."""
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    leads = _LEADS[size] | (points >> (6 * (size - 1)).astype(np.uint32))
    more = []  # places of code points with a second, third, fourth byte, and that byte
    for k in range(1, 4):
        at = np.flatnonzero(size > k)
        more.append((at, 0x80 | ((points[at] >> (6 * (size[at] - 1 - k)).astype(np.uint32)) & 0x3F)))
    places = len(points) - length + 1
    register = np.full(places, 0xFFFFFFFF, np.uint32)
    for n in range(length):
        register = _CRC[(register ^ leads[n : n + places]).astype(np.uint8)] ^ (register >> 8)
        for at, byte in more:
            begin, end = np.searchsorted(at, (n, n + places))
            if begin < end:
                some = at[begin:end] - n
                register[some] = _CRC[(register[some] ^ byte[begin:end]).astype(np.uint8)] ^ (register[some] >> 8)
        yield n + 1, ~register


def word_pulls(found: list[str], pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of pull over subwords(word), and how many these are, for every word, computed for all words at once."""
    longest = max(LENGTHS)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    edges = np.concatenate([[0], np.cumsum(sizes)])
    marked = f"<{'><'.join(found)}>" + "\0" * (longest - 1)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
    sums = np.zeros(len(found))
    for at in range(0, int(edges[-1]), RUN):
        end = min(at + RUN, int(edges[-1]))
        first, last = int(np.searchsorted(edges, at, "right")) - 1, int(np.searchsorted(edges, end, "left"))
        of = np.repeat(np.arange(first, last), np.diff(np.clip(edges[first : last + 1], at, end)))
        left = edges[of + 1] - np.arange(at, end)
        moved = np.zeros(end - at)
        for n, register in gram_registers(points[at : end + longest - 1], longest):
            if n in LENGTHS:
                # A word that is shorter than a length counts for it as a whole.
                times = (left >= n) + sum(m > n for m in LENGTHS) * ((left == n) & (sizes[of] == n))
                moved += pull[register % BUCKETS] * times
        sums[first:last] += np.bincount(of - first, moved, last - first)
    return sums, sum(np.maximum(sizes - n + 1, 1) for n in LENGTHS)


@dataclass
class Model:
    """pull holds, for every row of the table, how far its embedding moves the softmax towards toxic; bias what it starts from."""

    pull: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """The score of every text. Pulls are rounded to a binary fraction whose sums are exact, so a score doesn't depend on the texts beside it."""
        pull = np.rint(self.pull.astype(np.float64) * 2**24) / 2**24
        worst: list[np.ndarray] = []
        found: list[str] = []
        ends: list[int] = []
        for text in texts:
            found += _word.findall(text.lower())
            ends.append(len(found))
            if len(found) >= TOGETHER:
                worst.append(_worst(found, ends, pull))
                found, ends = [], []
        worst.append(_worst(found, ends, pull))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(worst) + self.bias, -60, 60)))

    def scorer(self):
        return lambda text: float(self.scores([text])[0])


def _worst(found: list[str], ends: list[int], pull: np.ndarray) -> np.ndarray:
    """What moves the softmax most in each text: the highest average of its passages. ends holds where each text ends in found."""
    if not ends:
        return np.zeros(0)
    number = {word: i for i, word in enumerate(dict.fromkeys(found))}
    pulls, counts = word_pulls(list(number), pull) if number else (np.zeros(0), np.zeros(0, np.int64))
    none = len(number)
    pulls, counts = np.append(pulls, 0), np.append(counts, 0)
    ids = np.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)), np.int32(none))
    end = np.array(ends)
    begin = np.concatenate([[0], end[:-1]])
    half = PASSAGE // 2
    n_passages = np.maximum(1, -((begin - end + half) // half))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    text = np.repeat(np.arange(len(ends)), n_passages)
    start = begin[text] + half * (np.arange(first[-1]) - first[text])
    mean = np.zeros(first[-1])
    for at in range(0, len(mean), RUN // PASSAGE):
        some = slice(at, at + RUN // PASSAGE)
        places = start[some, None] + np.arange(PASSAGE)
        rows = ids[np.where(places < end[text[some], None], places, len(found))]
        rows.sort(axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none  # the right side is computed before any is changed
        mean[some] = pulls[rows].sum(axis=1) / np.maximum(counts[rows].sum(axis=1), LEAST)
    return np.maximum.reduceat(mean, first[:-1])


def train(texts: list[str], labels: list[int], epochs: int = 15, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit table and softmax to labelled texts by stochastic gradients, in falling steps.

    Without texts of both labels there is nothing to learn: every text then gets the share of toxic texts seen (0.5 without any).
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    bags: dict[str, np.ndarray] = {}
    # Rows of the table and how often each, of all passages one after another: a large block goes back to the system when training ends, many small ones stay with the driver.
    all_rows, all_times, edges = array("H"), array("H"), [0]
    of_text: list[range] = []
    for text in texts:
        begin = len(edges) - 1
        for words in passages_of(text):
            rows = []
            for w in sorted(words):
                if w not in bags:
                    if len(bags) >= MEMO:
                        bags.clear()
                    bags[w] = np.array(subwords(w), np.uint16)
                rows.append(bags[w])
            rows, times = np.unique(np.concatenate([np.zeros(0, np.uint16), *rows]), return_counts=True)
            all_rows.frombytes(rows.tobytes())
            all_times.frombytes(np.minimum(times, 65_535).astype(np.uint16).tobytes())
            edges.append(len(all_rows))
        of_text.append(range(begin, len(edges) - 1))
    del bags
    flat_rows, flat_times = np.asarray(all_rows), np.asarray(all_times)
    weight = np.array([1 / max(int(flat_times[a:b].sum(dtype=np.int64)), LEAST) for a, b in pairwise(edges)])
    again = max(1, round((np.sum(y == 0) / np.sum(y == 1)) ** 0.5))  # the rarer label is shown more often
    table_ = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    soft, bias = (rng.standard_normal((DIM, 2)) / DIM).astype(np.float32), np.log([1 - share, share]).astype(np.float32)
    for epoch in range(epochs):
        # A toxic text teaches by the passage that looks worst so far, a clean one by its worst and another.
        pull = table_ @ (soft[:, 1] - soft[:, 0])
        logits = np.array([flat_times[a:b] @ pull[flat_rows[a:b]] for a, b in pairwise(edges)]) * weight
        chosen: list[tuple[int, int]] = []
        for own, label in zip(of_text, labels, strict=True):
            worst = own[int(np.argmax(logits[own.start : own.stop]))]
            chosen += [(worst, 1)] * again if label else [(worst, 0), (int(rng.integers(own.start, own.stop)), 0)]
        slow = rate * (1 - epoch / epochs)
        for at in rng.permutation(len(chosen)):
            p, label = chosen[at]
            rows, times = (x[edges[p] : edges[p + 1]] for x in (flat_rows, flat_times))
            mean = times @ table_[rows] * weight[p]
            z = mean @ soft + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[label] -= 1
            to_mean = soft @ error
            soft -= slow * np.outer(mean, error)
            bias -= 0.1 * slow * error
            table_[rows] -= np.outer(times * (slow * STEP * weight[p]), to_mean)
    return Model((table_ @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learnt from docs (doc_id, text) with a label in labels (doc_id, toxic), but for those whose crc32 of the id is divisible by five.

    At most sample texts of either label are drawn, by hash of id and text; they come to the driver, which trains. Null labels and ids don't count; of several labels of one id the highest does.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    taught = taught.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit("toxicity")))
    picked = [taught.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    got = rows.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).orderBy("h", "doc_id").collect()
    return train([r["text"] or "" for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    The whole text is scored, by its worst passage; a text without words gets what the softmax gives an empty average, and a null text is an empty one.
    Score never uses anything but the text. held_out is null for a null id. Repeated rows each get their score; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pull, model.bias))

    def run(batches):
        of_texts = Model(*shared.value).scores
        for batch in batches:
            scores = of_texts(t or "" for part in slices(batch) for t in part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pull, model.bias))
    names = docs.columns

    def run(batches):
        of_texts = Model(*shared.value).scores
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(of_texts(t or "" for t in part.column(names.index("text")).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir):
    """Every document with its toxicity, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
