"""Substring dedup by automata of repeated phrases.

Every window of WORDS words of a document whose words also stand in a document of smaller id is deleted there.

1. Equal texts are one class; its text is worked on once. Of each text the least grams of every window are kept (winnowing), so documents that share a window share one of them; only windows around grams that
   several documents hold are hashed.
2. A window that several documents hold is confirmed, and belongs to the first of them. Neighbours of which one always follows the other, wherever either stands, make one phrase: so every
   occurrence of any of its windows is an occurrence of the whole phrase. Phrases are cut from the text of their first document.
3. Phrases are dealt to shards by their first document, of bounded size; each shard's automaton (Aho-Corasick over coded words, by pyahocorasick) is compiled in the tasks that need it.
4. Every document that holds a phrase's first window is streamed through the automata of its shards, which locate all occurrences by their words. What they cover is deleted.

Hashes (64 bits) only find candidates: what is deleted is equal word for word to a text of a smaller id.
"""

from __future__ import annotations

import math
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, saved, slices, table
from .hashing import runs_hash, text_groups, word_hashes
from .line_dedup import fingerprints

WORDS = 13
#: Grams, and how many of them make up a window.
GRAM = 5
#: Bytes of phrases in a shard, some hundred of memory for each word; documents that one task streams through it; and words of a phrase (longer ones are cut into some that overlap by a window less a word).
SHARD_BYTES, SHARD_DOCS, PHRASE_WORDS = 3 << 20, 4_096, 4_096
#: Up to so many rows of some longs are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_KEY = ["d", "h"]


def _small(df: DataFrame) -> DataFrame:
    """df (already computed), to be broadcast if it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hashed(column: pa.Array):
    """first row, word hashes and where each text's begin (one more than texts), group by group."""
    for row, offsets, data in text_groups(column):
        hashes, owner, _, _ = word_hashes(offsets, data, lower=False)
        yield row, hashes, np.searchsorted(owner, np.arange(len(offsets)))


def _places(texts: DataFrame, n_words: int) -> DataFrame:
    """f, d, h, last, p: the grams kept of each text, with their places."""

    def run(batches):
        for batch in batches:
            for row, hashes, cuts in _hashed(batch.column("text")):
                f, text, p = fingerprints(hashes, cuts, min(GRAM, n_words), n_words - min(GRAM, n_words) + 1)
                keys = batch.select(["d", "h", "last"]).take(pa.array(text + row))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *keys.columns, pa.array(p.astype(np.int32))], names=["f", "d", "h", "last", "p"])

    return texts.select("d", "h", "last", "text").mapInArrow(run, "f long, d long, h long, last long, p int")


def _windows(marked: DataFrame, n_words: int) -> DataFrame:
    """w, d, h, last, before, after: the windows around the marked grams of each text (d, h, last, text, places) by their hashes, and the words on either side (0 where there is none)."""
    reach = np.arange(n_words - min(GRAM, n_words) + 1)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            places = batch.column("places")
            ends, flat = places.offsets.to_numpy(), places.values.to_numpy().astype(np.int64)
            for row, hashes, cuts in _hashed(batch.column("text")):
                n = len(cuts) - 1
                of = np.repeat(np.arange(n), np.diff(ends[row : row + n + 1]))
                at = (flat[ends[row] : ends[row + n], None] - reach).ravel()
                of = np.repeat(of, len(reach))
                fits = (at >= 0) & (at + n_words <= (cuts[1:] - cuts[:-1])[of])
                start = np.unique(cuts[of[fits]] + at[fits])
                of = np.searchsorted(cuts, start, "right") - 1
                near = np.concatenate([hashes, [np.uint64(0)]]) | np.uint64(1)
                before = np.where(start > cuts[of], near[start - 1], np.uint64(0))
                after = np.where(start + n_words < cuts[of + 1], near[start + n_words], np.uint64(0))
                keys = batch.select(["d", "h", "last"]).take(pa.array(of + row))
                yield pa.RecordBatch.from_arrays([pa.array(runs_hash(hashes, n_words)[start].view(np.int64)), *keys.columns, pa.array(before.view(np.int64)), pa.array(after.view(np.int64))], names=["w", "d", "h", "last", "before", "after"])

    return marked.select("d", "h", "last", "text", "places").mapInArrow(run, "w long, d long, h long, last long, before long, after long")


def phrases_of(hashes: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) place of the phrases of a text, given the hash of the window at every place, and which of them (own, sorted) are its own, always follow the same word, and always precede the same word."""
    if not len(own):
        return []
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    places = np.flatnonzero(own[at] == hashes)
    of, seen, out = at[places], set(), []
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | ~right[of[:-1]] | ~left[of[1:]]
    begins = np.flatnonzero(new)
    for a, b in zip(begins, [*begins[1:], len(places)][: len(begins)], strict=True):
        if of[a] not in seen:  # of several occurrences in one text the first is enough
            seen.add(of[a])
            out.append((int(places[a]), int(places[b - 1])))
    return out


def _cut(canonical: DataFrame, n_words: int) -> DataFrame:
    """w (the hash of its first window), first, part, phrase: the phrases of each text (d, text, own), their words with one space between; part counts shards' worth of bytes."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = {k: [] for k in ("w", "first", "part", "phrase")}
            for d, text, own in zip(batch.column("d").to_pylist(), batch.column("text"), batch.column("own"), strict=True):
                w, left, right = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("w", "left", "right"))
                order = np.argsort(w, kind="stable")
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                hashes, _, _, _ = word_hashes(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), lower=False)
                every = runs_hash(hashes, n_words).view(np.int64)
                split, size = raw.split(), 0
                whole = phrases_of(every, w[order], left[order], right[order])
                for a, b in ((k, min(b, k + PHRASE_WORDS - 1)) for a, b in whole for k in range(a, b + 1, PHRASE_WORDS)):
                    phrase = b" ".join(split[a : b + n_words])
                    for k, v in (("w", int(every[a])), ("first", d), ("part", size // SHARD_BYTES), ("phrase", phrase.decode("utf-8", "surrogatepass"))):
                        out[k].append(v)
                    size += len(phrase)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("w", pa.int64()), ("first", pa.int64()), ("part", pa.int32()), ("phrase", pa.string())]))

    return canonical.select("d", "text", "own").mapInArrow(run, "w long, first long, part int, phrase string")


class Phrases:
    """An automaton over the words of phrases, which gives every occurrence of every phrase in a text.

    A word is two characters, of which neither has more values than the root of the number of words: few branches at a node are quick to search. Other words are characters that no phrase has.
    """

    def __init__(self):
        self.phrases: list[tuple[list[bytes], int]] = []
        self.automaton, self.codes = None, {}

    def add(self, phrase: bytes, first: int) -> None:
        self.phrases.append((phrase.split(), first))

    def _compile(self) -> None:
        known = dict.fromkeys(w for phrase, _ in self.phrases for w in phrase)
        base = math.isqrt(len(known)) + 1
        self.codes = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(known)}
        self.automaton = ahocorasick.Automaton()
        for phrase, first in self.phrases:
            self.automaton.add_word("".join([self.codes[w] for w in phrase]), (len(phrase), first))
        self.automaton.make_automaton()
        self.phrases = []

    def occurrences(self, text: bytes):
        """first word, end and first document of each occurrence."""
        if self.automaton is None:
            self._compile()
        if self.codes:
            for last, (n, first) in self.automaton.iter("".join(map(self.codes.get, text.split(), repeat("\0\0")))):
                end = (last + 1) // 2
                yield end - n, end, first


def united(runs: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and adjacent runs joined."""
    out: list[dict] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RUNS = "array<struct<start:int,end:int>>"


def _located(dealt: DataFrame) -> DataFrame:
    """d, h, earlier, all: for each text and shard, the runs of phrases of documents before d, and of those of d too.

    dealt: rows of one (shard, salt) stand together, its phrases (kind 0: first, text) before its texts (kind 1: d, h, last, text).
    """

    def run(batches):
        at, phrases = None, Phrases()
        for batch in (part for whole in batches for part in slices(whole)):
            out = {"d": [], "h": [], "earlier": [], "all": []}
            for r in batch.to_pylist():
                if (r["shard"], r["salt"]) != at:
                    at, phrases = (r["shard"], r["salt"]), Phrases()
                raw = (r["text"] or "").encode("utf-8", "surrogatepass")
                if r["kind"] == 0:
                    phrases.add(raw, r["d"])
                    continue
                found = list(phrases.occurrences(raw))
                out["d"].append(r["d"])
                out["h"].append(r["h"])
                out["earlier"].append(united([(a, b) for a, b, first in found if first < r["d"]]))
                out["all"].append(united([(a, b) for a, b, _ in found]) if r["last"] > r["d"] else [])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("d", pa.int64()), ("h", pa.int64()), ("earlier", _RUN), ("all", _RUN)]))

    return dealt.mapInArrow(run, f"d long, h long, earlier {_RUNS}, all {_RUNS}")


def repeats(docs: DataFrame, n_words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, runs): d, h, first, last of the texts (id and hash) that stand under several ids, by their MD5; and d, h, earlier, all: of each text (the least id that holds it, and its hash) the runs of words (start, end)
    that stand in documents before d, and those that a later holder of the same text repeats.

    docs needs doc_id and text. Null ids and null texts have no part in it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text").filter("d is not null and text is not null")
    keyed = rows.withColumn("t", F.md5("text")).drop("text")
    classes = saved(keyed.groupBy("t").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last"))
    members = saved(keyed.join(_small(classes), "t").select(*_KEY, "first", "last").distinct())
    texts = rows.join(_small(members), _KEY, "left").filter("first is null or d = first").select("d", "h", F.coalesce("last", "d").alias("last"), "text")
    places = _places(texts, n_words)
    shared = saved(places.groupBy("f").agg(F.min("d").alias("first"), F.max("last").alias("last")).filter("first < last").select("f"))
    marks = saved(places.select("f", "d", "h", "p").join(shared, "f").groupBy(*_KEY).agg(F.collect_set("p").alias("places")))
    windows = _windows(texts.join(_small(marks), _KEY), n_words)
    same = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    confirmed = saved(windows.groupBy("w").agg(F.min("d").alias("first"), F.max("last").alias("last"), same("before").alias("left"), same("after").alias("right")).filter("first < last").drop("last"))
    own = confirmed.groupBy(F.col("first").alias("d")).agg(F.collect_list(F.struct("w", "left", "right")).alias("own"))
    canonical = texts.join(_small(saved(confirmed.select(F.col("first").alias("d")).distinct())), "d", "left_semi").join(own, "d")
    phrases = saved(_cut(canonical, n_words))
    shards = max(1, math.ceil((phrases.agg(F.sum(F.octet_length("phrase").cast("long"))).first()[0] or 0) / SHARD_BYTES))
    phrases = phrases.withColumn("shard", F.pmod(F.xxhash64("first", "part"), F.lit(shards)))
    # Which texts hold which shards' phrases; what cannot be deleted anywhere isn't looked for.
    heads = phrases.select("w", "first", "shard").distinct()
    routes = saved(windows.select("w", "d", "h", "last").join(heads, "w").filter("first < last").select(*_KEY, "shard").distinct())
    salts = saved(routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("salts")))
    of_text = saved(routes.join(salts, "shard").groupBy(*_KEY).agg(F.collect_list(F.struct("shard", "salts")).alias("to")))
    streamed = texts.join(_small(of_text), _KEY).select(*_KEY, "last", "text", F.inline("to"))
    streamed = streamed.select("shard", F.pmod(F.xxhash64(*_KEY), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), *_KEY, "last", "text")
    copies = phrases.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("first").alias("d"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("last"), F.col("phrase").alias("text"))
    dealt = copies.unionByName(streamed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    runs = _located(dealt).groupBy(*_KEY).agg(F.flatten(F.collect_list("earlier")).alias("earlier"), F.flatten(F.collect_list("all")).alias("all"))
    return members, saved(runs)


def dedup(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """All columns of docs, then gone: an array of (start, end), the words to delete, perhaps overlapping; null or empty for none (named so even if docs has it).

    Null ids come neither before nor after any other: such rows keep all. Rows of one id do not count against each other; equal rows get equal results. Null and short texts have no windows.
    An empty table gives an empty result.
    """
    if not 1 <= n_words <= 32:
        raise ValueError("windows have 1 to 32 words")
    members, runs = repeats(docs, n_words)
    # Only names that docs has not take part, so its columns may have any.
    own = lambda df, names: df.select(*[F.col(c).alias(f"__{c}") for c in names])
    rows = docs.withColumns({"__id": docs["doc_id"].cast("long"), "__h": F.xxhash64(docs["text"])})
    rows = rows.join(_small(members).select(F.col("d").alias("__id"), F.col("h").alias("__h"), F.col("first").alias("__first")), ["__id", "__h"], "left").withColumn("__d", F.coalesce("__first", "__id"))
    found = rows.join(own(_small(runs), (*_KEY, "earlier", "all")), ["__d", "__h"], "left")
    gone = F.when(F.col("__id") == F.col("__d"), F.col("__earlier")).otherwise(F.col("__all"))
    return found.select(*[c for c in docs.columns if c != "gone"], gone.alias("gone"))


def without(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """All columns of docs, then n_words, n_removed (long) and kept (string): its words, those that dedup() deletes, and those that stay with one space between (named so even if docs has them)."""
    deduped, counts = dedup(docs, n_words), ("gone", "n_words", "n_removed", "kept")
    rest = [c for c in docs.columns if c not in counts]
    whole = deduped.filter("gone is null or size(gone) = 0").withColumn("kept", F.regexp_replace(F.trim(F.coalesce("text", F.lit("")), F.lit(SPACES)), SPACE_RUN, " "))
    count = F.when(F.col("kept") == "", 0).otherwise(F.octet_length("kept") - F.octet_length(F.replace("kept", F.lit(" "))) + 1).cast("long")
    whole = whole.select(*rest, count.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "kept")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            n, removed, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                split = (text or "").encode("utf-8", "surrogatepass").split()
                stays = np.ones(len(split), bool)
                for r in gone:
                    stays[r["start"] : r["end"]] = False
                n.append(len(split))
                removed.append(int((~stays).sum()))
                kept.append(b" ".join([w for w, s in zip(split, stays.tolist(), strict=True) if s]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    cut = deduped.filter("size(gone) > 0").select(F.struct(*rest).alias("row"), "text", "gone")
    cut = cut.mapInArrow(run, f"row {cut.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return whole.unionByName(cut.select(*[F.col("row").getField(c).alias(c) for c in rest], "n_words", "n_removed", "kept"))


def op13_substring_dedup(spark, sf_dir):
    """Every document without the passages of 13 words or more that stand in documents of smaller id: counts and the digest of what is kept."""
    out = without(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT k, doc_id, s, sha256(array_to_string(words[s : s + 12], ' ')) AS h FROM (SELECT *, unnest(range(1, len(words) - 11)) AS s FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
g AS (SELECT w.k, list(DISTINCT w.s) AS starts FROM w JOIN f ON f.h = w.h AND f.first < w.doc_id GROUP BY w.k),
c AS (SELECT k, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS gone FROM g),
x AS (SELECT d.k, d.doc_id, d.words, c.gone, list_filter(range(1, len(d.words) + 1), lambda i: c.gone IS NULL OR NOT list_contains(c.gone, i)) AS stay FROM d LEFT JOIN c ON c.k = d.k)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(stay))::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_transform(stay, lambda i: words[i]), ' '), '')) AS kept_sha256 FROM x"""
