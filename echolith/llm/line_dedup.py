"""Line dedup by winnowing.

A text is a sequence of words, whatever its marks and line feeds are. At every word the gram of GRAM_WORDS words that begins there is hashed, and of each window of WINDOW grams the least hash is
kept: texts that share GRAM_WORDS + WINDOW - 1 words in a row, wherever these stand in their lines, share one of these fingerprints. Each fingerprint joins its later places to its first one (by
doc_id, then place) and to the one before; from there the match is extended over equal words both ways. The runs of all sources of a text are joined, and what is long enough together is deleted
where it comes later; the first stays. What a word's first place holds is never deleted for it, so nothing is lost altogether.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, table
from .hashing import runs_hash, text_groups, word_hashes

#: A gram is so many words: fewer recur by chance.
GRAM_WORDS = 8
WINDOW = 12
#: A stretch of adjacent or overlapping runs, of whatever sources, is deleted if it has so many words; so is a run that is one of several shared with the same text that have twice as many together.
RUN_WORDS = 25
#: Aligned places with so many words between them at most speak for the same source.
NEAR = 24
AROUND = 64
#: A fingerprint counts as frequent if one text in SAMPLED holds it so often or more, and holds more than one in SAMPLED_PART of the places seen: so at most SAMPLED_PART are.
SAMPLED, SAMPLED_LEAST, SAMPLED_PART = 16, 100, 20_000
#: The places of a frequent fingerprint are dealt to so many groups; a source that more texts quote than QUOTED is sent to several groups of them.
SALTS, QUOTED = 64, 256
#: Up to so many rows (of ids, or a text's runs: some 100 bytes each) are broadcast, so that no text is shuffled; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_KEY = ["d", "h"]


def _small(df: DataFrame) -> DataFrame:
    """df (already computed), to be broadcast if it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sliding(pick, x: np.ndarray, size: int) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every size neighbours, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x, done = pick(x[:-step], x[step:]), done + step
    return x


def fingerprints(hashes: np.ndarray, cuts: np.ndarray, gram: int = GRAM_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place of the minima (all of them, where equal) of windows of so many grams, given word hashes and where each text's begin; a text with fewer grams than a window is one window."""
    grams = np.maximum(np.diff(cuts) - gram + 1, 0)
    text = np.repeat(np.arange(len(grams)), grams)
    place = np.arange(len(text)) - (np.cumsum(grams) - grams)[text]
    # Between texts lie window slots that no gram takes, so that no window sees two texts.
    slot = np.arange(len(text)) + text * window
    own = runs_hash(hashes, gram)[cuts[text] + place]
    x = np.full(len(text) + (len(grams) + 1) * window, ~np.uint64(0))
    x[slot] = own
    least, whole = _sliding(np.minimum, x, window), np.zeros(len(x) - window + 1, bool)
    whole[slot[place < np.maximum(grams - window + 1, 1)[text]]] = True
    least = np.concatenate([np.zeros(window - 1, np.uint64), np.where(whole, least, np.uint64(0))])
    chosen = np.flatnonzero(own == _sliding(np.maximum, least, window)[slot])
    return own[chosen], text[chosen], place[chosen]


def _hashed(column: pa.Array):
    """first row, number of rows, word hashes and where each text's begin (one more than texts), group by group."""
    for row, offsets, data in text_groups(column):
        hashes, owner, _, _ = word_hashes(offsets, data, lower=False)
        yield row, len(offsets) - 1, hashes, np.searchsorted(owner, np.arange(len(offsets)))


def _places(rows: DataFrame) -> DataFrame:
    """f, d, h, p: the fingerprints of each text with their places."""

    def run(batches):
        for batch in batches:
            for row, _, hashes, cuts in _hashed(batch.column("text")):
                f, text, p = fingerprints(hashes, cuts)
                keys = batch.select(_KEY).take(pa.array(text + row))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *keys.columns, pa.array(p.astype(np.int32))], names=["f", *_KEY, "p"])

    return rows.select(*_KEY, "text").mapInArrow(run, "f long, d long, h long, p int")


def _words(rows: DataFrame) -> DataFrame:
    """d, h, words: each text's word hashes (64 bits each, as bytes)."""

    def run(batches):
        for batch in batches:
            for row, n, hashes, cuts in _hashed(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, n) for c in _KEY], pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=[*_KEY, "words"])

    return rows.mapInArrow(run, "d long, h long, words binary")


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def extended(words: np.ndarray, source: np.ndarray, places: np.ndarray, source_places: np.ndarray) -> list[tuple[int, int]]:
    """The runs (first word, end) of a text that repeat the source's words around the anchors (place, place in the source)."""
    runs, k, order = [], 0, np.lexsort((source_places, places))
    places, source_places = places[order], source_places[order]
    while k < len(places):
        p, s = int(places[k]), int(source_places[k])
        on = _reach(words[p:], source[s:])
        if on < GRAM_WORDS:  # hashes that are equal by chance
            k += 1
            continue
        runs.append((p - _reach(words[:p][::-1], source[:s][::-1]), p + on))
        # The next anchor of which a word is not covered yet.
        k = max(k + 1, int(np.searchsorted(places, p + on - GRAM_WORDS, "right")))
    return runs


def _compared(batch: pa.RecordBatch):
    """row number, which word the words begin with, words, source and anchors (places among these words, and in the source) of the rows of a batch of _both()."""
    anchors = batch.column("anchors")
    ends, flat = anchors.offsets.to_numpy(), anchors.values
    p, s = (flat.field(k).to_numpy() for k in ("p", "s"))
    for at, (words, begin, source) in enumerate(zip(batch.column("words"), batch.column("begin").to_pylist(), batch.column("source"), strict=True)):
        a, b = ends[at], ends[at + 1]
        yield at, begin, np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(source.as_buffer(), np.uint64), p[a:b] - begin, s[a:b]


def _runs(both: DataFrame, run_words: int) -> DataFrame:
    """d, h, start, end, sure: the runs that a text shares with each source; those that are sure go however short they are."""

    def run(batches):
        for batch in batches:
            at, starts, ends, sure = [], [], [], []
            for k, begin, words, source, p, s in _compared(batch):
                found = extended(words, source, p, s)
                at += [k] * len(found)
                starts += [begin + a for a, _ in found]
                ends += [begin + b for _, b in found]
                sure += [sum(b - a for a, b in found) >= 2 * run_words] * len(found)
            keys = batch.select(_KEY).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sure, pa.bool_())], names=[*_KEY, "start", "end", "sure"])

    return both.mapInArrow(run, "d long, h long, start int, end int, sure boolean")


def stretches(runs: list[dict], run_words: int) -> list[dict]:
    """What is to go, given the runs of all sources: adjacent and overlapping ones joined, if so many words together; and the sure ones."""
    out = [(r["start"], r["end"]) for r in runs if r["sure"]]
    start = end = 0
    for a, b in [*sorted((r["start"], r["end"]) for r in runs), (1 << 31, 1 << 31)]:
        if a > end:
            if end - start >= run_words:
                out.append((start, end))
            start = a
        end = max(end, b)
    return [{"start": a, "end": b} for a, b in out]


def _joined(runs: DataFrame, run_words: int) -> DataFrame:
    """d, h, runs: the stretches to delete from each text that has some."""

    def run(batches):
        for batch in batches:
            found = [stretches(r, run_words) for r in batch.column("runs").to_pylist()]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEY], pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*_KEY, "runs"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return runs.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end", "sure")).alias("runs")).mapInArrow(run, "d long, h long, runs array<struct<start:int,end:int>>")


def without(text: str, runs: list[dict]) -> tuple[str, int]:
    """The text without the words of the runs, and how many words went. What stood before and after a run stays as it was; white space after a run goes with it."""
    raw = text.encode("utf-8", "surrogatepass")
    solid = np.frombuffer(raw, np.uint8)
    solid = (solid != 0x20) & (solid - np.uint8(9) > 4)
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    gone = np.zeros(len(starts) + 1, bool)
    for r in runs:
        gone[r["start"] : r["end"]] = True
    edges, out = np.append(starts, len(raw)), [raw[: starts[0]]] if len(starts) else [raw]
    change = np.flatnonzero(np.diff(gone[:-1].astype(np.int8))) + 1
    for a, b in zip([0, *change], [*change, len(starts)], strict=True):
        if b > a and not gone[a]:
            out.append(raw[edges[a] : edges[b]])
    return b"".join(out).decode("utf-8", "surrogatepass"), int(gone[:-1].sum())


def _frequent(docs: DataFrame) -> DataFrame:
    """f: the frequent fingerprints (2 * SAMPLED_PART at most, so they may be broadcast). They are known by a sample of texts, which only decides whose places are dealt to several groups."""
    seen = saved(_places(docs.filter(F.pmod(F.xxhash64("d", "h"), F.lit(SAMPLED)) == 0)).groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    least = max(SAMPLED_LEAST, (seen.agg(F.sum("n")).first()[0] or 0) // SAMPLED_PART)
    return saved(seen.filter(F.col("n") >= least).select("f"))


def _earlier(places: DataFrame) -> DataFrame:
    """d, h, p, sd, sh, s, f: every place with the first one of its group (g) and with the one before it; of groups with f, which are some of several, the first place too, without sd, sh and s.

    places: g, f, d, h, p, ordered by g. Within a group they are put in order here; a group is as small as _pairs() makes it.
    """

    def found(g, f, d, h, p) -> pa.RecordBatch:
        order = np.lexsort((p, h, d, g))
        g, f, now = g[order], f.take(pa.array(order)), [x[order] for x in (d, h, p)]
        begins = np.concatenate([[True], g[1:] != g[:-1]])
        at, index = np.maximum.accumulate(np.where(begins, np.arange(len(g)), 0)), np.arange(len(g))
        same = lambda i, j: np.logical_and.reduce([x[i] == x[j] for x in now])
        later = index[~begins]
        by_last = later[~same(later, later - 1)]
        by_first = later[(at[later] < later - 1) & ~same(later, at[later]) & ~same(later - 1, at[later])]
        heads = index[begins & f.is_valid().to_numpy(zero_copy_only=False)]
        of, source = np.concatenate([by_last, by_first, heads]), np.concatenate([by_last - 1, at[by_first], heads])
        given = [pa.array(x[source], mask=np.arange(len(of)) >= len(of) - len(heads)) for x in now]
        return pa.RecordBatch.from_arrays([*[pa.array(x[of]) for x in now], *given, f.take(pa.array(of))], names=["d", "h", "p", "sd", "sh", "s", "f"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            g = batch.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            kept = batch.slice(cut)
            if cut:
                yield found(g[:cut], batch.column("f").slice(0, cut), *[batch.column(c).slice(0, cut).to_numpy() for c in ("d", "h", "p")])
        if kept is not None:
            yield found(kept.column("g").to_numpy(), kept.column("f"), *[kept.column(c).to_numpy() for c in ("d", "h", "p")])

    return places.mapInArrow(run, "d long, h long, p int, sd long, sh long, s int, f long")


def _supported(of_text: DataFrame) -> DataFrame:
    """d, h, sd, sh, anchors, f: the anchors of each text (d, h, x: p, sd, sh, s, f) by source, with f for those without source.

    Of the two sources of a place that one counts with which more places nearby are aligned (NEAR words); where one or two are, both count at a tie, else the first of them.
    """

    def run(batches):
        for batch in batches:
            x = batch.column("x").values
            valid = x.field("sd").is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("x").offsets.to_numpy()))
            p, sd, sh, s = (x.field(k).fill_null(0).to_numpy().astype(np.int64) for k in ("p", "sd", "sh", "s"))
            order = np.lexsort((p, p - s, sh, sd, valid, row))
            row, p, sd, sh, s, valid = row[order], p[order], sd[order], sh[order], s[order], valid[order]
            f, n = x.field("f").take(pa.array(order)), len(order)
            # Places on one diagonal, with no more than NEAR words from each to the next, support each other.
            new = np.ones(n, bool)
            new[1:] = (row[1:] != row[:-1]) | (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1]) | (p[1:] - s[1:] != p[:-1] - s[:-1]) | (p[1:] - p[:-1] > NEAR) | ~valid[1:]
            block = np.cumsum(new) - 1
            support = np.bincount(block)[block] if n else block
            order = np.lexsort((sh, sd, -support, valid, p, row))
            keep = np.ones(n, bool)
            keep[1:] = (row[order][1:] != row[order][:-1]) | (p[order][1:] != p[order][:-1]) | ~valid[order][:-1] | ((support[order][1:] == support[order][:-1]) & (support[order][1:] <= 2))
            order = np.sort(order[keep])
            row, p, sd, sh, s, valid, f = row[order], p[order], sd[order], sh[order], s[order], valid[order], f.take(pa.array(order))
            new = np.ones(len(order), bool)
            new[1:] = (row[1:] != row[:-1]) | (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1]) | ~valid[1:]
            begins = np.flatnonzero(new)
            first, ends = pa.array(begins), np.append(begins, len(order)).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32))], names=["p", "s"]))
            source = [pa.array(v[begins], t, mask=~valid[begins]) for v, t in ((sd, pa.int64()), (sh, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.select(_KEY).take(pa.array(row[begins])).columns, *source, anchors, f.take(first)], names=[*_KEY, "sd", "sh", "anchors", "f"])

    return of_text.mapInArrow(run, "d long, h long, sd long, sh long, anchors array<struct<p:int,s:int>>, f long")


def _pairs(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """d, h, sd, sh, anchors: texts with the texts where their fingerprints stand first, or before them.

    A frequent fingerprint's places are dealt to SALTS groups; the first places of these meet in turn.
    """
    places = _places(docs).withColumnRenamed("f", "g").join(F.broadcast(frequent.select(F.col("f").alias("g"), "f")), "g", "left")
    salt = F.pmod(F.xxhash64("d", "h"), F.lit(SALTS))
    places = places.select(F.when(F.col("f").isNull(), F.col("g")).otherwise(F.xxhash64("f", salt)).alias("g"), "f", "d", "h", "p")
    met = _earlier(places.repartition("g").sortWithinPartitions("g"))
    found = saved(_supported(met.groupBy("d", "h").agg(F.collect_list(F.struct("p", "sd", "sh", "s", "f")).alias("x"))))
    heads = found.filter("sd is null").select("f", F.struct("d", "h", F.col("anchors")[0]["p"].alias("p")).alias("at"))
    heads = heads.join(F.broadcast(heads.groupBy("f").agg(F.min("at").alias("first"))), "f").filter("first < at")
    again = heads.groupBy("at.d", "at.h", F.col("first.d").alias("sd"), F.col("first.h").alias("sh")).agg(F.collect_set(F.struct("at.p", F.col("first.p").alias("s"))).alias("anchors"))
    return found.filter("sd is not null").drop("f").unionByName(again)


def _words_of(docs: DataFrame, keys: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """d, h, words of the texts with these keys (d, h), one row of each; repeated: the keys of rows that stand several times, if there are any."""
    words = _words(docs.join(_small(saved(keys.distinct())), _KEY, "left_semi"))
    if repeated is None:
        return words
    return words.join(_small(repeated), _KEY, "left_anti").unionByName(words.join(_small(repeated), _KEY, "left_semi").dropDuplicates(_KEY))


def _both(docs: DataFrame, pairs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """pairs with words (from the word begin on, up to AROUND words off the outermost anchors) and source, the word hashes of either text. docs: d, h, text.

    A source that many texts quote is sent to several groups of these.
    """
    quoted = saved(pairs.groupBy("sd", "sh").agg(F.count("*").alias("n")).filter(F.col("n") > QUOTED).select("sd", "sh", F.ceil(F.col("n") / QUOTED).alias("parts")))
    part = F.pmod(F.xxhash64(*_KEY), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = pairs.join(_small(quoted), ["sd", "sh"], "left").select(*_KEY, "sd", "sh", "anchors", part).join(_words_of(docs, pairs.select(*_KEY), repeated), _KEY)
    # Of a long text the words around the anchors are enough: what is repeated further off has anchors of its own.
    begin = F.greatest(F.array_min("anchors.p") - AROUND, F.lit(0))
    length = F.array_max("anchors.p") + GRAM_WORDS + AROUND - F.col("begin")
    dealt = dealt.withColumn("begin", begin).withColumn("words", F.substring("words", 8 * F.col("begin") + 1, 8 * length))
    sources = _words_of(docs, pairs.select(F.col("sd").alias("d"), F.col("sh").alias("h")), repeated).select(F.col("d").alias("sd"), F.col("h").alias("sh"), F.col("words").alias("source"))
    sources = sources.join(_small(quoted), ["sd", "sh"], "left")
    sources = sources.select("sd", "sh", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(sources, ["sd", "sh", "part"]).select(*_KEY, "sd", "sh", "begin", "words", "source", "anchors")


def dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """All columns of docs with text shortened by the runs of words that it repeats, then n_words_removed (long; named so even if docs has it).

    docs needs doc_id and text. Runs repeated within a text go too. A text that repeats earlier ones throughout becomes empty; null texts stay null. Rows equal in id and text are one document and
    get the same result; rows of one id with different texts are documents of their own, in the order of a hash. Null ids come first. An empty table gives an empty result.
    """
    # Only these three columns take part until the end, so other columns may have any names.
    # h tells texts of one id apart, among them all those without an id.
    d, h = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(docs["text"])
    rest = docs.select(d.alias("d"), h.alias("h"), "text")
    frequent = _frequent(rest)
    repeated = saved(rest.groupBy(*_KEY).count().filter("count > 1").select(*_KEY))
    repeated = None if repeated.isEmpty() else repeated
    pairs = _pairs(rest, frequent)
    runs = _small(saved(_joined(_runs(_both(rest, pairs, repeated), run_words), run_words)))
    same = (d == runs["d"]) & (h == runs["h"])
    others = [c for c in docs.columns if c not in ("text", "n_words_removed")]
    # Texts without such runs never leave the JVM.
    whole = docs.join(runs, same, "left_anti").select(*others, "text", F.lit(0).cast("long").alias("n_words_removed"))
    cut = docs.join(runs, same).select(F.struct(*[docs[c] for c in others]).alias("row"), docs["text"], runs["runs"])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts, removed = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text, n = without(text, found)
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row", "text", "n_words_removed"])

    cut = cut.mapInArrow(run, f"row {cut.schema['row'].dataType.simpleString()}, text string, n_words_removed long")
    out = whole.unionByName(cut.select(*[F.col("row").getField(c).alias(c) for c in others], "text", "n_words_removed"))
    return out.select(*[c for c in docs.columns if c != "n_words_removed"], "n_words_removed")


def op8_line_dedup(spark, sf_dir):
    """Every document with its text after the deletion of repeated runs."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
