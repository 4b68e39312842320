"""Comparison of sequences that are too long for a row: segments of one meet those of the other that lie within the drift, and what agrees is summed up offset by offset.

A sequence is a table of segments (id, seg, words): words seg * SEGMENT and on, four bytes each. No task holds more of a sequence than the segments of its batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from echolith.functions.scoring import words_sound
from echolith.operators.numbering import numbered, numbered_as_read

#: Hashes in a segment; one is 4 KiB.
SEGMENT = 1_024
#: A sequence that is used in more pairs than this is sent out in several copies, so no key of the joins is hot.
USES = 256
#: Up to so many sequences (some 16 bytes each) with several copies are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


@F.pandas_udf(BinaryType())
def _pack(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else np.asarray(w).astype("<u4").tobytes())


def segments_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """id, seg and words from one row a hash (id, hash and the columns of order, by which the hashes of an id are sorted).

    Rows with a null hash or one outside 32 bits are an error of the job: left out, they would shift what follows. Places are found by ranges, so an id may hold most rows.
    """
    sound = F.when((F.col("hash") >= 0) & (F.col("hash") < 1 << 32), F.col("hash")).otherwise(F.raise_error(F.lit("hashes must be unsigned 32-bit numbers")).cast("long"))
    placed = numbered(rows.select("id", *order, sound.alias("hash")), "at", ["id"], order)
    held = placed.groupBy("id", F.floor(F.col("at") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("x"))
    return held.select("id", "seg", _pack(F.transform("x", lambda x: x["hash"])).alias("words"))


def segments_of_arrays(rows: DataFrame) -> DataFrame:
    """The same from one row a sequence (id, hashes); an empty one is one empty segment, an unsound or null one has none."""
    whole = rows.filter(words_sound(F.col("hashes")))
    cut = whole.select("id", "hashes", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("hashes") / SEGMENT) - 1, F.lit(0)))).alias("seg"))
    return cut.select("id", F.col("seg").cast("long").alias("seg"), _pack(F.slice("hashes", (F.col("seg") * SEGMENT + 1).cast("int"), F.lit(SEGMENT))).alias("words"))


def _agreement(batches):
    """pair, offset and bits that agree, for each offset at which two segments overlap."""
    for batch in batches:
        of = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("pair_row", "a_at", "b_at", "most")}
        left, right = batch.column("a_words"), batch.column("b_words")
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(x[i].as_buffer(), "<u4") for x in (left, right))
            a_at, b_at, most = int(of["a_at"][i]), int(of["b_at"][i]), int(of["most"][i])
            offsets = np.arange(max(-most, a_at - b_at - len(b) + 1), min(most, a_at + len(a) - 1 - b_at) + 1)
            bits = np.zeros(len(offsets), np.int64)
            for k, d in enumerate(offsets):
                first, last = max(a_at, b_at + d), min(a_at + len(a), b_at + len(b) + d)
                differ = np.bitwise_count(a[first - a_at : last - a_at] ^ b[first - d - b_at : last - d - b_at])
                bits[k] = 32 * (last - first) - int(differ.sum(dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(offsets), of["pair_row"][i])), pa.array(offsets.astype(np.int32)), pa.array(bits)], names=["pair_row", "d", "bits"])


def compare(pairs: DataFrame, segments: DataFrame, max_drift: int) -> DataFrame:
    """pair_id, score, best_offset, compared_hashes and matching_bits of every row of pairs (pair_id, a, b: ids of segments), as scoring.drift_comparison gives them.

    Offsets 0, +1, -1, ... up to max_drift and both lengths; of equal scores the earliest counts. An empty sequence gives 0 throughout, an id that has no segments nulls. A pair_id may be null or stand several times; each row has its result.
    """
    sizes = segments.groupBy("id").agg(F.max(F.col("seg") * SEGMENT + F.octet_length("words") / 4).cast("long").alias("n"))
    ids = numbered_as_read(pairs.select("a", "b").distinct(), "pair_row")
    one = ids.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    one = one.withColumn("most", F.least("n_a", "n_b", F.lit(max(max_drift, 0))))

    uses = one.select(F.col("a").alias("id")).unionAll(one.select("b")).groupBy("id").agg(F.ceil(F.count("*") / USES).alias("copies")).filter("copies > 1")
    uses = F.broadcast(uses) if uses.count() <= BROADCAST_ROWS else uses
    copies = F.coalesce("copies", F.lit(1)).cast("long")
    sent = segments.join(uses, "id", "left").select("id", "seg", "words", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    dealt = one
    for side in ("a", "b"):
        dealt = dealt.join(uses.select(F.col("id").alias(side), "copies"), side, "left").withColumn(f"{side}_copy", F.pmod("pair_row", copies)).drop("copies")

    cells = dealt.filter("n_a > 0 and n_b > 0").withColumn("a_seg", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_a") - 1) / SEGMENT))))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("a_seg") * SEGMENT - F.col("most")) / SEGMENT))
    high = F.least(F.floor((F.col("n_b") - 1) / SEGMENT), F.floor(((F.col("a_seg") + 1) * SEGMENT - 1 + F.col("most")) / SEGMENT))
    cells = cells.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("b_seg", F.explode(F.sequence("low", "high")))
    met = cells.join(sent.select(F.col("id").alias("a"), F.col("seg").alias("a_seg"), F.col("copy").alias("a_copy"), F.col("words").alias("a_words")), ["a", "a_seg", "a_copy"])
    # Of a's segment only the words within the drift of b's go on.
    skip = F.greatest(F.lit(0).cast("long"), F.col("b_seg") * SEGMENT - F.col("most") - F.col("a_seg") * SEGMENT)
    end = F.least(F.lit(SEGMENT).cast("long"), (F.col("b_seg") + 1) * SEGMENT + F.col("most") - F.col("a_seg") * SEGMENT)
    met = met.select("pair_row", "b", "b_seg", "b_copy", "most", (F.col("a_seg") * SEGMENT + skip).alias("a_at"), F.substring("a_words", (4 * skip + 1).cast("int"), (4 * (end - skip)).cast("int")).alias("a_words"))
    met = met.filter(F.octet_length("a_words") > 0)
    met = met.join(sent.select(F.col("id").alias("b"), F.col("seg").alias("b_seg"), F.col("copy").alias("b_copy"), F.col("words").alias("b_words")), ["b", "b_seg", "b_copy"])
    parts = met.select("pair_row", "most", "a_at", (F.col("b_seg") * SEGMENT).alias("b_at"), "a_words", "b_words").mapInArrow(_agreement, "pair_row long, d int, bits long")
    sums = parts.groupBy("pair_row", "d").agg(F.sum("bits").alias("bits"))

    d = F.col("d").cast("long")
    scored = sums.join(one.select("pair_row", "n_a", "n_b"), "pair_row").withColumn("n", F.least(F.col("n_a") - F.greatest(d, F.lit(0)), F.col("n_b") - F.greatest(-d, F.lit(0))))
    small = (F.col("bits").cast("double") / (F.col("n") * 32)).cast("float")
    large = (F.col("bits").cast("float") / (F.col("n") * 32).cast("float")).cast("float")
    tried = F.when(d > 0, 2 * d - 1).otherwise(-2 * d)
    best = F.min(F.struct((-F.when(F.col("n") < 524_288, small).otherwise(large)).alias("minus"), tried.alias("tried"), "d", "n", "bits")).alias("x")
    found = scored.groupBy("pair_row").agg(best)
    known = one.select("pair_row", F.lit(True).alias("known"))
    same = F.col("p.a").eqNullSafe(F.col("i.a")) & F.col("p.b").eqNullSafe(F.col("i.b"))
    rows = pairs.alias("p").join(ids.alias("i"), same).select("p.pair_id", "i.pair_row")
    out = rows.join(known, "pair_row", "left").join(found, "pair_row", "left")
    value = lambda x, kind: F.when(F.col("known"), F.coalesce(x, F.lit(0))).cast(kind)
    return out.select("pair_id", value(-F.col("x.minus"), "float").alias("score"), value(F.col("x.d"), "int").alias("best_offset"), value(F.col("x.n"), "long").alias("compared_hashes"), value(F.col("x.bits"), "long").alias("matching_bits"))
