"""Sharding by extendible hashing.

Rows hash to 60 bits. A bucket of the directory is a prefix of these bits; only a bucket whose bytes exceed the limit is split on its next bit, until every
bucket fits. The splits are found on sums of cells (fine prefixes, about 64 to a shard, so their number follows the number of shards): for every prefix length
the cells' bytes are summed, a few lengths at a time and upwards, and a cell belongs to the shortest prefix that fits. A cell that is too large itself is cut finer in a
further round, of its rows alone. Repeated rows hash apart because their running copy number is hashed with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved, table, times

BITS = 60
LIMIT = 1 << 20
#: So many levels of the directory are summed at once.
FOLD = 6


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, copy, bytes, h: one row for each of docs; h is 60 bits of an MD5."""
    bytes_ = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_hash"), bytes_.alias("bytes"))
    rows = times(rows.groupBy("doc_id", "text_hash", "bytes").agg(F.count("*").alias("n")), "n", "copy").drop("n")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash", F.col("copy").cast("string"))
    return rows.withColumn("h", F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long"))


def _prefix(h, depth):
    """The first depth bits of h, as a number; depth is a column or a number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, coarse: int, fine: int, limit: int) -> DataFrame:
    """cell, depth: the cells (of fine bits) that belong to a bucket of coarse to fine bits that fits; the others are too large themselves.

    Sums go upwards FOLD bits at a time, each time over what the last one left, so no level has more rows than the cells and a level's only prefix is summed from few rows.
    """
    sums, level, low = [], cells.select(F.col("cell").alias("prefix"), "bytes", "n"), fine
    while True:
        up = max(coarse, low - FOLD)
        d = F.explode(F.sequence(F.lit(up), F.lit(low if low == fine else low - 1))) if up < low or low == fine else None
        if d is not None:
            spread = level.select(d.alias("d"), "prefix", "bytes", "n").withColumn("prefix", F.call_function("shiftright", F.col("prefix"), (F.lit(low) - F.col("d")).cast("int")))
            sums.append(saved(spread.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))))
        if up == coarse:
            break
        level, low = sums[-1].filter(F.col("d") == up).drop("d"), up
    every = sums[0]
    for more in sums[1:]:
        every = every.unionByName(more)
    too_large = (F.col("bytes") > limit) & (F.col("n") > 1)
    split = every.filter(too_large).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"))
    fit = every.filter(~too_large).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    # A bucket is a prefix that fits and whose parent does not; a parent has two children at most.
    leaves = fit.filter(F.col("d") == coarse).select("d", "prefix").unionByName(fit.filter(F.col("d") > coarse).join(split, ["d", "parent"]).select("d", "prefix"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(fine) - F.col("d")).cast("int"))
    return leaves.select(F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("cell"), F.col("d").alias("depth"))


def shards(docs: DataFrame, limit: int = LIMIT, step: int = 12) -> DataFrame:
    """doc_id, text_hash, copy, bytes, depth, prefix, shard of every row of docs (doc_id, text).

    bytes is the UTF-8 length of the text (a null text has none, and is sharded too). shard is the bucket's bits as a string of 0 and 1; with all
    rows within the limit there is one bucket, of the empty string. No shard exceeds the limit, but for one that holds a
    single larger row (its depth is then that at which it is alone, or BITS). Null ids hash as an empty one. Other columns are ignored; an empty table gives an empty result.
    """
    rows = saved(_hashed(docs))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, 6 + max(0, (total // limit).bit_length()))
    open_rows, coarse, found = rows, 0, []
    while True:
        cells = saved(open_rows.groupBy(_prefix(F.col("h"), fine).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
        at = open_rows.withColumn("cell", _prefix(F.col("h"), fine)).join(_leaves(cells, coarse, fine, limit), "cell", "left").drop("cell")
        last = fine == BITS
        found.append(at.withColumn("depth", F.coalesce("depth", F.lit(BITS))) if last else at.filter("depth is not null"))
        if last or cells.filter((F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty():
            break
        open_rows, coarse, fine = saved(at.filter("depth is null").drop("depth")), fine + 1, min(BITS, fine + step)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    prefix = _prefix(F.col("h"), F.col("depth"))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0")))
    return out.select("doc_id", "text_hash", "copy", "bytes", F.col("depth").cast("int").alias("depth"), prefix.alias("prefix"), bits.alias("shard"))


def directory(sharded: DataFrame) -> DataFrame:
    """shard, depth, n_rows, bytes: the directory's buckets."""
    return sharded.groupBy("shard", "depth").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("bytes"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the rows of docs as Parquet with a folder for each shard; of rows that are equal in id and text each goes to the shard of its own copy number. docs may have columns of any names but shard, which is the folder's."""
    where = shards(docs, limit).select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("copy").alias("w_copy"), "shard")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("hash"))
    rows = numbered(rows, ["id", "hash"], "copy")
    joined = rows.join(where, (F.col("hash") == F.col("w_hash")) & (F.col("copy") == F.col("w_copy")) & F.col("id").eqNullSafe(F.col("w_id")))
    joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"], "shard").repartition("shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir):
    """Every document with the shard that it goes to."""
    return shards(table(spark, sf_dir, "documents")).select("doc_id", "bytes", "depth", "prefix", "shard")


#: Every prefix length is summed over all rows; a row's shard is one bit longer than its longest prefix that is too large.
ORACLE_SQL = f"""
WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS th,
                  row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
h AS (SELECT doc_id, bytes, copy, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), th, copy::VARCHAR)), 1, {BITS // 4}))::BIGINT AS h FROM r),
d AS (SELECT unnest(range(0, 24)) AS d),
big AS (SELECT d, h >> ({BITS} - d) AS p FROM h, d GROUP BY 1, 2 HAVING sum(bytes) > {LIMIT} AND count(*) > 1),
leaf AS (SELECT h.doc_id, h.bytes, h.copy, h.h, coalesce(max(big.d) + 1, 0) AS depth
         FROM h LEFT JOIN (d JOIN big USING (d)) ON h.h >> ({BITS} - d.d) = big.p GROUP BY ALL)
SELECT doc_id, bytes::BIGINT AS bytes, depth::INTEGER AS depth, (h >> ({BITS} - depth)::INTEGER)::BIGINT AS prefix,
       CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(h >> ({BITS} - depth)::INTEGER), depth::INTEGER) END AS shard
FROM leaf"""
