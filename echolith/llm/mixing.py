"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document of a source whose target is x times the source's size is wanted x times.
The whole part of x is taken outright. The fractional parts are rounded dependently: two documents at a time, one passes
words of its expected share to the other until one of them is taken whole or not at all, in the direction that a
coin, weighted so that each keeps its expectation, decides. Expected words per source are kept at every step, so only the last
document of a source is rounded alone. Documents meet in small hashed groups; what is left of each group meets again in a tree
whose levels shrink by the fan-in, so no group grows with the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, saved, table, times, word_count


#: Up to so many sources their targets (some 60 bytes each) are broadcast; more are joined by source.
BROADCAST_SOURCES = 50_000


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, n, source_size, target (double) for rows of source and size.

    Sources by code point (null last) take the weights in turn and divide share times all words; a target stops at cap times its source's
    size, and what it leaves goes to the others by weight until none is above. A source without words gets 0.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    # Water filling: in the order of the level at which a source is full, a source is capped if the level that the rest
    # could have reaches its own.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(by_level))
    open_level = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(every)["level"]
    target = F.least(F.col("most"), F.coalesce(open_level * F.col("weight"), F.col("most")))
    return per.select("source", "n", "source_size", target.alias("target"))


def _coin(salt: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return (F.xxhash64(F.lit(salt), *cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


_ITEM = "struct<key:struct<doc_id:bigint,text_hash:bigint,copy:int>,size:double,part:double>"
_STATE = f"struct<left:{_ITEM},done:array<struct<key:struct<doc_id:bigint,text_hash:bigint,copy:int>,size:double,one:int>>>"


def _pair(state: Column, item: Column, salt: str) -> Column:
    """Let the item meet the one that is left: words pass from one to the other until one of them is decided."""
    a, b = state["left"], item
    up, down = F.least(a["size"] - a["part"], b["part"]), F.least(a["part"], b["size"] - b["part"])
    raise_a = _coin(salt, a["key"], b["key"]) * (up + down) < down
    out = lambda x, one: F.array(F.struct(x["key"].alias("key"), x["size"].alias("size"), F.lit(one).cast("int").alias("one")))
    keep = lambda x, part: F.struct(x["key"].alias("key"), x["size"].alias("size"), part.alias("part"))
    none = F.lit(None).cast(_ITEM)

    def decided(winner: Column, loser: Column, room: Column) -> Column:
        """winner gains what it has room for from loser: then it is full, or loser is empty, or both."""
        left = F.when(room == loser["part"], none).when(room < loser["part"], keep(loser, loser["part"] - room)).otherwise(keep(winner, winner["part"] + loser["part"]))
        done = F.when(room == loser["part"], F.concat(out(winner, 1), out(loser, 0))).when(room < loser["part"], out(winner, 1)).otherwise(out(loser, 0))
        return F.struct(left.alias("left"), F.concat(state["done"], done).alias("done"))

    met = F.when(raise_a, decided(a, b, a["size"] - a["part"])).otherwise(decided(b, a, b["size"] - b["part"]))
    return F.when(a.isNull(), F.struct(keep(b, b["part"]).alias("left"), state["done"].alias("done"))).otherwise(met).cast(_STATE)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, fan_in: int = 32, seed: str = "mix") -> DataFrame:
    """doc_id, text_hash, row (its number among rows equal in these and the source), source, size, source_size, target, copies and taken (copies times size, in words) of every row of docs.

    docs needs doc_id, text and source; other columns are ignored, whatever their names. A null text has size 0, a null source is a
    source of its own (the last). Documents without words are never copied. Repeated rows are decided one by one. An empty table gives
    an empty result. Decisions depend on doc_id, text and seed only, so reruns agree. fan_in is how many documents meet in a group.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = saved(sized.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows")))
    sized = times(sized, "rows", "copy")
    per = saved(source_targets(sized, weights, share, cap))
    most, sources = per.agg(F.max("n"), F.count("*")).first()
    named = per.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # null joins too
    fixed = ["s", "source", "source_size", "target", "whole"]
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source").join(F.broadcast(named) if sources <= BROADCAST_SOURCES else named, "s")
        .withColumn("whole", F.floor(wanted).cast("int"))
        .withColumn("part", (wanted - F.floor(wanted)) * F.col("size"))
        .withColumn("key", F.struct("doc_id", "text_hash", "copy"))
    )
    plain = F.col("part") == 0
    done = [rows.filter(plain).select(*fixed, "key", F.col("size").cast("double").alias("size"), F.lit(0).alias("one"))]
    groups = F.ceil(F.col("n") / fan_in)
    level = rows.filter(~plain).select(
        *fixed, F.pmod(F.xxhash64(F.lit(seed), "key"), groups).alias("bucket"),
        F.struct("key", F.col("size").cast("double").alias("size"), "part").cast(_ITEM).alias("item"),
    )
    depth = max(1, math.ceil(math.log(max(2, math.ceil((most or 0) / fan_in)), fan_in)) + 1)
    for k in range(depth):
        start = F.struct(F.lit(None).cast(_ITEM).alias("left"), F.array().cast("array<struct<key:struct<doc_id:bigint,text_hash:bigint,copy:int>,size:double,one:int>>").alias("done")).cast(_STATE)
        met = level.groupBy(*fixed, "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
        salt = f"{seed}{k}"
        met = saved(met.select(*fixed, "bucket", F.aggregate("items", start, lambda s, x: _pair(s, x, salt)).alias("r")))  # noqa: B023
        done.append(met.select(*fixed, F.explode("r.done").alias("d")).select(*fixed, "d.key", "d.size", "d.one"))
        level = met.filter("r.left is not null").select(*fixed, F.floor(F.col("bucket") / fan_in).alias("bucket"), F.col("r.left").alias("item"))
    # One document per source is left at most; it is rounded to the nearer side, which brings the source nearest to its target.
    last = F.when(F.col("item.part") * 2 >= F.col("item.size"), 1).otherwise(0)
    done.append(level.select(*fixed, "item.key", "item.size", last.alias("one")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("one")).otherwise(0)
    return out.select(
        "key.doc_id", "key.text_hash", F.col("key.copy").alias("row"), "source", F.col("size").cast("long").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as mix() takes them; columns and their order are kept, whatever their names. Rows equal in id, text and source are numbered, and each gets what its number is given."""
    taken = mix(docs, **how).filter("copies > 0").select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), F.col("row").alias("t_row"), F.col("source").alias("t_source"), F.col("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"), docs["source"].alias("of"))
    # Only rows that are equal need numbers; there are few of them, or they are many of a kind.
    equal = saved(rows.groupBy("id", "hash", "of").count().filter("count > 1").select(F.col("id").alias("e_id"), F.col("hash").alias("e_hash"), F.col("of").alias("e_of")))
    if equal.isEmpty():
        rows = rows.withColumn("number", F.lit(1))
    else:
        same = F.col("id").eqNullSafe(F.col("e_id")) & (F.col("hash") == F.col("e_hash")) & F.col("of").eqNullSafe(F.col("e_of"))
        rows = rows.join(equal, same, "left_anti").withColumn("number", F.lit(1)).unionByName(numbered(rows.join(equal, same, "left_semi"), ["id", "hash", "of"], "number"))
    joined = rows.join(taken, (F.col("hash") == F.col("t_hash")) & (F.col("number") == F.col("t_row")) & F.col("id").eqNullSafe(F.col("t_id")) & F.col("of").eqNullSafe(F.col("t_source")))
    again = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("again"))
    return again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir):
    """Every document of the table with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
