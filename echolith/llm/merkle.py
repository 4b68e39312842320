"""Merkle manifest of a table: a hash tree over the rows of each group, and one over the groups.

Rows are hashed where they lie; from there on only digests move. A tree is built level by level: every node is joined with its siblings by their computed indices (XOR of the last bit for runs of two, slot offsets for
longer ones), keeps what stands before and after it in its run, and the node in slot zero emits the parent. A node's proof is then a path of such pairs. Paths are put together in blocks of a few levels,
from the top down, so no node carries its ancestors' siblings through a shuffle more than once a block.

Groups are encoded as text (`=` and the value, the empty text for null), so the null group comes first and the others in bytewise order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Nodes of a block's lowest level, at most.
BLOCK_NODES = 256


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (already computed; with a column g) with i, the place among those of their g by the order (0 on), and n, their number. Equal rows stand in any order.

    Rows are sorted by ranges over all groups, so a large group is spread; places are counted within each range and moved by the counts of the ranges before.
    """
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    by = ["g", *order, "__row"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row")
    rows = saved(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = rows.groupBy("g", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    parts = parts.select("g", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__move"), F.sum("__n").over(whole).alias("n"))
    return rows.join(parts, ["g", "__part"]).withColumn("i", F.col("__at") + F.col("__move")).drop("__part", "__at", "__move")


@dataclass
class Tree:
    """levels: g, i, n, digest, before, after of each level's nodes (the lowest with what else its rows held) where a group has several; roots: g, digest."""

    levels: list[DataFrame]
    roots: DataFrame
    fan_out: int


def with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """nodes with before and after: the digests of the others of their run on either side, joined in order."""
    slot = F.col("i") % fan_out
    out, others = nodes, nodes.select(F.col("g").alias("__g"), F.col("i").alias("__i"), F.col("digest").alias("__d"))
    for o in range(1, fan_out):
        index = F.col("i").bitwiseXOR(F.lit(1).cast("long")) if fan_out == 2 else F.col("i") - slot + (slot + o) % fan_out
        out = out.withColumn("__index", index).join(others, (F.col("g") == F.col("__g")) & (F.col("__index") == F.col("__i")), "left").drop("__g", "__i", "__index").withColumnRenamed("__d", f"__{o}")
    pick = lambda ahead: F.concat(*[F.coalesce(F.when((slot + o >= fan_out) == F.lit(ahead), F.col(f"__{o}")), F.lit("")) for o in range(1, fan_out)])
    return out.select(*nodes.columns, pick(True).alias("before"), pick(False).alias("after"))


def tree(leaves: DataFrame, fan_out: int = 2) -> Tree:
    """The tree of each group of leaves (g, i, n, digest; already computed). A node alone at its level is the group's root; the last run of a level may be short, even one node long, and is hashed all the same."""
    if fan_out < 2:
        raise ValueError("fan_out must be at least 2")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, roots = [], leaves, leaves.filter("n = 1").select("g", "digest")
    while most > 1:
        level = saved(with_siblings(nodes.filter("n > 1"), fan_out))
        levels.append(level)
        up = F.floor(F.col("i") / fan_out).cast("long")
        nodes = level.filter(F.col("i") % fan_out == 0).select("g", up.alias("i"), F.ceil(F.col("n") / fan_out).cast("long").alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest"))
        roots = roots.unionByName(nodes.filter("n = 1").select("g", "digest"))
        most = -(-most // fan_out)
    return Tree(levels, saved(roots), fan_out)


def paths(of: Tree) -> DataFrame | None:
    """The columns of the lowest level, but before and after, with path: an array of (before, after), from the node's own run up to the root's. None if no group has several leaves."""
    height = 1
    while of.fan_out ** (height + 1) <= BLOCK_NODES:
        height += 1
    above = None
    for low in reversed(range(0, len(of.levels), height)):
        levels = of.levels[low : low + height]
        rest = [c for c in levels[0].columns if c not in ("g", "i", "n", "before", "after")]
        width = [of.fan_out ** (height - k) for k in range(height)]
        inner = None
        for k, level in enumerate(levels):
            own = F.struct(*rest).alias("own") if k == 0 else F.lit(None).cast(levels[0].select(F.struct(*rest).alias("x")).schema["x"].dataType).alias("own")
            part = level.select("g", F.floor(F.col("i") / width[k]).cast("long").alias("block"), F.lit(k).alias("k"), F.struct("i", "n", "before", "after", own).alias("node"))
            inner = part if inner is None else inner.unionByName(part)
        blocks = inner.groupBy("g", "block").agg(*[F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("node")))).alias(f"l{k}") for k in range(len(levels))])
        if above is not None:
            blocks = blocks.join(above.select("g", F.col("i").alias("block"), F.col("path").alias("up")), ["g", "block"], "left")
        else:
            blocks = blocks.withColumn("up", F.lit(None).cast("array<struct<before:string,after:string>>"))
        each = blocks.select("*", F.explode("l0").alias("node"))
        steps = []
        for k in range(len(levels)):
            at = (F.floor(F.col("node.i") / of.fan_out**k) - F.col("block") * width[k]).cast("int")
            node = F.get(F.col(f"l{k}"), at)
            steps.append(F.when(node.isNotNull(), F.struct(node["before"].alias("before"), node["after"].alias("after"))))
        path = F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()), F.coalesce("up", F.array().cast("array<struct<before:string,after:string>>")))
        above = each.select("g", "node.i", "node.n", *[F.col(f"node.own.{c}").alias(c) for c in rest], path.alias("path"))
        if low:
            above = saved(above)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all digests of a path, from left to right and level by level."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


def manifest(rows: DataFrame, order: list[str], fan_out: int = 2) -> DataFrame:
    """All columns of rows, then subroot, root and path (array of (before, after), from the leaf to the root) of each.

    rows: g (group, never null), leaf (digest) and others, without names of two leading underscores. Within a group they stand by order, then by leaf; equal ones are leaves each. An empty table gives
    an empty result.
    """
    rows = saved(rows)
    leaves = saved(placed(rows, [*order, "leaf"]).withColumn("digest", F.col("leaf")))
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    groups = tree(leaves, fan_out)
    # The roots of groups are the leaves of one tree more.
    tops = saved(placed(saved(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")), ["of"]))
    top = tree(tops, fan_out)
    root = top.roots.first()
    ends = paths(top)
    ends = ends.select("of", "digest", "path") if ends is not None else tops.select("of", "digest", no_path.alias("path"))
    ends = saved(ends.select(F.col("of").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("__top")))
    keep = rows.columns
    own = leaves.filter("n = 1").select(*keep, no_path.alias("__own"))
    inner = paths(groups)
    if inner is not None:
        own = own.unionByName(inner.select(*keep, F.col("path").alias("__own")))
    return own.join(ends, "g").select(*rows.columns, "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.concat("__own", "__top").alias("path"))


def op12_merkle(spark, sf_dir):
    """Leaf, group root, root and proof of every document, and whether the row as it is now (every document whose crc32 seven divides has been tampered with) still verifies.

    Nulls in any column are hashed as `-`; null ids come first and are never tampered with; equal rows, or equal ids, are leaves each, in the order of their digests. Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hashed = lambda n_chars: row_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = docs.select(group.alias("g"), "doc_id", hashed(F.col("n_chars")).alias("leaf"), hashed(F.col("n_chars") + hit.cast("long")).alias("now"))
    proven = manifest(leaves, ["doc_id"])
    again = folded(F.col("now"), F.col("path"))
    out = proven.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text"))
_TREE = """{t} AS (SELECT {g}, 0 AS level, i, n, digest FROM {leaves}
 UNION ALL SELECT {g}, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY {g}, level, n, i // 2)"""
ORACLE_SQL = f"""WITH RECURSIVE
c AS (SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k::BIGINT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, b: xor(xor(s, b) >> 1, CASE WHEN xor(s, b) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS inverse FROM documents),
e AS (SELECT doc_id, lang, sha256({_LEAF.format(n='n_chars')}) AS digest, sha256({_LEAF.format(n='(n_chars + CASE WHEN (4294967295 - inverse) % 7 = 0 THEN 1 ELSE 0 END)')}) AS now FROM c),
l AS (SELECT coalesce('=' || lang, '') AS g, doc_id, digest, now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM e),
{_TREE.format(t='x', g='g', leaves='l')},
s AS (SELECT 0 AS h, g AS of, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM x WHERE n = 1),
{_TREE.format(t='y', g='h', leaves='s')},
u AS (SELECT l.g, l.i, x.level, CASE WHEN (l.i >> x.level) % 2 = 1 THEN z.digest ELSE '' END AS before, CASE WHEN (l.i >> x.level) % 2 = 0 THEN coalesce(z.digest, '') ELSE '' END AS after
  FROM l JOIN x ON x.g = l.g AND x.i = l.i >> x.level AND x.n > 1 LEFT JOIN x AS z ON z.g = x.g AND z.level = x.level AND z.i = xor(x.i, 1)
  UNION ALL SELECT l.g, l.i, 1000 + y.level, CASE WHEN (s.i >> y.level) % 2 = 1 THEN z.digest ELSE '' END, CASE WHEN (s.i >> y.level) % 2 = 0 THEN coalesce(z.digest, '') ELSE '' END
  FROM l JOIN s ON s.of = l.g JOIN y ON y.i = s.i >> y.level AND y.n > 1 LEFT JOIN y AS z ON z.level = y.level AND z.i = xor(y.i, 1)),
p AS (SELECT g, i, list(before || '|' || after ORDER BY level) AS path FROM u GROUP BY g, i)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(array_to_string(list_transform(p.path, lambda q: replace(q, '|', '')), ''), '')) AS proof_sha256,
 list_reduce(list_concat([l.now], coalesce(p.path, [])), lambda d, q: sha256(split_part(q, '|', 1) || d || split_part(q, '|', 2))) AS folded_root, folded_root = r.digest AS verified
FROM l JOIN s ON s.of = l.g CROSS JOIN (SELECT digest FROM y WHERE n = 1) AS r LEFT JOIN p ON p.g = l.g AND p.i = l.i"""
