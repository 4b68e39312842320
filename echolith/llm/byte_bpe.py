"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, and all chunks are pre-tokenised in parallel from wherever they begin. Two neighbours see the same
characters in their overlap; at the first place where both have a pre-token boundary they have resynchronised, and from there on the
later chunk's pre-tokens are those of the whole text. The text is cut at these places and the pieces are encoded in parallel. Where an overlap holds no common
boundary (one run of letters, say), the chunks are joined again and encoded as one piece, so the result is always that of the whole text.
Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

CHUNK = 32_768
OVERLAP = 1_024
#: A match that ends this near to a chunk's end may end elsewhere in the whole text (contractions look two characters ahead, white space one).
MARGIN = 4
ROWS = 256


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


@lru_cache(maxsize=4)
def load_tokens(path: str) -> list[bytes]:
    by_rank = {rank: token for token, rank in load_ranks(path).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    """The ids of a piece: its pre-tokens' pairs of lowest rank merged until none is left."""
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), np.int32)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _ids(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


def _encoded(batches: Iterator[pa.RecordBatch], keys: list[str], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """keys and ids of batches of keys and text."""
    encode = _encoder(path, pattern)
    for batch in batches:
        for part in _slices(batch):
            ids = [encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], _ids(ids)], names=[*keys, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and bytes of batches of doc_id and ids."""
    tokens = load_tokens(path)
    for batch in batches:
        for part in _slices(batch):
            raw = [b"".join(map(tokens.__getitem__, x or ())) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", "bytes"])


def _encode_text(rows: DataFrame, keys: list[str], path: str, pattern: str) -> DataFrame:
    """keys and ids of rows of keys and text."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text").mapInArrow(lambda batches: _encoded(batches, keys, path, pattern), f"{types}, ids array<int>")


def _chunked(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, k, part: the chunks of each text."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for at in range(0, len(text), chunk * 64):
                    starts = range(at, min(len(text), at + chunk * 64), chunk)
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(starts), "k": [s // chunk for s in starts], "part": [text[s : s + chunk + overlap] for s in starts]})

    return rows.select("key", "text").mapInArrow(run, "key string, k long, part string")


def _boundaries(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, k, part, head, tail: pre-token boundaries in the overlap that the chunk begins with and in that which it ends with, as places in the text.

    Only ends of pre-tokens that don't end in white space count: white space is split by what follows it, which a piece cut there would not see.
    """

    def run(batches):
        find = regex.compile(pattern).finditer
        for batch in batches:
            for part in _slices(batch):
                heads, tails = [], []
                for k, text in zip(part.column("k").to_pylist(), part.column("part").to_pylist(), strict=True):
                    at = np.fromiter((e for m in find(text) if not text[(e := m.end()) - 1].isspace()), np.int64)
                    sure = at[at <= len(text) - MARGIN]
                    heads.append(sure[sure < overlap] + k * chunk)
                    tails.append(sure[sure >= chunk] + k * chunk)
                lists = [pa.array([x.tolist() for x in xs], pa.list_(pa.int64())) for xs in (heads, tails)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", "k", "part")], *lists], names=["key", "k", "part", "head", "tail"])

    return chunks.mapInArrow(run, "key string, k long, part string, head array<long>, tail array<long>")


def pieces(rows: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, piece, text: the texts of rows (key, text), cut at pre-token boundaries; in order of piece they make up the text."""
    found = _boundaries(_chunked(rows, chunk, overlap).repartition("key", "k"), pattern, chunk, overlap)
    tails = found.select("key", (F.col("k") + 1).alias("k"), "tail")
    cut = F.array_min(F.array_intersect("head", "tail"))
    heads = found.select("key", "k", "part", "head").join(tails, ["key", "k"], "left").withColumn("cut", F.when(F.col("k") == 0, 0).otherwise(cut))
    order = Window.partitionBy("key").orderBy("k")
    start, base = F.coalesce("cut", F.col("k") * chunk), F.col("k") * chunk
    heads = heads.select("key", "k", "part", start.alias("start"), F.lead(start).over(order).alias("end"), F.last(F.when(F.col("cut").isNotNull(), F.col("k")), True).over(order).alias("piece"))
    length = F.coalesce(F.col("end"), F.lit(1 << 40)) - F.col("start")
    segment = F.substring("part", (F.col("start") - base + 1).cast("int"), F.least(length, F.lit(1 << 30)).cast("int"))
    joined = heads.select("key", "piece", "k", segment.alias("segment")).groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("k", "segment"))).alias("s"))
    return joined.select("key", "piece", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs (doc_id, text): the ids of the text's pre-tokens one after another, without special tokens.

    path is a file of ranks (base64 token and rank per line) that every worker can read; pattern is the pre-tokeniser's expression. Null and
    empty texts have no ids. Texts up to a chunk are encoded where they lie; longer ones as pieces. Repeated rows each get
    their ids; other columns are ignored; an empty table gives an empty result.
    """
    short, long = _divided(docs, chunk)
    return _encode_text(short, ["doc_id"], path, pattern).unionByName(_encode_long(long, path, pattern, chunk, overlap))


def _divided(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and text (empty for null) of the rows of up to a chunk, and of the longer ones."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk
    return rows.filter(~long), rows.filter(long)


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id and ids of rows of doc_id and text, encoded as pieces."""
    named = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary"))))
    named = named.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").cast("int").alias("n"))
    parts = _encode_text(pieces(named, pattern, chunk, overlap).repartition("key", "piece"), ["key", "piece"], path, pattern)
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    whole = whole.select("key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    again = named.select("key", "doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("i")).join(whole, "key")
    return again.select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and bytes of every row of encoded (doc_id, ids): the tokens' bytes one after another. Null ids are none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """What decode(encode(docs)) has, with texts up to a chunk encoded and decoded by one Python worker.

    Chained in one task the two take a worker each, and Spark keeps idle workers in turn: every later job of the session would hold four to two cores.
    """
    short, long = _divided(docs, chunk)
    kind = short.schema["doc_id"].dataType.simpleString()
    both = short.mapInArrow(lambda batches: _decoded(_encoded(batches, ["doc_id"], path, pattern), path), f"doc_id {kind}, ids array<int>, bytes binary")
    return both.unionByName(decode(_encode_long(long, path, pattern, chunk, overlap), path))


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with commas between) and decoded_sha256 of rows of doc_id, ids and bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark, sf_dir):
    """Every document's ids and decoded bytes, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))
