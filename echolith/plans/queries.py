"""Queries over the given tables that apply the operators, and SQL that computes the same from scratch.

Hash sequences are derived from keys: the parts of an order in line order, or the events of a user, each key times 2654435761 modulo 2**32.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith import constants, sql
from echolith.functions import codec, containers, dsp, grid, hashing, scoring, statistics
from echolith.operators import segments
from echolith.operators import signatures as ops
from echolith.operators.bit_index import CheckpointIndex
from echolith.operators.chunks import chunk_blocks
from echolith.operators.matcher import Matcher
from echolith.operators.store import CheckpointStore
from echolith.sources import files
from echolith.sources.shared import kept, shared_folder
from echolith.sources.wave import encode_wave
from echolith.sources.wave_files import read_chunks
from echolith.streaming import signal

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash(key) -> object:
    return F.pmod(key * F.lit(2654435761), F.lit(1 << 32))


def _order_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", _hash(F.col("l_partkey")).alias("h"))))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("x")).select("l_orderkey", F.transform("x", lambda x: x["h"]).alias("hashes"))


_ORDERS = "o AS (SELECT l_orderkey, list((l_partkey * 2654435761) % 4294967296 ORDER BY l_linenumber, (l_partkey * 2654435761) % 4294967296) AS hashes FROM lineitem GROUP BY l_orderkey)"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's sequence with that of the next order key; l_hashes is the earlier one's followed by its own first part again."""
    o = _order_hashes(spark, sf_dir)
    return o.select("l_orderkey", F.col("hashes").alias("a")).join(o.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.concat(F.slice("hashes", 1, 1), "hashes").alias("b")), "l_orderkey")


_PAIRS = f"{_ORDERS}, p AS (SELECT x.l_orderkey, x.hashes AS a, list_concat(y.hashes[1:1], y.hashes) AS b FROM o AS x JOIN o AS y ON y.l_orderkey = x.l_orderkey + 1)"
_DRIFTED = """e AS (SELECT l_orderkey, d, a[1 + greatest(d, 0):] AS x, b[1 + greatest(-d, 0):] AS y FROM p, (SELECT unnest(range(-3, 4)) AS d) WHERE abs(d) <= least(len(a), len(b))),
c AS (SELECT l_orderkey, d, least(len(x), len(y)) AS n, coalesce(list_sum(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: 32 - bit_count(xor(x[i], y[i])))), 0)::BIGINT AS bits FROM e),
s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE bits / (n * 32)::DOUBLE END::FLOAT AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END) AS k FROM s)"""


@query("similarity_pairs", f"""WITH {_PAIRS}
SELECT l_orderkey, (list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: 32 - bit_count(xor(a[i], b[i])))) / (least(len(a), len(b)) * 32)::DOUBLE)::FLOAT AS score FROM p""")
def similarity_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("l_orderkey", scoring.similarity(F.col("a"), F.col("b")).alias("score"))


@query("drift_similarity", f"""WITH {_PAIRS}, {_DRIFTED}
SELECT l_orderkey, score, d::INTEGER AS best_offset, n::BIGINT AS compared_hashes, bits AS matching_bits FROM r WHERE k = 1""")
def drift_similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("l_orderkey", F.inline(F.array(scoring.drift_comparison(F.col("a"), F.col("b"), 3))))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    return e.select(F.col("user_id").alias("ckpt_seq"), (F.col("user_id") % 7).cast("float").alias("timestamp"), F.size("e").cast("float").alias("duration"), F.transform("e", lambda x: _hash(x)).alias("hashes"))


_CHECKPOINTS = "c AS (SELECT user_id AS ckpt_seq, (user_id % 7)::FLOAT AS timestamp, list((event_id * 2654435761) % 4294967296 ORDER BY event_id) AS hashes FROM events GROUP BY user_id)"


_TOP = f"""WITH {_CHECKPOINTS},
e AS (SELECT q.ckpt_seq AS query_id, c.ckpt_seq, c.timestamp, d, q.hashes[1 + greatest(d, 0):] AS x, c.hashes[1 + greatest(-d, 0):] AS y FROM c AS q, c, (SELECT unnest(range(-2, 3)) AS d) WHERE q.ckpt_seq % 20 = 0 AND abs(d) <= least(len(q.hashes), len(c.hashes))),
s AS (SELECT query_id, ckpt_seq, timestamp, d, CASE WHEN least(len(x), len(y)) = 0 THEN 0 ELSE list_sum(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: 32 - bit_count(xor(x[i], y[i])))) / (least(len(x), len(y)) * 32)::DOUBLE END::FLOAT AS score FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, ckpt_seq ORDER BY score DESC, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END) AS k FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp, ckpt_seq) AS rank FROM b WHERE k = 1)
SELECT query_id, rank::INTEGER AS rank, timestamp, score, d::INTEGER AS best_offset FROM r WHERE rank <= 10"""


@query("checkpoint_topk", _TOP)
def checkpoint_topk(spark, sf_dir):
    """The ten checkpoints that agree best with every twentieth user's, over drifts of up to two."""
    c = _checkpoints(spark, sf_dir)
    return Matcher(c).with_drift(2).top(c.filter("ckpt_seq % 20 = 0").select(F.col("ckpt_seq").alias("query_id"), "hashes"), 10)


@query("sql_top_matches", _TOP)
def sql_top_matches(spark, sf_dir):
    """checkpoint_topk by the table function: every query in each of 32 packs of checkpoints, and the packs' lists ranked together."""
    sql.register(spark)
    _checkpoints(spark, sf_dir).createOrReplaceTempView("echolith_checkpoints")
    return spark.sql("""
        WITH rows AS (
            SELECT pmod(xxhash64(ckpt_seq), 32) AS pack, CAST(NULL AS BIGINT) AS query_id, ckpt_seq, timestamp, hashes FROM echolith_checkpoints
            UNION ALL SELECT explode(sequence(0, 31)), ckpt_seq, NULL, NULL, hashes FROM echolith_checkpoints WHERE ckpt_seq % 20 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, order_key, ckpt_seq) AS rank
            FROM sig_top_matches(TABLE(SELECT * FROM rows), 10, 2))
        SELECT query_id, rank, timestamp, score, best_offset FROM ranked WHERE rank <= 10""")


@query("index_topk", f"""WITH {_CHECKPOINTS},
f AS (SELECT ckpt_seq AS query_id, list_transform(hashes, lambda h: xor(h, CASE WHEN ckpt_seq % 60 = 0 THEN 252645135 ELSE 1 END)) AS hashes FROM c WHERE ckpt_seq % 20 = 0),
e AS (SELECT q.query_id, c.ckpt_seq, c.timestamp, d, q.hashes[1 + greatest(d, 0):] AS x, c.hashes[1 + greatest(-d, 0):] AS y FROM f AS q, c, (SELECT unnest(range(-1, 2)) AS d) WHERE abs(d) <= least(len(q.hashes), len(c.hashes))),
s AS (SELECT query_id, ckpt_seq, timestamp, d, CASE WHEN least(len(x), len(y)) = 0 THEN 0 ELSE list_sum(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: 32 - bit_count(xor(x[i], y[i])))) / (least(len(x), len(y)) * 32)::DOUBLE END::FLOAT AS score FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, ckpt_seq ORDER BY score DESC, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END) AS k FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp, ckpt_seq) AS rank FROM b WHERE k = 1)
SELECT query_id, rank::INTEGER AS rank, timestamp, score, d::INTEGER AS best_offset FROM r WHERE rank <= 1""")
def index_topk(spark, sf_dir):
    """The best checkpoint of every twentieth user's sequence with a bit of each hash changed, or half of them, by the index: the first are proven by it, the others compared with all."""
    c = _checkpoints(spark, sf_dir)
    index = CheckpointIndex.build(c, f"{shared_folder(spark)}/index-{uuid.uuid4()}")
    change = F.when(F.col("ckpt_seq") % 60 == 0, F.lit(252645135)).otherwise(F.lit(1)).cast("long")
    changed = c.filter("ckpt_seq % 20 = 0").select(F.col("ckpt_seq").alias("query_id"), F.transform("hashes", lambda h: h.bitwiseXOR(change)).alias("hashes"))
    return index.top(changed, 1, max_drift=1)


@query("matcher_add_count", """SELECT 'added' AS step, 2 * count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'cleared', 0""")
def matcher_add_count(spark, sf_dir):
    c = _checkpoints(spark, sf_dir)
    m = Matcher(c).add(c.withColumn("ckpt_seq", F.col("ckpt_seq") + (1 << 40)))
    return m.count().select(F.lit("added").alias("step"), "n").union(m.clear().count().select(F.lit("cleared"), "n"))


@query("checkpoint_store", """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT count(*) AS m FROM u)
SELECT 2 * m + k AS ckpt_seq, user_id, n, 2 * m AS n_before, 2 * m AS n_after FROM u, c UNION ALL SELECT 3 * m + (m - 1 - k), user_id, n, 2 * m, 2 * m FROM u, c""")
def checkpoint_store(spark, sf_dir):
    """Every user's checkpoint added twice, cleared, and added twice again, upwards and downwards: the numbers that the store gives, and how many there were before and after."""
    rows = _checkpoints(spark, sf_dir).select(F.col("ckpt_seq").alias("user_id"), F.col("ckpt_seq").cast("float").alias("timestamp"), "duration", "hashes")
    store = CheckpointStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4()}")
    before = store.add(rows).add(rows, ["user_id"]).count()
    store.clear().add(rows, ["user_id"]).add(rows.withColumn("down", -F.col("user_id")), ["down"])
    found = store.checkpoints().select("ckpt_seq", F.col("timestamp").cast("long").alias("user_id"), F.size("hashes").cast("long").alias("n"))
    return found.withColumns({"n_before": F.lit(before).cast("long"), "n_after": F.lit(store.count()).cast("long")})


@query("long_comparison", """WITH s AS MATERIALIZED (SELECT l_returnflag AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, (l_partkey * 2654435761) % 4294967296 AS h FROM lineitem),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT x.id || ' ' || y.id AS pair_id, x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, d FROM n AS x JOIN n AS y ON x.id <= y.id, (SELECT unnest(range(-20, 21)) AS d)),
x AS MATERIALIZED (SELECT pair_id, d, n_a, n_b, b, pos - d AS pos, h FROM p JOIN s ON s.id = p.a),
c AS (SELECT pair_id, d, least(n_a - greatest(d, 0), n_b - greatest(-d, 0)) AS n, sum(32 - bit_count(xor(x.h, y.h)))::BIGINT AS bits FROM x JOIN s AS y ON y.id = x.b AND y.pos = x.pos GROUP BY ALL),
r AS (SELECT *, (bits / (n * 32)::DOUBLE)::FLOAT AS score FROM c)
SELECT pair_id, score, d::INTEGER AS best_offset, n AS compared_hashes, bits AS matching_bits FROM r
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END) = 1""")
def long_comparison(spark, sf_dir):
    """The parts of all lines of each return flag as one sequence, and every two of them (and each with itself) compared over drifts of up to twenty."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("id"), "l_orderkey", "l_linenumber", "l_partkey", _hash(F.col("l_partkey")).alias("hash"))
    found = kept(segments.segments_of(rows, ["l_orderkey", "l_linenumber", "l_partkey"]))
    flags = found.select("id").distinct()
    pairs = flags.select(F.col("id").alias("a")).join(flags.select(F.col("id").alias("b")), F.col("a") <= F.col("b"))
    return segments.compare(pairs.select(F.concat_ws(" ", "a", "b").alias("pair_id"), "a", "b"), found, 20)


_LE = "array_to_string(list_transform([{x}, {x} // 256, {x} // 65536, {x} // 16777216], lambda b: printf('%02X', (b % 256)::INTEGER)), '')"


@query("sql_similarity", f"""WITH {_PAIRS}, {_DRIFTED}
SELECT l_orderkey, score AS drifted, (SELECT score FROM s AS x WHERE x.l_orderkey = r.l_orderkey AND x.d = 0) AS plain FROM r WHERE k = 1""")
def sql_similarity(spark, sf_dir):
    """The names registered for SQL, over the neighbouring orders, their sequences packed and read back."""
    sql.register(spark)
    packed = "sig_from_bytes(sig_to_bytes({0}, 0)).hashes"
    a, b = packed.format("a"), packed.format("b")
    return _neighbours(spark, sf_dir).selectExpr("l_orderkey", f"sig_similarity_drift({a}, {b}, 3) AS drifted", f"sig_similarity({a}, {b}) AS plain")


@query("serialize", f"""WITH {_ORDERS}, h AS (SELECT l_orderkey, l_orderkey * 1000 % 4294967296 AS ms, hashes FROM o)
SELECT l_orderkey, {_LE.format(x='ms')} || {_LE.format(x='len(hashes)')} || array_to_string(list_transform(hashes, lambda h: {_LE.format(x='h')}), '') AS payload FROM h""")
def serialize(spark, sf_dir):
    ms = F.pmod(F.col("l_orderkey") * 1000, F.lit(1 << 32))
    return _order_hashes(spark, sf_dir).select("l_orderkey", F.hex(codec.to_bytes(F.col("hashes"), ms)).alias("payload"))


@query("deserialize", f"""WITH {_ORDERS}
SELECT l_orderkey, CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey * 1000 % 4294967296 END AS duration_ms, CASE WHEN l_orderkey % 3 <> 0 THEN array_to_string(hashes, ',') END AS hashes FROM o""")
def deserialize(spark, sf_dir):
    """Payloads read back; of every third order the last byte is missing, of another third bytes follow."""
    whole = codec.to_bytes(F.col("hashes"), F.pmod(F.col("l_orderkey") * 1000, F.lit(1 << 32)))
    k = F.col("l_orderkey") % 3
    payload = F.when(k == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).when(k == 1, F.concat(whole, F.unhex(F.lit("090909")))).otherwise(whole)
    read = _order_hashes(spark, sf_dir).select("l_orderkey", codec.from_bytes(payload).alias("r"))
    return read.select("l_orderkey", "r.duration_ms", F.when(F.col("r").isNotNull(), F.array_join("r.hashes", ",")).alias("hashes"))


@query("window_grid", """WITH p AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n, 400 + o_orderkey % 1500 AS w, 200 + o_orderkey % 900 AS i FROM orders),
g AS (SELECT *, w * 11025 // 1000 AS ws, i * 11025 // 1000 AS ws_step FROM p),
k AS (SELECT *, unnest(range(0, CASE WHEN n < ws THEN 0 ELSE (n - ws) // ws_step + 1 END)) AS window_idx FROM g WHERE ws >= 4096)
SELECT o_orderkey, window_idx, window_idx * ws_step AS start, (window_idx * ws_step * 1000 + 5512) // 11025 AS timestamp_ms, w::BIGINT AS duration_ms,
       (window_idx * ws_step + 1023) // 1024 AS first_frame, (window_idx * ws_step + ws - 4096) // 1024 AS last_frame FROM k""")
def window_grid(spark, sf_dir):
    key = F.col("o_orderkey")
    cells = grid.windows(F.floor("o_totalprice").cast("long"), 400 + key % 1500, 200 + key % 900)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.inline(cells))


@query("unit_arithmetic", """SELECT o_orderkey, o_orderkey * 11025 // 1000 AS samples, least((o_orderkey * o_custkey * 1000 + 5512) // 11025, 4294967295) AS ms,
CASE WHEN o_orderkey * 10 < 4096 THEN 0 ELSE (o_orderkey * 10 - 4096) // 1024 + 1 END AS frames FROM orders""")
def unit_arithmetic(spark, sf_dir):
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", grid.samples_for_ms(key).alias("samples"), grid.ms_for_samples(key * F.col("o_custkey")).alias("ms"), grid.frame_count(key * 10).alias("frames"))


@query("resample_length", """SELECT p_partkey, rate::BIGINT AS rate, floor(p_partkey * 1000 / (rate / 11025.0::DOUBLE))::BIGINT AS frames FROM part, (SELECT unnest([8000, 11025, 22050, 44100, 48000, 384000]) AS rate)""")
def resample_length(spark, sf_dir):
    rates = F.explode(F.array(*[F.lit(r).cast("long") for r in (8000, 11025, 22050, 44100, 48000, 384000)]))
    return _table(spark, sf_dir, "part").select("p_partkey", rates.alias("rate")).select("p_partkey", "rate", grid.resampled_length(F.col("p_partkey") * 1000, F.col("rate")).alias("frames"))


@query("shape_errors", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 1000 END AS rate, p_size % 3 AS channels FROM part)
SELECT p_partkey, CASE WHEN rate = 0 OR rate > 384000 OR channels = 0 THEN 'invalid' END AS code,
CASE WHEN rate = 0 THEN 'sample rate must be greater than 0' WHEN rate > 384000 THEN 'sample rate must be at most 384000 Hz' WHEN channels = 0 THEN 'channel count must be greater than 0' END AS message,
CASE WHEN rate = 0 OR rate > 384000 OR channels = 0 THEN 3 ELSE 0 END AS status FROM p""")
def shape_errors(spark, sf_dir):
    rate = F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_partkey") * 1000)
    found = _table(spark, sf_dir, "part").select("p_partkey", grid.shape_error(rate, F.col("p_size") % 3).alias("e"))
    return found.select("p_partkey", "e.code", "e.message", grid.status_of(F.col("e.code")).alias("status"))


@query("window_errors", """WITH o AS (SELECT o_orderkey, o_orderkey % 700 AS w, o_custkey % 3 AS i FROM orders)
SELECT o_orderkey, CASE WHEN w * 11025 // 1000 < 4096 THEN 'Window too short: ' || (w * 11025 // 1000) || ' samples, need at least 4096' WHEN i * 11025 // 1000 = 0 THEN 'Window interval must be greater than 0' END AS message FROM o""")
def window_errors(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", grid.window_error(F.col("o_orderkey") % 700, F.col("o_custkey") % 3)["message"].alias("message"))


@query("container_sniff", """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '52494646' WHEN 1 THEN '494433' WHEN 2 THEN 'FFFB' WHEN 3 THEN 'FF1F' ELSE '' END || hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, '52494646') THEN 'wave' WHEN starts_with(h, '494433') OR (starts_with(h, 'FF') AND substr(h, 3, 1) IN ('E', 'F')) THEN 'mp3' ELSE 'unsupported' END AS container FROM d""")
def container_sniff(spark, sf_dir):
    k = F.pmod(F.col("doc_id"), F.lit(5))
    head = F.when(k == 0, "52494646").when(k == 1, "494433").when(k == 2, "FFFB").when(k == 3, "FF1F").otherwise("")
    content = F.concat(F.unhex(head), F.coalesce("text", F.lit("")).cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", containers.container(content).alias("container"))


_RISES = "list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN f[s + {k} + 1][i] - f[s + {k}][i] > 0.05::FLOAT THEN (1::BIGINT << (i - 1 + {at})::BIGINT) ELSE 0 END))::BIGINT"


@query("chroma_hashes", f"""WITH v AS (SELECT vec_id // 40 AS span, list(list_transform(embedding[1:12], lambda x: abs(x)::FLOAT) ORDER BY vec_id) AS f FROM embeddings GROUP BY 1),
s AS (SELECT span, f, unnest(list_sort(list_distinct(list_concat(range(1, len(f) - 6, 2), [len(f) - 7])))) AS s FROM v WHERE len(f) >= 8)
SELECT span, s - 1 AS frame_idx, xor(({_RISES.format(n=12, k=0, at=0)} | {_RISES.format(n=12, k=1, at=12)} | {_RISES.format(n=4, k=2, at=24)}),
 (least(greatest(trunc(list_reduce(f[s], lambda a, x: (a + x)::FLOAT) * 4)::BIGINT, 0), 15) << 28)) AS hash FROM s""")
def chroma_hashes(spark, sf_dir):
    """Spans of forty vectors taken as frames of twelve energies, and the hashes of each."""
    frame = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("float"))
    spans = _table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 40).alias("span")).agg(F.sort_array(F.collect_list(F.struct("vec_id", frame.alias("f")))).alias("x"))
    frames = spans.select("span", F.transform("x", lambda x: x["f"]).alias("f")).filter(F.size("f") >= 8)
    found = frames.select("span", F.explode(F.arrays_zip(grid.hash_starts(F.size("f")).alias("frame_idx"), hashing.hashes_of(F.col("f")).alias("hash"))).alias("z"))
    return found.select("span", "z.frame_idx", "z.hash")


@query("downmix_pairs", """WITH e AS (SELECT event_id // 2 AS frame, max(CASE WHEN event_id % 2 = 0 THEN value::FLOAT END) AS l, max(CASE WHEN event_id % 2 = 1 THEN value::FLOAT END) AS r FROM events GROUP BY 1)
SELECT frame, ((l + r)::FLOAT / 2::FLOAT)::FLOAT AS mono FROM e WHERE l IS NOT NULL AND r IS NOT NULL""")
def downmix_pairs(spark, sf_dir):
    """Even and odd events as the left and right samples of stereo frames; a frame that lacks one is dropped."""
    side = lambda k: F.max(F.when(F.col("event_id") % 2 == k, F.col("value").cast("float")))
    e = _table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 2).alias("frame")).agg(side(0).alias("l"), side(1).alias("r"))

    @F.pandas_udf("float")
    def mono(l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series(dsp.downmix(np.column_stack([l, r]).astype(np.float32).ravel(), 2))

    return e.filter("l is not null and r is not null").select("frame", mono("l", "r").alias("mono"))


@query("price_statistics", """SELECT o_orderpriority, min(o_totalprice) AS least, round(median(o_totalprice), 6) AS middle, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, max(o_totalprice) AS most, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1""")
def price_statistics(spark, sf_dir):
    """The statistics that timings are reported by."""
    found = statistics.summary(F.col("o_totalprice"))
    digits = {"middle": 6, "mean": 4, "p90": 6, "sd": 4}
    return _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[(F.round(x, digits[k]) if k in digits else x).alias(k) for k, x in found.items()])


#: The rate that a document's bytes are played at; a text of average length then lasts some seconds.
BYTE_RATE = 1_000


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as the samples of a mono wave blob; a byte is the high byte of its sample."""

    @F.pandas_udf("binary")
    def wave(text: pd.Series) -> pd.Series:
        return text.map(lambda t: encode_wave(np.frombuffer((t or "").encode(), np.int8).astype(np.int16) * 256, BYTE_RATE, 1))

    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), wave("text").alias("content"))


@query("wave_signatures")
def wave_signatures(spark, sf_dir):
    return ops.signatures(ops.decoded_blocks(_waves(spark, sf_dir))).select("id", "n_samples", "duration_ms", F.array_join("hashes", ",").alias("hashes"), "error.code")


@query("wave_windows")
def wave_windows(spark, sf_dir):
    return ops.windowed(ops.decoded_blocks(_waves(spark, sf_dir)), 1_500, 500).select("id", "window_idx", "timestamp_ms", "duration_ms", F.array_join("hashes", ",").alias("hashes"), "error.code")


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a stream for each part, with rates and channel counts of which some are unusable."""
    part = _table(spark, sf_dir, "part")
    rate = F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_partkey") * 1000).cast("long")
    op = F.when(F.col("p_partkey") % 7 == 0, "flush").otherwise("push")
    return part.select(F.col("p_partkey").cast("string").alias("stream_id"), F.lit(0).cast("long").alias("chunk_seq"), op.alias("op"), F.when(F.col("p_partkey") % 2 == 0, "i16").otherwise("f32").alias("format"), rate.alias("sample_rate"), (F.col("p_size") % 3).cast("int").alias("channels"))


@query("chunk_errors", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 1000 END AS rate, p_size % 3 AS channels FROM part WHERE p_partkey % 7 <> 0)
SELECT p_partkey::VARCHAR AS stream_id, 0::BIGINT AS chunk_seq, 'invalid' AS code,
CASE WHEN rate = 0 THEN 'sample rate must be greater than 0' WHEN rate > 384000 THEN 'sample rate must be at most 384000 Hz' ELSE 'channel count must be greater than 0' END AS message
FROM p WHERE (rate = 0 OR rate > 384000 OR channels = 0) AND NOT (p_partkey % 2 = 1 AND channels = 0)""")
def chunk_errors(spark, sf_dir):
    return signal.chunk_errors(_pushes(spark, sf_dir))


@query("wave_shapes", """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), s AS (SELECT doc_id, n, floor(n / (1000 / 11025.0::DOUBLE))::BIGINT AS m FROM d)
SELECT doc_id::VARCHAR AS id, m AS n_samples, (m * 1000 + 5512) // 11025 AS duration_ms, CASE WHEN m < 16537 THEN 0 ELSE (m - 16537) // 5512 + 1 END AS n_windows FROM s""")
def wave_shapes(spark, sf_dir):
    """What decoding and resampling make of every blob, and how many windows of 1,500 ms, 500 ms apart, it has."""
    blocks = ops.decoded_blocks(_waves(spark, sf_dir)).groupBy("id").agg(F.first("n_samples").alias("n_samples"))
    return blocks.select("id", "n_samples", grid.ms_for_samples(F.col("n_samples")).alias("duration_ms"), F.size(grid.windows(F.col("n_samples"), 1_500, 500)).cast("long").alias("n_windows"))


@query("wave_files", """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id::VARCHAR AS id, n AS n_source, greatest(1, (n + 2047) // 2048) AS n_chunks, floor(n / (1000 / 11025.0::DOUBLE))::BIGINT AS n_samples FROM d""")
def wave_files(spark, sf_dir):
    """The documents' wave blobs written as files, read again as chunks by ranges of bytes, and resampled over these: what every recording has."""
    folder = f"{shared_folder(spark)}/waves-{uuid.uuid4()}"
    files.write_blobs(_waves(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    read = read_chunks(spark, folder, 1 << 14, 2_048).withColumn("id", F.element_at(F.split("id", "/"), -1))
    found = read.groupBy("id").agg(F.max("n_source").alias("n_source"), F.count("*").alias("n_chunks"))
    blocks = chunk_blocks(read, one_shape=True).groupBy("id").agg(F.max("n_samples").alias("n_samples"))
    return found.join(blocks, "id")


@query("stream_windows")
def stream_windows(spark, sf_dir):
    """The same windows from streams: the documents' bytes pushed in chunks through keyed state, and closed at the end."""
    raw = F.hex(F.coalesce("text", F.lit("")).cast("binary"))
    size = 8_192
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), raw.alias("raw"))
    docs = docs.withColumn("n", F.ceil(F.length("raw") / (2 * size)).cast("int"))
    chunks = docs.select("stream_id", "raw", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    pcm = F.unhex(F.regexp_replace(F.substring("raw", F.col("k") * (2 * size) + 1, F.lit(2 * size)), "(..)", "00$1"))
    op = F.when(F.col("k") == F.col("n"), "close").otherwise("push")
    chunks = chunks.select("stream_id", F.col("k").cast("long").alias("chunk_seq"), op.alias("op"), F.lit("i16").alias("format"), F.lit(BYTE_RATE).cast("long").alias("sample_rate"), F.lit(1).alias("channels"), pcm.alias("pcm"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    chunks.write.parquet(f"{folder}/chunks", compression="zstd")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(signal.CHUNKS).parquet(f"{folder}/chunks")
        out = signal.stream_windows(stream, 1_500, 500).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(signal.WINDOWS).parquet(f"{folder}/out").filter("code is null").select("stream_id", "window_idx", "timestamp_ms", F.array_join("hashes", ",").alias("hashes"))


@query("version", f"SELECT '{constants.VERSION}' AS version, count(*) AS n_documents FROM documents")
def version(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("n_documents")).select(F.lit(constants.VERSION).alias("version"), "n_documents")
