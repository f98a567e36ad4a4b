"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of the row. A bucket that holds more
bytes than the limit splits on one more bit, and only such a bucket does; buckets that fit stay at
their depth. The directory is computed as a table: bytes for every bit prefix down to a depth that
follows from the total, and for every cell at that depth the shortest prefix that fits. Cells that
are still too large go round again, eight bits deeper, with their own rows only.

Defined results: a bucket of one row that is larger than the limit is a shard of its own, marked
oversized; rows that agree in every hash bit (equal id and text) cannot be split by any bit and stay
together, marked oversized if they exceed the limit; a null text has 0 bytes; no rows give no rows.
Columns of docs keep their names and values; where one is called like an output (OUTPUTS), the output
takes its place, so a sharded table can be sharded again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, hash60, read, staged, whole

BITS, LIMIT = 60, 8 << 20
OUTPUTS = ("shard", "shard_depth", "shard_bytes", "shard_rows", "oversized")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, _hash, _bytes): doc has docs' columns but those called like an output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)
    return docs.select(whole(docs, OUTPUTS).alias("doc"), hash60(name).alias("_hash"), F.octet_length(text).cast("long").alias("_bytes"))


def directory(keys: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """From rows (_hash, _bytes): for each round its depth and a table (_cell, _depth, _shard_bytes, _shard_rows, _oversized) of the cells settled in it."""
    total = keys.agg(F.sum("_bytes")).first()[0] or 0
    depth, rounds = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4), []
    while True:
        cells = keys.groupBy(F.shiftright("_hash", BITS - depth).alias("_cell")).agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
        up = cells.select("_cell", "_b", "_n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_depth"))
        up = up.withColumn("_prefix", F.expr(f"shiftright(_cell, {depth} - _depth)"))
        sums = up.groupBy("_depth", "_prefix").agg(F.sum("_b").alias("_shard_bytes"), F.sum("_n").alias("_shard_rows"))
        fits = sums.where((F.col("_shard_bytes") <= limit) | (F.col("_shard_rows") == 1) | (F.col("_depth") == BITS))
        found = up.join(fits, ["_depth", "_prefix"]).groupBy("_cell").agg(F.min(F.struct("_depth", "_shard_bytes", "_shard_rows")).alias("_leaf"))
        found = staged(cells.select("_cell").join(found, "_cell", "left").select("_cell", "_leaf.*"), "shard-cells")
        done = found.where(F.col("_depth").isNotNull()).withColumn("_oversized", F.col("_shard_bytes") > limit)
        rounds.append((depth, done))
        open_cells = found.where(F.col("_depth").isNull()).select("_cell")
        if depth == BITS or open_cells.isEmpty():
            return rounds
        keys = keys.withColumn("_cell", F.shiftright("_hash", BITS - depth)).join(open_cells, "_cell", "left_semi").select("_hash", "_bytes")
        depth = min(BITS, depth + 8)


def shard(docs: DataFrame, limit: int = LIMIT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns and shard (its bit prefix as a 0/1 string), shard_depth, shard_bytes, shard_rows, oversized."""
    full = hashed(docs, id_col, text_col)
    keys = staged(full.select("_hash", "_bytes"), "shard-keys")
    parts, settled = [], directory(keys, limit)
    drop(keys)
    for depth, cells in settled:
        rows = full.withColumn("_cell", F.shiftright("_hash", BITS - depth)).join(cells, "_cell")
        bits = F.lpad(F.bin(F.expr(f"shiftright(_cell, {depth} - _depth)")), F.col("_depth"), F.lit("0"))
        values = (F.when(F.col("_depth") == 0, "").otherwise(bits), F.col("_depth"), F.col("_shard_bytes"), F.col("_shard_rows"), F.col("_oversized"))
        parts.append(rows.select("doc.*", *(v.alias(c) for v, c in zip(values, OUTPUTS))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def op5(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    rows = shard(read(spark, sf_dir, "documents").select("doc_id", "text"), limit)
    return rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), *OUTPUTS)


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 with shards of 48 KiB, so that a small table splits unevenly and deep."""
    return op5(spark, sf_dir, 48 << 10)


ORACLE = """
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
l AS (SELECT d.*, k AS depth, h >> (60 - k) AS p FROM d, range(0, 25) r(k)),
s AS (SELECT depth, p, sum(b)::BIGINT AS bytes, count(*) AS n FROM l GROUP BY depth, p),
f AS (SELECT l.doc_id, l.b, l.h, l.depth, l.p, s.bytes, s.n, row_number() OVER (PARTITION BY l.doc_id, l.h ORDER BY l.depth) AS k
  FROM l JOIN s ON l.depth = s.depth AND l.p = s.p WHERE s.bytes <= 8388608 OR s.n = 1)
SELECT doc_id, b AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), depth::INT) END AS shard, depth::INT AS shard_depth,
  bytes AS shard_bytes, n AS shard_rows, bytes > 8388608 AS oversized FROM f WHERE k = 1
"""
SMALL_ORACLE = ORACLE.replace(str(LIMIT), str(48 << 10))
