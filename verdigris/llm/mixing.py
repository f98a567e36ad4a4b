"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w, with u from a hash of its id and text and w its
quality weight. A source whose target holds e complete epochs gives every document e times; what is left
of the target goes to the documents with the smallest keys, up to the prefix sum of sizes that comes
nearest to it. Equal rows have equal keys and are summed first, so that they count as one. The prefix sum
is taken in two steps, over key bins and inside a bin, so no source is sorted in one task: a bin is 1/512
of a power of two of the key and so holds under 1/1000 of its source, whatever the weights. The order is
by key and then by hash of id and text, which leaves ties to equal rows only; one row a source says where
its fraction ends, and whether a row is taken follows from that row alone, in mix() as in op9().

Defined results: a null text has size 0; a null source is a source of its own, after all others; a
source without words has target 0; a null id is an id like others; rows with one id and different texts
have different keys; rows equal in id and text are taken alike, all or none; no rows give no rows.
Columns of docs keep their names and values, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, drop, hash60, read, staged, whole

BINS_PER_OCTAVE = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """Quality weight from 0.1 to 1: less for a text full of symbols."""
    marks = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0))
    return F.greatest(F.lit(0.1), 1 - 5.0 * marks / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))


def keyed(docs: DataFrame, seed: int, weight: Column, *, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc, _source, _size, _key, _row) for every row: doc has docs' columns, _source sorts (null last), _row is a hash of id and text."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    u = (hash60(F.concat(F.lit(f"{seed}:"), name)) + 0.5) / float(1 << 60)
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    return docs.select(
        whole(docs).alias("doc"), source.alias("_source"), word_count(F.col(text_col)).alias("_size"),
        F.greatest(-F.ln(u) / weight, F.lit(1e-18)).alias("_key"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row a source: _source, _total, _target, _epochs, _rest. Targets share `share` of all sizes by weight, none above `most` times its source: the common level is the largest over all numbers of sources that stand at their cap."""
    total = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    order, everything = Window.orderBy("_source"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = total.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    total = total.withColumn("_cap", most * F.col("_total"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("_level", (share * F.sum("_total").over(everything) - before) / rest)
    total = total.withColumn("_target", F.least("_cap", F.col("_weight") * F.max("_level").over(everything)))
    epochs = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long")
    total = total.withColumn("_epochs", epochs)
    return total.select("_source", "_total", "_target", "_epochs", (F.col("_target") - F.col("_epochs") * F.col("_total")).alias("_rest"))


def plan(keys: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (_source, _size, _key, _row): one row a source with _total, _target, _epochs and _last, the last key and row that its fraction takes (null if none)."""
    goal = staged(targets(keys, weights, share, most), "mix-targets")
    keys = keys.groupBy("_source", "_key", "_row").agg(F.sum("_size").alias("_size")).withColumn("_bin", F.floor(F.log2("_key") * BINS_PER_OCTAVE))
    bins = keys.groupBy("_source", "_bin").agg(F.sum("_size").alias("_in_bin"))
    earlier = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_source", "_bin", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)).alias("_bins_before"))
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keys.withColumn("_inside", F.sum("_size").over(inside)).join(bins, ["_source", "_bin"]).join(goal, "_source")
    taken = (F.col("_rest") > 0) & (F.col("_bins_before") + F.col("_inside") - F.col("_size") / 2.0 <= F.col("_rest"))
    last = rows.where(taken).groupBy("_source").agg(F.max(F.struct("_key", "_row")).alias("_last"))
    out = staged(goal.join(last, "_source", "left"), "mix-last")
    drop(goal)
    return out


def copies() -> Column:
    """How often a row of keyed(), joined with its source's row of plan(), is taken."""
    return F.col("_epochs") + F.coalesce(F.struct("_key", "_row") <= F.col("_last"), F.lit(False)).cast("long")


def mix(
    docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, weight: Column | None = None,
    *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' own columns. Keys are sorted as a narrow table; the texts are then kept or repeated where they are read, against one row a source."""
    weight = plain_share(F.col(text_col)) if weight is None else weight
    full = keyed(docs, seed, weight, id_col=id_col, source_col=source_col, text_col=text_col)
    keys = staged(full.drop("doc"), "mix-keys")
    last = plan(keys, weights, share, most)
    drop(keys)
    rows = full.join(last.select("_source", "_epochs", "_last"), "_source")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), copies().cast("int")))).select("doc.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    full = keyed(docs, 17, plain_share(F.col("text")), id_col="doc_id", source_col="source", text_col="text")
    keys = staged(full.select("doc.doc_id", "_source", "_size", "_key", "_row"), "mix-keys")
    rows = keys.join(plan(keys), "_source")
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * copies()).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('17:' || doc_id || ':' || coalesce(text, '')), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0::DOUBLE)
      / greatest(0.1, 1 - 5.0::DOUBLE * coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) / greatest(coalesce(length(text), 0), 1)) AS k
  FROM documents),
t AS (SELECT s, sum(size)::BIGINT AS total FROM d GROUP BY s),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::BIGINT] AS w, 2.0::DOUBLE * total AS cap FROM t),
l AS (SELECT *, (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT s, total, least(cap, w * max(lev) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (SELECT d.*, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS rest,
  sum(size) OVER (PARTITION BY d.s ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid FROM d JOIN e USING (s))
SELECT doc_id, size, total AS source_size, target, (size * (epochs + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
