"""Quality rules: counts and rules of a document, and a verdict for each host.

Rule failures are summed by host and every host's failure rate is shrunk towards all hosts' rate with a
beta prior fitted by moments to the hosts. The bar follows from the fit too: a host is rejected, with all
its documents, if the lower end of its posterior rate (the mean less DEVIATIONS standard deviations) lies
above LIFT times the common rate, or above the middle between the common rate and 1 where that is less.
Where the hosts differ no more than chance would have them, the fitted prior is a point at the common rate
and no host stands out. Counts are column expressions, computed once and staged; hosts are one small
aggregate; the verdicts join back to the staged counts, never to the texts.

Defined results: a null text has no words and fails the base rule; a null source is one host; with
fewer than two hosts, or hosts that all fail alike, no host is rejected; repeated rows count each; no rows
give no rows. Kept columns that are called like an output (OUTPUTS) give way to it; other names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, bind, read, staged, whole

FEW_WORDS, REPEATED_PERCENT, WINDOW, LIFT, DEVIATIONS = 20, 30, 8, 2.0, 2.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*COUNTS, "base_failed", "host_docs", "host_failed", "host_rate", "host_kept", "kept")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many of the words lie in a run of `width` words found twice or more in the array. Runs are compared by a 64-bit hash; only a text that repeats any is sorted."""
    at = lambda hashes, i: F.get(hashes, i)

    def runs(hashes):
        starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(at(hashes, i + k) for k in range(width))))

    def covered(found):
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        shared = bind(pairs, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(shared, lambda x: x["i"]))
        first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    body = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))
    return bind(bind(F.transform(words, lambda w: F.xxhash64(w)), runs), body).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The five counts of a text, by name."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    lines = bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    values = of_words["n"], F.length(text) - F.regexp_count(text, F.lit(BLANK)), F.regexp_count(text, F.lit(r"[#*$%&|<>]")), lines, of_words["repeated"]
    return {name: value.cast("long") for name, value in zip(COUNTS, values)}


def base_failed() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """From rows (host, base_failed): one row a host: host, host_docs, host_failed, host_rate (shrunk), host_kept. The beta prior has the hosts' pooled rate as its mean; its weight follows from how much the hosts' rates vary beyond chance."""
    hosts = staged(rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.count("*").alias("k"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_docs") * rate * rate).alias("q"), F.sum(F.col("host_docs") * F.col("host_docs")).alias("nn")).first()
    mean, weight = prior(m["k"] or 0, m["n"] or 0, m["f"] or 0, m["q"] or 0.0, m["nn"] or 0)
    if weight is None:
        return hosts.withColumns({"host_rate": F.lit(mean), "host_kept": F.lit(True)})
    total = F.col("host_docs") + weight
    hosts = hosts.withColumn("host_rate", (F.col("host_failed") + mean * weight) / total)
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (total + 1))
    return hosts.withColumn("host_kept", F.col("host_rate") - DEVIATIONS * deviation <= min(LIFT * mean, (1 + mean) / 2))


def prior(hosts: int, docs: int, failed: int, squares: float, docs_squared: int) -> tuple[float, float | None]:
    """Mean and weight (alpha + beta, one document's worth at least) of the beta prior, by moments of the hosts' rates weighted by their documents; no weight where the hosts vary no more than chance."""
    if not docs:
        return 0.0, None
    mean = failed / docs
    spread = mean * (1 - mean)
    between = squares - docs * mean * mean  # sum of n (rate - mean)^2
    excess = between - (hosts - 1) * spread
    room = docs - docs_squared / docs
    if hosts < 2 or spread == 0 or excess <= 0 or room <= 0:
        return mean, None
    return mean, max(1.0, spread / (excess / room) - 1)


def judge(docs: DataFrame, *, host: Column | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, the counts, base_failed, the host's figures and kept, one row a document. A document's host is its source, or what the caller gives."""
    host = F.col("source") if host is None else host
    own = whole(docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in keep)), OUTPUTS)
    rows = docs.select(own.alias("doc"), F.coalesce(F.concat(F.lit("s"), host.cast("string")), F.lit("t")).alias("host"), *(v.alias(n) for n, v in counts(F.col(text_col)).items()))
    rows = staged(rows.withColumn("base_failed", base_failed()), "rule-counts")
    joined = rows.join(host_verdicts(rows), "host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    return joined.select("doc.*", *OUTPUTS)


RESULT = ("doc_id", *COUNTS, "base_failed", "kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select(*RESULT)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 with hosts that differ: texts of like length (within a power of two) are a host, and those of very short texts mostly fail."""
    section = F.length(F.bin(F.coalesce(F.length("text"), F.lit(0))))
    return judge(read(spark, sf_dir, "documents"), host=section).select(*RESULT, "host_docs", "host_failed", "host_kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, source, len(w) AS n, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) r(i)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(8, gap))::BIGINT AS n FROM (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS gap FROM r) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) AS q, sum(n * n) AS nn FROM h),
v AS (SELECT *, mean * (1 - mean) AS s, q - docs * mean * mean - (hosts - 1) * mean * (1 - mean) AS e, docs - nn / docs AS room FROM m),
z AS (SELECT mean, CASE WHEN hosts < 2 OR s = 0 OR e <= 0 OR room <= 0 THEN NULL ELSE greatest(1.0::DOUBLE, s / (e / room) - 1) END AS weight FROM v),
y AS (SELECT source, n, k, mean, weight, (k + mean * weight) / (n + weight) AS rate FROM h, z),
x AS (SELECT source, n, k, weight IS NULL OR rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) <= least(2 * mean, (1 + mean) / 2) AS ok FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""

SECTIONS_ORACLE = ORACLE.replace("SELECT doc_id, source, coalesce", "SELECT doc_id, length(bin(coalesce(length(text), 0))) AS source, coalesce", 1).replace(
    "NOT base_failed AND ok AS kept\n", "NOT base_failed AND ok AS kept, n::BIGINT AS host_docs, k::BIGINT AS host_failed, ok AS host_kept\n"
)
