"""What the operators share: reading, staging in the shared folder, whole-text batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() splits at the same six bytes.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Settings that hold while a table is staged: what its writing shuffles is freed at its end, and batches of whole texts stay small.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "3000"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths that this process has staged and not dropped, in order.
LIVE: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and the rows are computed once. What the writing has shuffled is freed at its end."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    before = {name: spark.conf.get(name) for name in STAGING}
    for name, value in STAGING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    LIVE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    LIVE[:] = [x for x in LIVE if x[1] != path]


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables. For tables that no plan still to be run reads: results are lazy."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)


def drop_others(before: list, *kept: DataFrame) -> None:
    """Deletes what has been staged since `before` (a copy of LIVE), but `kept`."""
    keep = {path for _, path in before} | {table.staged_at for table in kept}
    for spark, path in [x for x in LIVE if x[1] not in keep]:
        _delete(spark, path)


#: Blocks in which a key filter is put together, in bytes; the bits that it has for a key, and at most in all; where its probes begin in a key's 64 mixed bits.
FILTER_BLOCK, BITS_FOR_A_KEY, MOST_BITS, PROBES = 4096, 16, 1 << 28, (0, 18, 36)


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    own = mixed(keys.view(np.uint64))
    return [((own >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in PROBES]


def key_filter(keys: DataFrame) -> Broadcast:
    """A Bloom filter of a staged column of longs, put together block by block as a job, and broadcast: two bytes a key, 32 megabytes at most. Beyond that it lets more and more pass that is not among the keys, which costs time only: whoever uses it joins afterwards."""
    (name,), spark = keys.columns, keys.sparkSession
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(FILTER_BLOCK * 8, BITS_FOR_A_KEY * keys.count() - 1).bit_length())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(np.asarray(batch.column(0)), bits)))
            blocks, first = np.unique(at // (FILTER_BLOCK * 8), return_index=True)
            rows = []
            for block, part in zip(blocks.tolist(), np.split(at, first[1:])):
                marks = np.zeros(FILTER_BLOCK * 8, bool)
                marks[part - block * FILTER_BLOCK * 8] = True
                rows.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(rows, pa.binary())], ["block", "marks"])

    def together(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FILTER_BLOCK, np.uint8)
        for table in tables:
            for marks in table.column("marks").to_pylist():
                total |= np.frombuffer(marks, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "marks"])

    large = keys.mapInArrow(marked, "block int, marks binary")
    out = np.zeros(bits // 8, np.uint8).reshape(-1, FILTER_BLOCK)
    for r in large.groupBy("block").applyInArrow(together, "block int, marks binary").collect():  # the filter's bytes in all
        out[r["block"]] = np.frombuffer(r["marks"], np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


def may_hold(marks: Broadcast, key: Column) -> Column:
    """Whether the key may be in the filter: true for all that are. Only the key's column goes to Python."""

    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        bits, found = marks.value, np.ones(len(keys), bool)
        for at in _probes(np.asarray(keys), len(bits) * 8):
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return held(key)


def without(rows: DataFrame, gone: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows but those that the staged table gone (doc_id, row: a hash of id and text) names. Rows that its filter does not know stay where they are; only the others are joined with it."""
    marks, key = key_filter(gone.select("row")), F.xxhash64(F.col(id_col), F.col(text_col))
    held = may_hold(marks, key)
    some = rows.where(held)
    same = (F.xxhash64(some[id_col], some[text_col]) == gone["row"]) & some[id_col].cast("long").eqNullSafe(gone["doc_id"])
    return rows.where(~held).unionAll(some.join(gone, same, "left_anti"))


def free_name(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as make it none of df's columns (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row of df as a struct, which keeps its columns apart from working ones of any name; `without` names columns to leave out (case is ignored)."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in without))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would change other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def hash60(c: Column) -> Column:
    """60 bits of md5 as a non-negative long; any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes of text; a longer text stays whole, alone. After each batch the memory that Arrow keeps for later goes back, as several workers share a machine."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, end - start)
            start, base = end, int(ends[end - 1])
        pa.default_memory_pool().release_unused()


def text_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and where each text's begin (one entry more than texts). A null has none."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = text_lengths(trimmed) == 0  # such a text is split into one empty word
    words = lists.flatten()
    if blank.any():
        counts[blank] = 0
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, np.concatenate([[0], np.cumsum(counts)])


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen last; the cache is emptied when it is full."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: pa.Array) -> np.ndarray:
        """The hashes of an array of words; each different word is looked up once."""
        coded = words.dictionary_encode()
        own = coded.dictionary.cast(pa.binary()).to_pylist()
        return np.fromiter(map(self.__getitem__, own), np.uint64, len(own))[coded.indices.to_numpy(zero_copy_only=False)] if own else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count]
        out ^= out >> np.uint64(29)
    return mixed(out)
