"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments, as many as the text needs: each holds the terms of some whole
documents, the posting list of every term (all positions, in order) and where its documents begin. It
is written to the shared folder and can be searched any number of times. A search goes through the
segments where they lie: for each window of a test item the posting list of the segment's rarest term,
moved by the term's offset, gives candidate starts, which are intersected with the offset-adjusted
lists of the other terms from rare to frequent. All windows of a segment go through together as
arrays. Nothing is shuffled; test items are broadcast in blocks of bounded size, and the rows of
several blocks are merged by document.

Defined results: null texts have no words; items without words match nothing; an item that occurs
in several rows is one item; equal windows of several items count for each; matches never cross
documents; repeated rows are searched alike; no documents give no rows, no items leave all clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, slices, split, staged, without

WIDTH, BLOCK_BYTES, SEGMENT_BYTES, CANDIDATES = 10, 2 << 20, 4_000_000, 1_000_000

#: A-Z to a-z, all other ASCII but digits and a-z to a blank; bytes of other characters stay.
FOLD = bytes((i + 32 if 0x41 <= i <= 0x5A else i) if i >= 0x80 or 0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A else 0x20 for i in range(256))

INDEX = "segment long, terms binary, counts binary, positions binary, doc_ids array<long>, doc_keys array<long>, starts array<int>"
FOUND = "segment long, ordinal int, doc_id long, doc_key long, n_words long, n_hit long, items array<string>, spans array<struct<first: int, last: int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def folded(texts: pa.Array) -> pa.Array:
    """Texts as words_of() splits them: FOLD over all their bytes at once; null is empty."""
    filled = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int32)[filled.offset : filled.offset + len(filled) + 1]
    body = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(FOLD) if data and len(filled) else b""
    return pa.StringArray.from_buffers(len(filled), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(body))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the postings of all terms of docs and returns the stored table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SEGMENT_BYTES):
            words, starts = split(folded(batch.column("text")))
            coded = words.dictionary_encode()
            terms, ids = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            counts = np.bincount(ids, minlength=len(terms)).astype(np.int32)
            positions = np.argsort(ids, kind="stable").astype(np.int32)
            row = [[segment], [b" ".join(terms)], [counts.tobytes()], [positions.tobytes()], [batch.column("doc_id")], [batch.column("key")], [starts.astype(np.int32)]]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            arrays = [pa.array([x[0].to_pylist() if isinstance(x[0], pa.Array) else x[0]], t) for x, t in zip(row, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["segment", "terms", "counts", "positions", "doc_ids", "doc_keys", "starts"])
            segment += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(build, INDEX), "postings")


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, starts: np.ndarray):
        self.ids = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.counts, self.positions, self.starts = np.frombuffer(counts, np.int32), np.frombuffer(positions, np.int32), starts
        self.first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.size = int(self.first[-1])
        #: term * size + position: ascending, so membership in any posting list is a binary search.
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) * self.size + self.positions

    def local(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.size + position
        at = np.searchsorted(self.keys, key)
        return (at < self.size) & (self.keys[np.minimum(at, self.size - 1)] == key)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting lists of terms one after another: number of the term in the argument, and position."""
        n = self.counts[term].astype(np.int64)
        which = np.repeat(np.arange(len(term)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return which, self.positions[self.first[term][which] + inside].astype(np.int64)

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Occurrences (row of windows, start) of windows of term numbers, -1 where a term is missing."""
        rows = np.flatnonzero((windows >= 0).all(1))
        if not len(rows):
            return
        counts = self.counts[windows[rows]]
        offsets = np.argsort(counts, axis=1, kind="stable")  # rarest first
        ends = np.cumsum(counts.min(1), dtype=np.int64)
        width, at = windows.shape[1], 0
        while at < len(rows):  # so many windows at a time that their rarest lists stay small
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
            part, order = windows[rows[at:to]], offsets[at:to]
            which, start = self.postings(part[np.arange(len(part)), order[:, 0]])
            start = start - order[which, 0]
            keep = (start >= 0) & (start + width <= self.size)
            which, start = which[keep], start[keep]
            for k in range(1, width):
                offset = order[which, k]
                keep = self.holds(part[which, offset], start + offset)
                which, start = which[keep], start[keep]
            keep = self.document(start) == self.document(start + width - 1)
            yield rows[at:to][which[keep]], start[keep]
            at = to

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest of the terms that have every other term within slop words in the same document."""
        if (terms < 0).any():
            return np.empty(0, np.int64)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        _, found = self.postings(terms[:1])
        for t in terms[1:]:
            own = self.postings(np.array([t]))[1]
            doc = self.document(found)
            low, high = np.maximum(found - slop, self.starts[doc]), np.minimum(found + slop, self.starts[doc + 1] - 1)
            found = found[np.searchsorted(own, low) < np.searchsorted(own, high, "right")]
        return found


def item_windows(items: list[tuple[object, str | None]], width: int) -> tuple[list[bytes], list[tuple[np.ndarray, list[list[str]]]]]:
    """The words of all items, and for each width the distinct windows (word numbers) with their items."""
    words, by_width = Numbers(), {}
    for item, text in items:
        own = [words[w] for w in words_of((text or "").encode())]
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            by_width.setdefault(size, {}).setdefault(tuple(own[i : i + size]), set()).add(str(item))
    return list(words), [(np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for w in by_width.values()]


def search(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ids, n_words, n_hit, items (sorted) and spans (word numbers, both included)."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    found = None
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        one = index.mapInArrow(_searcher(index.sparkSession, [tuple(r) for r in part.collect()], width), FOUND)  # about block_bytes
        found = one if found is None else found.unionAll(one)
    return found if blocks == 1 else _merged(found)


def _searcher(spark: SparkSession, items: list[tuple[str, str | None]], width: int):
    shared = spark.sparkContext.broadcast(item_windows(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_width = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                yield _found(row, words, by_width)

    return run


def _found(row: dict, words: list[bytes], by_width) -> pa.RecordBatch:
    starts = np.array(row["starts"], np.int64)
    segment = Segment(row["terms"], row["counts"], row["positions"], starts)
    local, docs = segment.local(words), len(starts) - 1
    change, items = np.zeros(segment.size + 1, np.int32), [set() for _ in range(docs)]
    if segment.size:
        for windows, owners in by_width:
            for which, start in segment.phrases(local[windows]):
                np.add.at(change, start, 1)
                np.add.at(change, start + windows.shape[1], -1)
                for d, w in set(zip(segment.document(start).tolist(), which.tolist())):
                    items[d].update(owners[w])
    hit = np.cumsum(change[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(hit)])
    spans = [_spans(hit[a:b]) if items[d] else [] for d, (a, b) in enumerate(zip(starts, starts[1:]))]
    columns = [
        pa.array([row["segment"]] * docs, pa.int64()), pa.array(range(docs), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_keys"], pa.int64()),
        pa.array(np.diff(starts), pa.int64()), pa.array(upto[starts[1:]] - upto[starts[:-1]], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "doc_key", "n_words", "n_hit", "items", "spans"])


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": a, "last": b - 1} for a, b in edge.reshape(-1, 2).tolist()]


def _merged(found: DataFrame) -> DataFrame:
    """The rows of several blocks of items as one row a document; spans that meet become one."""
    rows = found.groupBy("segment", "ordinal", "doc_id", "doc_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )

    def join(done, x):
        last = F.get(done, F.size(done) - 1)
        meets = (F.size(done) > 0) & (x["first"] <= last["last"] + 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    rows = rows.withColumn("spans", F.aggregate("spans", none, join))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return rows.select("segment", "ordinal", "doc_id", "doc_key", "n_words", size.alias("n_hit"), "items", "spans")


def proximity(index: DataFrame, words: list[str], slop: int) -> DataFrame:
    """doc_id and position of the rarest word, where all words lie within slop words of it."""
    wanted = [w for x in words for w in words_of(x.encode())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = np.array(row["starts"], np.int64)
                segment = Segment(row["terms"], row["counts"], row["positions"], starts)
                at = segment.near(segment.local(wanted), slop) if segment.size and wanted else np.empty(0, np.int64)
                doc = segment.document(at)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - starts[doc], pa.int64())], ["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def clean(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """docs without the rows that hold a window of any item."""
    index = build_index(docs)
    found = staged(search(index, items, **names).where("n_hit > 0").select("doc_id", F.col("doc_key").alias("row")).distinct(), "contaminated")
    drop(index)
    return without(docs, found)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 8, 2))) r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, greatest(len(w) - k + 2, 1))) r(i)),
m AS (SELECT DISTINCT doc_id, k, i, item FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT DISTINCT doc_id, k, i FROM m) x, unnest(range(i, i + k)) r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
