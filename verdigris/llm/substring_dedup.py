"""Substring deduplication with an FM-index per shard.

A word goes if a window of WINDOW words covers it whose words also start earlier (in a smaller
doc_id, or earlier in the same document). Two equal windows have the same minimizer, the smallest
hash among their 8-word runs, at the same place in the window. So consecutive windows with one
minimizer form a piece, and only pieces whose minimizer occurs twice or more can hold a repeated
window:

1. every document's minimizers are counted over the corpus; only those seen twice go on, and only
   documents that hold one are read again for the words of their pieces;
2. equal pieces are one, which knows the earliest place where it stands: at all other places its
   windows go;
3. where one minimizer still has several different pieces, they go to the shard of that minimizer. A
   shard builds a compressed FM-index of its pieces and streams them through it: backward search over the
   wavelet matrix gives the matching statistics, and the intervals that reach the window's length are
   reported with the earliest place of their block;
4. no minimizer may fill a shard: one with over `most` different pieces has them cut in two, into the
   windows with the minimizer in their first and in their second half. All windows of a part have more
   words in common than the minimizer, so these take its place as the key, and steps 2 and 3 follow for the
   parts. After four such cuts a part is a single window and its key the whole window, so equal ones are
   one. The same steps hold at every size; a cut only deals the windows of a hot minimizer finer.

Words, minimizers and keys are compared by 64-bit hashes, whole pieces by 128 bits.

Defined results: a null text has no words; a text shorter than the window loses none; rows that are
equal in id and text start at the same place, so neither is earlier and both keep what other rows
leave; rows with one id and different texts are one document with two texts, the earlier start wins;
a null id comes after all others; no rows give no rows. Only id and text are read, whatever other
columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, WordHashes, drop, grams, key_filter, may_hold, mixed, read, slices, split, staged
from .fm_index import FMIndex

WINDOW, RUN = 20, 8
SHARD_WORDS, MOST_PIECES = 200_000, 1_000


def pieces(words: np.ndarray, starts: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """From word hashes of documents one after another, for every piece: minimizer, document, first window, number of windows, and how many words of the first window stand before the minimizer."""
    none = np.empty(0, np.int64)
    count = len(words) - window + 1
    if count <= 0:
        return none.astype(np.uint64), none, none, none, none
    g = grams(words, run)
    best, size, want = np.arange(len(g)), 1, window - run + 1
    while size < want:  # leftmost minimum of ever longer stretches
        step = min(size, want - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[a] <= g[b], a, b)
        size += step
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:count]
    at = np.flatnonzero(np.arange(count) + window <= starts[1:][document])
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    best, document = best[:count][at], document[at]
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (document[1:] != document[:-1])]))
    sizes = np.diff(np.concatenate([new, [len(at)]]))
    return g[best[new]], document[new], at[new], sizes, best[new] - at[new]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, "text"):
        words, starts = split(batch.column("text"))
        m, document, first, _, _ = pieces(hashes.of(words), starts)
        rows = np.asarray(batch.column("row"))[document]
        yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(rows), pa.array((first - starts[document]).astype(np.int32))], ["minimizer", "row", "first"])


PIECE = "key long, h1 long, h2 long, row long, late boolean, doc_id long, first int, windows int, lead int, words binary"
PLACE = ["late", "doc_id", "first"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document that start where one of `firsts` says."""
    hashes = WordHashes()
    for batch in slices(batches, "text"):
        words, starts = split(batch.column("text"))
        h = hashes.of(words)
        m, document, first, sizes, lead = pieces(h, starts)
        firsts = batch.column("firsts")
        marks = np.zeros(int(starts[-1]) + 1, bool)
        own = np.asarray(firsts.flatten()).astype(np.int64) + np.repeat(starts[:-1], np.asarray(pc.list_value_length(firsts)))
        marks[own] = True
        keep = np.flatnonzero(marks[first])
        m, document, first, sizes, lead = m[keep], document[keep], first[keep], sizes[keep], lead[keep]
        of = [np.asarray(batch.column(c))[document] for c in ("row", "late", "doc_id")]
        yield _piece_rows(m.view(np.int64), h, first, sizes, lead, [*of, (first - starts[document]).astype(np.int32)])


def _piece_rows(key: np.ndarray, h: np.ndarray, begin: np.ndarray, sizes: np.ndarray, lead: np.ndarray, places: list[np.ndarray]) -> pa.RecordBatch:
    """Pieces of `sizes` windows that begin at `begin` in the word hashes h; places: row, late, doc_id and first."""
    length = sizes + WINDOW - 1
    h1, h2 = _hashed_runs(h, begin, length)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    offsets = np.concatenate([[0], np.cumsum(length * 8)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(h[np.repeat(begin, length) + inside])])
    columns = [key, h1, h2, *places, sizes.astype(np.int32), lead.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), words], [x.split()[0] for x in PIECE.split(", ")])


def _cut(level: int):
    """Each piece as the parts whose windows have the minimizer in the same of 2 ** level stretches of the window, keyed by the words that all windows of the part must have in common."""
    last = WINDOW - RUN
    stretch = np.arange(last + 1) * 2**level // (last + 1)  # of a window with so many words before the minimizer
    least = np.array([np.flatnonzero(stretch == s)[0] for s in stretch])
    most = np.array([np.flatnonzero(stretch == s)[-1] for s in stretch])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            sizes, lead, first = (np.asarray(batch.column(c)).astype(np.int64) for c in ("windows", "lead", "first"))
            h = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
            begin = np.cumsum(sizes + WINDOW - 1) - (sizes + WINDOW - 1)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            before = lead[owner] - inside
            new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(stretch[before]) != 0)]))
            count = np.diff(np.concatenate([new, [len(owner)]]))
            owner, inside, before = owner[new], inside[new], before[new]
            at = begin[owner] + inside
            low, high = at + before - least[before], at + before + RUN + last - most[before]
            key, _ = _hashed_runs(h, low, high - low)
            key = (mixed(key.view(np.uint64) + stretch[before].astype(np.uint64))).view(np.int64)
            of = [np.asarray(batch.column(c))[owner] for c in ("row", "late", "doc_id")]
            yield _piece_rows(key, h, at, count, before, [*of, (first[owner] + inside).astype(np.int32)])

    return run


def _hashed_runs(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of h[first : first + length] for each run: polynomials in an odd base, from running sums, so that a run's length costs nothing."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        up, down = (np.full(len(h) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[:-1], dtype=np.uint64)])
        value = (sums[first + length] - sums[first]) * up[first]
        out.append(mixed(mixed(value) + length.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


REMOVED = "row long, first int, windows int"


def _indexed(table: pa.Table) -> pa.Table:
    """One shard: builds the FM-index of its pieces, streams them through it and returns the runs of windows that stand earlier."""
    table = table.combine_chunks()
    late, doc, first, sizes, row = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("late", "doc_id", "first", "windows", "row"))
    length = sizes + WINDOW - 1
    begin = np.cumsum(length + 1) - (length + 1)
    text = np.zeros(int((length + 1).sum()), np.int64)
    where = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    text[where] = np.unique(np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64), return_inverse=True)[1] + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = begin[owner] + inside
    # the number of every window's start in the order of places; equal places (equal ids) stay equal
    keys = np.stack([late[owner], doc[owner], first[owner] + inside])
    order = np.lexsort(keys[::-1])
    place = np.full(len(text), np.iinfo(np.int64).max)
    place[starts[order]] = np.cumsum(np.concatenate([[False], (np.diff(keys[:, order], axis=1) != 0).any(0)])[: len(order)])
    index = FMIndex(text, place, WINDOW)
    matched, interval = index.matching_statistics(text, starts + WINDOW, times=2)
    number = np.flatnonzero(matched == WINDOW)
    gone = number[index.least_place(interval[number]) < place[starts[number]]]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)])[: len(gone)])
    top, size = gone[head], np.diff(np.concatenate([head, [len(gone)]]))
    return pa.table({"row": pa.array(row[owner[top]], pa.int64()), "first": pa.array((first[owner[top]] + inside[top]).astype(np.int32)), "windows": pa.array(size.astype(np.int32))})


def removed_windows(rows: DataFrame, shard_words: int = SHARD_WORDS, most: int = MOST_PIECES) -> list[DataFrame]:
    """From rows (row, late, doc_id, text): staged tables (row, first, windows) of the runs of windows that start earlier elsewhere."""
    found = staged(rows.select("row", "text").mapInArrow(_minimizers, "minimizer long, row long, first int"), "minimizers")
    # staged, so that the join shuffles both sides for itself and a hot minimizer's rows can be split
    twice = staged(found.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer"), "minimizers-seen-twice")
    some = found.where(may_hold(key_filter(twice), F.col("minimizer")))
    firsts = staged(some.join(twice, "minimizer").groupBy("row").agg(F.collect_set("first").alias("firsts")), "piece-starts")  # of one document
    drop(found, twice)
    level, removed = 0, []
    held = may_hold(key_filter(firsts.select("row")), F.col("row"))
    texts = staged(rows.where(held).join(firsts, "row").select("row", "late", "doc_id", "text", "firsts"), "texts-with-pieces")  # so that filter and pieces are not two Python workers of one task
    some = staged(texts.mapInArrow(_pieces, PIECE), "pieces")
    drop(firsts, texts)
    while True:
        name, place = ["key", "h1", "h2"], F.struct(*PLACE)
        distinct = staged(some.groupBy(*name).agg(F.min(place).alias("earliest")), "distinct-pieces")
        several = staged(distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys-of-several")
        where = some.select(*name, "row", "windows", *PLACE).join(distinct, name).where(place != F.col("earliest"))
        copies = staged(where.select("row", "first", "windows"), "removed-copies")
        at = F.xxhash64(*name, *PLACE)
        wanted = staged(distinct.join(several, "key").select(*name, "earliest.*", "n").withColumn("at", at), "wanted-pieces")
        drop(distinct, several)
        # equal rows stand at one place: of their pieces one goes on
        single = some.where(may_hold(key_filter(wanted.select("at")), at)).join(wanted.drop("at"), [*name, *PLACE])
        single = staged(single.groupBy(*name, *PLACE).agg(*(F.first(c).alias(c) for c in ("row", "windows", "lead", "words", "n"))), "single-pieces")
        drop(some, wanted)
        small = single.where(F.col("n") <= most)
        total = small.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
        shards = max(1, -(-total // shard_words))
        small = small.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        small = small.select("shard", "row", "late", "doc_id", "first", "windows", "words")
        runs = staged(small.groupBy("shard").applyInArrow(_indexed, REMOVED), "removed-by-index")
        removed += [copies, runs]
        large = single.where(F.col("n") > most)
        if large.isEmpty():
            drop(single)
            return removed
        level += 1
        some = staged(large.select("row", "late", "doc_id", "first", "windows", "lead", "words").mapInArrow(_cut(level), PIECE), "cut-pieces")
        drop(single)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, starts = split(batch.column("text"))
        runs = batch.column("runs")
        change = np.zeros(int(starts[-1]) + 1, np.int32)
        own, flat = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)), runs.flatten()
        low = starts[own] + np.asarray(flat.field("first"))
        np.add.at(change, low, 1)
        np.add.at(change, low + np.asarray(flat.field("windows")) + WINDOW - 1, -1)
        on = np.cumsum(change[:-1]) == 0
        upto = np.concatenate([[0], np.cumsum(on)])[starts]
        left = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.filter(pa.array(on)))
        counts = np.diff(starts)
        names = [c for c in batch.schema.names if c not in ("text", "runs")]
        columns = [pa.array(counts), pa.array(counts - np.diff(upto)), pc.binary_join(left, " ").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, most: int = MOST_PIECES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by blanks, as UTF-8)."""
    number = F.col(id_col).cast("long")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), number.alias("id"), F.col(text_col).alias("text"))
    known = rows.select("row", F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("doc_id"), "text")
    removed = removed_windows(known, shard_words, most)
    runs = staged(reduce(DataFrame.unionAll, removed).groupBy("row").agg(F.collect_set(F.struct("first", "windows")).alias("runs")), "runs-to-remove")  # of one document
    drop(*removed)
    held = may_hold(key_filter(runs.select("row")), F.col("row"))
    some = staged(rows.where(held).join(runs, "row", "left").select(F.col("id").alias("doc_id"), "text", "runs"), "texts-with-runs")
    drop(runs)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANK + "+"), lambda w: w != "")
    plain = rows.where(~held).select(F.col("id").alias("doc_id"), words.alias("words"))
    plain = plain.select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("words", " ").cast("binary").alias("kept"))
    return some.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept binary").unionAll(plain)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 18, 1))) r(i)),
r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, w, js FROM d LEFT JOIN c USING (doc_id)),
u AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) s WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(js) AS j FROM c) z WHERE z.doc_id = s.doc_id AND z.j = s.j) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN u ON k.doc_id = u.doc_id
"""
