"""Similarity join on word shingles: rare-first prefix filtering, verified once per pair.

A document's set holds the 64-bit hashes of its distinct shingles; documents with equal sets are one
class, known by a 64-bit hash of the set. Shingles are ordered from rare to frequent by a count over
the whole corpus (a sketch of fixed size; any common order gives right results, the counts only make
prefixes selective). Two sets that reach the threshold share a shingle of their prefixes, so:

1. every class sends the shingles of its prefix; only those of two classes or more go on;
2. within a shingle and a band of set sizes, every class is paired with the one there that has the
   fewest prefix shingles of its own, the nearest to what near copies come from: as many pairs as
   postings, however large a group of near copies is;
3. pairs pass length, positional and suffix filters (prefix shingles that no other set has cannot be
   shared; the suffix filter bounds the overlap by the sets' counts over fixed ranges of the hash)
   and are verified on the whole sets, once;
4. links make components. Where a shingle still has classes of different components, all their pairs
   across components follow, through the same filters; so the components are those of all links;
5. every link lies inside a component. The classes of a component are dealt into blocks of about
   BLOCK_OF of one size band; each pair of blocks whose bands can hold links is one unit of work, which
   has the sets of both and gives, for each class, how many others it is linked with (or the links
   themselves). So no row is made for a pair that is no link, and counts need none for links either.

A near-copy group of k different texts has up to k(k-1)/2 true links. Steps 1 to 4 are linear in k; step
5 sends every set of the group to k / BLOCK_OF units.

Links are pairs of classes; documents of one class are linked too. Defined results: null, empty and
blank texts have the empty set and are linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows have equal sets; a null id counts as larger than any; no rows give no rows.
Columns beyond id and text are not read by Join, whatever their names; one_of_each() keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, drop, free_name, grams, key_filter, may_hold, mixed, read, slices, split, staged, without
from .components import components

SIZE, PERCENT = 4, 85
SKETCH, BLOCK, RANGES, BLOCK_OF = 1 << 20, 4096, 64, 256


def shingle_sets(texts: pa.Array, hashes: WordHashes, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, starts = split(pc.ascii_lower(texts))
    h = hashes.of(words)
    runs, out = grams(h, size), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a < size:
            out.append(grams(h[a:b], b - a) + np.uint64(b - a) if b > a else h[a:b])
            continue
        own = np.sort(runs[a : b - size + 1])
        new = np.empty(len(own), bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of every set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(np.concatenate([np.empty(0, np.uint64), *sets])), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mixed((total[ends] - total[ends - sizes]) ^ sizes.astype(np.uint64)).view(np.int64)


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of values, as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


FACTS = "doc_id long, row long, n int, class long, ranges binary, block int, salt int, counts binary"


def _facts(size: int):
    """A row for every document, and at the end of a task its counts of shingles. ranges: how many of the set's hashes lie in each of RANGES equal parts, 65,535 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = WordHashes(), np.zeros(SKETCH, np.int32)
        names = [x.split()[0] for x in FACTS.split(", ")]
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), hashes, size)
            n, sizes, every = len(sets), np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
            np.add.at(sketch, (every % np.uint64(SKETCH)).astype(np.int64), 1)
            part = np.repeat(np.arange(n) * RANGES, sizes) + (every >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
            ranges = np.minimum(np.bincount(part, minlength=n * RANGES), 65535).astype(np.uint16)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(sizes.astype(np.int32)), pa.array(classes_of(sets)), binaries(ranges, np.full(n, RANGES))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names)
        part = np.flatnonzero(sketch.reshape(-1, BLOCK).any(1))
        none, salt = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())], TaskContext.get().partitionId() // 512
        counts = pa.array([sketch[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in part], pa.binary())
        yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array([salt] * len(part), pa.int32()), counts], names)

    return run


def _summed(kind):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, kind)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def rarity(facts: DataFrame) -> np.ndarray:
    """For each bucket of the sketch the level (eighths of a power of two) of its count over all documents: one megabyte, whatever the corpus."""
    parts = facts.where("block is not null").select("block", "salt", "counts")
    parts = parts.groupBy("block", "salt").applyInArrow(_summed(np.int32), "block int, counts binary")
    sums = staged(parts.groupBy("block").applyInArrow(_summed(np.int64), "block int, counts binary"), "join-rarity")
    levels = np.zeros(SKETCH, np.uint8)
    for r in sums.collect():  # SKETCH counts in all
        counts = np.frombuffer(r["counts"], np.int64)
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.minimum(255, np.log2(counts + 1.0) * 8).astype(np.uint8)
    drop(sums)
    return levels


def prefix_length(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1  # n - ceil(percent n / 100) + 1


def _prefixes(size: int, percent: int, levels):
    """(token, class, n, at) for the prefix of every set; a class that this task has just seen is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, seen = WordHashes(), levels.value, set()
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), hashes, size)
            keys = classes_of(sets)
            tokens, new = [], []
            for d, (own, key) in enumerate(zip(sets, keys.tolist())):
                if not len(own) or key in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                rank, k = table[(own % np.uint64(SKETCH)).astype(np.int64)], prefix_length(len(own), percent)
                order = np.argsort(rank, kind="stable")[:k]
                tokens.append(own[order])
                new.append(d)
            if new:
                n = np.array([len(sets[d]) for d in new], np.int32)
                k = np.array([len(t) for t in tokens], np.int64)
                at = (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(keys[new], k), np.repeat(n, k), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "class", "n", "at"])

    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), hashes, size)
            elements = binaries(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("class"), elements], ["class", "elements"])

    return run


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _verified(percent: int):
    """From rows (u, v, their sets ea and eb): the links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ea"), batch.column("eb")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = shared_size(a, b)
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return run


def _far(percent: int):
    """The suffix filter: pairs whose counts over the ranges of the hash are too far apart for a link go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, RANGES).astype(np.int32) for c in ("ra", "rb"))
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n", "m"))
            need = -(-percent * (n + m) // (100 + percent))
            near = np.abs(a - b).sum(1) <= n + m - 2 * need
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("u", "v")], ["u", "v"])

    return run


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each of the sets `left` (numbers) is linked with each of `right`, by an incidence matrix over their elements, so many elements at a time."""
    both = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(sets[k]) for k in both])
    codes = np.unique(np.concatenate([sets[k] for k in both]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    i, j = np.searchsorted(both, left), np.searchsorted(both, right)
    shared, width = np.zeros((len(left), len(right)), np.float32), 4096
    for low in range(0, int(codes[-1]) + 1, width):
        a, b = np.searchsorted(codes, [low, low + width])
        holds = np.zeros((len(both), width), np.float32)
        holds[owner[a:b], codes[a:b] - low] = 1
        shared += holds[i] @ holds[j].T
    size = sizes.astype(np.float64)
    return 100.0 * shared >= percent * (size[i][:, None] + size[j][None, :] - shared)


CELL = ["component", "low", "bu", "high", "bv"]


def _in_cell(percent: int, pairs: bool):
    """The links of one pair of blocks: as pairs, or for each class the number of rows that it is linked with there."""

    def run(table: pa.Table) -> pa.Table:
        low, high, bu, bv = (table.column(c)[0].as_py() for c in ("low", "high", "bu", "bv"))
        one_block = low == high and bu == bv
        first = np.asarray(table.column("first").combine_chunks())
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if not one_block else (np.arange(len(first)),) * 2
        classes, rows = (np.asarray(table.column(c).combine_chunks()) for c in ("class", "rows"))
        if not len(left) or not len(right):
            hits = np.zeros((len(left), len(right)), bool)
        else:
            hits = linked([np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()], left, right, percent)
        if one_block:
            np.fill_diagonal(hits, False)
        if pairs:
            i, j = np.nonzero(np.triu(hits) if one_block else hits)
            u, v = classes[left[i]], classes[right[j]]
            return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})
        ends = [(classes[left], hits @ rows[right])] + ([] if one_block else [(classes[right], hits.T @ rows[left])])
        return pa.table({"class": pa.array(np.concatenate([c for c, _ in ends]), pa.int64()), "k": pa.array(np.concatenate([k for _, k in ends]).astype(np.int64))})

    return run


class Join:
    """The join of one corpus. What it stages and no later step reads is dropped as it goes; drop_all() ends the rest."""

    def __init__(self, docs: DataFrame, size: int = SIZE, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text", block_of: int = BLOCK_OF):
        self.percent, self.size, self.block_of = percent, size, block_of
        spark = docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
        self.facts = staged(self.rows.mapInArrow(_facts(size), FACTS), "join-facts")
        self.documents = self.facts.where("block is null").select("doc_id", "row", "n", "class")
        first = F.min_by(F.struct("row", "n", "ranges"), F.struct("doc_id", "row")).alias("x")
        classes = self.facts.where("block is null and n > 0").groupBy("class").agg(first, F.count("*").alias("rows"))
        self.classes = staged(classes.select("class", "x.*", "rows"), "join-classes")
        levels = spark.sparkContext.broadcast(rarity(self.facts))
        found = staged(self.rows.select("text").mapInArrow(_prefixes(size, percent, levels), "token long, class long, n int, at int"), "join-prefixes")
        # aggregates that are joined back are staged, so that the join shuffles both sides and a hot key's rows can be split
        shared = staged(found.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("token"), "join-shared")
        own = F.count("*").over(Window.partitionBy("class"))
        rest = F.col("n") - (F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1 - own)
        known = found.where(may_hold(key_filter(shared), F.col("token"))).join(shared, "token").repartition("class").dropDuplicates(["class", "token"])  # classes come from several tasks
        self.postings = staged(known.withColumn("rest", rest.cast("int")).withColumn("band", self._band(F.col("n"))), "join-postings")
        drop(found, shared)
        self.repeats = not self.documents.groupBy("doc_id", "row").count().where("count > 1").isEmpty()
        self.sets: DataFrame | None = None
        self._parts = [self.facts, self.classes, self.postings]

    def drop_all(self) -> None:
        """Deletes what the steps share. What result() has given stays readable, links() and the like do not."""
        drop(*self._parts)

    def _band(self, n: Column) -> Column:
        """Sets of sizes in a ratio that the threshold allows lie in one band or in two next to each other."""
        return F.floor(F.ln(n.cast("double")) / math.log(100 / self.percent)).cast("int")

    def _overlap(self, a: Column, b: Column) -> Column:
        """The overlap that sets of these sizes need."""
        return F.ceil((a + b) * self.percent / (100.0 + self.percent) - 1e-9)

    def _possible(self, x: str, y: str) -> Column:
        """Length filter, and what is left of a set once the prefix shingles that no other prefix has are off: a bound for the set whose prefix ends first (the other's may stand behind that prefix), so the larger of both."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        sizes = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return sizes & (F.greatest(f"{x}.rest", f"{y}.rest") >= self._overlap(n, m))

    def _near(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs that pass the suffix filter."""
        ranges = self.classes.select("class", "n", "ranges")
        both = pairs.join(ranges.toDF("u", "n", "ra"), "u").join(ranges.toDF("v", "m", "rb"), "v")
        return staged(both.mapInArrow(_far(self.percent), "u long, v long"), label)

    def _need(self, wanted: DataFrame) -> None:
        """Stages the sets of the classes `wanted` that are not there yet, from one text each. Of the texts only those are shuffled that a filter of the wanted ones lets pass."""
        wanted = wanted.select("class").distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("class"), "class", "left_anti")
        wanted = staged(wanted.join(self.classes.select("class", "row"), "class").select("class", "row"), "join-wanted")
        if self.sets is None or not wanted.isEmpty():
            texts = self.rows.select("row", "text").where(may_hold(key_filter(wanted.select("row")), F.col("row"))).join(wanted, "row")
            texts = staged(texts.select("class", "text"), "join-texts")  # so that filter and sets are not two Python workers of one task
            sets = texts.mapInArrow(_whole(self.size), "class long, elements binary")
            sets = staged(sets.dropDuplicates(["class"]) if self.repeats else sets, "join-sets")
            drop(texts)
            self._parts.append(sets)
            self.sets = sets if self.sets is None else self.sets.unionAll(sets)
        drop(wanted)

    def _links(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (u, v) that reach the threshold: suffix filter, then the sets themselves."""
        near = self._near(pairs, "join-near")
        self._need(near.select(F.col("u").alias("class")).unionAll(near.select(F.col("v").alias("class"))))
        both = near.join(self.sets.toDF("u", "ea"), "u").join(self.sets.toDF("v", "eb"), "v")
        links = staged(both.select("u", "v", "ea", "eb").mapInArrow(_verified(self.percent), "u long, v long"), label)
        drop(near)
        return links

    def starred(self) -> DataFrame:
        """Each posting with the class of its shingle and band that has the fewest shingles of its own."""
        p = self.postings
        pivot = p.groupBy("token", "band").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("off"), "n", "class", "rest")).alias("y"), F.count("*").alias("k"))
        pivot = staged(pivot.where("k > 1").drop("k"), "join-pivots")
        pairs = p.select("token", "band", F.struct("n", "class", "rest").alias("x")).join(pivot, ["token", "band"])
        pairs = pairs.where((F.col("x.class") != F.col("y.class")) & self._possible("x", "y"))
        pairs = staged(pairs.select(F.least("x.class", "y.class").alias("u"), F.greatest("x.class", "y.class").alias("v")).distinct(), "join-pairs")
        drop(pivot)
        return pairs

    def across(self, known: DataFrame, done: DataFrame) -> DataFrame:
        """All pairs of one shingle whose classes lie in different components so far, but those done. The positional filter takes each shingle as the first that a pair shares: a pair that reaches the threshold passes at the one that is, and every prefix shingle that such a pair shares is here."""
        named = self.postings.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        several = staged(named.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token"), "join-several")
        named = staged(named.join(several, "token").select("token", "component", "band", F.struct("n", "class", "rest", "at").alias("x")), "join-open")
        here = named.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))  # sizes that can be linked lie in one band or two next to each other
        other = named.select("token", F.col("component").alias("other"), "band", F.col("x").alias("y"))
        n, m = F.col("x.n"), F.col("y.n")
        fits = F.least(n - F.col("x.at"), m - F.col("y.at")) >= self._overlap(n, m)
        pairs = here.join(other, ["token", "band"]).where((F.col("component") < F.col("other")) & self._possible("x", "y") & fits)
        pairs = pairs.select(F.least("x.class", "y.class").alias("u"), F.greatest("x.class", "y.class").alias("v")).distinct()
        pairs = staged(pairs.join(done, ["u", "v"], "left_anti"), "join-pairs")
        drop(several, named)
        return pairs

    def components(self) -> DataFrame:
        """(node, component) of the classes that are not their component's first."""
        return self._connected[0]

    @cached_property
    def _connected(self) -> tuple[DataFrame, DataFrame]:
        """The components, and the links found on the way to them."""
        pairs = self.starred()
        links = self._links(pairs, "join-links")
        first = components(links)
        open_pairs = self.across(first, pairs)
        more = self._links(open_pairs, "join-links")
        known = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more))
        drop(pairs, open_pairs, first)
        self._parts += [links, more, known]
        return known, links.unionAll(more)

    def _cells(self) -> DataFrame:
        """The sets of every component of three classes or more, for each cell (a pair of blocks) that they belong to; first: whether in its first block."""
        known = self.components()
        members = known.select(F.col("node").alias("class"), "component").unionAll(known.select(F.col("component").alias("class"), "component").distinct())
        large = staged(known.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component"), "join-large")
        members = staged(members.join(large, "component").join(self.classes.select("class", "n", "rows"), "class").withColumn("band", self._band(F.col("n"))), "join-members")
        bands = staged(members.groupBy("component", "band").agg(F.ceil(F.count("*") / self.block_of).cast("int").alias("blocks")), "join-bands")
        one = members.join(bands, ["component", "band"]).withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        above = bands.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
        below = bands.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
        one = one.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")

        def numbers(count: Column) -> Column:
            return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

        def cell(low, bu, high, bv, first):
            return F.struct(low.alias("low"), bu.alias("bu"), high.alias("high"), bv.alias("bv"), first.alias("first"))

        band, b, yes, no = F.col("band"), F.col("b"), F.lit(True), F.lit(False)
        own = F.transform(numbers(F.col("blocks")), lambda o: cell(band, F.least(b, o), band, F.greatest(b, o), b <= o))
        up = F.transform(numbers(F.col("above")), lambda o: cell(band, b, band + 1, o, yes))
        down = F.transform(numbers(F.col("below")), lambda o: cell(band - 1, o, band, b, no))
        dealt = staged(one.select("class", "rows", "component", F.explode(F.concat(own, up, down)).alias("cell")).select("class", "rows", "component", "cell.*"), "join-dealt")
        self._need(dealt.select("class"))
        drop(large, members, bands)
        self._parts.append(dealt)
        return dealt.join(self.sets, "class")

    def links(self) -> DataFrame:
        """All pairs (u, v), u < v, of classes that reach the threshold, each once; `documents` says which documents have a class."""
        inside = self._cells().groupBy(*CELL).applyInArrow(_in_cell(self.percent, True), "u long, v long")
        return inside.unionAll(self._pairs_alone())

    def _pairs_alone(self) -> DataFrame:
        """The links that are components of their own: those of two classes."""
        known, links = self._connected
        alone = staged(known.groupBy("component").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").select(F.col("component").alias("u"), F.col("node").alias("v")), "join-alone")
        self._parts.append(alone)
        return alone

    def n_links(self) -> DataFrame:
        """(class, n_links) where there are any: how many other rows a document of the class is linked with, those of its own class included."""
        inside = self._cells().groupBy(*CELL).applyInArrow(_in_cell(self.percent, False), "class long, k long")
        alone = self._pairs_alone()
        ends = alone.unionAll(alone.select("v", "u")).toDF("class", "other")
        ends = ends.join(self.classes.select(F.col("class").alias("other"), F.col("rows").alias("k")), "other").select("class", "k")
        copies = self.classes.where("rows > 1").select("class", (F.col("rows") - 1).alias("k"))
        out = staged(inside.unionAll(ends).unionAll(copies).groupBy("class").agg(F.sum("k").alias("n_links")), "join-counts")
        self._parts.append(out)
        return out

    def result(self, with_links: bool = True) -> DataFrame:
        """One row a document: doc_id, row (hash of id and text), n_shingles, component_id, first: whether it is its component's first by id and hash (equal rows all are), and n_links, unless not wanted: with how many other rows it is linked."""
        classes = self.components().withColumnRenamed("node", "class")
        if with_links:
            classes = staged(classes.join(self.n_links(), "class", "full"), "join-verdicts")
            self._parts.append(classes)
        docs = self.documents.join(classes, "class", "left")
        docs = staged(docs.withColumn("component", F.coalesce("component", "class")).drop("class"), "join-components")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        least = staged(docs.where("n > 0").groupBy("component").agg(F.min(place).alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "join-least")
        self.results = [docs, least]
        out = docs.join(least, "component", "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")))
        component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
        first = F.coalesce(F.col("least") == place, F.lit(True))
        counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if with_links else []
        return out.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), first.alias("first"), *counted)


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, then hash of id and text. Of equal rows (id and text) one stays; rows without shingles all do."""
    join = Join(docs, size, percent, id_col=id_col, text_col=text_col)
    found = join.result(with_links=False)
    repeated = staged(found.where("first and n_shingles > 0").groupBy("doc_id", "row").agg(F.count("*").alias("k")).where("k > 1"), "join-repeated")
    gone = staged(found.where(~F.col("first")).select("doc_id", "row").unionAll(repeated.select("doc_id", "row")).distinct(), "join-gone")
    join.drop_all()
    drop(*join.results)
    kept = without(docs, gone, id_col=id_col, text_col=text_col)
    if not repeated.isEmpty():
        row = free_name(docs, "row")
        rows = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
        same = (rows[row] == repeated["row"]) & rows[id_col].cast("long").eqNullSafe(repeated["doc_id"])
        kept = kept.unionAll(rows.join(repeated, same, "left_semi").dropDuplicates([id_col, row]).drop(row))
    return kept


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = Join(read(spark, sf_dir, "documents"))
    found = join.result()
    join.drop_all()
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[i:i + 3], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
q AS (SELECT u, count(*) AS n FROM e GROUP BY u),
c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.doc_id WHERE c.r < e.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id, coalesce(q.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m USING (doc_id) LEFT JOIN q ON q.u = d.doc_id
"""
