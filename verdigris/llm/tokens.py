"""Token counts of whole texts by a map-side two-tier lookup.

A byte-level BPE tokenizer encodes each pre-token apart, so a text has as many tokens as its pre-tokens
have together. Which pre-tokens are frequent the tokenizer's own file says: a BPE vocabulary lists its
entries in the order in which they were merged, frequent ones first. The first of its entries that are
whole pre-tokens, a fixed number of them of bounded length, are broadcast with their token counts as one
dictionary. Every worker looks pre-tokens up there, and encodes those it misses once, keeping them in a
cache that lives as long as the worker, over all its tasks, and is emptied when full. The texts are read
once and no pre-token leaves its task. What the table holds changes the speed only, never a count.

The pre-token pattern is applied with Python's re to texts whose characters all lie in blocks where
letters, numbers and spaces are listed here; any other text, and any that holds an added token's
string, is encoded whole by the library, so counts are the library's in every case.

Defined results: a null or empty text has 0 tokens; repeated rows count alike; no rows, no rows. Other
columns are kept; those called n_bytes or n_tokens give way to the counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, whole

FREQUENT, LONGEST, LIMIT = 32_768, 24, 512

# The pre-token pattern of the vocabulary, with its classes written out for the blocks of PLAIN.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \u0085 "
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PLAIN = "[\\x00-ɏ‐-‧‰-⁞€]*"


class Splitter:
    """Pre-tokens of a text, or None where only the library can tell."""

    def __init__(self, added: list[str]):
        self.find, self.plain = re.compile(PATTERN).findall, re.compile(PLAIN).fullmatch
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None

    def __call__(self, text: str) -> list[str] | None:
        return self.find(text) if (text.isascii() or self.plain(text)) and not self.added(text) else None


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [x.content for x in tokenizer.get_added_tokens_decoder().values()]


class Lengths(dict):
    """Token counts of pre-tokens that the broadcast table lacks, encoded once each."""

    MOST = 500_000

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def learn(self, pieces: set[str]) -> None:
        """Encodes those that are not here, all at once."""
        new = list(pieces - self.keys())
        if len(self) + len(new) > self.MOST + len(self.frequent):
            self.clear()
            self.update(self.frequent)
            new = list(pieces - self.keys())
        for piece, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self[piece] = len(encoded)


#: Of this worker, by tokenizer file: its tokenizer, splitter and cache.
WORKER: dict[tuple[str, int], tuple] = {}


def of_worker(path: str, frequent) -> tuple:
    key = path, frequent.value["size"]
    if key not in WORKER:
        tokenizer, added = load(path)
        WORKER[key] = tokenizer, Splitter(added), Lengths(tokenizer, frequent.value["lengths"])
    return WORKER[key]


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, as the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(0x100) if b not in plain)}


def frequent_pieces(tokenizer, split: Splitter, most: int = FREQUENT, longest: int = LONGEST) -> list[str]:
    """The first entries of the vocabulary that are whole pre-tokens."""
    byte, found = byte_of(), []
    for entry, _ in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
        if len(found) == most:
            break
        try:
            piece = bytes(byte[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):  # not of a byte-level vocabulary, or a part of a character
            continue
        if len(piece) <= longest and split(piece) == [piece]:
            found.append(piece)
    return found


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """docs' columns but the text, n_bytes and n_tokens; path is the tokenizer's file, which every executor has."""
    tokenizer, added = load(path)
    pieces = frequent_pieces(tokenizer, Splitter(added), most)
    lengths = {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False))}
    shared = docs.sparkSession.sparkContext.broadcast({"size": most, "lengths": lengths})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, split, lengths = of_worker(path, shared)
        of = lengths.__getitem__
        for batch in slices(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            found = [split(text or "") for text in texts]
            lengths.learn(set(chain.from_iterable(filter(None, found))))
            counts = [len(tokenizer.encode(text, add_special_tokens=False)) if pieces is None else sum(map(of, pieces)) for text, pieces in zip(texts, found)]
            sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), sizes, pa.array(counts, pa.int64())], ["doc", "n_bytes", "n_tokens"])

    rows = docs.select(whole(docs, (text_col.lower(), "n_bytes", "n_tokens")).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(count, f"doc {rows.schema['doc'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return rows.select("doc.*", "n_bytes", "n_tokens")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
