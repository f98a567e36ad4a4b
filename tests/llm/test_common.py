import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.llm import common


def test_slices_keep_rows_whole_and_in_order():
    texts = ["a" * n for n in (0, 3, 50, 2, 2, 2, 0)] + [None]
    parts = list(common.slices([pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})], "t", 6))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(sum(len(x or "") for x in p.column("t").to_pylist()) <= 6 or p.num_rows == 1 for p in parts)


def test_word_hashes_survive_their_limit(monkeypatch):
    monkeypatch.setattr(common.WordHashes, "LIMIT", 3)
    words = pa.array([str(i) for i in range(20)])
    hashes = common.WordHashes()
    assert (hashes.of(words) == hashes.of(words)).all() and len(set(hashes.of(words).tolist())) == 20


@pytest.mark.parametrize("n", [1, 4, 8])
def test_grams_depend_on_order(n):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 30).astype(np.uint64)
    g = common.grams(words, n)
    assert len(g) == 31 - n and len(common.grams(words[: n - 1], n)) == 0
    again = common.grams(np.concatenate([words[5 : 5 + n], words[5 : 5 + n][::-1]]), n)
    assert again[0] == g[5] and (n == 1 or again[n] != g[5])


def test_staged_tables_lie_in_the_shared_folder_and_can_be_dropped(spark):
    df = common.staged(spark.range(5).select("id", F.lit(None).cast("string").alias("x")), "test")
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("x", "string")]
    common.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.staged_at).count()


def test_split_is_the_word_definition():
    texts = ["a" + chr(c) + "b" for c in range(0x300)] + ["", None, " ", " a\n\nÉ b ", "\x1cq\x85", "a\xa0b", "x"]
    words, starts = common.split(pa.array(texts))
    got = [[w.encode() for w in words.to_pylist()[a:b]] for a, b in zip(starts, starts[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]


def test_free_names(spark):
    df = spark.range(1).selectExpr("id as Row", "id as _row")
    assert common.free_name(df, "row") == "__row" and common.free_name(df, "x") == "x"


def test_hash60_is_the_md5_prefix(spark):
    import hashlib

    r = spark.sql("select 'é:1' as x").select(common.hash60(F.col("x")).alias("h")).first()
    assert r["h"] == int(hashlib.md5("é:1".encode()).hexdigest()[:15], 16)


def test_key_filters_let_all_keys_pass_and_few_others(spark, monkeypatch):
    keys = common.staged(spark.range(0, 5000).selectExpr("xxhash64(id) as key"), "keys")
    others = spark.range(5000, 25_000).selectExpr("xxhash64(id) as key")
    marks = common.key_filter(keys)
    assert keys.where(common.may_hold(marks, F.col("key"))).count() == 5000
    assert others.where(common.may_hold(marks, F.col("key"))).count() < 400
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)  # far too small: nearly all pass, no key is lost
    assert keys.where(common.may_hold(common.key_filter(keys), F.col("key"))).count() == 5000
    empty = common.staged(keys.limit(0), "no keys")
    assert others.where(common.may_hold(common.key_filter(empty), F.col("key"))).count() == 0


def test_rows_without(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a"), (2, "a")], "doc_id long, text string").selectExpr("*", "3 as row")
    gone = common.staged(rows.where("(doc_id = 1 and text = 'b') or doc_id = 2 or (doc_id is null and text is null)").selectExpr("doc_id", "xxhash64(doc_id, text) as row").distinct(), "gone")
    assert sorted(map(tuple, common.without(rows, gone).collect()), key=str) == [(1, "a", 3), (None, "a", 3)]
    assert common.without(rows, common.staged(gone.limit(0), "none")).count() == 6
