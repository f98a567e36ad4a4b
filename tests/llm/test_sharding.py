import hashlib

import pytest

from verdigris.llm.sharding import BITS, directory, hashed, shard


def bits(doc_id, text):
    h = int(hashlib.md5(f"{'-' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:15], 16)
    return f"{h:060b}"


def brute(rows, limit):
    """Splits buckets one bit at a time."""
    todo, done = [("", list(range(len(rows))))], {}
    size = [len((t or "").encode()) for _, t in rows]
    code = [bits(*r) for r in rows]
    while todo:
        prefix, members = todo.pop()
        if sum(size[i] for i in members) <= limit or len(members) == 1 or len(prefix) == BITS:
            done |= dict.fromkeys(members, prefix)
        else:
            for b in "01":
                part = [i for i in members if code[i].startswith(prefix + b)]
                if part:
                    todo.append((prefix + b, part))
    return sorted((rows[i][0] or 0, done[i]) for i in range(len(rows)))


@pytest.mark.parametrize("limit", [50, 700, 10**9])
def test_against_one_bit_at_a_time(spark, docs_of, limit):
    rows = [(i, "é" * (i % 40)) for i in range(300)] + [(900, "x" * 5000), (901, None), (902, ""), (None, "abc"), (7, "é" * 7), (7, "other")]
    got = shard(docs_of(rows), limit).collect()
    assert sorted((r["doc_id"] or 0, r["shard"]) for r in got) == brute(rows, limit)
    for s in {r["shard"] for r in got}:
        own = [r for r in got if r["shard"] == s]
        assert len(own) == own[0]["shard_rows"] and sum(len((r["text"] or "").encode()) for r in own) == own[0]["shard_bytes"]
        assert own[0]["oversized"] == (own[0]["shard_bytes"] > limit) and len(s) == own[0]["shard_depth"]


def test_rows_that_no_bit_parts_stay_together(spark, docs_of):
    got = shard(docs_of([(1, "same text")] * 20 + [(2, "b")]), 20).collect()
    assert {(r["shard_rows"], r["oversized"]) for r in got if r["doc_id"] == 1} == {(20, True)} and len(got) == 21


def test_rounds_go_deeper_only_where_needed(spark, docs_of):
    full = hashed(docs_of([(i, "x") for i in range(40)] + [(50, "y" * 30)] * 3), "doc_id", "text")
    depths = [d for d, _ in directory(full.select("_hash", "_bytes"), 40)]
    assert depths[0] < depths[-1] == BITS


def test_empty_and_columns(spark, docs_of):
    assert shard(docs_of([])).count() == 0
    assert shard(docs_of([(1, "a")])).columns[-5:] == ["shard", "shard_depth", "shard_bytes", "shard_rows", "oversized"]


def test_clashing_names(spark, docs_of):
    names = ["_hash", "_bytes", "_cell", "_depth", "_shard_bytes", "doc", "a.b"]
    df = docs_of([(i, "x" * i) for i in range(30)]).selectExpr("*", *(f"{i} as `{n}`" for i, n in enumerate(names)))
    once = shard(df, 60)
    assert once.columns == [*df.columns, "shard", "shard_depth", "shard_bytes", "shard_rows", "oversized"]
    assert all(r[n] == i for r in once.collect() for i, n in enumerate(names))
    again = shard(once, 100)
    assert again.columns == once.columns and {(r["doc_id"], r["shard"]) for r in again.collect()} == {(r["doc_id"], r["shard"]) for r in shard(df, 100).collect()}


def test_the_registered_small_limit_splits(spark):
    from verdigris.llm.sharding import small_shards

    rows = small_shards(spark, "/root/testdata/sf0.001").collect()
    assert len({r["shard_depth"] for r in rows}) > 1
