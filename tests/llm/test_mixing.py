import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.llm.mixing import copies, keyed, mix, plain_share, plan, targets


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water-filling by rounds: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def keys(spark, rows):
    return spark.createDataFrame([("t" if s is None else "s" + s, n) for s, n in rows], "_source string, _size long")


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1000, "b": 1, "c": 1}, {"a": 0, "b": 50}, {f"s{i}": (i * 37) % 90 for i in range(20)}, {"A": 5, "a": 500, "é": 40},
])
def test_targets_are_water_filling(spark, sizes):
    got = {r["_source"]: r["_target"] for r in targets(keys(spark, list(sizes.items())), (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    want = filled(sizes)
    assert got == {("t" if s is None else "s" + s): pytest.approx(want[s]) for s in sizes}


def table(docs_of):
    rows = [(i, "w " * (1 + i % 40), "big" if i % 3 else f"src{i % 5}") for i in range(900)]
    return docs_of(rows + [(2000, "w " * 500, "src1"), (2001, None, "src1"), (2002, "", "big"), (2003, "a b", None), (5, rows[5][1], rows[5][2])])


def rows_of(df):
    full = keyed(df, 17, plain_share(F.col("text")), id_col="doc_id", source_col="source", text_col="text")
    return full.join(plan(full.drop("doc")), "_source").select("doc.doc_id", "doc.text", "_source", "_size", "_target", "_epochs", copies().alias("_copies"))


def test_taken_comes_near_targets(spark, docs_of):
    rows = rows_of(table(docs_of)).collect()
    assert len(rows) == 905 and all(r["_copies"] <= 2 for r in rows if r["_size"])
    for source in {r["_source"] for r in rows}:
        own = [r for r in rows if r["_source"] == source]
        assert abs(sum(r["_size"] * r["_copies"] for r in own) - own[0]["_target"]) <= max(r["_size"] for r in own) + 1e-6
        split = {r["_copies"] for r in own if r["_size"]}
        assert max(split) - min(split) <= 1  # complete epochs before any fraction


def brute(docs):
    """(id, size, taken) of every row, by one pass over each source in the order of the keys."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}
    totals = {}
    for r in docs:
        totals[r[2]] = totals.get(r[2], 0) + size[r]
    target, out = filled(totals), {}
    for s in totals:
        own = Counter(r for r in docs if r[2] == s)

        def key(r):
            u = (int(hashlib.md5(f"17:{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
            marks = len(re.findall(r"[#*$%&|<>!]", r[1] or ""))
            return max(-math.log(u) / max(0.1, 1 - 5.0 * marks / max(len(r[1] or ""), 1)), 1e-18)

        epochs = int(target[s] // totals[s]) if totals[s] else 0
        rest, before = target[s] - epochs * totals[s], 0
        for r in sorted(own, key=key):
            more = rest > 0 and before + size[r] * own[r] / 2 <= rest
            before += size[r] * own[r]
            out[r] = epochs + more
    return sorted((repr(r), size[r], out[r]) for r in docs)


def test_ties_and_repeated_rows_in_any_order(spark, docs_of):
    rng = random.Random(3)
    rows = [(1, "w " * n, "a") for n in (3, 7, 11, 20, 50) for _ in range(2)] + [(None, "v " * n, "a") for n in (4, 4, 9, 30)]
    rows += [(i, "x " * (1 + i % 9) + "#" * (i % 3), rng.choice(["a", "b", "c"])) for i in range(2, 60)] + [(70, "same row", "b")] * 40 + [(71, None, None), (71, "", None)]
    want = brute(rows)
    for parts, order in ((1, rows), (5, rows[::-1]), (3, rng.sample(rows, len(rows)))):
        df = docs_of(order).repartition(parts)
        got = sorted((repr((r["doc_id"], r["text"], None if r["_source"] == "t" else r["_source"][1:])), r["_size"], r["_copies"]) for r in rows_of(df).collect())
        assert got == want
        mixed = Counter(repr((r["doc_id"], r["text"], r["source"])) for r in mix(df).collect())
        taken = Counter()
        for name, _, k in want:
            taken[name] += k
        assert mixed == +taken


def test_reruns_agree_and_the_mix_repeats_rows(spark, docs_of):
    df = table(docs_of)
    once, again = (sorted((r["doc_id"], r["_copies"]) for r in rows_of(x).collect()) for x in (df, df.repartition(7)))
    assert once == again
    out = mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(k for _, k in once)


def test_clashing_names(spark, docs_of):
    names = ["_source", "_size", "_key", "_row", "_epochs", "_last", "_copy", "col", "doc", "_target"]
    df = table(docs_of)
    more = df.selectExpr("*", *(f"{i} as {n}" for i, n in enumerate(names)))
    got = mix(more)
    assert got.columns == more.columns and all(r[n] == i for r in got.collect() for i, n in enumerate(names))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in mix(df).collect())


def test_better_documents_come_first(spark, docs_of):
    rows = [(i, "word " * 20 if i % 2 else "#$% " * 20, "a") for i in range(600)]
    taken = {r["doc_id"]: r["_copies"] for r in rows_of(docs_of([*rows, *((1000 + i, "w " * 100, "b") for i in range(90))])).where("_source = 'sa'").collect()}
    assert sum(taken[i] for i in range(600) if i % 2) > sum(taken[i] for i in range(600) if not i % 2) + 50


def test_empty(spark, docs_of):
    assert mix(docs_of([])).count() == 0 and rows_of(docs_of([])).count() == 0
