import hashlib
import random

import numpy as np
import pytest

from verdigris.llm.fm_index import FMIndex
from verdigris.llm.substring_dedup import WINDOW, dedup


def brute(docs):
    first, words = {}, [(t or "").split() for _, t in docs]
    key = lambda d: 1 << 62 if d is None else d
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - WINDOW + 1):
            g = tuple(w[i : i + WINDOW])
            first[g] = min(first.get(g, (key(d), i)), (key(d), i))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] < (key(d), i):
                gone |= set(range(i, i + WINDOW))
        out.append((key(d), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    text = lambda n, size: " ".join(f"é{rng.randrange(size)}" for _ in range(n))
    passages = [text(n, 500) for n in (19, 20, 21, 25, 40, 90, 300)]
    docs = [(i, f"{text(rng.randrange(30), 50)} {rng.choice(passages)} {text(rng.randrange(30), 50)} {rng.choice(passages)}") for i in range(60)]
    docs += [(70 + i, " ".join(["a"] * n)) for i, n in enumerate((5, 20, 21, 60))] + [(80, " ".join(["a b c"] * 40)), (81, "x\ty\nz\x0bq " * 30), (82, None), (83, ""), (84, text(20_000, 300))]
    docs += [(90 + i, docs[i][1]) for i in range(5)] + [(3, docs[3][1])] * 2 + [(None, docs[5][1])]
    return docs


@pytest.mark.parametrize("seed,most,shard_words", [(1, 1_000, 200_000), (2, 2, 200_000), (3, 1_000, 500)])
def test_against_brute_force(spark, docs_of, seed, most, shard_words):
    docs = cases(seed)
    got = dedup(docs_of(docs).repartition(4), most=most, shard_words=shard_words).collect()
    rows = sorted((1 << 62 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert rows == brute(docs)


def test_one_id_with_two_texts(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = {r["n_words"]: r["n_removed"] for r in dedup(docs_of([(1, passage), (1, f"lead {passage}")])).collect()}
    assert rows == {30: 0, 31: 30}


def test_empty_table(spark, docs_of):
    assert dedup(docs_of([])).count() == 0


def test_hot_minimizers_are_cut_as_often_as_it_takes(spark, docs_of):
    rng = random.Random(8)
    middle = [f"m{i}" for i in range(8)]
    near = lambda k: [f"n{rng.randrange(2)}" for _ in range(k)]
    docs = [(i, " ".join([*near(rng.randrange(16)), *middle, *near(rng.randrange(16))])) for i in range(150)]
    got = dedup(docs_of(docs).repartition(3), most=1, shard_words=300).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute(docs)


def test_many_equal_rows(spark, docs_of):
    text = " ".join(f"w{i % 150}" for i in range(400))
    docs = [(7, text)] * 3000 + [(9, text), (2, "x " + text)]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup(docs_of(docs).repartition(5)).collect()}
    assert got == {(2, 401, 250), (7, 400, 400), (9, 400, 400)}


def test_clashing_names(spark, docs_of):
    df = docs_of([(1, "a b")]).selectExpr("*", *(f"0 as {n}" for n in ("key", "late", "first", "windows", "runs", "kept", "id", "minimizer")))
    assert [tuple(r) for r in dedup(df).collect()] == [(1, 2, 0, b"a b")]


@pytest.mark.parametrize("width", [5, 20])
def test_matching_statistics(width):
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 6, 400), 0)
    text[100:140], place = text[300:340], rng.permutation(401)
    index = FMIndex(text, place, width)
    stream = np.concatenate([rng.integers(0, 8, 60), text[90:150]])
    ends = np.arange(len(stream) + 1)
    for times in (1, 2):
        length, begin = index.matching_statistics(stream, ends, times)
        for e in ends.tolist():
            at = lambda k: [s for s in range(401 - k) if (text[s : s + k] == stream[e - k : e]).all() and (text[s : s + k] > 0).all()]  # noqa: E731, B023
            want = max(k for k in range(min(e, width) + 1) if k == 0 or len(at(k)) >= times)
            assert length[e] == want
            if want == width and times == 2:
                assert index.least_place(begin[e : e + 1])[0] == min(place[s] for s in at(width))
