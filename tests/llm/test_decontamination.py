import random
import re

import pytest

from verdigris.llm.phrase_index import build_index, clean, proximity, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            k = min(width, len(own))
            windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["The", "of", "éa", "x1", "Zo", "Ünd", "the", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 9, 10, 14, 30]))) for i in range(25)] + [(90, None), (91, "!!"), (7, text(12)), (3, "the of")]
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(30)]
    docs += [(100 + i, f"{text(6)} {items[i][1]} {text(6)}") for i in range(20)] + [(5, None), (5, ""), (6, text(30_000)), (100, docs[0][1]), (None, items[3][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_against_brute_force(spark, docs_of, block_bytes):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = search(build_index(docs_of(docs).coalesce(2)), benchmark, block_bytes=block_bytes)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_hit"], r["items"]) for r in found.collect())
    assert got == sorted((d[0] if d[0] is not None else -1, *b) for d, b in zip(docs, brute(docs, items)))


def test_spans_are_the_hit_words(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c"), (2, "c d"), (3, "x y")], "item_id long, text string")
    r = search(build_index(docs_of([(1, "z a b c d q x y")])), items).first()
    assert [(s["first"], s["last"]) for s in r["spans"]] == [(1, 4), (6, 7)] and r["n_hit"] == 6


def test_no_documents_and_no_items(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert search(build_index(docs_of([])), items).count() == 0
    r = search(build_index(docs_of([(1, "a b c")])), items.limit(0)).first()
    assert (r["n_hit"], r["items"]) == (0, [])


def test_phrases_do_not_cross_documents(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert {r["n_hit"] for r in search(build_index(docs_of([(1, "x a b"), (2, "c d y")]).coalesce(1)), items).collect()} == {0}


def test_proximity(spark, docs_of):
    index = build_index(docs_of([(1, "a q q b"), (2, "a q q q q b"), (3, "b a"), (4, "a")]))
    assert sorted(r["doc_id"] for r in proximity(index, ["a", "b"], 3).collect()) == [1, 3]
    assert proximity(index, ["a", "nowhere"], 3).count() == 0


def test_clean_drops_what_is_hit_and_nothing_else(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = docs_of([(1, "x A,b c y"), (2, "a b d"), (None, "a b c"), (3, None), (2, "a b c")])
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(2, "a b d"), (3, None)])
