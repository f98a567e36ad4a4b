import random

import pytest

from verdigris.llm.components import components
from verdigris.llm.jaccard_join import Join, one_of_each, prefix_length


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(docs))


def near_copies(rng, base, n, edits):
    """Copies of copies, so that the ends of a chain are far apart."""
    out, words = [], base.split()
    for _ in range(n):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        out.append(" ".join(words))
    return out


def cases(seed):
    rng = random.Random(seed)
    text = lambda n, size=60: " ".join(f"v{rng.randrange(size)}" for _ in range(n))
    docs = [text(rng.choice([1, 3, 4, 5, 8, 30, 120])) for _ in range(60)]
    for n, edits in ((80, 1), (80, 2), (200, 3)):
        docs += near_copies(rng, text(n), 12, edits)
    common = text(50)
    docs += [f"{common} {text(6)}" for _ in range(15)] + [common] * 5
    docs += ["", "  ", None, "a b", "A B", "a b c", "É b c d", "é b c d", text(20_000)]
    docs = list(enumerate(docs))
    return docs + [(3, docs[3][1]), (200, docs[70][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs_of, seed):
    docs = cases(seed)
    got = Join(docs_of(docs).repartition(5)).result().collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(docs)


def linked(docs):
    """How many other rows each row is linked with."""
    sets = [shingles(t) for _, t in docs]
    out = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                out[i] += 1
                out[j] += 1
    return sorted((d, n) for (d, _), n in zip(docs, out))


@pytest.mark.parametrize("block", [128, 3])
def test_links_against_brute_force(spark, docs_of, block):
    docs = cases(3)
    rng, base = random.Random(4), [f"x{k}" for k in range(100)]
    # near copies that differ at one place each: all of them are linked with one another
    docs += [(1000 + k, " ".join([*base[:p], f"y{k}", *base[p + 1 :]])) for k in range(30) for p in [rng.randrange(100)]]
    docs += [(1100 + k, docs[-1][1]) for k in range(3)]
    join = Join(docs_of(docs).repartition(5), block_of=block)
    got = join.result().collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == linked(docs)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(docs)
    pairs = [(r["u"], r["v"]) for r in join.links().collect()]
    assert len(pairs) == len(set(pairs)) and all(u < v for u, v in pairs)


def test_shared_shingles_behind_the_other_prefix_count(spark, docs_of):
    base = " ".join(f"x{k}" for k in range(50))
    docs = [(1, base), (2, base + " a b c d e f")]
    got = Join(docs_of(docs)).result().collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(1, 1, 1), (2, 1, 1)]


def test_one_of_each(spark, docs_of):
    docs = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, "x y z u"), (7, None), (8, None), (9, "x y z u"), (2, "A b c d e f g")]
    table = docs_of(docs)
    kept = one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(2, "A b c d e f g"), (7, ""), (8, ""), (9, "x y z u")]


def test_empty_table_and_nulls(spark, docs_of):
    assert Join(docs_of([])).result().count() == 0
    got = {(r["doc_id"], r["component_id"]) for r in Join(docs_of([(None, "a b c d"), (4, "a b c d"), (None, "q r s t")])).result().collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_prefixes():
    assert [prefix_length(n) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + rng.randrange(i)) for i in range(1, 40)] + [(500, 500)]
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
