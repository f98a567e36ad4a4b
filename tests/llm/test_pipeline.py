import re
import zlib
from collections import Counter

import pytest
import test_mixing
import test_sharding
from test_quality import plain_scores

import corpus_pipeline
from verdigris.llm import common, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Every stage's result on its own input."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF).cache()))
        docs = out[-1][1]
    return out


def test_stages(spark, steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "source_mixing", "sharding"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.count() > 0


def pairs_linked(texts, size=5, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                yield i, j


def plain_quality(docs, labels):
    train = [(docs[d], q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5]
    return {d for d, score in zip(docs, plain_scores(train, docs.values())) if score >= 0.3}


def plain_near_duplicates(docs):
    ids = sorted(docs)
    least = {d: d for d in ids}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, j in pairs_linked([docs[d] for d in ids]):
        a, b = top(ids[i]), top(ids[j])
        least[max(a, b)] = min(a, b)
    return {d for d in ids if top(d) == d}


def plain_decontamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for t in items:
        w = words(t)
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    return {d for d, t in docs.items() if not hit(words(t))}


def test_run_against_a_plain_version(spark):
    """Every stage written again without Spark, on what the plain version of the stage before has kept."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs, source = {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["source"] for r in rows}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(docs) == len(rows)
    for keep in (lambda d: plain_quality(d, labels), plain_near_duplicates, lambda d: plain_decontamination(d, items)):
        kept = keep(docs)
        assert len(kept) < len(docs)
        docs = {d: docs[d] for d in docs if d in kept}
    mixed = [d for d, (name, _, k) in zip(sorted(docs), sorted_by_id(test_mixing.brute([(d, t, source[d]) for d, t in docs.items()]), docs, source)) for _ in range(k)]
    want = Counter(test_sharding.brute([(d, docs[d]) for d in mixed], 8 << 20))
    got = Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def sorted_by_id(brute, docs, source):
    by_name = {name: row for row in brute for name in [row[0]]}
    return [by_name[repr((d, docs[d], source[d]))] for d in sorted(docs)]


def test_stages_keep_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[0][1].collect()}
    wrong = [d for d, q in labels.items() if (d in kept) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels)


def test_mix_and_shards(spark, steps):
    before, after = steps[3]
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(copies) <= {r["doc_id"] for r in before.collect()} and max(copies.values()) <= 2
    words = after.select(mixing.word_count(after.text).alias("n")).agg({"n": "sum"}).first()[0]
    total = before.select(mixing.word_count(before.text).alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(words - 1.5 * total) < 0.1 * total
    assert steps[4][1].count() == after.count() and "shard" in steps[4][1].columns


def test_a_run_leaves_its_result_only(spark, steps):
    before = list(common.LIVE)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in steps[4][1].collect())
    assert [x for x in common.LIVE if x not in before] == [(spark, got.staged_at)]
