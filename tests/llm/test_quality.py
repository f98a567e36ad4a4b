import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from verdigris.llm import quality_model, rules


def labelled(docs_of, spark):
    good = [(i, " ".join(f"Plain word{i * 7 + k} text, here." for k in range(20))) for i in range(60)]
    bad = [(100 + i, " ".join(f"odd{i}{k}$$$ ###" for k in range(30 + i))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad], "doc_id long, quality int, toxic int")
    return docs_of(good + bad + [(500, None), (501, ""), (502, "x" * 50_000), (3, good[3][1])]), labels


def stats_of(docs):
    return docs.select("doc_id", quality_model.statistics(F.col("text")).alias("stats"))


def plain_statistics(text):
    """The statistics of a text, from their definition."""
    t = text or ""
    words, lines, find = re.split(r"[\x20\x09-\x0D]+", t), t.split("\n"), lambda p: len(regex.findall(p, t))
    n, chars = len(words) + 5, len(t)
    root = lambda x: math.sqrt(x)
    return [
        math.log(len(set(words)) + 5) / math.log(n), math.log((len(set(lines)) + 3) / (len(lines) + 3)), math.log((chars + 25) / n), root(find(r"[.,;:]") / n), root(find(r"[!?]") / n),
        root(find(r"[^\p{L}\p{M}\p{N}\x09-\x0D\x20.,;:!?'\"()-]") / n), root(find(r"\p{Lu}") / (chars + 40)), root(find(r"[0-9]") / (chars + 40)),
    ]


def plain_scores(train, rows, shrink=0.2, ridge=0.02):
    """The posterior of two Gaussian classes with shrunk covariances, by solving with the covariances themselves."""
    x, y = np.array([plain_statistics(t) for t, _ in train]), np.array([k for _, k in train])
    parts = {}
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge**2 * np.eye(len(cov))
        parts[c] = own.mean(0), cov, len(own) / len(x)
    out = []
    for t in rows:
        v, log = np.array(plain_statistics(t)), {}
        for c, (mean, cov, share) in parts.items():
            log[c] = math.log(share) - (np.linalg.slogdet(cov)[1] + (v - mean) @ np.linalg.solve(cov, v - mean)) / 2
        out.append(1 / (1 + math.exp(min(700, max(-700, log[0] - log[1])))))
    return out


def test_statistics(spark, docs_of):
    texts = ["Plain text, here.\nAnd here!", "SHOUT!! SHOUT!!", "a | b | c $$$ ###", None, "", "éÉ ñ 12 3.5", "x\nx\nx\n", "q" * 100_000, "tab\tand  blanks "]
    got = {r["doc_id"]: r["stats"] for r in stats_of(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_statistics(t), abs=1e-9), t


def test_against_plain_discriminant_and_on_held_out_labels(spark):
    """Scores are those of a plain discriminant fitted on the same rows; held-out labels, never fitted, are predicted."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    got = {r["doc_id"]: r for r in quality_model.op6(spark, "/root/testdata/sf0.01").collect()}
    ids = sorted(texts)
    want = plain_scores([(texts[d], q) for d, q in quality.items() if not out(d)], [texts[d] for d in ids])
    assert [got[d]["score"] for d in ids] == pytest.approx(want, abs=1e-6)
    held = [d for d in quality if out(d)]
    assert all(got[d]["held_out"] == out(d) for d in ids)
    assert sum(got[d]["predicted"] == quality[d] for d in held) >= 0.97 * len(held)


def test_separates_and_is_defined_everywhere(spark, docs_of):
    docs, labels = labelled(docs_of, spark)
    rows = stats_of(docs)
    model = quality_model.fit(rows, quality_model.training_labels(labels))
    scores = {r["doc_id"]: r["score"] for r in rows.select("doc_id", model.score(F.col("stats")).alias("score")).collect()}
    assert all(scores[i] > 0.3 for i in range(60)) and all(scores[100 + i] < 0.3 for i in range(40))
    assert all(0 <= s <= 1 for s in scores.values())
    more = docs.selectExpr("*", "1 as stats", "2 as label", "3 as id", "4 as words")
    kept = quality_model.accepted(more, labels)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect()} >= set(range(60))


def test_one_class_or_none(spark, docs_of):
    rows = stats_of(docs_of([(1, "a b"), (2, "c")]))
    for labels, score in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.5)):
        model = quality_model.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["score"] for r in rows.select(model.score(F.col("stats")).alias("score")).collect()} == {score}


def test_held_out_rows(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", quality_model.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_empty_table(spark, docs_of):
    docs, labels = docs_of([]), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.accepted(docs, labels).count() == 0


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {r for r in runs if runs.count(r) > 1} if len(runs) < 2000 else set()
    covered = {i + k for i, r in enumerate(runs) if r in many for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


TEXTS = ["a b c d e f g h " * 4, "one two three four five six seven eight nine ten one two three four five six seven eight", "x\nx\n\n \n\nx\ty\r\nx", None, "", " \n ", "é😀 |b| #c", "a\x1cb\x85c\u2003d e", " ".join(map(str, range(500))), "same " * 30, "a b c d e f g h a b c d e f g h", "l1\r\nl1\nl1\r\n"]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_counts(spark, docs_of, k):
    r = docs_of([(1, TEXTS[k])]).select(*(v.alias(n) for n, v in rules.counts(F.col("text")).items())).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(TEXTS[k])


def test_hosts(spark, docs_of):
    fine = " ".join(f"w{i}" for i in range(40))
    rows = [(i, fine, "good") for i in range(50)] + [(100 + i, "short", "bad") for i in range(49)] + [(149, fine, "bad"), (200, "short", "tiny"), (201, fine, None), (202, None, None)]
    got = {r["doc_id"]: r for r in rules.judge(docs_of(rows)).collect()}
    assert all(got[i]["kept"] for i in range(50)) and not got[149]["kept"] and not got[149]["base_failed"]
    assert not got[100]["kept"] and got[201]["kept"] and not got[202]["kept"] and len(got) == len(rows)
    assert got[200]["host_rate"] < 1  # one failure does not condemn a host by itself


def test_prior():
    assert rules.prior(0, 0, 0, 0.0, 0) == (0.0, None)
    assert rules.prior(2, 20, 10, 5.0, 200) == (0.5, None)  # two hosts at the common rate
    mean, weight = rules.prior(2, 200, 100, 100.0, 20_000)  # one fails always, one never
    assert mean == 0.5 and weight == 1.0


def test_the_verdict_follows_from_the_fitted_prior(spark, docs_of):
    """The same host, one failure in four, is rejected among good hosts and kept among hosts like itself."""
    fine = " ".join(f"w{i}" for i in range(40))
    host = lambda name, n, bad, at: [(at + i, "short" if i < bad else fine, name) for i in range(n)]
    good = [x for k in range(8) for x in host(f"g{k}", 60, k % 2, 1000 * k)]
    alike = [x for k in range(8) for x in host(f"a{k}", 60, 14 + k % 3, 1000 * k)]
    one = host("x", 60, 15, 50_000)
    for others, kept in ((good, False), (alike, True)):
        got = [r for r in rules.judge(docs_of(others + one), keep=("doc_id", "source")).collect() if r["source"] == "x"]
        assert {r["host_kept"] for r in got} == {kept} and sum(r["kept"] for r in got) == (45 if kept else 0)


def test_registered_sections_reject_hosts(spark):
    rows = rules.sections(spark, "/root/testdata/sf0.01").collect()
    assert any(not r["base_failed"] and not r["kept"] for r in rows) and any(r["kept"] for r in rows)


def test_clashing_names(spark, docs_of):
    df = docs_of([(1, "a b"), (2, " ".join("abcdefghijklmnopqrstuvwxyz"))]).selectExpr("*", "1 as host", "2 as doc", "3 as kept", "4 as n_words", "5 as _text")
    got = {r["doc_id"]: r for r in rules.judge(df, keep=("doc_id", "host", "doc", "kept", "_text")).collect()}
    assert got[2]["kept"] is True and got[2]["n_words"] == 26 and (got[1]["host"], got[1]["doc"], got[1]["_text"]) == (1, 2, 5)


def test_no_rows(spark, docs_of):
    assert rules.judge(docs_of([])).count() == 0
