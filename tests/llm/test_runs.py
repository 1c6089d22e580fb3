"""Periodic runs against a period-by-period scan, on made-up texts and on whole tables with planted endings."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import queries
from sluice.llm.runs import branching_squares, periodic_runs, planted, run_digests

SMALL = "/root/testdata/sf0.001"


def scan(words, least_words=6, least_repeats=4):
    """Every period, every stretch."""
    found = []
    for q in range(1, len(words) // least_repeats + 1):
        same = "".join("1" if a == b else "0" for a, b in zip(words, words[q:]))
        for m in re.finditer("1+", same):
            start, length = m.start(), m.end() - m.start() + q
            part = words[start : start + length]
            if length >= max(least_words, least_repeats * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def shorten(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def ending(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _texts():
    rng = random.Random(8)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é", "x " * 30_000]
    texts += ["y " * 9 + "a b " * 9 + "a b c " * 9, "ab" * 40_000, " ".join(rng.choice("abc") for _ in range(3000))]
    for _ in range(300):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 90))]
        at, size, copies = rng.randrange(len(words)), rng.randint(1, 9), rng.randint(1, 9)
        texts.append(" ".join(words[:at] + (words[at : at + size] * copies) + words[at + size // 2 :]))
    return texts


@pytest.mark.parametrize("least_words, least_repeats", [(6, 4), (2, 2), (5, 3)])
def test_equals_scan(spark, least_words, least_repeats):
    texts = [t for t in _texts() if t is None or len(t) < 3000] + (["x " * 3000] if least_repeats == 4 else [])
    rows = [(k if k % 7 else None, t, 5, "c", "r") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, n_words int, collapsed string, runs string").repartition(3)
    expected = []
    for key, text, *_ in rows + rows[:40]:
        words = split(text)
        runs = scan(words, least_words, least_repeats)
        expected.append((key, len(words), runs, shorten(words, runs)))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs, least_words=least_words, least_repeats=least_repeats).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_long_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x " * 400_000), (2, "x y " * 200_000 + "z"), (3, "ab" * 500_000)], "doc_id long, text string")
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()}
    assert found[1] == (400_000, [(0, 400_000, 1)], "x")
    assert found[2] == (400_001, [(0, 400_000, 2)], "x y z")
    assert found[3][:2] == (1, [])
    assert run_digests(periodic_runs(planted(docs.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least_repeats=1)


def test_squares_are_few():
    """A text of one word has a branching square for each half length, and no more tests than places."""
    ends, periods = branching_squares(np.zeros(101, np.int64))
    assert sorted(periods.tolist()) == list(range(1, 51)) and set(ends.tolist()) == {101}


def test_query_equals_scan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = []
    for row in docs.select("doc_id", "text").collect():
        words = ending(row.doc_id, split(row.text))
        runs = scan(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, shorten(words, runs))]
        expected.append((row.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest))
    found = queries.op12_periodic_runs(spark, SMALL)
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(expected)
    assert found.where("n_runs > 0").count() > 10


def test_strongest_run_breaks_ties(spark):
    docs = spark.createDataFrame([(1, "a a a a a a z b b b b b b z c d c d c d c d c d c d"), (None, None)], "doc_id long, text string")
    best = run_digests(periodic_runs(docs)).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert tuple(best[0])[1:6] == (3, 0, 6, 1, 6000) and tuple(best[1])[1:6] == (0, None, None, None, None)
    assert best[1].runs_sha256 == best[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
