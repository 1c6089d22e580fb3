"""The chain against sums over all taggings, held-out accuracy, offsets, and odd rows."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import queries
from sluice.llm.toxicity import Chain, ToxicityModel, _document_values, fit, tagged, token_features, train

DATA = "/root/testdata/sf0.01"


def _all_taggings(emission, first, moves):
    """Marginals and expected moves by going through every tagging of every text."""
    marginal, expected = np.zeros(len(emission)), np.zeros((2, 2))
    bounds = [*np.flatnonzero(first).tolist(), len(emission)]
    for a, b in zip(bounds, bounds[1:]):
        total, own, steps = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            weight = math.exp(sum(emission[a + k] * t for k, t in enumerate(tags)) + sum(moves[x, y] for x, y in zip(tags, tags[1:])))
            total += weight
            own += weight * np.array(tags)
            for x, y in zip(tags, tags[1:]):
                steps[x, y] += weight
        marginal[a:b], expected = own / total, expected + steps / total
    return marginal, expected


def test_chain_equals_all_taggings():
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 130):
        first = np.arange(size) % 9 == 0
        emission, moves = rng.normal(0, 2, size), rng.normal(0, 1, (2, 2))
        chain = Chain(emission, first, moves)
        marginal, expected = _all_taggings(emission, first, moves)
        assert np.allclose(chain.marginal, marginal) and np.allclose(chain.moves_expected(), expected)


def test_long_chain_stays_finite():
    emission = np.tile([25.0, -25.0, 0.0], 40_000)
    first = np.zeros(len(emission), bool)
    first[0] = True
    chain = Chain(emission, first, np.array([[1.0, -3.0], [-3.0, 1.0]]))
    assert np.isfinite(chain.marginal).all() and chain.marginal[0] > 0.99 and chain.marginal[1] < 0.01


def test_features_of_words():
    def of(text):
        features, *_ = token_features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        return [set(row.tolist()) - {0} for row in features]

    plain, marked, longer = of("Nonsense **nonsense!? nonsenses")
    assert plain == marked
    assert len(plain & longer) == 4  # beginnings of 3, 4, 5 and 6, but neither the whole word nor its end
    assert of("12 %%")[0] != of("13 %%")[0] and of("") == []


def _made_up(count=600, seed=4):
    rng = np.random.default_rng(seed)
    common = ["w%dx" % k for k in range(400)]
    rows = []
    for k in range(count):
        words, toxic = list(rng.choice(common, int(rng.integers(5, 80)))), k % 4 == 0
        if toxic:
            for place in rng.integers(0, len(words), 3):
                words[place] = "grubnak" + "abcdefgh"[rng.integers(8)] * 2 + "!"
        rows.append((k, "é ".join(words), int(toxic)))
    return rows


def test_spans_are_the_planted_words(spark):
    rows = _made_up()
    model = train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]) == 1)
    odd = [(None, None, 0), (1000, "", 0), (1001, " \n", 0), (1002, "ü grubnakzz w3x", 1), (1003, "w1x " * 300_000 + "grubnakaa! grubnakbb!", 1)]
    docs = spark.createDataFrame([(k, t, "s", "p", 1) for k, t, _ in rows + odd + rows[:20]], "doc_id long, text string, score string, spans string, start int").repartition(3)
    found = tagged(docs, model).collect()
    assert len(found) == len(rows) + len(odd) + 20
    texts = {k: t for k, t, _ in rows + odd}
    for row in found:
        text = texts[row.doc_id] or ""
        assert 0 <= row.score <= 1
        hit = [text[s.start : s.end] for s in row.spans]
        assert sum(h.count("grubnak") for h in hit) == text.count("grubnak"), (row.doc_id, hit)
        assert all("grubnak" in word for h in hit for word in h.split())
    plain = {r.score for r in found if r.doc_id in (None, 1000, 1001)}
    assert len(plain) == 1 and plain.pop() < 0.5
    assert tagged(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(3, 1), (3, 0), (None, 1), (4, None)]])
def test_poor_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "x"), (3, "c"), (None, "d")], "doc_id long, text string")
    table = spark.createDataFrame([(k, 0, y) for k, y in labels], "doc_id long, quality int, toxic int")
    scores = tagged(docs, fit(docs, table)).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 and r.spans == [] for r in scores)


def test_sample_bounds_hold(spark):
    rows = _made_up(400)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels, sample_rows=200, sample_bytes=30_000)
    assert len(model.keys)
    none = fit(docs, labels, sample_bytes=0)
    assert not len(none.keys)


def test_values_of_documents():
    values = _document_values(np.array([0.2, 0.9, 0.5]), np.array([0, 0, 2, 3, 3]))
    assert np.allclose(values[:, 0], [0, 0.9, 0.5, 0]) and np.allclose(np.expm1(values[:, 1]), [0, 1.1, 0.5, 0])
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.zeros((2, 2)), np.zeros(4))
    assert np.allclose(empty.scores(np.zeros(0), np.array([0, 0])), 0.5)


def test_query_on_held_out_rows(spark):
    """Most toxic documents are caught and clean ones left alone, on rows that were not learnt from."""
    scores = {r.doc_id: r for r in queries.op13_toxic_spans(spark, DATA).collect()}
    assert len(scores) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    right = {0: [], 1: []}
    for row in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        own = scores[row.doc_id]
        assert own.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and own.predicted == int(own.score >= 0.5)
        if own.held_out:
            right[row.toxic].append(own.predicted == row.toxic)
    assert np.mean(right[0]) >= 0.97 and np.mean(right[1]) >= 0.6, {k: (len(v), np.mean(v)) for k, v in right.items()}
