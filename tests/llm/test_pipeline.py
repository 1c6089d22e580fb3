"""Every stage of the pipeline, and all of them, against plain Python on rows with null and repeated ids."""

import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import bytes_words, ngram_join
from sluice.llm.ngram_join import ngram_classes
from sluice.llm.quality import fit, scored

RNG = np.random.default_rng(12)
WORDS = ["w%d" % k for k in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, extra int"


def _words(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def _text(n=40):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    base, item = _text(60), _text(30)
    near = base.split()
    near[30] = "other"
    words = item.split()
    words[10] = "changed"
    texts = [
        (1, base), (2, base), (None, base), (3, " ".join(near)), (3, _text()), (4, _text()), (4, _text()), (None, _text()), (None, None), (5, None), (6, ""), (6, ""),
        (7, _text(20) + " " + " ".join(words) + " " + _text(20)), (None, "x " + item), (8, _text(25) + " card 4111 1111 1111 1111 " + _text(10)), (8, _text(3000)), (9, "one two"), (10, "one two"),
    ]
    folder = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t or ""), "r", 1) for k, t in texts]
    spark.createDataFrame(rows + [rows[0]], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, _text(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows + [rows[0]]


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted((tuple(r)[:2] for r in df.collect()), key=repr)


def one_of_each_group(rows):
    """Rows as (id, text): by five-word shingles, similarity 0.8, the smallest id of a group (null the last)."""
    sets = []
    for _, text in rows:
        w = _words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    groups = {}
    for k, (key, text) in enumerate(rows):
        groups.setdefault(find(k), []).append((key is None, key, text))
    return [min(g, key=lambda r: r[:1] + ((r[1] or 0),)) for g in groups.values()]


def test_near_duplicates(spark, case):
    folder, rows = case
    kept = _rows(corpus_pipeline.near_duplicates(spark, _docs(spark, folder), folder))
    expected = one_of_each_group([r[:2] for r in rows])
    assert sorted((k for k, _ in kept), key=repr) == sorted((k for _, k, _ in expected), key=repr)
    assert sorted(kept, key=repr) == sorted(((k, t) for _, k, t in expected), key=repr)


def test_links_of_null_ids(spark):
    """A set that only rows without an id hold links its neighbours."""
    words = [f"v{k}" for k in range(100)]
    first, middle, last = " ".join(words), " ".join(words[4:] + ["a", "b", "c", "d"]), " ".join(words[8:] + ["a", "b", "c", "d", "e", "f", "g", "h"])
    for key in (9, None):
        docs = spark.createDataFrame([(1, first), (key, middle), (5, last), (5, "a different text under the id"), (key, middle)], "doc_id long, text string")
        found = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_classes(docs).collect())
        assert [c for _, n, c in found if n > 10] == [1] * 4, found


def test_benchmark_passages_go_whatever_the_id(spark, case):
    folder, rows = case
    kept = _rows(corpus_pipeline.benchmark_free(spark, _docs(spark, folder), folder))
    dirty = {(7, rows[12][1]), (None, rows[13][1])}
    assert kept == sorted((r[:2] for r in rows if r[:2] not in dirty), key=repr)


def test_quality_and_privacy(spark, case):
    folder, rows = case
    docs = _docs(spark, folder)
    assert _rows(corpus_pipeline.quality(spark, docs, folder)) == sorted((r[:2] for r in rows), key=repr)  # without labels all stay
    private = corpus_pipeline.private(spark, docs, folder).collect()
    assert len(private) == len(rows) and sum("4111 1111 1111 1111" in (r.text or "") for r in private) == 0
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in private)
    plain = [r for r in rows if "card" not in (r[1] or "")]
    assert {r[1] for r in plain} <= {r.text for r in private}


def test_run_equals_the_stages_in_plain_python(spark, case):
    folder, rows = case
    kept = [(k, t) for _, k, t in one_of_each_group([r[:2] for r in rows])]
    kept = [r for r in kept if r != (7, rows[12][1]) and r != (None, rows[13][1])]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, folder).collect()
    lengths = sorted((k or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in kept if "card" not in (t or ""))
    totals = {}
    for r in found:
        totals.setdefault((r.doc_id, r.sequence_id, r.offset), r.length)
    got = sorted(((r.doc_id or 0, r.length) for r in found))
    pieces = sorted((k, n) for key, size in lengths for k, n in [(key, min(4096, size - at)) for at in range(0, size, 4096)])
    assert [p for p in pieces if p not in got] == [] and len(got) == len(pieces) + 1  # and the text whose card has changed


def test_empty_tables(spark, case, tmp_path):
    folder, _ = case
    docs = _docs(spark, folder).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_quality_stage_equals_the_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = scored(docs, model).where(F.col("score") >= 0.5).count()
    assert corpus_pipeline.quality(spark, docs, sf).count() == good < docs.count()


def test_shingles_of_a_batch_take_bounded_memory():
    """What a worker holds beside a batch does not grow with it, and frequent shingles are those of a plain count."""
    rng = np.random.default_rng(2)
    column = pa.array([" ".join(map(str, rng.integers(0, 9999, 500))) for _ in range(2000)] + [None, "one two"])
    rows = dict(ngram_join._gram_sets(column, 5))
    assert len(rows) == len(column) and not len(rows[2000]) and len(rows[2001]) == 1
    bytes_words._powers.clear()
    tracemalloc.start()
    for _ in ngram_join._gram_sets(column, 5):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert column.nbytes > 4e6 and peak < 24e6

    blocks = [rng.integers(0, 3000, 5000).astype(np.uint64), np.zeros(0, np.uint64), rng.integers(0, 1500, 5000).astype(np.uint64) << np.uint64(20)]
    values, times = ngram_join._frequent(blocks, 4)
    plain = Counter(np.concatenate(blocks).tolist())
    assert dict(zip(values.tolist(), times.tolist())) == {k: n for k, n in plain.items() if n >= 4}


def test_rows_that_stay_are_picked_by_the_same_join_at_every_size(spark, capsys):
    docs = spark.createDataFrame([(1, _text(), "x", "y", 1, "z", 2), (2, None, "x", "y", 1, "z", 2)], SCHEMA)
    corpus_pipeline.near_duplicates(spark, docs, "").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
