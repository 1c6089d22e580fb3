"""Each operator against a one-by-one version on small rows, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import attention, chat, pii
from sluice.llm.attention import language_scores
from sluice.llm.components import components
from sluice.llm.decontamination import benchmark_overlaps
from sluice.llm.licenses import license_matches
from sluice.llm.neighbours import nearest
from sluice.llm.ngram_join import ngram_classes
from sluice.llm.packing import pack_documents
from sluice.llm.quality import fit, scored
from sluice.llm.suffixes import repeated_bytes

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RNG = np.random.default_rng(5)
WORDS = ["w%d" % k for k in range(300)] + ["É́té", "x y", "<|endoftext|>", "it's", "a.b,c!!", "\x1c", "Σ"]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, component_id string, set_key string, place string"


def _texts():
    base = [" ".join(RNG.choice(WORDS, 60)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one two", "ONE two", "a" * 700, "ab" * 3000, " ".join(RNG.choice(WORDS, 4000))]
    for text in base:
        words = text.split()
        texts += [text, text, " ".join(words[:-2]), " ".join(words[:30]) + " mid " + " ".join(words[31:]), " ".join(RNG.choice(WORDS, 20)) + " " + text]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", "y", "z") for k, t in enumerate(_texts())]
    return spark.createDataFrame(rows + [rows[3], rows[9]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().translate(LOWER).split()


def test_join(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for k, text in rows:
        w = _words(text)
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                    root[a] = root[b] = min(root[a], root[b])
    found = sorted(map(tuple, ngram_classes(docs).collect()))
    assert found == sorted((k, len(sets[k]), root[k]) for k, _ in rows)
    assert ngram_classes(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (7, 7), (None, 3)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: 0 for k in range(41)} | {90: 90, 100: 90}


def test_repeated_bytes(docs, none):
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])
    seen, expected = set(), {}
    for k, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(b for b, m in zip(data, mark) if not m)
        expected[k] = (len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest(), kept)
    found = repeated_bytes(docs).collect()
    assert len(found) == docs.count()
    assert all(tuple(r)[1:] == (*expected[r.doc_id][:4], bytearray(expected[r.doc_id][4])) for r in found)
    assert repeated_bytes(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = pack_documents(docs, TOKENIZER, capacity=256, most_open=3).collect()
    expected = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected[r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(none, TOKENIZER).count() == 0


def test_chat_comes_back(spark):
    said = [None, "", " ", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [/INST", "[TURN x] [/TURN]", "x " * 4000, "[/SYS]"]
    rows = [(c, t, RNG.choice(["user", "assistant", "system", "tool] x", ""]).item(), said[RNG.integers(len(said))], "e") for c in range(30) for t in range(9)]
    rows += [(None, None, None, None, "e"), rows[0], (99, 1, "user", "b", "e"), (99, 1, "user", "a", "e")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    turns = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    found = chat.digests(chat.format_conversations(table, stretch=4)).collect()
    assert len(found) == len(turns)
    for r in found:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns[r.conv_id])
        assert (r.n_turns, r.turns_sha256) == (len(turns[r.conv_id]), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_neighbours(spark):
    vectors = RNG.standard_normal((400, 16))
    vectors[50:90] = vectors[0]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    odd = [(900, None, 1), (920, [0.0] * 16, 1), (940, [float("nan")] * 16, 1), (960, [None] * 16, 1), (980, [1.0, 2.0], 1), rows[3]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    found, hits, total = {}, 0, 0
    for r in nearest(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 20))
    for q, got in found.items():
        got.sort()
        scores = vectors @ vectors[q]
        want = sorted((k for k in range(400) if k != q), key=lambda k: (-round(scores[k], 9), k))[:20]
        hits += len(set(want) & {v for _, v, _ in got})
        total += 20
        assert [r for r, _, _ in got] == list(range(1, 21)) and all(abs(scores[v] - s) < 1e-9 for _, v, s in got)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:]))
    assert hits >= 0.9 * total
    assert nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_benchmark_overlaps_tolerate_substitutions(spark, none):
    item = [f"i{k}" for k in range(30)]
    changed = ["zz" if k % 7 == 3 else w for k, w in enumerate(item)]
    texts = ["pre " * 50 + " ".join(item) + " post", "PRE " + " ".join(changed).upper() + "!!", " ".join(item[:9]) + " and else", None, "", "short item here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "Short, item here.")], "item_id long, text string")
    for size in (2_000_000, 20):  # one block, several blocks
        found = {(r.doc_id, r.item_id): r for r in benchmark_overlaps(docs, bench, block_words=size).collect()}
        assert set(found) == {(0, 1), (1, 1), (5, 4)}
        assert (found[0, 1].first_word, found[0, 1].n_words, found[0, 1].n_equal) == (50, 30, 30)
        assert found[1, 1].n_equal == 26
    assert benchmark_overlaps(none, bench).count() == 0 and benchmark_overlaps(docs, bench.limit(0)).count() == 0


def test_masks_are_hit_wherever_a_quarter_differs():
    from sluice.llm.decontamination import MASKS, WHOLE_BELOW, whole_masks

    def held(equal, mask, places):
        return any(all(equal[p + k] for k, bit in enumerate(mask) if bit == "1") for p in places)

    # The most equal words without a mask, by dynamic programming over the last eleven words. From 24 words on, a stretch
    # falls into stretches of 12 to 23 words, one of which has at least the same share.
    widest = max(map(len, MASKS))
    states = np.arange(1 << (widest - 1))
    most = np.where(states == 0, 0, -1000)
    for length in range(1, 24):
        new = np.full(len(states), -1000)
        for bit in (0, 1):
            word = (states << 1) | bit
            free = np.all([(word & int(m, 2)) != int(m, 2) for m in MASKS], axis=0)
            np.maximum.at(new, (word & (len(states) - 1))[free], (most + bit)[free])
        most = new
        assert length < 12 or most.max() < 0.75 * length
    for length in range(1, WHOLE_BELOW):
        for wrong in itertools.combinations(range(length), length // 4):
            assert any(held([k not in wrong for k in range(length)], m, [0]) for m in whole_masks(length, 0.75))


def test_benchmark_overlaps_are_those_of_all_diagonals(spark):
    rng, rows = np.random.default_rng(8), []
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 30])]
    for item in items:
        for _ in range(25):
            text = list(item)
            for k in rng.choice(len(text), rng.integers(0, len(text) // 3 + 1), replace=False):
                text[k] = "zz"
            begin = rng.integers(0, max(1, len(text) - 13))
            rows.append(["p"] * rng.integers(0, 5) + text[begin:] + ["q"] * rng.integers(0, 5))
        rows.append(["zz" if k % 4 == 3 else w for k, w in enumerate(item)])
    rows += [rng.choice([w for item in items[-3:] for w in item], 40).tolist() for _ in range(30)]
    expected = {}
    for d, text in enumerate(rows):
        for i, item in enumerate(items):
            for shift in range(-len(item), len(text)):
                equal = [text[shift + k] == w for k, w in enumerate(item) if 0 <= shift + k < len(text)]
                ends = [(b - a, sum(equal[a:b])) for a in range(len(equal)) for b in range(a + min(12, len(item)), len(equal) + 1)]
                longest = max([(n, -k, s) for k, (n, s) in enumerate(ends) if 4 * s >= 3 * n], default=None)
                if longest:
                    expected[d, i] = max(expected.get((d, i), 0), longest[2])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.n_equal for r in benchmark_overlaps(docs, bench).collect()} == expected


def test_licenses(spark, none):
    texts = ["x y\nLicensed under the Apache License, Version 2.0.\nz", "licensed under the very Apache license version 2.0", None, "", "the license of the version", "RELEASED UNDER THE MIT LICENSE!! " * 2]
    found = license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.template, r.first_word, r.end_word, r.n_inserted) for r in found)
    assert got == [(0, "Apache-2.0", 2, 9, 0), (1, "Apache-2.0", 0, 8, 1), (5, "MIT", 0, 5, 0), (5, "MIT", 5, 10, 0)]
    assert license_matches(none).count() == 0


def _luhn(digits):
    return sum((d * 2 - 9 if d > 4 else d * 2) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4111 1111 1111 1111, again 4111 1111 1111 1111; no card 4111111111111112", "born 1999-02-28 and 31/12/2001, never 30/02/2001", "at 10.0.255.1 or 300.1.1.1", "a.b@mail.example.com +1 (555) 010-9999", None, "", "plain text 12", "born 1999-02-28"]
    rows = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    out = {r.doc_id: r for r in pii.pseudonymised(rows.drop("n_replaced"), "key", count_column="n_replaced").collect()}
    assert [out[k].n_replaced for k in range(8)] == [2, 2, 1, 2, 0, 0, 0, 1]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", out[0].text)
    assert cards[0] == cards[1] != "4111 1111 1111 1111" and _luhn(cards[0].replace(" ", "")) and "4111111111111112" in out[0].text
    assert out[7].text.split()[-1] == out[1].text.split()[1] != "1999-02-28" and "30/02/2001" in out[1].text
    assert all(int(p) < 256 for p in out[2].text.split()[1].split(".")) and "300.1.1.1" in out[2].text
    assert re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\.[a-z]{7}\.com \+1 \(\d{3}\) \d{3}-\d{4}", out[3].text)
    assert (out[4].text, out[5].text, out[6].text) == (None, "", "plain text 12")
    other = pii.pseudonymised(rows.drop("n_replaced"), "other key").where("doc_id = 7").first().text
    assert other != out[7].text


def test_cards_beside_other_digits(spark):
    card, bare, amex, long = "4111 1111 1111 1111", "4111111111111111", "3782-822463-10005", "4111 1111 1111 1111 110"
    texts = [f"{card} 12/25", f"{bare} 123", f"{amex} 1234", f"2 {card} 7", f"123456 {card}", f"{card} {card}", f"{card} 12/25/2024", f"{card} 10.0.0.1", f"{card} 1.b@mail.org", f"{card} 3rd", long, f"{bare}-12", "4111 1111 1111 1112 12/25", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(rows, "key", count_column="n").collect()}
    alone = pii.pseudonymised(spark.createDataFrame([(0, card), (1, bare), (2, amex)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    new_card, new_bare, new_amex = (r.text for r in alone)
    assert [out[k].text for k in (0, 1, 2, 3, 4, 5, 9, 11)] == [f"{new_card} 12/25", f"{new_bare} 123", f"{new_amex} 1234", f"2 {new_card} 7", f"123456 {new_card}", f"{new_card} {new_card}", f"{new_card} 3rd", f"{new_bare}-12"]
    assert [out[k].n for k in range(13)] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 1, 1, 1, 0]
    assert all(out[k].text.startswith(new_card + " ") and texts[k].split()[-1] not in out[k].text for k in (6, 7, 8))
    assert _luhn(out[10].text.replace(" ", "")) == _luhn(long.replace(" ", "")) and out[12].text == texts[12]


def test_feistel_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert numbers.select(pii.feistel_text(F.col("t"), "k", "x").alias("p")).distinct().count() == 1000
    days = spark.range(146_097).select(pii.feistel_pair(F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773, "k", "d").alias("p"))
    assert days.distinct().count() == 146_097


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = scored(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    right = rows.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    blank = fit(docs, labels.limit(0))
    assert [r.score for r in scored(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), blank).collect()] == [0.5, 0.5]


def test_language_scores(docs, none):
    found = language_scores(docs, TOKENIZER, frequent=20).collect()
    rows = [(r.doc_id, _words(r.text)) for r in docs.collect()]
    counts, ends = Counter(), 0
    for k, w in rows:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(w)
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    words = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        w = words[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + math.log10((ends + 0.5) / (total + 0.5 * (kinds + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in counts for x in w) + 1, total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert language_scores(none, TOKENIZER).count() == 0


def test_every_training_text_reaches_the_score(spark):
    held = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 5 == 1)
    said = ["the old harbour light", "seven green bottles fall", "a quiet winter morning"]
    train = [k for k in range(30) if zlib.crc32(str(k).encode()) % 5 != 1][: len(said)]

    def scores(left_out):
        rows = [(k, t if n != left_out else "") for n, (k, t) in enumerate(zip(train, said))] + [(held, said[left_out])]
        return next(r.score for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect() if r.held_out)

    whole = spark.createDataFrame([*zip(train, said), *((k, t) for k, t in zip([k for k in range(100, 300) if zlib.crc32(str(k).encode()) % 5 == 1], said))], "doc_id long, text string")
    with_all = [r.score for r in language_scores(whole, TOKENIZER).orderBy("doc_id").collect() if r.held_out]
    assert all(scores(n) < with_all[n] for n in range(len(said)))


def test_windows_see_half_a_window_back_at_least():
    at, inside = attention.windows(np.array([0, 300, 310]))
    scored = [p for row, live in zip(at[:, attention.CONTEXT :], inside[:, attention.CONTEXT :]) for p in row[live]]
    assert sorted(scored) == list(range(310))
    for row, live in zip(at, inside):
        for p in row[attention.CONTEXT :][live[attention.CONTEXT :]]:
            begin = 0 if p < 300 else 300
            assert sum(live & (row <= p)) >= min(64, p - begin) + 1


def test_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_scores(docs, TOKENIZER).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    left = {r.doc_id for r in docs.collect()}
    assert left < kept and len(left) > len(kept) / 2
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == left


def test_gradients_are_those_of_the_loss():
    """Against differences of a one-by-one attention over the windows of two long texts and short ones."""
    rng = np.random.default_rng(4)
    offsets = np.array([0, 1, 70, 270, 275])
    at, inside = attention.windows(offsets)
    at, ids = np.clip(at, 0, 274), rng.integers(0, 50, 275)
    groups, targets, class_after = ids % 7, ids % 11, np.log(rng.random((7, attention.CLASSES)).astype(np.float32) + 0.1)
    weights = {k: w + rng.standard_normal(w.shape).astype(np.float32) * np.float32(0.1) for k, w in attention.fresh_weights().items()}
    late = at[:, attention.CONTEXT :]

    def loss(weights):
        w, total = {k: x.astype(float) for k, x in weights.items()}, []
        for row, live in zip(at, inside):
            x = w["embed"][ids[row]] + w["place"]
            for p in range(attention.CONTEXT, attention.WINDOW):
                if live[p]:
                    seen = [k for k in range(p + 1) if live[k]]
                    share = np.exp((x[p] @ w["q"]) @ (x[seen] @ w["k"]).T / np.sqrt(attention.WIDTH))
                    logits = (share / share.sum() @ (x[seen] @ w["v"]) + x[p]) @ w["out"] + class_after[groups[row[p]]]
                    total.append(np.log(np.exp(logits).sum()) - logits[targets[row[p]]])
        return np.mean(total)

    grad = attention.gradients(weights, ids[at], groups[late], targets[late], inside, class_after)
    for name, w in weights.items():
        place = np.unravel_index(np.argmax(np.abs(grad[name])), w.shape)
        up, down = ({**weights, name: w.astype(float)} for _ in range(2))
        up[name][place] += 1e-5
        down[name][place] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, grad[name][place], rel_tol=1e-2), name


def test_scores_and_gradients_share_the_powers_of_what_was_counted():
    """Scores against a one-by-one attention; the powers of the counted part are taken once, by whoever has them."""
    rng = np.random.default_rng(8)
    size, offsets = 400, np.array([0, 1, 70, 270, 275])
    ids = rng.integers(0, size, 275)
    ids[offsets[1:] - 1] = size
    vocabulary = attention.Vocabulary(np.bincount(ids, minlength=size + 1).astype(float), rng.random(size + 1) < 0.5)
    vocabulary.learn(rng.integers(0, 40, (attention.GROUPS, attention.COLUMNS)).astype(float))
    weights = {k: w + rng.standard_normal(w.shape).astype(np.float32) * np.float32(0.2) for k, w in attention.fresh_weights().items()}
    w, plain = {k: x.astype(float) for k, x in weights.items()}, []
    for begin, end in zip(offsets, offsets[1:]):
        before, total = np.append(size, ids[begin : end - 1]), 0.0
        for p in range(end - begin):
            first = p // attention.STEP * attention.STEP - attention.CONTEXT
            seen = np.arange(max(0, first), p + 1)
            x = w["embed"][vocabulary.inputs[before[seen]]] + w["place"][seen - first]
            share = np.exp((x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(attention.WIDTH))
            logits = (share / share.sum() @ (x @ w["v"]) + x[-1]) @ w["out"] + vocabulary.class_after[vocabulary.groups[before[p]]]
            inside = vocabulary.inside(ids[begin + p : begin + p + 1], before[p : p + 1])[0]
            total += logits[vocabulary.classes[ids[begin + p]]] - np.log(np.exp(logits).sum()) + inside
        plain.append(total)
    assert np.allclose(attention.log_probabilities(weights, vocabulary, ids, offsets), plain, rtol=1e-5)

    at, inside = attention.windows(offsets)
    at = np.clip(at, 0, 274)
    late = at[:, attention.CONTEXT :]
    given = weights, vocabulary.inputs[ids[at]], vocabulary.groups[ids[late]], vocabulary.classes[ids[late]], inside
    whole, handed = attention.gradients(*given, vocabulary.class_after), attention.gradients(*given, None, np.exp(vocabulary.class_after))
    assert all(np.array_equal(whole[k], handed[k]) and np.abs(whole[k]).max() > 0 for k in weights)


def test_ids_come_back_from_their_bytes():
    texts = pa.array(["one two three", None, "", "a" * 700, "É́té <|endoftext|> x"])
    tokens = attention.WordTokens(TOKENIZER)
    size = tokens.tokenizer.get_vocab_size()
    for kind in ("<u2", "<u4"):
        coded, sizes = attention._encoded(texts, tokens, kind)
        (first, last, ids, places), = attention._subwords(pa.array(coded, pa.binary()), pa.array(sizes), kind, size)
        plain = [np.frombuffer(tokens(t or ""), "<u4").tolist() + [size] for t in texts.to_pylist()]
        assert (first, last, ids.tolist()) == (0, 5, sum(plain, [])) and np.diff(places).tolist() == [len(x) for x in plain]


def test_encoding_holds_a_bounded_stretch(spark, monkeypatch):
    """However many rows a batch has, their subwords are handed on by the stretch; the words kept stay within their bound."""
    stretches = []

    def encoded(texts, tokens, kind, whole=attention._encoded):
        found = whole(texts, tokens, kind)
        stretches.append((int(found[1].sum()), len(tokens.known)))
        return found

    class Seen(Exception):
        pass

    def settled(df):
        plans.append(df)
        if len(plans) == 2:
            raise Seen
        return df

    plans, run = [], {}
    monkeypatch.setattr(attention, "settle", settled)
    monkeypatch.setattr(attention, "_encoded", encoded)
    monkeypatch.setattr(attention, "_WORDS_KEPT", 500, raising=False)
    maps = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, *a, **b: (run.__setitem__(f.__name__, f), maps(df, f, *a, **b))[1])
    texts = [" ".join(f"w{k}x{n}" for n in range(100)) for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with pytest.raises(Seen):
        language_scores(docs, TOKENIZER)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts), pa.array([False] * 2000), pa.array(range(2000))], ["doc_id", "text", "held_out", "row"])
    made = pa.Table.from_batches(run["encode"]([batch])).filter(pa.compute.field("ids").is_valid())
    assert made["row"].to_pylist() == list(range(2000)) and made["size"].to_pylist() == [len(t) for t in texts]
    assert max(size for size, _ in stretches) <= 1 << 18 and max(known for _, known in stretches) <= 500
    plain = attention.WordTokens(TOKENIZER)
    assert all(np.frombuffer(ids, "<u2").tolist() == np.frombuffer(plain(t), "<u4").tolist() for ids, t in zip(made["ids"].to_pylist(), texts))
