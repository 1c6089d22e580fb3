"""Alignment of tokens against one text and one pair of tokens at a time."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import alignment, queries
from sluice.llm.alignment import Pair, aligned, byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_a string, block string, key string"
ODD = [
    None, "", " ", "a", " a", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> <s></s> <unk> <0x41>", "▁ is no space", "漢字 and 😀😀",
    "é é combining é", " 　  wide", "\x00\x1c\x7f", "it's we'll I'd", "1234567890 " * 40, "no" + "o" * 3000, " " * 2500 + "x", "=" * 4000,
]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, tools):
    """(ids, byte ranges) of both kinds, or nothing."""
    first, second = tools
    letters, data = byte_letters(), (" " + (text or "")).encode()
    a = first.encode(data.decode(), add_special_tokens=False).ids if text else []
    b = second.encode(text) if text else []
    a_bytes = [bytes(letters[c] for c in first.id_to_token(k)) for k in a]
    b_bytes = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return []
    out = []
    for ids, parts in ((a, a_bytes), (b, b_bytes)):
        at, rows = 0, []
        for k, part in zip(ids, parts):
            rows.append((k, at, at + len(part)))
            at += len(part)
        out.append(rows)
    return out


def one_by_one(rows, tools):
    links, basics, counts = [], [], Counter()
    for key, text in rows:
        both = tokens(text, tools)
        if not both:
            links.append([])
            basics.append((key, 0, 0, 0, ""))
            continue
        a, b = both
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in shared:
            groups.append(",".join(str(k) for k, s, _ in a if low <= s < high) + "|" + ",".join(str(k) for k, s, _ in b if low <= s < high))
            low = high
        own = []
        for k, s, e in a:
            own += [(k, j) for j, t, f in b if s < f and t < e]
        links.append(own)
        counts.update(set(own))
        basics.append((key, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (k, _), n in counts.items():
        most[k] = max(most[k], n)
    return [
        (key, a, b, g, len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), digest)
        for (key, a, b, g, digest), own in zip(basics, links)
    ]


def _rows():
    rng = random.Random(6)
    words = ["alpha", "Beta", "gam", "mas", "über", "naïve", "x", "12", "...", "(see)", "it's", "\n", "  ", "日本", "straße"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    return rows + rows[20:30]


@pytest.mark.parametrize("block_bytes, block_rows, slice_bytes", [(16_000_000, 100_000, 1_500_000), (500, 100_000, 300), (10**9, 2, 1)])
def test_equals_one_by_one(spark, tools, monkeypatch, block_bytes, block_rows, slice_bytes):
    """The result does not depend on blocks and slices."""
    rows = _rows() if slice_bytes > 1 else _rows()[:40]
    docs = spark.createDataFrame([(k, t, "p", "q", "r") for k, t in rows], SCHEMA).repartition(3)
    found = aligned(docs, A, B, block_bytes=block_bytes, block_rows=block_rows).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(one_by_one(rows, tools), key=repr)


def test_slices(tools):
    """A text's tokens are its own, whatever stands beside it in a slice."""
    pair = Pair.of(A, B)
    texts = [t or "" for t in ODD]
    counts, digests, links = alignment.align(texts, pair)
    for k, text in enumerate(texts):
        alone, digest, own = alignment.align([text], pair)
        assert digest == [digests[k]] and all(alone[n][0] == counts[n][k] for n in alone)
        assert Counter(own.column("key").to_pylist()) == Counter(x for t, x in zip(links.column("text").to_pylist(), links.column("key").to_pylist()) if t == k)


def test_fast_encoder_is_the_file(tools):
    pair, rng = Pair.of(A, B), random.Random(1)
    assert pair.fast is not None
    letters = "ab Z09'\n\t  　▁é漢😀<|endoftext|>.,'s're\x00\x1c"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pair.fast.encode_ordinary(" " + text) == tools[0].encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_long_text_and_empty_table(spark, tools):
    long = "many words of a long text, and then some more; " * 20_000
    rows = [(1, long), (2, "z" * 200_000), (3, "many words")]
    found = {r.doc_id: r for r in aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert found[1].n_a == len(tools[0].encode(" " + long, add_special_tokens=False).ids) and found[1].n_b == len(tools[1].encode(long))
    assert found[2].n_links > 0 and found[1].n_best <= found[1].n_links <= found[1].count_sum
    assert aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    nothing = aligned(spark.createDataFrame([(5, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert sorted((tuple(r) for r in nothing), key=repr) == sorted([(5, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)


def test_query_equals_one_by_one(spark, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, aligned(docs, A, B).collect())) == sorted(one_by_one(rows, tools))
    whole = queries.op11_token_alignment(spark, SMALL)
    assert whole.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
