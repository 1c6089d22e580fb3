"""Alignment of two tokenizations of the same texts, as Arrow tables inside tasks and partial counts between them.

The token lists of a slice of texts are flattened, with the text that each token comes from. Cumulative sums of token
bytes, started anew for each text, are the places where tokens end; a hash join of (text, end) keys finds the places
where tokens of both kinds end. They cut a text into groups. Two tokens overlap exactly where one of the places at which
any token ends lies inside or at the end of both, so each such place is one link. Links are counted per text and pair by
a grouped table, and per block of texts; only a block's distinct pairs travel. Spark sums the blocks' counts and sends
every block its own pairs back, with which the texts of the block are finished.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import pieces, utf8
from sluice.sources.workspace import settle

BLOCK_BYTES, BLOCK_ROWS, SLICE_BYTES = 16_000_000, 100_000, 1_500_000
_PAIRS_AT_ONCE = 100_000
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast encoder takes time quadratic in such a stretch; the other one does not.
_LONG = re.compile(rb"\S{2000}|\s{2000}")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes, decimal names and sizes of the tokens of one kind, by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.bytes = pa.array(tokens, pa.binary())
        self.names = pa.array([str(k) for k in range(len(tokens))])
        self.lengths = pa.array([len(t) for t in tokens], pa.int64())


class Pair:
    """Both tokenizers of a worker."""

    _in_worker: dict[tuple[str, str], Pair] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        """The worker's own, kept from task to task."""
        if (a_path, b_path) not in cls._in_worker:
            cls._in_worker[a_path, b_path] = cls(a_path, b_path)
        return cls._in_worker[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        known: dict[int, bytes] = {}
        for token, place in described["model"]["vocab"].items():
            known[place] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        special = set()
        for added in described.get("added_tokens", []):
            known[added["id"]] = added["content"].encode()
            special.add(added["id"])
        self.a = Vocabulary([known.get(k, b"") for k in range(max(known) + 1)])
        self.fast = self._fast(described, {t: k for k, t in known.items() if k not in special})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.b = Vocabulary([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)])

    @staticmethod
    def _fast(described: dict, ranks: dict[bytes, int]):
        """The same vocabulary in the quicker encoder, which needs merges in the order of the ids they make."""
        import tiktoken

        cut, model = described.get("pre_tokenizer") or {}, described["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if described.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        if made != sorted(made) or len(set(made)) != len(ranks) - 256 or min(made, default=0) < 256:
            return None
        return tiktoken.Encoding("fast", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of space and text by the first, and of the text by the second, which adds the space itself."""
        first = []
        for text in texts:
            if self.fast is None or _LONG.search(text.encode()):
                first.append(self.slow.encode(" " + text, add_special_tokens=False).ids)
            else:
                first.append(self.fast.encode_ordinary(" " + text))
        return _lists(first), _lists(self.pieces.encode(texts, num_threads=1) if texts else [])


def _lists(rows: list[list[int]]) -> pa.ListArray:
    places = np.zeros(len(rows) + 1, np.int32)
    places[1:] = np.cumsum([len(r) for r in rows])
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(places[-1]))))


def _joined(lists: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, vocabulary.bytes.take(lists.values)), b"")


def _ends(lists: pa.ListArray, vocabulary: Vocabulary, base: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(ids, text, end inside the text) of all tokens."""
    ids, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
    return ids, text, pc.subtract(pc.cumulative_sum(vocabulary.lengths.take(ids)), base.take(text))


def _group_texts(ids: pa.Array, last: np.ndarray, names: pa.Array) -> pa.Array:
    """Ids of each group in decimal, by commas; ``last`` is the place of each group's last token."""
    places = np.append(0, last + 1).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(places), names.take(ids)), ",")


def align(texts: list[str], pair: Pair) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Counts of each text, its digest of groups, and (text, pair, links) of its distinct pairs.

    A pair is one number, first id x second vocabulary's size + second id.
    """
    n = len(texts)
    counts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * n
    first, second = pair.encode(texts)
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    usable = pc.and_(pc.equal(_joined(first, pair.a), whole), pc.equal(_joined(second, pair.b), whole))
    usable = pc.and_(usable, pc.greater(pc.binary_length(whole), 1))
    own = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    empty = pa.table({"text": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    if not len(own):
        return counts, digests, empty
    first, second = first.filter(usable), second.filter(usable)
    sizes = pc.binary_length(whole.filter(usable)).cast(pa.int64())
    base = pc.subtract(pc.cumulative_sum(sizes), sizes)
    a_ids, a_text, a_end = _ends(first, pair.a, base)
    b_ids, b_text, b_end = _ends(second, pair.b, base)

    def side(text, end, name):
        return pa.table({"text": text, "end": end, name: pa.array(np.arange(len(end)))})

    both = side(a_text, a_end, "a").join(side(b_text, b_end, "b"), keys=["text", "end"], join_type="inner", use_threads=False)
    a_last, b_last = np.sort(both.column("a").to_numpy()), np.sort(both.column("b").to_numpy())
    a_of, b_of, a_number, b_number = (x.to_numpy() for x in (a_text, b_text, a_ids, b_ids))
    groups = np.bincount(a_of[a_last], minlength=len(own))
    named = pc.binary_join_element_wise(_group_texts(a_ids, a_last, pair.a.names), _group_texts(b_ids, b_last, pair.b.names), "|")
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)).astype(np.int32)), named), ";")
    for k, line in zip(own.tolist(), lines.to_pylist()):
        digests[k] = hashlib.sha256(line.encode()).hexdigest()

    # Each place where a token ends is one link; places where both end are counted with the first kind.
    starts = base.to_numpy()
    a_place, b_place = a_end.to_numpy() + starts[a_of], b_end.to_numpy() + starts[b_of]
    alone = np.ones(len(b_place), bool)
    alone[b_last] = False
    alone = np.flatnonzero(alone)
    a_link = np.concatenate([np.arange(len(a_place)), np.searchsorted(a_place, b_place[alone])])
    b_link = np.concatenate([np.searchsorted(b_place, a_place), alone])
    key = a_number[a_link].astype(np.int64) * pair.b.size + b_number[b_link]
    links = pa.table({"text": own[a_of[a_link]], "key": key}).group_by(["text", "key"], use_threads=False).aggregate([([], "count_all")])
    counts["n_a"][own], counts["n_b"][own] = np.bincount(a_of, minlength=len(own)), np.bincount(b_of, minlength=len(own))
    counts["n_groups"][own], counts["n_links"][own] = groups, np.bincount(a_of[a_link], minlength=len(own))
    return counts, digests, links.rename_columns(["text", "key", "links"])


def _narrow(values: np.ndarray, small) -> bytes:
    """The numbers as ``small`` ones if all fit, else with 32 bits."""
    return values.astype(small if not len(values) or values.max() <= np.iinfo(small).max else np.uint32).tobytes()


def _wide(data: bytes, count: int, small) -> np.ndarray:
    width = len(data) // count if count else np.dtype(small).itemsize
    return np.frombuffer(data, small if width == np.dtype(small).itemsize else np.uint32).astype(np.int64)


_DOCUMENT = ["n_a", "n_b", "n_groups", "n_links"]
_FIRST = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in _DOCUMENT], ("groups_sha256", pa.string())]
    + [("pairs", pa.int32()), ("places", pa.binary()), ("times", pa.binary()), ("place", pa.int32()), ("key", pa.int64()), ("held", pa.int64())]
)
_FIRST_KIND = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs int, places binary, times binary, place int, key long, held long"
_KIND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Block:
    """Texts of a task, until there are enough of them for a block of their own."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows = number, 0, 0
        self.ids, self.counts, self.digests, self.links = [], {n: [] for n in _DOCUMENT}, [], []

    def add(self, ids: pa.Array, size: int, counts: dict[str, np.ndarray], digests: list[str], links: pa.Table) -> None:
        self.links.append(links.set_column(0, "text", pc.add(links.column("text"), self.rows)))
        self.bytes, self.rows = self.bytes + size, self.rows + len(ids)
        self.ids.append(ids)
        self.digests += digests
        for name in _DOCUMENT:
            self.counts[name].append(counts[name])

    def batches(self):
        """One row for each text with its pairs as places in the block's list, and one row for each pair of the list."""
        links = pa.concat_tables(self.links)
        partial = links.group_by("key", use_threads=False).aggregate([([], "count_all")]).sort_by("key")
        keys = partial.column("key").to_numpy()
        text, place = links.column("text").to_numpy(), np.searchsorted(keys, links.column("key").to_numpy())
        order = np.argsort(text * max(1, len(keys)) + place)
        text, place, times = text[order], place[order], links.column("links").to_numpy()[order]
        bounds = np.searchsorted(text, np.arange(self.rows + 1)).tolist()
        steps = np.diff(place, prepend=0)
        heads = np.array(bounds[:-1])[np.diff(bounds) > 0]
        steps[heads] = place[heads]
        rows = {
            "block": pa.repeat(pa.scalar(self.number, pa.int64()), self.rows), "doc_id": pa.concat_arrays(self.ids), "groups_sha256": pa.array(self.digests, pa.string()),
            "pairs": pa.array(np.diff(bounds), pa.int32()),
            "places": pa.array([_narrow(steps[a:b], np.uint16) for a, b in zip(bounds, bounds[1:])], pa.binary()),
            "times": pa.array([_narrow(times[a:b], np.uint8) for a, b in zip(bounds, bounds[1:])], pa.binary()),
        } | {name: pa.array(np.concatenate(self.counts[name])) for name in _DOCUMENT}
        yield _filled(rows, self.rows)
        for at in range(0, len(keys), _PAIRS_AT_ONCE):
            part = partial.slice(at, _PAIRS_AT_ONCE)
            size = len(part)
            yield _filled(
                {
                    "block": pa.repeat(pa.scalar(self.number, pa.int64()), size), "place": pa.array(np.arange(at, at + size), pa.int32()),
                    "key": part.column("key").combine_chunks(), "held": part.column("count_all").combine_chunks(),
                },
                size,
            )


def _filled(columns: dict[str, pa.Array], size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _FIRST], schema=_FIRST)


def _finish(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over each text's links, from its block's pairs."""
    size = 1 + (pc.max(pairs.column("place")).as_py() if len(pairs) else 0)
    held, best = np.zeros(size, np.int64), np.zeros(size, bool)
    place = pairs.column("place").to_numpy()
    held[place], best[place] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for count, places, times in zip(*(texts.column(n).to_pylist() for n in ("pairs", "places", "times"))):
        own, often = np.cumsum(_wide(places, count, np.uint16)), _wide(times, count, np.uint8)
        sums.append(int((held[own] * often).sum()))
        bests.append(int(often[best[own]].sum()))
    columns = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    names = ["doc_id", *_DOCUMENT, "n_best", "count_sum", "groups_sha256"]
    return pa.table({n: columns[n] if n in columns else texts.column(n) for n in names})


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text",
    block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece model that puts a space
    before a text. Special tokens' strings inside a text are plain text. Groups end where tokens of both kinds end;
    links are the pairs of token occurrences that share bytes. ``count_sum`` adds up, over a text's links, in how many
    rows the pair of ids is linked; ``n_best`` counts the links whose pair has the first id's highest such number.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and
    an empty digest. Null ids and repeated rows are rows like others, and each counts. Other columns are not read,
    whatever their names; an empty table gives an empty table.

    Texts are read and encoded once. A block (``block_bytes`` of text or ``block_rows`` rows, and at least one text) is
    finished in one task; a task holds one block's distinct pairs of each text, and the tokens of about a megabyte of text
    or of one longer text. The list of best numbers that is broadcast has a row for each id of the first vocabulary at most.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def encode(batches):
        pair, number = Pair.of(a_path, b_path), TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for low, high in pieces(offsets, SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                size = int(offsets[high] - offsets[low])
                if block.rows and (block.bytes + size > block_bytes or block.rows + high - low > block_rows):
                    yield from block.batches()
                    block = _Block(block.number + 1)
                block.add(batch.column(0).slice(low, high - low), size, *align(texts, pair))
        if block.rows:
            yield from block.batches()

    first = settle(rows.mapInArrow(encode, _FIRST_KIND))
    pairs = first.where("key IS NOT NULL").select("block", "place", "key", "held")
    a_size = Pair.of(a_path, b_path).b.size
    totals = pairs.groupBy("key").agg(F.sum("held").alias("total")).withColumn("a", F.expr(f"key div {a_size}"))
    top = totals.groupBy("a").agg(F.max("total").alias("most"))
    judged = totals.join(F.broadcast(top), "a").select("key", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.join(judged, "key").select(F.col("block").alias("own"), "place", "total", "best")
    texts = first.where("key IS NULL").select("block", "doc_id", *_DOCUMENT, "groups_sha256", "pairs", "places", "times")
    return texts.groupBy("block").cogroup(back.groupBy("own")).applyInArrow(_finish, _KIND)
