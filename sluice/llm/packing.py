"""Sequence packing by bounded-space online best-fit.

A fixed number of sequences is open. A bitset has a bit for each amount of free space that an open sequence has; the
lowest set bit at or above a piece's length is its best fit. Where nothing fits and no further sequence may be opened,
the fullest one is closed. Each task packs what it reads. What is still open when a task ends is packed again by fewer
tasks with the same rule, so that small tasks leave no loosely filled sequences.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.workspace import settle

CAPACITY, OPEN, END = 4096, 256, 1
_WORDS_KEPT = 1_000_000
#: Punctuation (no apostrophe) between an ASCII letter or digit and white space: the rules cut before it.
_TAIL = re.compile(rb"([a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=\s|$)")


class WordTokens:
    """Token ids of texts, as little-endian 32-bit numbers.

    The vocabulary's rules never look across ASCII white space and drop it, so the ids of a text are those of its words
    (in lower case, which the rules ask for, and without the punctuation at their ends, which is a word of its own), and a worker encodes the words that it meets once, up to a bound.
    """

    _in_worker: dict[tuple[str, int], WordTokens] = {}

    @classmethod
    def of(cls, path: str, kept: int = _WORDS_KEPT) -> WordTokens:
        """The worker's own, kept from task to task."""
        if (path, kept) not in cls._in_worker:
            cls._in_worker[path, kept] = cls(path, kept)
        return cls._in_worker[path, kept]

    @classmethod
    def release(cls) -> None:
        """Give the worker's memory back, in tasks after the last that encodes."""
        cls._in_worker.clear()

    def __init__(self, path: str, kept: int = _WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.kept = Tokenizer.from_file(path), {}, kept

    @staticmethod
    def _words(text: str) -> list[bytes]:
        data = text.encode()
        if b"<|" not in data:  # special tokens are read before letters are lowered
            data = _TAIL.sub(rb"\1 \2", data.lower())
        return data.split()

    def _fresh(self, new: list[bytes]) -> dict[bytes, bytes]:
        fresh = {}
        for k in range(0, len(new), 100_000):
            some = new[k : k + 100_000]
            for word, coded in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                fresh[word] = struct.pack(f"<{len(coded.ids)}I", *coded.ids)
        return fresh

    def stretch(self, texts: list[str]) -> list[bytes]:
        """Of each text; their new words are encoded together, and stay if there is room for all of them."""
        words = list(map(self._words, texts))
        fresh = self._fresh(list(set().union(*words).difference(self.known)))
        self.known.update(fresh)
        coded = [b"".join(map(self.known.__getitem__, w)) for w in words]
        if len(self.known) > self.kept:
            for word in fresh:
                del self.known[word]
        return coded

    def __call__(self, text: str) -> bytes:
        words = self._words(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        fresh = self._fresh(list({w for w in words if w not in self.known}))
        if len(self.known) + len(fresh) <= self.kept:
            self.known.update(fresh)
            return b"".join(map(self.known.__getitem__, words))
        return b"".join([fresh.get(w) or self.known.get(w, b"") for w in words])


class BestFit:
    """Open sequences by free space; ``place`` gives back the sequences that it closed."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free = 0  # bit k: some open sequence has k places left
        self.open: dict[int, list[list]] = defaultdict(list)
        self.count = 0

    def _take(self, space: int) -> list:
        sequence = self.open[space].pop()
        if not self.open[space]:
            del self.open[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return sequence

    def place(self, piece, length: int) -> list[list]:
        closed, fitting = [], self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.count == self.most_open:
                closed.append(self._take((self.free & -self.free).bit_length() - 1))
            space, sequence = self.capacity, []
        sequence.append((piece, self.capacity - space))
        space -= length
        if space:
            self.open[space].append(sequence)
            self.free |= 1 << space
            self.count += 1
        else:
            closed.append(sequence)
        return closed

    def rest(self) -> list[list]:
        return [sequence for space in sorted(self.open) for sequence in self.open[space]]


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _packed(pieces: Iterator[tuple], capacity: int, most_open: int, level: int, keep_rest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of closed sequences; what stays open at the end has no sequence_id if ``keep_rest``."""
    fit, rows, task = BestFit(capacity, most_open), [], TaskContext.get().partitionId()
    number = (level << 62) + (task << 32)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)

    for piece in pieces:
        for sequence in fit.place(piece, piece[3]):
            rows += [(*p, number, offset) for p, offset in sequence]
            number += 1
        if len(rows) > 20_000:
            yield batch()
            rows = []
    for sequence in fit.rest():
        rows += [(*p, None if keep_rest else number, offset) for p, offset in sequence]
        number += 1
    yield batch()


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, most_open: int = OPEN, end_id: int = END,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each row of ``docs``.

    A text's ids, then ``end_id``. Only a longer text is cut, into pieces of ``capacity``. Null and empty texts are the
    end id alone. Null ids and repeated rows are packed like others. Other columns are not read; an empty table gives
    an empty table. ``ids_crc32`` is of the piece's ids as little-endian unsigned 32-bit numbers.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        tokens, end = WordTokens.of(tokenizer_path), end_id.to_bytes(4, "little")

        def pieces():
            for batch in batches:
                for k in range(len(batch)):
                    ids = tokens(batch.column(1)[k].as_py() or "") + end
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield batch.column(0)[k].as_py(), number, at // 4, len(part) // 4, zlib.crc32(part)

        yield from _packed(pieces(), capacity, most_open, 0, True)

    def again(batches):
        def pieces():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

        yield from _packed(pieces(), capacity, most_open, 1, False)

    first = settle(rows.mapInArrow(run, _SCHEMA))
    # At most `most_open` sequences of every task are left: a task in 64 takes the rest of 64.
    left = first.where("sequence_id IS NULL")
    tasks = len(first.inputFiles())  # each has written a file
    left = left.coalesce(max(1, -(-tasks // 64))).mapInArrow(again, _SCHEMA)
    return first.where("sequence_id IS NOT NULL").unionByName(left)
