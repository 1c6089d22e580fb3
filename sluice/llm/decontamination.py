"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; positions it leaves out may differ. The masks' hashes of the test items
are joined with those of the training texts, inside the tasks that read the texts: test items come as blocks of bounded
size, one pass over the texts for each block. Around each hit the text and the item are compared word by word along the
hit's diagonal, so that substituted words are tolerated wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import mix, pieces, utf8, words
from sluice.sources.workspace import settle

#: 1: the word counts, 0: it may differ. Every stretch of 12 words or more of which 75 % are equal holds one of these whole
#: (enumerated in the tests for 12 to 23 words, of which all longer stretches are made up).
MASKS = ("11001011", "110111", "11010000101", "1101000101")
WHOLE_BELOW = 12
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 22
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words without ASCII punctuation at their ends, and how many lie before each text."""
    bare = data
    if len(data):
        space = np.isin(data, np.frombuffer(b" \t\n\r\v\f", np.uint8))
        mark = _PUNCTUATION[data]
        # Punctuation next to a space, the text's edge or other such punctuation counts as space.
        edge = space.copy()
        for _ in range(4):
            near = np.zeros(len(data), bool)
            near[1:] |= edge[:-1]
            near[:-1] |= edge[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            near[0] = near[-1] = True
            near[inner] = near[inner - 1] = True
            edge |= mark & near
        bare = np.where(edge, np.uint8(32), data)
    numbers, _, _, before = words(bare, offsets)
    return numbers, before


def whole_masks(length: int, share: float) -> list[str]:
    """Masks as long as an item of fewer than ``WHOLE_BELOW`` words: one stays whole wherever ``1 - share`` of them differ.

    The words are cut into two blocks more than words may differ, and each mask holds two of the blocks.
    """
    wrong = int(length * (1 - share) + 1e-9)
    if not wrong:
        return ["1" * length]
    blocks = np.array_split(np.arange(length), min(length, wrong + 2))
    keep = 2 if len(blocks) == wrong + 2 else 1
    if len(blocks) <= wrong:
        return ["0" * length]
    return ["".join("1" if any(k in b for b in held) else "0" for k in range(length)) for held in combinations(blocks, keep)]


def seed_hashes(numbers: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's words at each place where the whole mask fits."""
    count = len(numbers) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, np.uint64(int(mask, 2)))
    for place, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += numbers[place : place + count]
    return mix(out)


class Items:
    """The seeds of a bounded block of test items."""

    def __init__(self, ids: list, numbers: list[np.ndarray], masks: tuple[str, ...], share: float):
        self.ids, self.numbers = ids, numbers
        self.tables = []
        short = sorted({len(n) for n in numbers if 0 < len(n) < WHOLE_BELOW})
        for mask, length in [*((m, 0) for m in masks), *((m, n) for n in short for m in whole_masks(n, share))]:
            chosen = [k for k, n in enumerate(numbers) if (len(n) == length if length else len(n) >= WHOLE_BELOW)]
            hashes = [seed_hashes(numbers[k], mask) for k in chosen]
            if not sum(map(len, hashes)):
                continue
            flat = np.concatenate(hashes)
            item = np.repeat(chosen, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            order = np.argsort(flat, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(flat & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((mask, flat[order], item[order], place[order], seen))

    def overlaps(self, text: np.ndarray, hits: tuple[np.ndarray, np.ndarray], least_words: int, share: float) -> Iterator[tuple]:
        """(item, first word, words, equal words) of the best verified overlap with each item that was hit."""
        best: dict[int, tuple] = {}
        for item, shift in np.unique(np.stack(hits), axis=1).T.tolist():
            own = self.numbers[item]
            low, high = max(0, -shift), min(len(own), len(text) - shift)
            equal = own[low:high] == text[low + shift : high + shift]
            need = min(least_words, len(own))
            if len(equal) < need:
                continue
            # The longest stretch with the asked share of equal words: prefix sums of equal - share.
            gain = np.concatenate([[0.0], np.cumsum(equal - share + 1e-9)])
            lowest = np.minimum.accumulate(gain)
            first = np.searchsorted(-lowest, -gain, "left")  # leftmost place that is not above
            length = np.arange(len(gain)) - first
            stop = int(np.argmax(length))
            if length[stop] >= need:
                begin = int(first[stop])
                same = int(equal[begin:stop].sum())
                if item not in best or (same, stop - begin) > (best[item][3], best[item][2]):
                    best[item] = (item, low + shift + begin, stop - begin, same)
        yield from best.values()

    def find(self, numbers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shift) of all seed hits in texts that follow each other; a seed across two texts is left out."""
        texts, items, shifts = [], [], []
        for mask, flat, item, place, seen in self.tables:
            hashes = seed_hashes(numbers, mask)
            at = np.flatnonzero(seen[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            left, right = np.searchsorted(flat, hashes[at], "left"), np.searchsorted(flat, hashes[at], "right")
            count = right - left
            at, left, count = at[count > 0], left[count > 0], count[count > 0]
            text = np.searchsorted(before, at, "right") - 1
            inside = at + len(mask) <= before[text + 1]
            at, left, count, text = at[inside], left[inside], count[inside], text[inside]
            rank = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
            texts.append(np.repeat(text, count))
            items.append(item[rank])
            shifts.append(np.repeat(at - before[text], count) - place[rank])
        if not texts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(texts), np.concatenate(items), np.concatenate(shifts)


def benchmark_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", least_words: int = 12, share: float = 0.75,
    masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, n_equal, coverage``: the best overlap of each text with each item it holds.

    Words are compared in lower case (A-Z) without ASCII punctuation at their ends (up to four marks). An overlap is a
    stretch of at least ``least_words`` words (or the whole of a shorter item) of which at least ``share`` are equal,
    at equal distances; with the given ``masks`` none from 12 words and 75 % on is missed. ``coverage``: equal words by the item's words. Null or empty
    texts and items overlap with nothing; rows with a null id count, as do repeated rows, each with rows of its own;
    repeated items give repeated rows. Other columns are not read. Empty tables give an empty table.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.coalesce(F.col(item_text_column).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    schema = "doc_id long, item_id long, first_word long, n_words long, n_equal long, coverage double"
    result = None
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        data, offsets = utf8(pa.array([row["text"] for row in held], pa.string()))
        numbers, before = plain_words(data, offsets)
        ready = Items([row["item_id"] for row in held], [numbers[a:b] for a, b in zip(before[:-1], before[1:])], masks, share)
        shared = docs.sparkSession.sparkContext.broadcast(ready)

        def scan(batches, shared=shared):
            ready = shared.value
            for batch in batches:
                out = [[] for _ in range(6)]
                data, offsets = utf8(batch.column(1))
                ids = batch.column(0).to_pylist()
                for first, last in pieces(offsets):
                    here = offsets[first : last + 1] - offsets[first]
                    numbers, before = plain_words(data[offsets[first] : offsets[last]], here)
                    texts, items, shifts = ready.find(numbers, before)
                    for text in np.unique(texts).tolist():
                        own = texts == text
                        found = ready.overlaps(numbers[before[text] : before[text + 1]], (items[own], shifts[own]), least_words, share)
                        for item, start, length, same in found:
                            values = (ids[first + text], ready.ids[item], start, length, same, same / len(ready.numbers[item]))
                            for column, value in zip(out, values):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(out)],
                    ["doc_id", "item_id", "first_word", "n_words", "n_equal", "coverage"],
                )

        found = rows.mapInArrow(scan, schema)
        result = found if result is None else result.unionByName(found)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows of ids that overlap with a test item, all columns kept. Null ids stay."""
    hit = settle(benchmark_overlaps(docs, benchmark, id_column, **options).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, docs[id_column] == hit["_hit"], "left_anti")
