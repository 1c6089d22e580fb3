"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Fingerprints are hashes of ``K`` words; of every two neighbouring ones the smaller is kept (ties: the
later), so a shared run of ``K + 1`` words is always noticed. The templates' fingerprints form an inverted index, which
every task holds; its size is checked. Hits on nearby diagonals make a
candidate place, and there the template is aligned with the text within a band around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import pieces, utf8
from sluice.llm.decontamination import plain_words, seed_hashes

K, BAND = 3, 8
MOST_TEMPLATE_WORDS = 2_000_000

#: Short public license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3."),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def winnowed(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Places of the kept fingerprints of texts that follow each other: of two neighbours of a text the smaller stays."""
    starts, ends = before[:-1], np.maximum(before[:-1], before[1:] - K + 1)
    inside = np.zeros(len(hashes) + 1, np.int32)
    live = ends > starts
    np.add.at(inside, starts[live], 1)
    np.add.at(inside, ends[live], -1)
    held = np.cumsum(inside[:-1]) > 0
    highest = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where(held, hashes, highest)
    after, prior = np.append(own[1:], highest), np.append(highest, own[:-1])
    # Alone in its text, smaller than the next, or not above the one before.
    return np.flatnonzero(held & ((own < after) | (own <= prior)))


def aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int, int]:
    """(equal words, first, end, inserted words) of the best alignment of the template in the text near a diagonal.

    Template word i lies within ``band`` of text word i + shift. The equal words are as many as possible, and of such
    alignments the one with the fewest text words between the first and the last equal one is taken, then the one that
    begins nearest to the diagonal.
    """
    width = 2 * band + 1
    worst = (0, 0, -1, -1)
    row = [worst] * width  # (equal, -words spanned, first, last) at text place i - 1 + shift - band + k
    for i in range(len(template)):
        new = []
        for k in range(width):
            at = i + shift - band + k
            best = row[k + 1] if k + 1 < width else worst  # the template's word is missing
            if k and new[k - 1] > best:
                best = new[k - 1]  # a word of the text is extra
            if 0 <= at < len(text) and text[at] == template[i]:
                equal, _, first, _ = row[k]
                first = at if first < 0 else first
                best = max(best, (equal + 1, first - at, first, at))
            new.append(best)
        row = new
    equal, _, first, last = max(row, key=lambda r: (r[0], r[1], -abs(r[2] - shift)))
    return equal, first, last + 1, last + 1 - first - equal


class Index:
    """Fingerprints of templates: hash to (template, word place)."""

    def __init__(self, names: list[str], texts: list[str]):
        data, offsets = utf8(pa.array(texts, pa.string()))
        numbers, before = plain_words(data, offsets)
        self.names = names
        self.words = [numbers[a:b] for a, b in zip(before[:-1], before[1:])]
        hashes = [seed_hashes(w, "1" * K) for w in self.words]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        # Templates keep all their hashes: what a text keeps depends on its surroundings.
        item = np.repeat(np.arange(len(hashes)), np.diff(bounds))
        place = np.arange(len(flat)) - bounds[item]
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.place = flat[order], item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(flat & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def candidates(self, numbers: np.ndarray, before: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By text: (template, diagonal) of the kept fingerprints that templates have."""
        hashes = seed_hashes(numbers, "1" * K)
        at = winnowed(hashes, before)
        at = at[self.seen[(hashes[at] & np.uint64(0xFFFFF)).astype(np.int64)]]
        left, right = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        found: dict[int, set] = {}
        for place, a, b in zip(at.tolist(), left.tolist(), right.tolist()):
            text = int(np.searchsorted(before, place, "right")) - 1
            for k in range(a, b):
                found.setdefault(text, set()).add((int(self.item[k]), place - int(before[text]) - int(self.place[k])))
        return {text: sorted(pairs) for text, pairs in found.items()}


def license_matches(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text", least_coverage: float = 0.8,
) -> DataFrame:
    """``doc_id, template, first_word, end_word, n_equal, n_inserted, coverage`` for each place of a template in a text.

    Words are compared in lower case (A-Z) without ASCII punctuation at their ends. ``coverage``: aligned equal words by
    the template's words; places below ``least_coverage`` are left out, and of overlapping places of one template the
    best (ties: the first) stays. Null and empty texts, and templates of fewer than ``K`` words, match nothing. Null ids
    and repeated rows give rows of their own; other columns are not read; an empty table gives an empty table. The
    templates are a list in memory and may have two million words in all.
    """
    if sum(len(text.split()) for _, text in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("Too many template words for an index in every task; call once for each part of the templates.")
    shared = docs.sparkSession.sparkContext.broadcast(Index([n for n, _ in templates], [t for _, t in templates]))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "template", "first_word", "end_word", "n_equal", "n_inserted", "coverage"]

    def scan(batches):
        index = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for first, last in pieces(offsets):
                here = offsets[first : last + 1] - offsets[first]
                numbers, before = plain_words(data[offsets[first] : offsets[last]], here)
                for text, pairs in index.candidates(numbers, before).items():
                    own, places, last_seen = numbers[before[text] : before[text + 1]], [], None
                    for item, shift in pairs:
                        if last_seen and last_seen[0] == item and shift - last_seen[1] < BAND // 2:
                            continue  # the band around the earlier diagonal holds this one
                        last_seen = (item, shift)
                        words = index.words[item]
                        low = max(0, shift - BAND)
                        equal, a, b, extra = aligned(words, own[low : shift + len(words) + BAND + 1], shift - low)
                        if equal >= least_coverage * len(words):
                            places.append((item, -equal, a + low, b + low, extra))
                    taken: list[tuple] = []
                    for item, equal, a, b, extra in sorted(places):
                        if all(item != other or b <= c or a >= d for other, c, d in taken):
                            taken.append((item, a, b))
                            out.append((ids[first + text], index.names[item], a, b, -equal, extra, -equal / len(index.words[item])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return rows.mapInArrow(scan, "doc_id long, template string, first_word long, end_word long, n_equal long, n_inserted long, coverage double")
