"""Character trigrams as numbers: counted and weighed on whole Arrow batches, no row for a trigram.

A trigram is three code points in one 63-bit number, exactly. A profile of few different characters becomes a cube that is
looked up by three small character numbers; one of many characters is searched in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_CUBE_CELLS = 1 << 24
#: A hit adds this beside its weight, so that a language without any hit can be told from one with the sum 0.
_HIT = 1 << 42


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after each other, and where each text begins (null: empty)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    whole = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32)
    return whole, np.append(0, np.cumsum(sizes))


def codes(points: np.ndarray) -> np.ndarray:
    """The number of the trigram at each place, two fewer than points."""
    wide = points.astype(np.int64)
    return wide[:-2] | wide[1:-1] << 21 | wide[2:] << 42


def grams_of(numbers: np.ndarray) -> list[str]:
    points = np.stack([numbers & 0x1FFFFF, numbers >> 21 & 0x1FFFFF, numbers >> 42], axis=1).astype("<u4")
    text = np.ascontiguousarray(points).tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)]


def segments(starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first point, last point, text of each trigram) of stretches of about a million places; a long text is cut."""
    ends = starts[1:]
    usable = np.maximum(ends - starts[:-1] - 2, 0)  # trigrams of each text
    text, inside = 0, 0
    while text < len(usable):
        first, size, rows = int(starts[text]) + inside, 0, []
        while text < len(usable) and size < SEGMENT:
            take = min(int(usable[text]) - inside, SEGMENT - size)
            rows.append((text, int(starts[text]) + inside, take))
            size, inside = size + take, inside + take
            if inside >= usable[text]:
                text, inside = text + 1, 0
        last = rows[-1][1] + rows[-1][2] + 2
        owner = np.full(max(0, last - first - 2), -1, np.int64)
        for of, begin, take in rows:
            owner[begin - first : begin - first + take] = of
        yield first, last, owner


def count_grams(langs: list[str | None], texts: list[str | None]) -> tuple[list[str], list[str], np.ndarray]:
    """(language, trigram, how often) in a batch, trigrams inside texts only."""
    names = sorted({l for l, t in zip(langs, texts) if l is not None and t})
    number = {name: k for k, name in enumerate(names)}
    of = np.array([number[l] if l in number else -1 for l in langs], np.int64)
    points, starts = code_points(texts)
    out_langs, out_grams, out_counts = [], [], []
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for first, last, owner in segments(starts):
        if last - first < 3:
            continue
        values = codes(points[first:last])
        lang = np.where(owner >= 0, of[owner], -1)
        for k in range(len(names)):
            found, n = np.unique(values[lang == k], return_counts=True)
            if len(found):
                parts[k].append(np.stack([found, n]))
    for k, part in enumerate(parts):
        if part:
            both = np.concatenate(part, axis=1)
            values, place = np.unique(both[0], return_inverse=True)
            out_langs += [names[k]] * len(values)
            out_grams += grams_of(values)
            out_counts.append(np.bincount(place, both[1], len(values)).astype(np.int64))
    return out_langs, out_grams, np.concatenate(out_counts) if out_counts else np.zeros(0, np.int64)


class GramWeights:
    """Weights of trigrams by language, ready for look-up."""

    def __init__(self, grams: list[str], langs: list[str], weights: np.ndarray):
        self.langs = sorted(set(langs))
        points, _ = code_points(grams)
        keys = codes(points)[::3] if len(points) else np.zeros(0, np.int64)
        self.keys, place = np.unique(keys, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, len(self.langs)), np.int64)  # the last row is of unknown trigrams
        column = np.searchsorted(self.langs, langs) if langs else np.zeros(0, np.int64)
        np.add.at(self.table, (place, column), weights + _HIT)
        alphabet = np.unique(points)
        self.letters = self.cube = None
        if len(alphabet) and (len(alphabet) + 1) ** 3 <= _CUBE_CELLS and alphabet[-1] < 1 << 17:
            side = len(alphabet) + 1
            self.letters = np.zeros(int(alphabet[-1]) + 2, np.int32)  # 0: not in any known trigram
            self.letters[alphabet] = np.arange(1, side)
            known = points.reshape(-1, 3)
            spot = self.letters[known].astype(np.int64)
            self.cube = np.full(side**3, len(self.keys), np.int32)
            self.cube[(spot[:, 0] * side + spot[:, 1]) * side + spot[:, 2]] = place
            self.side = side

    def rows(self, points: np.ndarray) -> np.ndarray:
        """The table's row for each trigram of the points."""
        if self.cube is not None:
            spot = self.letters[np.minimum(points, len(self.letters) - 1)]
            return self.cube[(spot[:-2] * self.side + spot[1:-1]) * self.side + spot[2:]]
        values = codes(points)
        at = np.minimum(np.searchsorted(self.keys, values), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == values, at, len(self.keys)) if len(self.keys) else np.zeros(len(values), np.int64)

    def best(self, texts: list[str | None]) -> pa.Array:
        """The language of the highest sum, ties to the first name, null where no trigram is known."""
        points, starts = code_points(texts)
        hits, sums = (np.zeros((len(texts), len(self.langs)), np.int64) for _ in range(2))
        for first, last, owner in segments(starts):
            if last - first < 3:
                continue
            rows = self.rows(points[first:last])
            used = np.flatnonzero(owner >= 0)
            if not len(used):
                continue
            text = owner[used]
            heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            for k in range(len(self.langs)):
                total = np.add.reduceat(self.table[rows[used], k], heads)
                hits[text[heads], k] += total >> 42
                sums[text[heads], k] += total & (_HIT - 1)
        if not self.langs:
            return pa.nulls(len(texts), pa.string())
        ranked = np.where(hits > 0, sums, -1)
        best = ranked.argmax(axis=1)
        return pa.array([self.langs[k] if some else None for k, some in zip(best.tolist(), (hits > 0).any(axis=1).tolist())], pa.string())
