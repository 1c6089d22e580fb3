"""Periodic stretches of words, found by the branching-tandem test on an enhanced suffix array.

The texts of a batch are one sequence of word numbers in which no two texts share a number, so repeats stay inside a
text. Two neighbouring copies of a stretch of ``d`` words that are followed by different words are two suffixes whose
longest common prefix is exactly ``d``: they lie on the two sides of a boundary of the LCP array with that value. For
each boundary the suffixes ``i`` of the smaller side are looked at, and ``i + d`` and ``i - d`` are searched on the other side
through the inverse suffix array. No tree is built: a boundary's sides follow from the nearest smaller values around
it. Each such square is rotated to the left as far as words agree, which gives the run that it ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import pieces, utf8

LEAST_WORDS, LEAST_REPEATS = 6, 4
_BATCH_BYTES = 1 << 20
_TESTS_AT_ONCE = 1 << 22
_FEW = 16


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse; only suffixes that still share a rank are sorted again, with doubled reach."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.full(n + 1, -1, np.int64)
    first = np.empty(n, bool)
    key, live, reach = ids[order], np.arange(n), 1
    while len(live):
        first = np.empty(len(live), bool)
        first[0], first[1:] = True, key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        rank[order[live]] = live[starts][group]
        sizes = np.diff(np.append(starts, len(live)))
        live = live[(sizes > 1)[group]]
        if not len(live):
            break
        suffixes = order[live]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + reach, n)] + 1
        again = np.argsort(key, kind="stable")
        order[live], key = suffixes[again], key[again]
        reach *= 2
    return order, rank[:n]


def _agree(ids: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on (``step`` 1 or -1) are equal, at most ``room``."""
    out, live, done = np.zeros(len(a), np.int64), np.flatnonzero(room > 0), 0
    while len(live) > _FEW:
        live = live[ids[a[live] + step * done] == ids[b[live] + step * done]]
        done += 1
        out[live] = done
        live = live[room[live] > done]
    for k in live.tolist():
        x, y, at, most, width = int(a[k]), int(b[k]), done, int(room[k]), 64
        while at < most:
            size = min(width, most - at)
            reach = np.arange(at, at + size) * step
            unequal = np.flatnonzero(ids[x + reach] != ids[y + reach])
            if len(unequal):
                at += int(unequal[0])
                break
            at, width = at + size, width * 2
        out[k] = at
    return out


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP array: compared only where the words before differ; elsewhere it is one less than that of the suffix before."""
    n = len(ids)
    before = np.full(n, -1, np.int64)  # the suffix sorted just before each one
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    fresh = (places == 0) | (before <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = ids[inner - 1] != ids[before[inner] - 1]
    some = np.flatnonzero(fresh & (before >= 0))
    value = np.zeros(n, np.int64)
    value[some] = _agree(ids, some, before[some], 1, n - np.maximum(some, before[some]))
    since = np.maximum.accumulate(np.where(fresh, places, 0))
    return (value[since] - (places - since))[order]


def _nearest(values: np.ndarray, equal: bool) -> np.ndarray:
    """For each place with a positive value the nearest one to its left with a smaller (or ``equal``) value.

    All places jump at once, each to where the place that it stopped at has got to. Place 0 holds no positive value.
    """
    at = np.arange(len(values)) - 1
    live = np.flatnonzero(values > 0)
    while len(live):
        there = at[live]
        beyond = values[there] > values[live] if equal else values[there] >= values[live]
        live = live[beyond]
        at[live] = at[there[beyond]]
    return at


def branching_squares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of every pair of equal neighbouring stretches that the words behind them tell apart."""
    order, rank = suffix_order(ids)
    n, lcp = len(ids), np.append(common_prefixes(ids, order), -1)
    lcp[0] = -1
    low = _nearest(lcp, True)  # of equal boundaries the first one divides all of their suffixes
    high = n - _nearest(lcp[::-1], False)[::-1]
    depth_at = np.flatnonzero(lcp[:n] > 0)
    low, high = low[depth_at], high[depth_at]
    left = depth_at - low <= high - depth_at
    begin, size = np.where(left, low, depth_at), np.where(left, depth_at - low, high - depth_at)
    other, other_end = np.where(left, depth_at, low), np.where(left, high, depth_at)
    upto = np.cumsum(size)
    ends, periods, done = [], [], 0
    while done < len(size):
        base = int(upto[done - 1]) if done else 0
        last = max(done + 1, int(np.searchsorted(upto, base + _TESTS_AT_ONCE, "right")))
        which = np.repeat(np.arange(done, last), size[done:last])
        inside = np.arange(len(which)) - (upto[which] - size[which] - base)
        here, depth = order[begin[which] + inside], lcp[depth_at[which]]
        for near in (here + depth, here - depth):
            valid = np.flatnonzero((near >= 0) & (near < n))
            there = rank[near[valid]]
            valid = valid[(there >= other[which[valid]]) & (there < other_end[which[valid]])]
            ends.append(np.maximum(here[valid], near[valid]) + depth[valid])
            periods.append(depth[valid])
        done = last
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ends), np.concatenate(periods)


def runs_of(ids: np.ndarray, least_words: int, least_repeats: int) -> np.ndarray:
    """(start, length, period) of each run of at least that many words and repeats, by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    if len(ids) > 1:
        ends, periods = branching_squares(ids)
        by_end = np.lexsort((periods, ends))
        ends, periods = ends[by_end], periods[by_end]
        while len(ends):
            # The smallest period of an end, rotated to the left; squares of its multiples inside the run are no runs.
            first = np.r_[True, ends[1:] != ends[:-1]]
            end, period = ends[first], periods[first]
            start = end - 2 * period
            start = start - _agree(ids, start - 1, end - period - 1, -1, start)
            length = end - start
            keep = length >= np.maximum(least_words, least_repeats * period)
            found.append(np.column_stack([start, length, period])[keep])
            rest = ~first & (2 * periods > length[np.cumsum(first) - 1])
            ends, periods = ends[rest], periods[rest]
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch(texts: list[bytes], least_words: int, least_repeats: int) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, all runs with their text, and the texts without the words that a run repeats."""
    split = [text.split() for text in texts]  # bytes are split at \x20 and \x09-\x0D
    ids, bounds = [], [0]
    for words in split:
        known: dict[bytes, int] = {}
        ids += [known.setdefault(word, place) for place, word in enumerate(words, bounds[-1])]
        bounds.append(len(ids))
    runs = runs_of(np.array(ids, np.int64), least_words, least_repeats)
    text_of = np.searchsorted(bounds, runs[:, 0], "right") - 1
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    touched = set(text_of.tolist())
    left = []
    for k, words in enumerate(split):
        if k in touched:
            words = [words[p] for p in np.flatnonzero(kept[bounds[k] : bounds[k + 1]])]
        left.append(b" ".join(words))
    runs[:, 0] -= np.array(bounds)[text_of]
    return np.diff(bounds).tolist(), runs, np.searchsorted(text_of, np.arange(len(texts) + 1)), left


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs``; no shuffle, each row on its own.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared by their bytes. A run is a stretch of consecutive words with smallest
    period q (words q apart are equal), of at least ``least_words`` words and ``least_repeats`` periods (2 or more), that
    no neighbouring word extends. ``runs`` holds (start, length, period) in words from 0, by start, then period; runs of
    different periods may overlap and all are given. ``collapsed`` is the words joined by one space, without those that
    some run contains after its first q words.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Null ids and repeated rows are rows like
    others. Other columns are not read, whatever their names; an empty table gives an empty table. A task holds about a
    megabyte of text at a time, and a longer text alone, whole.
    """
    if least_repeats < 2:
        raise ValueError("A run repeats at least twice.")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in pieces(offsets, _BATCH_BYTES):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)]
                counts, runs, places, left = _batch(texts, least_words, least_repeats)
                values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(places, pa.int32()), values), pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(find, kind)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared exactly; ties go to the smaller start, then period. Null if none."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))

    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(better(run, best), run).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of ``periodic_runs`` rows."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text`` in which one id in ten ends periodically.

    With h = crc32(decimal id) and g = h div 10: if h mod 10 is 0, each of the n words from a = g mod n on becomes the
    original word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8). Other texts, null ids and texts without
    words are left as they are.
    """
    text, key = F.col(text_column).cast("string"), F.col(id_column).cast("long")
    word_list = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.crc32(key.cast("string")) % 10 == 0
    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.when(chosen, word_list).alias("w"))
    rows = rows.withColumn("g", F.expr("crc32(cast(doc_id AS string)) div 10")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
