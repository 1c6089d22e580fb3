"""Removal of repeated byte strings with a sparse suffix array, sorted by bucket-pointer refinement.

Only sampled suffixes are sorted. Of each window of ``length`` bytes the ``Q``-gram with the smallest number (ties: the
leftmost) is its anchor; equal windows have equal anchors at equal places, so every repeated window is found at a
repeated anchor. About one byte in 35 is an anchor.

Initial buckets are the anchors' Q-grams. A bucket is refined by the bucket identifiers of later offsets: identifiers
of depth 2Q are made of the identifiers at p and p + Q, those of the whole window of two of depth 2Q, and the updated
identifiers serve the next level. The refined identifier of an anchor covers all windows that it is the anchor of. The
anchors are then sorted over the cluster by (bucket, refined identifier, document, place), in ranges that cut through
hot buckets, and read in order:

* a suffix alone in its bucket is finished: nothing of it repeats;
* all but the first of a refined bucket repeat with all their windows;
* the first ones of a bucket that fell into several are refined once more, window by window.

Identifiers are 64-bit numbers of the content; what removes bytes rests on two independent ones, 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import mix, pieces, utf8
from sluice.sources.workspace import settle

Q = 32
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_TAG_BITS = 40


def _paired(names: np.ndarray, gap: int, odd: np.uint64) -> np.ndarray:
    """Identifiers of twice the depth, from those at p and p + gap."""
    return names[:-gap] * odd + names[gap:]


def bucket_names(data: np.ndarray) -> np.ndarray:
    """The identifier of the Q-gram at each place (empty for fewer than Q bytes)."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    names = data.astype(np.uint64) + np.uint64(1)
    for level, gap in enumerate((1, 2, 4, 8, 16)):
        names = _paired(names, gap, _ODD[level % 4])
        if gap in (4, 16):
            names = mix(names)
    return names


def window_names(names: np.ndarray, at: np.ndarray, length: int, odd: int = 0) -> np.ndarray:
    """Identifiers of the ``length``-byte windows at these places, refined from those of depth Q and 2Q."""

    def double(p: np.ndarray) -> np.ndarray:
        return mix(names[p] * _ODD[odd] + names[p + Q])

    return mix(double(at) * _ODD[odd + 1] + double(at + (length - 2 * Q)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by doubling."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, refined identifier, text, first window, windows after the first) of each anchor of the texts."""
    whole = np.ones(max(0, len(data) - length + 1), bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        whole[max(begin, end - length + 1) : end] = False
    windows = np.flatnonzero(whole)
    if not len(windows):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    names = bucket_names(data)
    ranked = (names & _HIGH) | np.arange(len(names), dtype=np.uint64)
    anchor = (_least(ranked, length - Q + 1)[windows] & _LOW).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = windows[starts], windows[np.append(starts[1:], len(windows)) - 1]
    place, reach = anchor[starts], last - first
    shape = (place - first).astype(np.uint64) * np.uint64(1 << 20) + reach.astype(np.uint64)
    refined = mix((window_names(names, first, length) * _ODD[2] + window_names(names, last, length)) * _ODD[3] + shape)
    return names[place], refined, np.searchsorted(offsets, first, "right") - 1, first, reach


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _scan(settled_unique: bool):
    """Read rows sorted by (a, b, id, place) and say which repeat.

    kind 1: an earlier row has the same (a, b). kind 2: not decided here. What is alone is left out.
    Anchors (``settled_unique``): a first row is undecided if its bucket a holds several b. Windows: a first row is kept.
    In either case the first rows of groups that touch the border of a partition are undecided.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pending = None  # the last row so far; the first row of a group of which one b was seen so far
        several = opening = True

        def out(rows, kind):
            arrays = [_long(x) for x in rows] + [pa.array(np.full(len(rows[0]), kind, np.int32))]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "id", "place", "kind"])

        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if not len(rows[0]):
                continue
            before = [np.concatenate([[x[0] - 1 if last is None else last[k]], x[:-1]]) for k, x in enumerate(rows)]
            same_a, same_b = rows[0] == before[0], rows[1] == before[1]
            if last is None:
                same_a[0] = False
            same = same_a & same_b & (rows[2] == before[2]) & (rows[3] == before[3])  # a row given twice
            same_b &= same_a
            fresh = ~same_b
            group = same_a if settled_unique else same_b
            starts = np.flatnonzero(~group)
            edges = np.concatenate([[0], starts, [len(group)]]) if not len(starts) or starts[0] else np.append(starts, len(group))
            edges = np.unique(edges)
            firsts = np.add.reduceat(fresh, edges[:-1])
            continued = bool(group[0])
            multiple = firsts > 1
            if continued:
                multiple[0] = several or bool(firsts[0]) or multiple[0]
            elif last is not None:
                opening = False
            undecided = np.repeat(multiple, np.diff(edges)) & fresh if settled_unique else np.zeros(len(fresh), bool)
            if pending is not None:
                if continued and multiple[0] and settled_unique:
                    yield out([np.array([x]) for x in pending], 2)
                    pending = None
                elif not continued:
                    pending = None
            if opening:  # the partition's first group
                undecided[: edges[1]] |= fresh[: edges[1]]
                if len(edges) > 2:
                    opening = False
            begin = edges[-2]
            lone = np.flatnonzero(fresh[begin:] & ~undecided[begin:])
            if len(lone):
                pending = [x[begin + lone[0]] for x in rows]
            repeats = same_b & ~same
            yield out([x[repeats] for x in rows], 1)
            yield out([x[undecided] for x in rows], 2)
            several = bool(multiple[-1]) if len(edges) > 2 or not continued else several or bool(multiple[-1])
            last = [x[-1] for x in rows]
        if pending is not None:
            yield out([np.array([x]) for x in pending], 2)

    return scan


def _sorted(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "a", "b", "id", "place").sortWithinPartitions("a", "b", "id", "place")


_ROWS = "a long, b long, id long, place long"


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary) for each row of ``docs``.

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in a smaller id, or earlier in the
    same text. Texts are UTF-8 bytes, null is empty; matches never cross texts and are judged on the input. A null id
    stands before all others. Rows with the same id and the same text are one document given twice: both get its
    result. Different texts of one id are ordered by a hash of the text. Other columns are not read; an empty table
    gives an empty one. ``length`` is 64 to 250; texts are shorter than 4 GB.
    """
    if not 2 * Q <= length <= 250:
        raise ValueError("length is 64 to 250.")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"),
        F.shiftrightunsigned(F.xxhash64("text"), _TAG_BITS + 1).alias("tag"), "text", "doc_id",
    )

    def sample(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last in pieces(offsets):
                here = offsets[first : last + 1] - offsets[first]
                bucket, refined, text, start, reach = anchors(data[offsets[first] : offsets[last]], here, length)
                place = (tags[first + text] << _TAG_BITS) | ((start - here[text]) << 8) | reach
                yield pa.RecordBatch.from_arrays([_long(x) for x in (bucket, refined, ids[first + text], place)], ["a", "b", "id", "place"])

    def packed(batches):
        """Texts travel compressed to their decisions."""
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            kept = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(kept, pa.binary())], ["id", "tag", "doc_id", "z"])

    def windows(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, tags, packs, lists = (batch.column(k).to_pylist() for k in range(4))
            for id_, tag, pack, places in zip(ids, tags, packs, lists):
                data = np.frombuffer(open_.decompress(pack), np.uint8)
                places = np.array(places, np.int64)
                start, count = places >> 8, (places & 255) + 1
                at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                names = bucket_names(data)
                for k in range(0, len(at), 1 << 18):
                    some = at[k : k + (1 << 18)]
                    place = (np.int64(tag) << _TAG_BITS) | (some << 8)
                    yield pa.RecordBatch.from_arrays(
                        [_long(window_names(names, some, length)), _long(window_names(names, some, length, 1)), pa.array(np.full(len(some), id_, np.int64)), pa.array(place)],
                        ["a", "b", "id", "place"],
                    )

    def per_document(places: DataFrame) -> DataFrame:
        low = F.col("place").bitwiseAND(F.lit((1 << _TAG_BITS) - 1))
        return places.groupBy("id", F.shiftrightunsigned("place", _TAG_BITS).alias("tag")).agg(F.collect_list(low).alias("places"))

    def cut(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            found = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for pack, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = open_.decompress(pack)
                places = np.sort(np.array(places or [], np.int64))
                start, stop = places >> 8, np.maximum.accumulate((places >> 8) + (places & 255) + length) if len(places) else places
                new = np.concatenate([[True], start[1:] > stop[:-1]]) if len(places) else np.zeros(0, bool)
                begins, ends = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)] if len(places) else stop
                kept, at = [], 0
                for a, b in zip(begins.tolist(), ends.tolist()):
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                for name, value in zip(found, (len(data), len(data) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept)):
                    found[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[n], t) for n, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["doc_id", *found],
            )

    judged = settle(_sorted(rows.mapInArrow(sample, _ROWS)).mapInArrow(_scan(True), _ROWS + ", kind int"))
    texts = rows.mapInArrow(packed, "id long, tag long, doc_id long, z binary")
    doubtful = per_document(judged.where("kind = 2").select("id", "place").distinct())
    opened = texts.join(doubtful, ["id", "tag"]).select("id", "tag", "z", "places").mapInArrow(windows, _ROWS)
    finer = settle(_sorted(opened).mapInArrow(_scan(False), _ROWS + ", kind int"))
    # Two rows for each partition at most: groups that may go on across its border.
    border = settle(finer.where("kind = 2").select("a", "b", "id", "place").distinct())
    first = border.groupBy("a", "b").agg(F.min(F.struct("id", "place")).alias("first"))
    late = border.join(first, ["a", "b"]).where(F.struct("id", "place") > F.col("first")).select("id", "place")
    gone = judged.where("kind = 1").select("id", "place").unionByName(finer.where("kind = 1").select("id", "place")).unionByName(late)
    whole = texts.join(per_document(gone), ["id", "tag"], "left").select("doc_id", "z", "places")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
