"""Exact Jaccard self-join of documents on word n-grams, by signature trees.

A signature is a bitmap of a document's hashed n-grams. Trees stand over documents sorted by size: a node holds the OR
of its children's bitmaps, the range of their sizes and the largest number of n-grams that share a bit with another
one of their document. Two trees are walked together, and a pair of nodes is left when even the largest overlap that
its bitmaps allow is too small for its sizes.

Where trees meet is chosen so that no link is lost. Ordered by their number, the first n-grams of two documents that
link have one in common (prefix filter), so trees are built over the documents of one such n-gram. N-grams that stand
in more than one of 256 documents go to the end of the order: any order is exact, this one keeps frequent lines out of
the prefixes. Pairs that pass on bitmaps alone give coarse groups; each group meets once with its whole n-gram sets,
where the second walk compares exactly. Groups beyond a stated number of rows or n-grams are cut into parts and every
pair of parts is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import mix, pieces, text_shingles, utf8, words
from sluice.llm.components import components
from sluice.sources.workspace import settle

FANOUT = 16
PART_ROWS = 8192
PART_GRAMS = 4_000_000
COMMON_SHARE = 256
#: N-grams that are held together for one numpy call, or for one batch that is handed on.
BLOCK = 1 << 18


def _gram_sets(column, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct n-gram numbers, sorted) for all rows of an Arrow column."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets):
        here = offsets[first : last + 1] - offsets[first]
        numbers, _, _, before = words(data[offsets[first] : offsets[last]], here)
        for row, runs in enumerate(text_shingles(numbers, before, width), first):
            runs = np.sort(runs)
            yield row, runs[np.concatenate([[True], runs[1:] != runs[:-1]])] if len(runs) else runs


def _frequent(blocks: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, how often it occurs) of those that occur ``least`` times; a table of hashed counts picks what to count."""
    mask, cells = np.uint64(0xFFFFF), np.zeros(1 << 20, np.int64)
    for block in blocks:
        cells += np.bincount((block & mask).astype(np.int64), minlength=len(cells))
    values, times = np.unique(np.concatenate([b[cells[(b & mask).astype(np.int64)] >= least] for b in blocks]), return_counts=True)
    often = times >= least
    return values[often], times[often]


def _set_key(grams: np.ndarray) -> int:
    """A number of the set: equal sets, equal numbers."""
    if not len(grams):
        return 0
    both = mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(mix(np.array([both.sum(), len(grams)], np.uint64) * np.uint64(3)).sum().astype(np.int64))


#: Bits for each n-gram of the signatures that travel, and of those that are made where the whole sets are.
NARROW, WIDE = 1, 16


def signature(grams: np.ndarray, bits_each: int = NARROW) -> np.ndarray:
    """A bitmap of at least ``bits_each`` bits for each n-gram, a power of two."""
    bits = np.zeros(max(64, 1 << int(bits_each * len(grams) - 1).bit_length()), bool)
    bits[(grams & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The same signature at a smaller width."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def least_overlap(a, b, percent: int):
    """The smallest overlap at which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Levels of nodes over members sorted by size."""

    def __init__(self, sizes: np.ndarray, signatures: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        length = min(len(s) for s in signatures)
        bits = np.stack([folded(signatures[k], length) for k in self.order])
        low = sizes[self.order].astype(np.int64)
        crowded = low - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, low, low, crowded)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, crowded = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts), np.maximum.reduceat(crowded, cuts),
            ))

    def passing(self, level: int, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes can hold a link: most overlap against what the sizes ask for at least."""
        bits, low, high, crowded = self.levels[level]
        small, large = np.maximum(low[left], -(-percent * low[right] // 100)), np.maximum(low[right], -(-percent * low[left] // 100))
        fits = (small <= high[left]) & (large <= high[right])
        left, right = left[fits], right[fits]
        most = np.bitwise_count(bits[left] & bits[right]).sum(1, dtype=np.int64) + np.minimum(crowded[left], crowded[right])
        most = np.minimum(most, np.minimum(high[left], high[right]))
        ok = np.zeros(len(fits), bool)
        ok[np.flatnonzero(fits)[most >= least_overlap(small[fits], large[fits], percent)]] = True
        return ok

    def links(self, percent: int, accept=None) -> list[tuple[int, int]]:
        """(first member, member) of everything joined by pairs that pass (and are accepted).

        A pair inside what is already joined is not looked at again.
        """
        count = len(self.order)
        root = list(range(count))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                a, b = find(i), find(j)
                if a != b and (accept is None or accept(int(self.order[i]), int(self.order[j]))):
                    root[max(a, b)] = min(a, b)
                continue
            below = len(self.levels[level - 1][1])
            left = np.arange(i * FANOUT, min((i + 1) * FANOUT, below))
            right = left if i == j else np.arange(j * FANOUT, min((j + 1) * FANOUT, below))
            if level == 1 and len({find(k) for k in [*left.tolist(), *right.tolist()]}) == 1:
                continue
            one, two = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
            if i == j:
                keep = one < two if level == 1 else one <= two
                one, two = one[keep], two[keep]
            ok = self.passing(level - 1, one, two, percent)
            stack.extend((level - 1, a, b) for a, b in zip(one[ok][::-1].tolist(), two[ok][::-1].tolist()))
        return [(int(self.order[find(k)]), int(self.order[k])) for k in range(count) if find(k) != k]


def tree_links(sizes: np.ndarray, signatures: list[np.ndarray], percent: int, accept=None) -> list[tuple[int, int]]:
    """``SignatureTree.links`` with a tree for each signature width.

    Sets that can link have the same width or neighbouring ones, so a tree also takes those of twice its width that are
    not too large for its own; nothing is folded further.
    """
    widths, found = np.array([len(s) for s in signatures]), []
    for width in np.unique(widths).tolist():
        own = widths == width
        near = (widths == 2 * width) & (percent * sizes <= 100 * sizes[own].max())
        at = np.flatnonzero(own | near)
        if len(at) > 1:
            checked = (lambda a, b: accept(int(at[a]), int(at[b]))) if accept else None
            links = SignatureTree(sizes[at], [signatures[k] for k in at]).links(percent, checked)
            found += [(int(at[a]), int(at[b])) for a, b in links]
    return found


def _parts(rows: DataFrame, key: str, member: str, weight: str) -> DataFrame:
    """``rows`` with the task each one goes to: one for a group, or one for each pair of a large group's parts."""
    sized = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w")).where(F.col("_n") > 1)
    sized = settle(sized.select(key, F.ceil(F.greatest(F.col("_n") / PART_ROWS, F.col("_w") / PART_GRAMS)).cast("int").alias("_parts")))
    own = F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")
    spread = rows.join(sized, key).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    spread = spread.withColumn("_other", other)
    task = F.concat_ws(":", F.col(key).cast("string"), F.least("_own", "_other"), F.greatest("_own", "_other"))
    # With more than two parts, the pairs of a part with itself are covered by its pairs with others.
    return spread.where((F.col("_parts") == 1) | (F.col("_own") != F.col("_other"))).withColumn("task", task).drop("_own", "_other", "_parts", key)


def _walk(width: int, percent: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by task; a task's members are held together, one task at a time."""

        def links(members: list[tuple]) -> list[tuple[int, int]]:
            if not width:
                sets = {key: (size, data) for key, size, data in members}
                if len(sets) < 2:
                    return []
                keys, sizes = list(sets), np.array([size for size, _ in sets.values()], np.int64)
                found = tree_links(sizes, [np.frombuffer(data, np.uint64) for _, data in sets.values()], percent)
                return [(keys[a], keys[b]) for a, b in found]
            texts = pa.array([data for _, _, data in members], pa.binary())
            # Another text may stand under the id that stands for a set.
            whole = {members[row][0]: g for row, g in _gram_sets(texts, width) if len(g) and _set_key(g) == members[row][0]}
            keys, grams = list(whole), list(whole.values())
            if len(keys) < 2:
                return []

            def accept(a: int, b: int) -> bool:
                overlap = len(np.intersect1d(grams[a], grams[b], assume_unique=True))
                return 100 * overlap >= percent * (len(grams[a]) + len(grams[b]) - overlap)

            found = tree_links(np.array([len(g) for g in grams], np.int64), [signature(g, WIDE) for g in grams], percent, accept)
            return [(keys[a], keys[b]) for a, b in found]

        def out(pairs):
            u, v = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        task, members, pairs = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for at, key, size, data in zip(*columns):
                if at != task:
                    pairs += links(members)
                    task, members = at, []
                members.append((key, size, data))
            if len(pairs) > 10_000:
                yield out(pairs)
                pairs = []
        yield out(pairs + links(members))

    return walk


def _linked(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges from ``task, set_key, n, data`` rows; ``data``: signatures (``width`` 0), or texts to compare exactly."""
    dealt = members.select("task", "set_key", "n", "data").repartition("task").sortWithinPartitions("task", "n", "set_key")
    return dealt.mapInArrow(_walk(width, percent), "u long, v long")


def ngram_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    The set of a text: its distinct ``width``-word shingles, the whole sequence where it has fewer words. Texts link
    when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable over links.
    Null or wordless texts have an empty set (0) and link with nothing: their own id. Rows with the same text, also
    repeated rows, share a class; a null id is never the smallest unless all are null, then the class is null.
    Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))

    def measure(batches):
        """Per document: set key and size. Per task: the n-grams that are frequent in it, with their documents (kind 1)."""
        counted: dict[int, int] = {}
        total = held = 0
        for batch in batches:
            ids, keys, sizes, signs, blocks, waiting, held_back = batch.column(0), [], [], [], [], [], 0
            for _, grams in _gram_sets(batch.column(1), width):
                keys.append(_set_key(grams))
                sizes.append(len(grams))
                signs.append(signature(grams).tobytes() if len(grams) else None)
                waiting.append(grams)
                held_back += len(grams)
                if held_back >= BLOCK:
                    blocks.append(np.concatenate(waiting))
                    waiting, held_back = [], 0
            if sum(sizes):
                # What is frequent in no batch cannot be frequent in a task.
                values, times = _frequent([*blocks, np.concatenate([np.zeros(0, np.uint64), *waiting])], max(2, len(keys) // COMMON_SHARE))
                for value, n in zip(values.astype(np.int64).tolist(), times.tolist()):
                    counted[value] = counted.get(value, 0) + n
            total += len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(keys), pa.int32()), ids.cast(pa.int64()), batch.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                ["kind", "doc_id", "text_key", "set_key", "n", "signature"],
            )
        held = {k: n for k, n in counted.items() if n * COMMON_SHARE >= total}
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * len(held), pa.int32()), *[pa.nulls(len(held), pa.int64())] * 2, pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64()), pa.nulls(len(held), pa.binary())],
            ["kind", "doc_id", "text_key", "set_key", "n", "signature"],
        )

    spark = docs.sparkSession
    measured = settle(rows.mapInArrow(measure, "kind int, doc_id long, text_key long, set_key long, n long, signature binary"))
    sets = measured.where("kind = 0").drop("kind", "signature")
    # One document in 256 at least holds each of these, so there are at most 256 times the mean set size of them.
    documents = sets.count()
    common = measured.where("kind = 1").groupBy(F.col("set_key").alias("gram")).agg(F.sum("n").alias("n"))
    common = common.where(F.col("n") * COMMON_SHARE >= documents).orderBy(F.desc("n"), "gram").limit(1 << 16)
    late = np.sort(np.array([row["gram"] for row in common.collect()], np.int64).view(np.uint64))
    late = spark.sparkContext.broadcast(late)

    def prefixes(batches):
        told: set[int] = set()  # copies in a task tell their prefix once

        def out(grams_out, keys, sizes):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams_out).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))],
                ["gram", "set_key", "n"],
            )

        for batch in batches:
            grams_out, keys, sizes, held_back = [], [], [], 0
            for _, grams in _gram_sets(batch.column(1), width):
                if not len(grams) or (key := _set_key(grams)) in told:
                    continue
                told.add(key)
                size = len(grams)
                if len(late.value):
                    spot = np.minimum(np.searchsorted(late.value, grams), len(late.value) - 1)
                    last = late.value[spot] == grams
                    grams = np.concatenate([grams[~last], grams[last]])
                prefix = grams[: size - -(-percent * size // 100) + 1]
                grams_out.append(prefix)
                keys.append(np.full(len(prefix), key, np.int64))
                sizes.append(np.full(len(prefix), size, np.int32))
                held_back += len(prefix)
                if held_back >= BLOCK:
                    yield out(grams_out, keys, sizes)
                    grams_out, keys, sizes, held_back = [], [], [], 0
            if keys:
                yield out(grams_out, keys, sizes)

    def meetings(batches):
        """Of rows sorted by n-gram: those whose n-gram stands in several sets, with a number of that group of sets."""
        rest = None
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left")) if len(columns[0]) else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield grouped([c[:cut] for c in columns])
        if rest is not None:
            yield grouped(rest)

    def grouped(columns):
        gram, key, size = columns
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        gram, key, size = gram[new], key[new], size[new]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(gram)))
        # The same sets meet at many n-grams: one number for a group of sets, so that they are compared once.
        number = np.add.reduceat(mix(key.view(np.uint64)), starts) if len(gram) else np.zeros(0, np.uint64)
        number = np.repeat(number.view(np.int64), counts)
        several = np.repeat(counts > 1, counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(number[several]), pa.array(key[several]), pa.array(size[several].astype(np.int64))], ["meeting", "set_key", "n"]
        )

    found = rows.mapInArrow(prefixes, "gram long, set_key long, n int").repartition("gram").sortWithinPartitions("gram", "set_key")
    met = settle(found.mapInArrow(meetings, "meeting long, set_key long, n long").distinct())

    # One row stands for each set: the smallest id, null the last, with a hash of its text beside it.
    stands = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("stands")
    nodes = sets.groupBy("set_key", "n").agg(F.min("doc_id").alias("least_id"), stands)
    # Copies become one signature in each task before they travel.
    signed = measured.where("kind = 0 AND n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.first("signature").alias("data"))
    signed = signed.join(met.select("set_key").distinct(), "set_key", "left_semi")
    drawn = _parts(met, "meeting", "set_key", "n").drop("n").join(settle(signed), "set_key")
    coarse = components(_linked(drawn, 0, percent))

    # The texts of groups are read again for the exact walk, one for each set.
    wanted = settle(coarse.join(nodes, coarse["node"] == nodes["set_key"]).select("stands", F.col("set_key").alias("wanted"), "root", "n"))
    dealt = _parts(wanted.select("root", F.col("wanted").alias("set_key"), "stands", "n"), "root", "set_key", "n")
    of_row = (rows["text_key"] == F.col("stands.text_key")) & rows["doc_id"].eqNullSafe(F.col("stands.doc_id"))
    # The same plan at every size: sorted and merged, so that copies under one id are split at run time.
    gathered = rows.join(dealt.hint("merge"), of_row).groupBy("task", "set_key", "n").agg(F.first(F.col("text").cast("binary")).alias("data"))
    classes = components(_linked(gathered, width, percent))

    labelled = nodes.join(classes, nodes["set_key"] == classes["node"], "left").select("set_key", "n", "least_id", "root")
    roots = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("root_id"))
    labelled = settle(labelled.join(roots, "root", "left").select("set_key", "n", F.coalesce("root_id", "least_id").alias("component_id")))
    filled = sets.where("n > 0").join(labelled.where("n > 0"), ["set_key", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
