"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A bounded sample of labelled documents gives the training data. Words whose features (the word, its beginnings, its
end) are found in toxic documents far more often than chance allows are the first labelled tokens of those documents; the
field is fitted to them, labels the toxic documents' tokens anew by its own marginals, and is fitted again. Texts are
tagged inside the tasks that read them: the chain of a whole batch is one product of 2 x 2 matrices, with a matrix that
forgets the past at the start of each text, and the products are scanned in parallel blocks. So one pass forward and one
backward give every word's probability, however long a text is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytes_words import _numbers, mix, pieces, utf8, words

SAMPLE_ROWS, SAMPLE_BYTES, MOST_FEATURES = 20_000, 10_000_000, 20_000
PREFIXES, SUFFIX = (3, 4, 5, 6, 8), 4
NEAR = 3
_BLOCK = 64
_BATCH_BYTES, _SLICE_BYTES = 1 << 21, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, start byte, end byte) of each word and how many words lie before each text; feature 0 is none.

    A word without the ASCII signs and digits at its ends (or whole, if nothing else is left) gives a number for
    itself, one for each beginning of some length and one for its end. A-Z count as a-z.
    """
    _, starts, ends, before = words(data, offsets)
    if not len(starts):
        return np.zeros((0, len(PREFIXES) + 2), np.uint64), starts, ends, before
    letter, places = _LETTER[data], np.arange(len(data))
    after = np.minimum.accumulate(np.where(letter, places, len(data))[::-1])[::-1][starts]
    last = np.maximum.accumulate(np.where(letter, places, -1))[ends - 1] + 1
    bare = after >= ends
    core, core_end = np.where(bare, starts, after), np.where(bare, ends, last)
    size = core_end - core
    columns = [mix(_numbers(data, core, core_end))]
    for k, width in enumerate(PREFIXES, 1):
        key = mix(_numbers(data, core, np.minimum(core + width, core_end)) + np.uint64(k))
        columns.append(np.where(size > width, key, np.uint64(0)))
    key = mix(_numbers(data, np.maximum(core_end - SUFFIX, core), core_end) + np.uint64(99))
    columns.append(np.where(size > SUFFIX, key, np.uint64(0)))
    return np.stack(columns, axis=1), starts, ends, before


def _scan(matrices: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) M1 .. Mt for every t, each scaled to a sum of 1; ``matrices`` is (2, 2, n)."""
    n = matrices.shape[2]
    blocks = -(-n // _BLOCK)
    padded = np.zeros((2, 2, blocks * _BLOCK))
    padded[:, :, :n] = matrices
    padded[0, 0, n:] = padded[1, 1, n:] = 1
    steps = np.ascontiguousarray(padded.reshape(2, 2, blocks, _BLOCK).transpose(3, 0, 1, 2))
    for k in range(1, _BLOCK):
        (a, b), (c, d) = steps[k - 1]
        (e, f), (g, h) = steps[k]
        product = np.array([[a * e + b * g, a * f + b * h], [c * e + d * g, c * f + d * h]])
        steps[k] = product / product.max(axis=(0, 1))
    carry = np.ones((2, blocks))
    if blocks > 1:
        carry[:, 1:] = _scan(steps[-1][:, :, :-1])
    out = carry[0] * steps[:, 0] + carry[1] * steps[:, 1]
    out /= out.sum(axis=1, keepdims=True)
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


class Chain:
    """Emission of the toxic state for each word, transitions between the states clean (0) and toxic (1)."""

    def __init__(self, emission: np.ndarray, first: np.ndarray, moves: np.ndarray):
        """``first`` marks the words that begin a text; ``moves[a, b]`` is the logarithm of a step's weight."""
        n = len(emission)
        self.weight = np.stack([np.ones(n), np.exp(np.clip(emission, -30, 30))])
        self.steps = np.exp(moves)[:, :, None] * self.weight[None]
        self.steps[:, :, first] = self.weight[None][:, :, first]  # forgets what came before
        self.forward = _scan(self.steps)
        # Backwards, the step into a word is taken after it, and a text's last word looks at nothing.
        back = np.ones((2, 2, n))
        back[:, :, :-1] = self.steps[:, :, 1:]
        last = np.append(first[1:], True)
        back[:, :, last] = 1
        self.backward = _scan(back[:, :, ::-1].transpose(1, 0, 2))[:, ::-1]
        joint = self.forward * self.backward
        self.marginal = joint[1] / joint.sum(axis=0)
        self.first = first

    def moves_expected(self) -> np.ndarray:
        """Expected number of each step over all texts."""
        inner = np.flatnonzero(~self.first)
        pairs = self.forward[:, None, inner - 1] * self.steps[:, :, inner] * self.backward[None, :, inner]
        return (pairs / pairs.sum(axis=(0, 1))).sum(axis=2)


def _firsts(before: np.ndarray) -> np.ndarray:
    first = np.zeros(before[-1], bool)
    first[before[:-1][np.diff(before) > 0]] = True
    return first


class ToxicityModel:
    """Feature weights and transitions of the field, and a logistic model of documents over its marginals."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, moves: np.ndarray, document: np.ndarray):
        self.keys, self.weights, self.bias, self.moves, self.document = keys, weights, bias, moves, document

    def find(self, features: np.ndarray) -> np.ndarray:
        """Row of each feature in the model, one past the end where it has none."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        at = np.searchsorted(self.keys, features)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != features] = len(self.keys)
        return at

    def emission(self, at: np.ndarray) -> np.ndarray:
        return np.append(self.weights, 0.0)[at].sum(axis=1) + self.bias

    def marginals(self, features: np.ndarray, before: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        return Chain(self.emission(self.find(features)), _firsts(before), self.moves).marginal

    def scores(self, marginals: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probability that each text is toxic."""
        values = np.column_stack([_document_values(marginals, before), np.ones(len(before) - 1)])
        return 1 / (1 + np.exp(-np.clip(values @ self.document, -40, 40)))


def _document_values(marginals: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Strongest word, expected toxic words, and their density, of each text."""
    size = np.diff(before)
    sums = np.append(0, np.cumsum(marginals))
    total = np.maximum(sums[before[1:]] - sums[before[:-1]], 0)
    most = np.zeros(len(size))
    some = np.flatnonzero(size)
    if len(some):
        most[some] = np.maximum.reduceat(marginals, before[:-1][some])
    return np.column_stack([most, np.log1p(total), np.sqrt(total / np.maximum(size, 1))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the last column is the intercept, free of the ridge."""
    w, free = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    free[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - free * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(free)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _contexts(features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for the words before and after each word; copies of a passage repeat it, new uses of a word do not."""
    out = np.zeros(len(doc), np.uint64)
    same = doc[1:] == doc[:-1]
    out[1:] += np.where(same, features[:-1, 0], np.uint64(0)) * np.uint64(3)
    out[:-1] += np.where(same, features[1:, 0], np.uint64(0))
    return mix(out)


def _slices(texts: pa.Array):
    """Features of about a megabyte of texts at a time: (first text, features, text of each word, words before each text)."""
    data, offsets = utf8(texts)
    for low, high in pieces(offsets, _SLICE_BYTES):
        features, _, _, before = token_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        yield low, features, np.repeat(np.arange(low, high), np.diff(before)), before


def _context_counts(texts: pa.Array, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature, in how many different contexts) for all features or those of the sorted ``keys``, and the number of words."""
    kinds, size = [[] for _ in range(len(PREFIXES) + 2)], 0
    for _, features, doc, _ in _slices(texts):
        size += len(doc)
        context = _contexts(features, doc)
        for column, kind in zip(features.T, kinds):
            held = column != 0 if keys is None else keys[np.minimum(np.searchsorted(keys, column), len(keys) - 1)] == column
            key = column[held]
            pair = mix(key * np.uint64(5) + context[held])  # 64 bits for at most some ten million pairs
            _, place = np.unique(pair, return_index=True)
            kind.append((pair[place], key[place]))
    found = []
    for kind in kinds:
        if kind:
            pair, key = (np.concatenate(part) for part in zip(*kind))
            kind.clear()
            _, place = np.unique(pair, return_index=True)
            found.append(np.unique(key[place], return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    key, count = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(key)  # features of different kinds are different numbers
    return key[order], count[order], size


def train(texts: pa.Array, toxic: np.ndarray, clean_weight: float = 1.0, most_features: int = MOST_FEATURES, rounds: int = 2) -> ToxicityModel:
    """The model of these labelled texts; a clean one stands for ``clean_weight`` documents.

    Every third text only calibrates the document scores, on which neither features nor the field were chosen.
    """
    calibrates = np.arange(len(toxic)) % 3 == 2
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.zeros((2, 2)), np.zeros(4))
    share = (toxic.sum() + 0.5) / (toxic.sum() + clean_weight * (~toxic).sum() + 1)
    model.document[-1] = math.log(share / (1 - share))

    # Features in more contexts of toxic documents than these documents' share of words explains (Chernoff's bound).
    keys, inside, size = _context_counts(texts.filter(pa.array(~calibrates & toxic)))
    keys, inside = keys[inside >= 3], inside[inside >= 3]
    if not len(keys):
        return model
    seen, counts, rest = _context_counts(texts.filter(pa.array(~calibrates & ~toxic)), keys)
    if not rest:
        return model
    outside = np.zeros(len(keys))
    outside[np.searchsorted(keys, seen)] = counts
    base, part = size / (size + rest), inside / (inside + outside)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = part * np.log(part / base) + np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - base)), 0)
    evidence = np.where(part > base, (inside + outside) * gap, 0)
    purity = inside / (inside + outside * clean_weight + 0.5)
    chosen = np.flatnonzero((evidence > math.log(1000)) & (part > (1 + base) / 2))
    chosen = np.sort(chosen[np.argsort(-evidence[chosen], kind="stable")[:most_features]])
    certain = (evidence > math.log(100 * len(keys))) & (purity >= 0.8)
    certain, keys = np.append(certain[chosen], False), keys[chosen]
    model.keys, model.weights, model.bias = keys, np.zeros(len(keys)), -4.0

    # The field learns from the words around any chosen feature; the rest look like these words' neighbours.
    rows, first, may = [], [], []
    for _, features, doc, _ in _slices(texts.filter(pa.array(~calibrates))):
        at = model.find(features)
        near = (at < len(keys)).any(axis=1)
        for _ in range(NEAR):
            wider = near.copy()
            wider[1:] |= near[:-1] & (doc[1:] == doc[:-1])
            wider[:-1] |= near[1:] & (doc[1:] == doc[:-1])
            near = wider
        used = np.flatnonzero(near)
        fresh = np.ones(len(used), bool)
        fresh[1:] = (np.diff(used) > 1) | (doc[used][1:] != doc[used][:-1])
        rows.append(at[used].astype(np.int32))
        first.append(fresh)
        may.append(toxic[~calibrates][doc[used]])
    rows, first, may = np.concatenate(rows), np.concatenate(first), np.concatenate(may)
    if len(rows):
        marked = may & certain[rows].any(axis=1)
        for _ in range(rounds):
            _fit_field(model, rows, first, marked.astype(float))
            marked = may & (Chain(model.emission(rows), first, model.moves).marginal > 0.5)
    held = texts.filter(pa.array(calibrates))
    values = [_document_values(model.marginals(features, before), before) for _, features, _, before in _slices(held)]
    y = toxic[calibrates].astype(float)
    if 0 < y.sum() < len(y):
        model.document = _logistic(np.column_stack([np.concatenate(values), np.ones(len(y))]), y, np.where(y == 1, 1.0, clean_weight))
    return model


def _fit_field(model: ToxicityModel, rows: np.ndarray, first: np.ndarray, marked: np.ndarray, steps: int = 60, rate: float = 0.2, ridge: float = 0.02) -> None:
    """Raise the likelihood of the ``marked`` words by Adam steps on all of them."""
    size = len(model.keys)
    inner = np.flatnonzero(~first)
    observed = np.zeros((2, 2))
    np.add.at(observed, (marked[inner - 1].astype(int), marked[inner].astype(int)), 1)
    flat, scale = rows.ravel(), max(1.0, marked.sum())
    mean, spread = np.zeros(size + 5), np.zeros(size + 5)
    for step in range(1, steps + 1):
        chain = Chain(model.emission(rows), first, model.moves)
        missing = marked - chain.marginal
        slope = np.bincount(flat, np.repeat(missing, rows.shape[1]), size + 1)[:size] - ridge * model.weights
        moved = observed - chain.moves_expected() - model.moves
        whole = np.concatenate([slope, [missing.sum()], moved.ravel()]) / scale
        mean, spread = 0.9 * mean + 0.1 * whole, 0.99 * spread + 0.01 * whole**2
        change = rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6)
        model.weights = model.weights + change[:size]
        model.bias += change[size]
        model.moves = model.moves + change[size + 1 :].reshape(2, 2)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, most_features: int = MOST_FEATURES,
) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled rows of at most ``sample_bytes`` of text together, by a hash of the id.

    Up to half of both bounds goes to toxic rows; clean ones are weighted up to their number. Rows whose crc32(id as
    text) mod 5 is 0 are never learnt from. Null ids and labels other than 0 and 1 are ignored, and so is an id that is
    labelled both ways; of rows that repeat an id one is taken. Without labels of both kinds every text gets the share
    of toxic labels.
    """
    key = F.col(id_column).cast("long")
    known = labels.select(key.alias("_id"), F.col(label_column).cast("double").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & (F.crc32(F.col("_id").cast("string")) % 5 != 0))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    place, wide = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), 1 << 30
    chosen = None
    for label in (1.0, 0.0):  # about 10 % more than asked for, then exactly as many by their place
        some = known.where(F.col("_label") == label).where(place < int(wide * min(1.0, 1.1 * sample_rows / 2 / max(1, counts.get(label, 0)) + 1e-4)))
        some = some.orderBy(place, "_id").limit(sample_rows // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(key.alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")  # at most sample_rows rows
    sizes = rows.groupBy("_id").agg(F.max(F.octet_length("_text")).alias("size"), F.first("_label").alias("label"))
    sized = sorted((r["place"], r["_id"], r["size"], r["label"]) for r in sizes.withColumn("place", place).collect())  # numbers of at most sample_rows rows
    taken, weights, left = [], {}, sample_bytes
    for label in (1.0, 0.0):
        space = left // 2 if label else left
        before = len(taken)
        for _, key_value, size, own in sized:
            if own == label and size <= space:
                space, left = space - size, left - size
                taken.append(key_value)
        weights[label] = counts.get(label, 0) / max(1, len(taken) - before)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k,) for k in taken], "_id long")
    found = rows.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.max("_text").alias("_text"), F.first("_label").alias("_label"))
    table = found.orderBy(F.xxhash64("_id"), "_id").toArrow()  # at most sample_bytes of text
    marks = np.array(table.column("_label").to_pylist(), float) == 1
    return train(table.column("_text").combine_chunks() if len(table) else pa.array([], pa.string()), marks, max(1.0, weights[0.0] / max(weights[1.0], 1e-9)), most_features)


def tagged(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, spans`` for each row of ``docs``; no shuffle, each row on its own.

    ``score`` (0 to 1) is the probability that the text is toxic; ``spans`` are the stretches of words whose marginal
    probability reaches ``threshold``: (start, end) in characters, end excluded, and the greatest probability inside.

    Null and empty texts, and texts without words, have no spans and the score of a text without toxic words. Null ids
    and repeated rows are rows like others. Other columns are not read, whatever their names; an empty table gives an
    empty table. A task holds about two megabytes of text at a time, and a longer text alone, whole.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def tag(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in pieces(offsets, _BATCH_BYTES):
                part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                features, starts, ends, before = token_features(part, edges)
                marginals = model.marginals(features, before)
                hot = np.flatnonzero(marginals >= threshold)
                text_of = np.searchsorted(before, hot, "right") - 1
                fresh = np.ones(len(hot), bool)
                fresh[1:] = (np.diff(hot) > 1) | (np.diff(text_of) > 0)
                opens = np.flatnonzero(fresh)
                closes = np.append(opens[1:], len(hot))[: len(opens)] - 1
                chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                origin = chars[edges[text_of[opens]]] if len(opens) else np.zeros(0, np.int64)
                begin, end = chars[starts[hot[opens]]] - origin, chars[ends[hot[closes]]] - origin
                best = np.maximum.reduceat(marginals[hot], opens) if len(opens) else np.zeros(0)
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(best)], fields=list(kind))
                places = np.searchsorted(text_of[opens], np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(model.scores(marginals, before)), pa.ListArray.from_arrays(pa.array(places, pa.int32()), spans)],
                    ["doc_id", "score", "spans"],
                )

    return rows.mapInArrow(tag, "doc_id long, score double, spans array<struct<start: long, end: long, score: double>>")
