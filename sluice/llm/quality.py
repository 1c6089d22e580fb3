"""Document quality by a sparse rule ensemble.

Small boosted trees are grown on text statistics of a bounded sample of labelled rows. Every path of a tree from its
root is a rule, a conjunction of comparisons. A logistic model with an L1 penalty weighs the rules and drops most of
them. What is left is compiled into one Spark column expression, so all texts are scored inside Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 24, 3, 48

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold) each


def statistics(text: Column) -> dict[str, Column]:
    """Numbers of a text; for shares, of its characters or words."""

    def times(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "size": F.log1p(F.length(text).cast("double")), "words": F.log1p(F.size(words).cast("double")),
        "word_size": size / count, "distinct": F.size(F.array_distinct(words)) / count,
        "upper": times("[A-Z]") / size, "digits": times("[0-9]") / size, "marks": times("[.,;:]") / size,
        "loud": times("[!?]") / size, "signs": times(r"[#$%&*+=<>@~^_{}\[\]\\/|]") / size, "bars": times(r"\|") / size, "lines": times("\n") / size,
    }


def _grow(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, rules: set, out: np.ndarray) -> None:
    """Split by the best gain of second-order boosting; note every path and add the leaf values to ``out``."""
    if path:
        rules.add(tuple(sorted(path)))
    total, mass = slope[rows].sum(), weight[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 40:
        for k, cut in enumerate(edges):
            if not len(cut):
                continue
            left = np.cumsum(np.bincount(bins[rows, k], slope[rows], len(cut) + 1))[:-1]
            heavy = np.cumsum(np.bincount(bins[rows, k], weight[rows], len(cut) + 1))[:-1]
            gain = left**2 / (heavy + 1) + (total - left) ** 2 / (mass - heavy + 1) - total**2 / (mass + 1)
            gain[(heavy < 1) | (mass - heavy < 1)] = 0
            place = int(np.argmax(gain))
            if gain[place] > best[0]:
                best = (gain[place], (k, place))
    if best[1] is None:
        out[rows] += 0.3 * total / (mass + 1)
        return
    k, place = best[1]
    above = bins[rows, k] > place
    for side in (False, True):
        _grow(bins, edges, slope, weight, rows[above == side], (*path, (k, side, float(edges[k][place]))), rules, out)


def grow_rules(values: np.ndarray, labels: np.ndarray) -> list[Rule]:
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in values.T]
    bins = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(edges, values.T)], axis=1)
    rules: set[Rule] = set()
    margin = np.zeros(len(labels))
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        _grow(bins, edges, labels - chance, chance * (1 - chance), np.arange(len(labels)), (), rules, margin)
    return sorted(rules)


def holds(rule: Rule, values: np.ndarray) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for k, above, cut in rule:
        ok &= (values[:, k] > cut) == above
    return ok


def fit_weights(x: np.ndarray, labels: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the intercept is free."""
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weights, bias = np.zeros(x.shape[1]), math.log(share / (1 - share))
    if not x.shape[1]:
        return weights, bias
    rate = 4 * len(x) / (np.linalg.norm(np.column_stack([x, np.ones(len(x))]), 2) ** 2)
    ahead, ahead_bias, pace = weights, bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ ahead + ahead_bias))) - labels
        new = ahead - rate * (x.T @ error) / len(x)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias, next_pace = ahead_bias - rate * error.mean(), (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / next_pace * (new - weights)
        ahead_bias = new_bias + (pace - 1) / next_pace * (new_bias - bias)
        weights, bias, pace = new, new_bias, next_pace
    return weights, bias


class RuleModel:
    """Weighted rules over ``statistics``."""

    def __init__(self, names: list[str], rules: list[Rule], weights: list[float], bias: float):
        self.names, self.rules, self.weights, self.bias = names, rules, weights, bias

    def score(self, statistic: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            parts = [statistic[self.names[k]] > F.lit(cut) if above else statistic[self.names[k]] <= F.lit(cut) for k, above, cut in rule]
            condition = parts[0]
            for part in parts[1:]:
                condition = condition & part
            total = total + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS, penalty: float = 0.002,
) -> RuleModel:
    """Learn from at most ``sample_rows`` labelled rows, taken by a hash of the id (all rows where there are fewer).

    Rows whose crc32(id as text) mod 3 is 1 are never learnt from. Null ids and labels other than 0 and 1 are ignored,
    and so is an id that is labelled both ways. Without labelled rows the model scores 0.5 everywhere.
    """
    key = F.col(id_column).cast("long")
    known = labels.select(key.alias("_id"), F.col(label_column).cast("double").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & (F.crc32(F.col("_id").cast("string")) % 3 != 1))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    count, wide = known.count(), 1 << 30
    place = F.pmod(F.xxhash64("_id"), F.lit(wide))
    if count > sample_rows:
        known = known.where(place < int(wide * min(1.0, 1.05 * sample_rows / count)))
    known = known.orderBy(place, "_id").limit(sample_rows)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(key.alias("_id"), text.alias("_text")).join(F.broadcast(known), "_id")  # at most sample_rows rows
    named = statistics(F.col("_text"))
    taken = rows.select("_id", "_label", *[column.alias(name) for name, column in named.items()]).orderBy("_id", *named).limit(sample_rows).collect()
    names = list(named)
    if not taken:
        return RuleModel(names, [], [], 0.0)
    values = np.array([[row[name] for name in names] for row in taken])
    marks = np.array([row["_label"] for row in taken])
    rules = grow_rules(values, marks)
    x = np.array([holds(rule, values) for rule in rules], float).reshape(len(rules), len(values)).T
    weights, bias = fit_weights(x, marks, penalty)
    kept = [k for k in range(len(rules)) if abs(weights[k]) > 1e-4]
    return RuleModel(names, [rules[k] for k in kept], [weights[k] for k in kept], bias)


def scored(docs: DataFrame, model: RuleModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a score in 0 to 1 (higher: label 1 likelier). Null text is scored as empty; all rows are kept."""
    helpers = {name: f"_stat_{name}" for name in model.names}
    named = statistics(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    measured = docs.select("*", *[named[name].alias(column) for name, column in helpers.items()])
    return measured.withColumn(score_column, model.score({n: F.col(c) for n, c in helpers.items()})).drop(*helpers.values())
