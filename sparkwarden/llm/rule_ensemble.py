"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every whole text are counted in one Arrow pass (:data:`STATISTICS`).
2. On a bounded sample of labelled rows (``sample_rows``, those with the least hash of
   their id) shallow trees are boosted; every path from a root to a node becomes a
   conjunctive rule.
3. A logistic model with an L1 penalty gives each rule a weight, most of them 0.  If more than ``most_rules`` are left the
   penalty is raised and the rules left are fitted anew: what is compiled must stay one method of generated code.
4. The rules that are left are compiled into one Spark column expression.

Training is bounded by ``sample_rows`` and happens on the driver; scoring is narrow.

Result: ``doc_id, score, keep``; ``score`` is the probability of good quality, ``keep``
is ``score >= threshold``.

Edge cases.  Null and empty texts, and texts without a word, score 0 and are rejected.  Texts of any length are counted
whole.  Equal texts score alike; a score of just the threshold is kept.
Labels that are null count as missing; of several labels of one doc_id the least
counts.  With no labelled rows, or labels of one kind only, every text with a word
scores 1 and stays.  Repeated rows and null doc_ids are scored each for itself; an empty
table gives no rows; extra columns are handed on by :func:`filtered`, ignored by
:func:`scored`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .storage import free_name

STATISTICS = ("words", "mean_word", "longest_word", "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "lines", "distinct", "repeats", "wide")
SAMPLE_ROWS = 12_000
THRESHOLD = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[192:] = True  # one for each letter beyond ASCII
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True


def per_text(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are hit."""
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text; zeros where there is no word."""
    data, offsets = arrays.raw(texts)
    hashes, start, end, counts = arrays.words(data, offsets, arrays.EXACT)
    n = len(counts)
    out = np.zeros((n, len(STATISTICS)))
    rows = np.flatnonzero(counts)
    if len(rows) == 0:
        return out
    words = counts[rows].astype(float)
    first = (np.cumsum(counts) - counts)[rows]
    size = end - start
    doc = np.repeat(np.arange(n), counts)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # Distinct words: one sort, the text's number above the hash.
    key = np.sort((doc.astype(np.uint64) << np.uint64(43)) | (hashes >> np.uint64(21)))
    new = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[new] >> np.uint64(43)).astype(np.int64), minlength=n)[rows]
    letters = np.maximum(per_text(_ALPHA[data], offsets)[rows], 1)
    count = lambda c: per_text(data == ord(c), offsets)[rows] / words
    out[rows] = np.column_stack(
        [
            words,
            np.add.reduceat(size, first) / words,
            np.maximum.reduceat(size, first),
            per_text(_UPPER[data], offsets)[rows] / letters,
            per_text(_DIGIT[data], offsets)[rows] / words,
            per_text(_SYMBOL[data], offsets)[rows] / words,
            count("!"),
            count("|"),
            count("."),
            count(","),
            count("\n"),
            distinct / words,
            np.add.reduceat(same, first) / words,
            per_text(data >= 192, offsets)[rows] / letters,
        ]
    )
    return np.round(out, 6)


def statistics_column(text: Column) -> Column:
    """``array<double>`` in the order of :data:`STATISTICS`."""

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        texts = arrays.text_column(column)
        parts = [statistics(texts.slice(lo, hi - lo)).reshape(-1) for lo, hi in arrays.slices(texts)]
        flat = np.concatenate(parts) if parts else np.zeros(0)
        arrays.release()
        k = len(STATISTICS)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k), pa.array(flat))

    # Else the optimizer would evaluate it for a filter and again for a projection.
    return of.asNondeterministic()(text.cast("string"))


# --- training ----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic, above, value)``: greater than the value, or at most it."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, value in self.conditions:
            out &= (x[:, j] > value) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for j, above, value in self.conditions:
            out = out & (stats[j] > F.lit(value) if above else stats[j] <= F.lit(value))
        return out


@dataclass
class Model:
    intercept: float = 30.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-z)), 0.0)

    def column(self, stats: Column) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.when(stats[0] > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.lit(0.0))


def simplified(conditions: list[tuple[int, bool, float]]) -> tuple[tuple[int, bool, float], ...]:
    """Of several bounds on one side of a statistic, the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for j, above, value in conditions:
        old = best.get((j, above))
        best[j, above] = value if old is None else max(old, value) if above else min(old, value)
    return tuple((j, above, value) for (j, above), value in sorted(best.items()))


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, leaf: int, rate: float, seed: int) -> list[Rule]:
    """Rules of all nodes of ``trees`` boosted trees, each grown on half of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    rng = np.random.Generator(np.random.PCG64(seed))
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        half = np.flatnonzero(rng.random(len(y)) < 0.5)
        nodes: list[tuple[list, np.ndarray, np.ndarray]] = [([], half, np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for conditions, own, every in nodes:
                split = _best_split(binned[own], gradient[own], hessian[own], cuts, leaf) if level < depth else None
                if split is None:
                    step = gradient[own].sum() / (hessian[own].sum() + 1.0) if len(own) else 0.0
                    f[every] += rate * np.clip(step, -4, 4)
                    continue
                j, k = split
                for above in (False, True):
                    path = [*conditions, (j, above, float(cuts[j][k]))]
                    rules[Rule(simplified(path))] = None
                    following.append((path, own[(binned[own, j] > k) == above], every[(binned[every, j] > k) == above]))
            nodes = following
    return list(rules)


def _best_split(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], leaf: int) -> tuple[int, int] | None:
    best, found = 1e-3, None
    total_g, total_h = gradient.sum(), hessian.sum()
    base = total_g**2 / (total_h + 1)
    for j, c in enumerate(cuts):
        if len(c) == 0:
            continue
        size = len(c) + 1
        g = np.cumsum(np.bincount(binned[:, j], gradient, size))[:-1]
        h = np.cumsum(np.bincount(binned[:, j], hessian, size))[:-1]
        n = np.cumsum(np.bincount(binned[:, j], minlength=size))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - base
        gain[(n < leaf) | (len(binned) - n < leaf)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = float(gain[k]), (j, k)
    return found


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept goes unpenalised."""
    n, k = z.shape
    design = np.column_stack([np.ones(n, np.float32), z.astype(np.float32)])
    v = np.full(k + 1, 1 / np.sqrt(k + 1), np.float32)
    for _ in range(20):  # largest singular value, for the step
        v = design.T @ (design @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 4 * n / (norm * 1.05)
    w = np.zeros(k + 1)
    look, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(design @ look.astype(np.float32))))
        after = look - step * (design.T @ (p - y).astype(np.float32)) / n
        after[1:] = np.sign(after[1:]) * np.maximum(np.abs(after[1:]) - step * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = after + (t - 1) / u * (after - w), after, u
    return float(w[0]), w[1:]


def trained(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, most_rules: int = 48, seed: int = 1) -> Model:
    """A model of rows ``x`` of statistics with labels ``y`` (1 good, 0 bad).

    The penalty is raised until at most ``most_rules`` are left: what Spark compiles into one method."""
    some = x[:, 0] > 0
    x, y = x[some], y[some].astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model()
    rules = tree_paths(x, y, trees, depth, bins=64, leaf=max(2, min(20, len(y) // 20)), rate=0.2, seed=seed)
    if not rules:
        return Model()
    z = np.column_stack([r.holds(x) for r in rules])
    _, once = np.unique(np.packbits(z, axis=0), axis=1, return_index=True)  # rules that no row tells apart
    once = np.sort(once)
    while True:
        intercept, weights = lasso_logistic(z[:, once], y, penalty)
        if (np.abs(weights) > 1e-4).sum() <= most_rules:
            break
        once = once[np.abs(weights) > 1e-4]
        penalty *= 1.6
    kept = [(rules[k], round(float(w), 6)) for k, w in zip(once.tolist(), weights, strict=True) if abs(w) > 1e-4]
    return Model(round(intercept, 6), kept)


def fitted(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``sample_rows`` labelled rows of ``df``; their choice depends on ids alone."""
    known = labels.select(labels[id_column].cast("long").alias("k"), labels[label_column].cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))
    ids = df.select(df[id_column].cast("long").alias("k")).where("k is not null").distinct()
    chosen = known.join(ids, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    texts = df.select(df[id_column].cast("long").alias("k"), df[text_column].alias("t"))
    rows = texts.join(F.broadcast(chosen), "k").select("k", "y", statistics_column(F.col("t")).alias("s")).groupBy("k").agg(F.first("y").alias("y"), F.max("s").alias("s")).toPandas()
    if len(rows) == 0:
        return Model()
    rows = rows.sort_values("k")
    return trained(np.array(rows["s"].tolist()), (rows["y"].to_numpy() > 0).astype(int))


def scored(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, score, keep`` of every row."""
    model = fitted(df, labels, id_column, text_column, sample_rows=sample_rows)
    stats = df.select(df[id_column].cast("long").alias("doc_id"), statistics_column(df[text_column]).alias("s"))
    return stats.select("doc_id", F.round(model.column(F.col("s")), 6).alias("score")).withColumn("keep", F.col("score") >= threshold)


def filtered(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that are kept, with all its columns."""
    model = fitted(df, labels, id_column, text_column, sample_rows=sample_rows)
    mark = free_name(df, "statistics")
    return df.withColumn(mark, statistics_column(df[text_column])).where(F.round(model.column(F.col(mark)), 6) >= threshold).drop(mark)
