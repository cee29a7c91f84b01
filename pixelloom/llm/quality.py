"""Quality classifier: Bradley-Terry ranking learnt from preference pairs, thresholded at a quantile of the scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import carried, scratch, slices, store, turn_to

#: Evaluations of the loss at most (Newton steps and their halvings); L2; fall of the loss that ends the steps; bins of scores in 1.
STEPS, RIDGE, FALL, BINS = 60, 1e-3, 1e-9, 64
BATCH_BYTES = 4 << 20
#: Score at the threshold: what is below is predicted 0.
CUT = 0.3
#: Share of the documents by which the threshold's quantile may differ from that of label 0.
SLACK = 0.01
FEATURES = (
    "log_words", "upper", "digits", "symbols", "non_ascii", "mean_word", "long_words", "short_words", "distinct", "log_distinct", "top_word",
    "repeats", "stops", "bangs", "pipes", "odd_endings", "title", "line_repeats", "entropy", "distinct_endings",
)


def features(text: str | None) -> list[float]:
    """Numbers that describe a text's form: shares of kinds of characters and words, repetition, variety. All 0 for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    c = np.bincount(b, minlength=256)
    upper, lower, digit, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    symbols = c[33:127].sum() - upper - lower - digit - c[44] - c[46]
    share = c[c > 0] / len(b)
    counts = Counter(words)
    ends = Counter([w[-1] for w in words])
    lengths = np.fromiter(map(len, words), np.int64, n)
    regular = sum(k for e, k in ends.items() if e.isalnum() or e in ".,;:")
    lines = text.split("\n")
    return [
        np.log(n), upper / len(b), digit / len(b), symbols / len(b), high / len(b), min(float(lengths.mean()), 40.0), float((lengths > 14).mean()),
        float((lengths < 3).mean()), len(counts) / n, np.log(len(counts)), max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        c[46] / n, c[33] / n, c[124] / n, 1 - regular / n, sum(map(str.istitle, words)) / n, 1 - len(set(lines)) / len(lines),
        float(-(share * np.log(share)).sum()), len(ends) / min(n, 60),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  # on the Bradley-Terry score
    spread: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, bounded, and their squares, so that a middle value can be the best."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def raw(self, f: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of expanded features; added up column by column, so that a row's score is the same in any batch."""
        s = np.zeros(len(f))
        for column, w in zip(f.T, self.weights):
            s += column * w
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold, and rising with the Bradley-Terry score."""
        raw = self.raw(self.expand(x))
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.spread, -30, 30)) * (1 - CUT) / CUT)


def _rounded(a: np.ndarray) -> np.ndarray:
    """To single precision, so that the order in which sums were added up doesn't show."""
    return a.astype(np.float32).astype(float)


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sums of their rows of values."""
    if len(keys) == 0:
        return keys, values
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
    return keys[order][starts], np.add.reduceat(values[order], starts, axis=0)


# What a pass over the labelled documents adds up by a key: functions of features x and labels y that return keys and rows of values.


def _totals(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return y, np.hstack([np.ones((len(x), 1)), x])


def _deviations(x: np.ndarray, y: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(x), np.int64), (x - mean) ** 2


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.floor(raw * BINS).astype(np.int64)


def _binned(x: np.ndarray, y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By bin of the score and label (2 * bin + label): the number of documents, and their expanded features."""
    f = model.expand(x)
    return 2 * _bins(model.raw(f)) + y, np.hstack([np.ones((len(f), 1)), f])


def _outer(x: np.ndarray, y: np.ndarray, model: Model, keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of expanded features with themselves, weighted by bin and label; the key is the row of the matrix."""
    f = model.expand(x)
    w = weight[np.searchsorted(keys, 2 * _bins(model.raw(f)) + y)]
    return np.arange(f.shape[1]), (f * w[:, None]).T @ f


class Arrays:
    """Labelled documents in memory: features x, labels y."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y.astype(np.int64)

    def sums(self, of: Callable, width: int) -> tuple[np.ndarray, np.ndarray]:
        return _by_key(*of(self.x, self.y))

    def gap(self, model: Model, keys: np.ndarray, counts: np.ndarray, share: float, weight: tuple[float, float]) -> tuple[float, float]:
        """The neighbouring scores between which the threshold lies: of the gaps that have a share of the documents' weight below them that differs
        from share by SLACK at most, the widest (the lowest of these); if there are none, that whose share is nearest."""
        values, at = np.unique(model.raw(model.expand(self.x)), return_inverse=True)
        below = np.cumsum(np.bincount(at, self.y == 0)) * weight[0] + np.cumsum(np.bincount(at, self.y == 1)) * weight[1]
        return max((_rank(s, t, b, share) for s, t, b in zip(values.tolist(), values[1:].tolist(), below.tolist())), default=(0, 0, 0, values[0], values[0]))[3:]


def _rank(low: float, high: float, below: float, share: float) -> tuple[bool, float, float, float, float]:
    """The greatest of these is the gap chosen; below is the documents' weight up to low."""
    off = abs(below - share)
    fits = off <= SLACK + 1e-12
    return fits, high - low if fits else -off, -low, low, high


class Table:
    """Labelled documents as a stored table: features (array of double), label (int). Only sums and bins' bounds come to the driver."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _read(self, schema: str, of: Callable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn_to("quality")
            yield from of((_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)) for b in batches)

        return self.rows.select("features", "label").mapInArrow(run, schema)

    def sums(self, of: Callable, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers are added up as rows (key * width + column, number): a query with a column for each takes the JVM hundreds of MB to compile."""

        def partial(parts):
            keys, values = np.zeros(0, np.int64), np.zeros((0, width))
            for x, y in parts:
                k, v = of(x, y)
                keys, values = _by_key(np.concatenate([keys, k]), np.vstack([values, v]))
            at = (keys[:, None] * width + np.arange(width)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values.ravel())], names=["at", "v"])

        got = self._read("at long, v double", partial).groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
        return got["at"].to_numpy()[::width] // width, got["v"].to_numpy().reshape(-1, width)

    def gap(self, model: Model, keys: np.ndarray, counts: np.ndarray, share: float, weight: tuple[float, float]) -> tuple[float, float]:
        """As in Arrays. The counts of the bins tell in which of them the gap may lie; these bins' scores are sorted, each bin by itself."""
        bins, n = _by_key(keys >> 1, np.where((keys & 1)[:, None] == [0, 1], counts[:, None], 0.0))
        before = np.vstack([np.zeros((1, 2)), np.cumsum(n, axis=0)])  # documents of either label below each bin
        below = before[1:] @ np.array(weight)
        a, b = np.searchsorted(below, [share - SLACK - 1e-9, share + SLACK + 1e-9])
        first, last = max(int(a) - 1, 0), min(int(b) + 1, len(bins) - 1)

        def scored(parts):
            for x, y in parts:
                s = model.raw(model.expand(x))
                k = _bins(s)
                use = (k >= bins[first]) & (k <= bins[last])
                columns = k[use], s[use], y[use], *before[np.searchsorted(bins, k[use])].T.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bin", "s", "y", "n0", "n1"])

        scores = self._read("bin long, s double, y long, n0 long, n1 long", scored)
        values = scores.groupBy("bin", "s", "n0", "n1").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1"))
        in_order = Window.partitionBy("bin").orderBy("s")
        upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
        gaps = values.select("bin", "s", "n0", "n1", F.lead("s").over(in_order).alias("t"), F.sum("c0").over(upto).alias("c0"), F.sum("c1").over(upto).alias("c1"))
        off = F.abs((F.col("n0") + F.col("c0")) * F.lit(float(weight[0])) + (F.col("n1") + F.col("c1")) * F.lit(float(weight[1])) - F.lit(float(share)))
        fits = off <= SLACK + 1e-12
        rank = F.struct(fits.alias("fits"), F.when(fits, F.col("t") - F.col("s")).otherwise(-off).alias("by"), (-F.col("s")).alias("low"), "s", "t")
        best = gaps.groupBy("bin").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.max(F.when(F.col("t").isNotNull(), rank)).alias("best"))
        got = sorted(best.collect(), key=lambda r: r["bin"])
        ranks = [tuple(r["best"]) for r in got if r["best"]]
        ranks += [_rank(r["most"], q["least"], float(below[first + i]), share) for i, (r, q) in enumerate(zip(got, got[1:]))]
        return max(ranks, default=(0, 0, 0, got[0]["least"], got[0]["least"]))[3:]


def _pairs(keys: np.ndarray, sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a document of label 1 and one of label 0, with L2, and its slope. Each bin of one label meets each of the
    other, at the mean scores of their documents. Also, for the curvature: the pairs' products of features of one with the other's, and by
    bin and label the weight that its documents' products with themselves have."""
    n, f = sums[:, 0], sums[:, 1:]
    s, good, bad = f @ w / n, np.flatnonzero(keys & 1), np.flatnonzero(1 - (keys & 1))
    pairs = n[good].sum() * n[bad].sum()
    loss, pull, weight, cross = 0.0, np.zeros(len(keys)), np.zeros(len(keys)), np.zeros((len(w), len(w)))
    step = max(1, 2_000_000 // len(bad))
    for i in range(0, len(good), step):
        g = good[i : i + step]
        margin = s[g][:, None] - s[bad]
        q = 1 / (1 + np.exp(np.clip(margin, -30, 30)))  # that the pair is the other way round
        h = q * (1 - q)
        loss += n[g] @ np.logaddexp(0, -margin) @ n[bad]
        pull[g] += q @ n[bad]
        pull[bad] -= n[g] @ q
        weight[g] += h @ n[bad]
        weight[bad] += n[g] @ h
        cross += f[g].T @ (h @ f[bad])
    return loss / pairs + RIDGE / 2 * w @ w, -(f.T @ pull) / pairs + RIDGE * w, cross / pairs, weight / pairs


def fit(x: np.ndarray, y: np.ndarray, prevalence: float) -> Model:
    """As learn() does, from rows in memory. prevalence: the share of label 1 for which the threshold is set, with the labels weighted accordingly."""
    return _fit(Arrays(x, y), prevalence)


def _fit(rows: Arrays | Table, prevalence: float | None = None) -> Model:
    """Document scores w.f(x) from preference pairs (a document of label 1 over one of label 0), by logistic loss on feature differences.

    All documents and all pairs of them count. A pair's loss depends on the two scores alone, and its slope on the features linearly, so sums by
    bin of the score (BINS in 1) stand for the pairs; for that, scores are taken as their bin's mean, features as they are. The threshold
    lies at the quantile of all scores below which the share of label 0 lies; see Arrays.gap.
    """
    d = len(FEATURES)
    labels, sums = rows.sums(_totals, 1 + d)
    n = {int(k): float(v) for k, v in zip(labels, sums[:, 0])}
    n0, n1 = n.get(0, 0.0), n.get(1, 0.0)
    if prevalence is None:
        prevalence = n1 / (n0 + n1) if n0 + n1 else 0.5
    if not n0 or not n1:
        return Model(np.zeros(d), np.ones(d), np.zeros(2 * d), -1.0 if prevalence >= 0.5 else 1.0, 1.0)
    mean = _rounded(sums[:, 1:].sum(0) / (n0 + n1))
    scale = _rounded(np.sqrt(rows.sums(lambda x, y: _deviations(x, y, mean), d)[1][0] / (n0 + n1)) + 1e-6)
    model, step, best = Model(mean, scale, np.zeros(2 * d), 0.0, 1.0), np.zeros(2 * d), np.inf
    for _ in range(STEPS):
        new = replace(model, weights=_rounded(model.weights + step))
        k, v = rows.sums(lambda x, y: _binned(x, y, new), 1 + 2 * d)
        loss, slope, cross, weight = _pairs(k, v, new.weights)
        if loss < best:
            model, best, keys, sums = new, loss, k, v
            curve = rows.sums(lambda x, y: _outer(x, y, new, k, weight), 2 * d)[1] - cross - cross.T + RIDGE * np.eye(2 * d)
            step = -np.linalg.solve(curve, slope)
            fall = -slope @ step / 2
        else:
            step, fall = step / 2, fall / 2
        if fall < FALL:
            break
    weights = ((1 - prevalence) / n0, prevalence / n1)
    low, high = rows.gap(model, keys, sums[:, 0], 1 - prevalence, weights)
    raw = sums[:, 1:] @ model.weights / sums[:, 0]
    middle = np.average(raw, weights=sums[:, 0])
    spread = _rounded(np.sqrt(np.average((raw - middle) ** 2, weights=sums[:, 0])))
    return replace(model, threshold=(low + high) / 2, spread=float(spread) / 4 + 1e-9)


def learn(described: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """A model of all documents, as describe() returns them, that labels covers.

    Rows without label or key aren't used, of a key's several labels the largest counts; each of a key's several documents counts. Features
    and labels meet by key, texts aren't shuffled; the result is stored, as it is read in each step, and removed at the end.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__label"))
    with scratch(described.sparkSession):
        held = described.select(key, "features").join(rows, key).select("features", F.col("__label").alias("label"))
        return _fit(Table(store(held, "quality-rows")))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """As learn(), from whole texts of any length; null ones count as empty."""
    return learn(describe(docs.select(key, text), text), labels, label, key)


def _matrix(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _described(rows: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    yield 0, len(rows), _matrix(rows)


def _texts(rows: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for a, b in slices(rows, BATCH_BYTES):
        yield a, b, np.array([features(t) for t in rows.slice(a, b - a).to_pylist()], float)


def _mapped(df: DataFrame, column: str, added: dict[str, T.DataType], of, read=_texts, stays: bool = False) -> DataFrame:
    rows, keep, at = carried(df, column, list(added), stays)
    schema = df.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("quality")
        for batch in batches:
            for a, b, x in read(batch.column(at)):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + of(x), names=[*keep, *added])

    return rows.mapInArrow(run, schema)


def describe(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its column text, plus features (array of double, as FEATURES)."""
    return _mapped(df, text, {"features": T.ArrayType(T.DoubleType())}, lambda x: [pa.array(list(x), pa.list_(pa.float64()))])


def score(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("quality_score", "rejected"), stays: bool = False) -> DataFrame:
    """df without its column text (with it, if it stays), plus quality_score (double, 0 to 1) and rejected (boolean: score below CUT), or as names calls them.

    Null and empty texts have all features 0 and are scored so. Columns of these names, in any case, are replaced; repeated rows and empty tables need no
    care; whole texts are read. Nothing is shuffled; the model, a few hundred numbers, goes along with the tasks.
    """
    return _judged(df, model, text, names, _texts, stays)


def score_described(df: DataFrame, model: Model, names: tuple[str, str] = ("quality_score", "rejected")) -> DataFrame:
    """As score(), of documents as describe() returns them; without the column features."""
    return _judged(df, model, "features", names, _described)


def _judged(df: DataFrame, model: Model, column: str, names: tuple[str, str], read, stays: bool = False) -> DataFrame:
    def of(x: np.ndarray) -> list[pa.Array]:
        s = model.score(x)
        return [pa.array(s, pa.float64()), pa.array(s < CUT, pa.bool_())]

    return _mapped(df, column, {names[0]: T.DoubleType(), names[1]: T.BooleanType()}, of, read, stays)
