"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy, with calibrated rejection.

Beside the languages the model learns a class of texts in none of them, from texts with shuffled letters and from random letters of other
alphabets. A text that is long enough to tell is rejected where this class is ODDS times likelier than the best language, and any text where
the best of the languages isn't likely enough beside the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import carried, slices, turn_to

#: Rows of the embedding table, its width, and the subword lengths in characters (a word's border counts as one).
BUCKETS, WIDTH, LENGTHS = 1 << 16, 16, (2, 3, 4)
#: Training: labelled documents for each language at most, about; longest of them in characters; epochs; words of the short pieces.
SAMPLE, LONGEST, EPOCHS, PIECE = 1000, 100_000, 4, (3, 30)
#: Characters of the shortest pieces that are turned into text in no language.
SHORTEST = 12
#: Subwords of the shortest texts (some 30 letters) that the class of no language can reject, and how much likelier it must be.
FEWEST, ODDS = 80, 3.0
#: A text is rejected if its best probability is below the level that this share of the held-back, rightly recognised training texts exceeds.
KEEP_SHARE = 0.9999
UNKNOWN = "und"
BATCH_BYTES = 1 << 19


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point below 0x33480, which has all letters, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x33480)), bool, 0x33480)


def subwords(points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Starts and buckets of the subwords of each length in a lower-cased text of code points; and where letters are.

    Anything but letters counts as one border character; a subword has no border inside, and at least one letter.
    """
    is_letter = letters()[np.minimum(points, 0x3347F)]
    c = np.where(is_letter, points, 0).astype(np.uint64)
    starts, buckets = [], []
    for n in LENGTHS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        inside = is_letter[1 : m + 1].copy() if n > 2 else is_letter[:m] | is_letter[1 : m + 1]
        for k in range(2, n - 1):
            inside &= is_letter[k : m + k]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h + c[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        starts.append(at)
        buckets.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1))
    return starts, buckets, is_letter


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embeddings times output weights: (BUCKETS, languages and none of them)
    bias: np.ndarray
    heat: float  # divides the logits
    least: float  # probabilities below are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, probabilities and whether rejected; und, 0 and rejected for a text that is null or has no letter."""
        n, k = len(texts), len(self.languages)
        sums, counts, some = np.zeros((n, self.table.shape[1])), np.zeros(n), np.zeros(n, bool)
        points = [code_points(t or "") for t in texts]
        ends = np.cumsum([len(p) for p in points])
        whole = np.concatenate(points) if points else np.zeros(0, np.uint32)
        step = 4 * BATCH_BYTES  # a very long text is read in overlapping stretches
        for a in range(0, len(whole), step):
            stretch = whole[a : a + step + max(LENGTHS) - 1]
            starts, buckets, is_letter = subwords(stretch)
            np.logical_or.at(some, np.searchsorted(ends, a + np.flatnonzero(is_letter[:step]), "right"), True)
            for at, bucket in zip(starts, buckets):
                bucket, at = bucket[at < step], at[at < step]
                own = np.searchsorted(ends, a + at, "right")
                first = np.flatnonzero(np.diff(own, prepend=-1))
                if len(first):
                    sums[own[first]] += np.add.reduceat(self.table[bucket], first, axis=0, dtype=np.float64)
                    counts += np.bincount(own, minlength=n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.heat
        none = z[:, k] - z[:, :k].max(1) > np.log(ODDS)
        p = np.exp(z[:, :k] - z[:, :k].max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = np.where(some, p[np.arange(n), best], 0.0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], score, ~some | (score < self.least) | (none & (counts >= FEWEST))


def no_language(text: str, rng: np.random.Generator) -> np.ndarray:
    """Code points of a text in no language: text with its letters shuffled, or with random ones of some 30 in a row of all letters instead."""
    points = code_points(text).copy()
    at = np.flatnonzero(letters()[np.minimum(points, 0x3347F)])
    if rng.random() < 0.5:
        points[at] = rng.permutation(points[at])
    else:
        every = np.flatnonzero(letters())
        points[at] = every[int(rng.integers(len(every) - 30)) + rng.integers(30, size=len(at))]
    return points


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """A model of the given texts, whole and in random short pieces; a tenth of the texts is held back for calibration."""
    languages = sorted(set(langs))
    others = np.random.default_rng(seed + 1)
    k, rng = len(languages), np.random.default_rng(seed)
    back = rng.random(len(texts)) < 0.1 if len(texts) >= 50 else np.zeros(len(texts), bool)
    examples, held = [], []
    for t, lang, b in zip(texts, langs, back):
        y, words = languages.index(lang), t.split()
        pieces = [t]
        for _ in range(3):
            if len(words) > PIECE[1]:
                w = int(rng.integers(*PIECE))
                i = int(rng.integers(len(words) - w))
                pieces.append(" ".join(words[i : i + w]))
        every = [(code_points(s), y) for s in pieces]
        every += [(no_language(s, others), k) for s in pieces[-2:] if len(s) >= SHORTEST]
        for points, y in every:
            found = subwords(points)[1]
            ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
            if len(ids):
                (held if b else examples).append((ids, (n / n.sum()).astype(np.float32), y))
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, k + 1), np.float32), np.zeros(k + 1, np.float32)
    steps, done = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for j in rng.permutation(len(examples)):
            ids, share, y = examples[j]
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = 1.0 * (1 - done / steps)
            back_prop = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            emb[ids] -= (10 * rate) * np.outer(share, back_prop)
            done += 1
    table = emb @ out
    heat, least = 1.0, 0.0
    check = held or examples
    if check and k:
        z = np.array([share @ table[ids] + bias for ids, share, _ in check], np.float64)
        y = np.array([e[2] for e in check])

        def loss(h: float) -> float:
            q = z / h - (z / h).max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]))

        heat = min((float(h) for h in np.geomspace(0.05, 20, 61)), key=loss)
        right = (z[:, :k].argmax(1) == y) & (y < k)
        if right.any():  # the class of no language takes no larger share of them than KEEP_SHARE leaves
            move = min(0.0, float(np.quantile(z[right, :k].max(1) - z[right, k], 1 - KEEP_SHARE)))
            bias[k] += move
            z[:, k] += move
        q = np.exp(z[:, :k] / heat - (z[:, :k] / heat).max(1, keepdims=True))
        top = (q / q.sum(1, keepdims=True)).max(1)[right]
        least = float(np.quantile(top, 1 - KEEP_SHARE)) if len(top) else 0.0
    return Model(languages, table, bias, heat, least)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of about sample labelled rows for each language (all, if fewer), chosen by a hash of key.

    Rows without text, language or key, and texts longer than LONGEST, aren't used. Rows that come to the driver: sample for each language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, -(-sample * 1_000_000 // n)))]), F.col(lang))
    chosen = rows.where((F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1_000_000)) < share) & (F.length(text) <= LONGEST))
    got = sorted(chosen.select(key, text, lang).collect(), key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in got], [r[2] for r in got])


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "rejected"), stays: bool = False) -> DataFrame:
    """df without its column text (with it, if it stays), plus lang_pred (string), lang_score (double, 0 to 1) and rejected (boolean), or as names calls them.

    Null texts and texts without a letter: und, 0, rejected. So are all texts if the model has no language. Ties go to the language first in order.
    Columns of these names, in any case, are replaced; repeated rows and empty tables need no care; whole texts are read, in stretches.
    Nothing is shuffled; the model goes along with the tasks.
    """
    read, keep, at = carried(df, text, list(names), stays)
    schema = df.select(*keep).schema
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language_id")
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts, BATCH_BYTES):
                pred, score, rejected = model.predict(texts.slice(a, b - a).to_pylist())
                columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + columns, names=[*keep, *names])

    return read.mapInArrow(run, schema)
