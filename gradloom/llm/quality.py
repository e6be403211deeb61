"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins.  Cyclic boosting visits the features in turn and
fits a shallow tree on each one's bins, so a feature's trees add up to one lookup table; then
the pairs with the most gain left get two-way tables in the same way.  A score is the logistic
function of a sum of table entries, added up by numpy for a batch at a time.

The model is fitted on at most ``rows`` labelled texts (those with the smallest md5 of their
key: the documented bound of the sample); every text is scored whole.  Null text is empty and
empty text has a score like any other.  Rows with a null label or key are not learned from, a
label that occurs twice counts twice, and without labels every score is 0.5.  Only the text
enters a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.llm import tokens as T

FEATURES = """log_bytes log_words word_length long_words short_words capitals upper_words digits other_marks exclamations bars
stops commas lines_per_word non_ascii distinct_words repeated_words marked_words""".split()


class Settings(NamedTuple):
    rows: int = 20_000
    bins: int = 32
    rounds: int = 150
    rate: float = 0.1
    splits: int = 3  # of a tree on one feature
    pairs: int = 10
    pair_bins: int = 8
    pair_rounds: int = 60
    least: int = 5  # rows on either side of a split


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # two features, their bins' pair bins, table


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789")
_OTHER = _marks("#$%&*+/<=>@[\\]^_`{}~()\"':;-?")
_BANG, _BAR, _STOP, _COMMA, _LINE = _marks("!"), _marks("|"), _marks("."), _marks(","), _marks("\n")


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a slice."""
    n = len(starts) - 1
    first, end, doc = T.words(data, starts)
    hashes = T.word_hashes(data, first, end) if len(first) else np.empty(0, np.uint64)
    size = np.diff(starts).astype(float)
    count = np.bincount(doc, minlength=n).astype(float)
    length = end - first

    def total(flags: np.ndarray) -> np.ndarray:
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=before[1:])
        return (before[starts[1:]] - before[starts[:-1]]).astype(float)

    def words_where(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=n).astype(float)

    upper = _UPPER[data]
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=capitals[1:])
    loud = (capitals[end] - capitals[first]) * 2 >= length if len(first) else np.empty(0, bool)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(first), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    last = data[end - 1] if len(end) else np.empty(0, np.uint8)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(count),
            np.bincount(doc, weights=length, minlength=n) / per_word,
            words_where(length > 15) / per_word,
            words_where(length < 4) / per_word,
            total(upper) / per_byte,
            words_where(loud & (length > 1)) / per_word,
            total(_DIGIT[data]) / per_byte,
            total(_OTHER[data]) / per_byte,
            total(_BANG[data]) / per_byte,
            total(_BAR[data]) / per_byte,
            total(_STOP[data]) / per_word,
            total(_COMMA[data]) / per_word,
            total(_LINE[data]) / per_word,
            total(data > 127) / per_byte,
            np.bincount(doc[order][fresh], minlength=n) / per_word,
            words_where(again) / per_word,
            words_where(_OTHER[last]) / per_word,
        ]
    )


def _table(columns: list) -> np.ndarray:
    return np.concatenate(columns) if columns else np.empty((0, len(FEATURES)))


def _steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Leaf value of every bin: a tree of at most ``splits`` splits, best one first."""
    G, H, N = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
    cuts = [0, len(g)]
    for _ in range(s.splits):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            left, right = (G[k] - G[a]) ** 2 / (H[k] - H[a] + 1), (G[b] - G[k]) ** 2 / (H[b] - H[k] + 1)
            gain = left + right - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
            gain[(N[k] - N[a] < s.least) | (N[b] - N[k] < s.least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], int(k[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on either axis."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda X: (X[:-1, :-1], X[:-1, -1:] - X[:-1, :-1], X[-1:, :-1] - X[:-1, :-1], X[-1, -1] - X[:-1, -1:] - X[-1:, :-1] + X[:-1, :-1])
    gs, hs = quarter(G), quarter(H)
    gain = sum(a * a / (b + 1) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [a[i, j] / (b[i, j] + 1) for a, b in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1)), out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def boost(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on a table of features and 0/1 labels."""
    if not len(y):
        return Model(0.0, [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1], method="lower")) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    f = np.full(len(y), base)
    for _ in range(s.rounds):
        for b, t, n in zip(bins, tables, counts, strict=True):
            p = _logistic(f)
            step = s.rate * _steps(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), n, s)
            t += step
            f += step[b]
    coarse = [np.arange(len(t)) * s.pair_bins // max(len(t), s.pair_bins) for t in tables]
    p, ranked = _logistic(f), []
    shape = (s.pair_bins, s.pair_bins)

    def sums(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a][bins[a]] * s.pair_bins + coarse[b][bins[b]], w, s.pair_bins**2).reshape(shape)

    for a in range(len(bins)):
        for b in range(a):
            ranked.append((_quarters(sums(a, b, y - p), sums(a, b, p * (1 - p)))[0], a, b))
    pairs = [(a, b, np.zeros(shape)) for _, a, b in sorted(ranked, reverse=True)[: s.pairs]]
    for _ in range(s.pair_rounds):
        for a, b, t in pairs:
            p = _logistic(f)
            step = s.rate * _quarters(sums(a, b, y - p), sums(a, b, p * (1 - p)))[1]
            t += step
            f += step[coarse[a][bins[a]], coarse[b][bins[b]]]
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in pairs])


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model.base)
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    for b, t in zip(bins, model.tables, strict=True):
        f += t[b]
    for a, b, ca, cb, t in model.pairs:
        f += t[ca[bins[a]], cb[bins[b]]]
    return _logistic(f)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the labelled rows of ``docs``; ``labels`` has key and label."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k", "y").limit(settings.rows)
    # No more rows than ``settings.rows``, so they may be broadcast; the texts stay in place.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def measure(batches):
        for batch in batches:
            x = _table([features(data, starts) for _, data, starts in T.slices(batch.column(2))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c) for c in x.T]], names=["k", "y", *names])

    schema = f"k {dict(rows.dtypes)['k']}, y double, " + ", ".join(f"{n} double" for n in names)
    got: pd.DataFrame = rows.mapInArrow(measure, schema).toPandas().sort_values(["k", "y", *names])
    return boost(got[names].to_numpy(float), got["y"].to_numpy(float), settings)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (probability of label 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    columns = [*keep, "score"]

    def run(batches):
        for batch in batches:
            x = _table([features(data, starts) for _, data, starts in T.slices(batch.column(batch.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(shared.value, x))], names=columns)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, score double")
