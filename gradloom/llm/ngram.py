"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by workers.

A gram of level k is the pair of its two level k - 1 grams, the one without its last word (its
context) and the one without its first (its suffix), and its key is a 64-bit hash of the two.
Tasks count grams in numpy and send sorted runs, one blob for each shard of the key space, so
the shuffle moves packed arrays and a frequent gram is one entry for each task.  A shard adds
its runs up, writes keys and counts as sorted arrays to the shared folder, and sends to the
level below how many distinct words precede each suffix and what follows each context.

Workers map the arrays of all shards and look up sorted queries; pages that are not asked for
are never read.  The model has one entry for each distinct gram and is neither broadcast nor
held in memory.

Defined cases: null text is empty and scores its end token only; unknown words get their share
of the uniform distribution over the vocabulary and one unknown word; an unseen context falls
back to the level below; with too few counts for a discount it is 0.75 of the count's step.
Repeated rows count as often as they occur.  Without training text every probability is 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.llm import runs as R
from gradloom.llm import tokens as T
from gradloom.llm.storage import Folder

#: Tokens counted in a task before its sorted runs are sent.
RUN_TOKENS = 2_000_000
FACTS = ("types", "total", "tokens", "ones", "twos", "threes", "fours")
RESULT = "shard int, blob binary, " + ", ".join(f"{f} bigint" for f in FACTS)


def token_grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each after ``order - 1`` start marks and before one end mark; text numbers; which are tokens."""
    first, end, doc = T.words(data, starts)
    n = len(starts) - 1
    counts = np.bincount(doc, minlength=n)
    pad = order - 1
    sizes = counts + pad + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if n else 0, T.START)
    real = np.zeros(len(out), bool)
    if len(first):
        at = np.arange(len(first)) + (np.arange(n) * (pad + 1) + pad)[doc]
        out[at] = T.word_hashes(data, first, end)
        real[at] = True
    out[ends - 1] = T.END
    real[ends - 1] = True
    return out, np.repeat(np.arange(n), sizes), real


def levels(hashes: np.ndarray, order: int) -> list[np.ndarray]:
    """Key of the level k gram that ends at each position, for k = 1..order (those before position k - 1 mean nothing)."""
    keys = [hashes]
    for _ in range(order - 1):
        last = keys[-1]
        keys.append(np.concatenate([last[:1], T.chain(last[:-1], last[1:])]))
    return keys


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _pairs(contexts: np.ndarray, suffixes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Packed runs of (context, suffix, count), by shard of their key."""
    shard = (T.chain(contexts, suffixes) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.lexsort((contexts, shard))
    contexts, suffixes, counts, shard = contexts[order], suffixes[order], counts[order], shard[order]
    cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
    some = np.flatnonzero(np.diff(cuts))
    blobs = [R.pack(*(x[cuts[s] : cuts[s + 1]] for x in (contexts, suffixes, counts))) for s in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _count(docs: DataFrame, text: str, order: int, level: int, bits: int) -> DataFrame:
    """Sorted runs of the grams of one level: of pairs from level 2 on, of (word, count) at level 1."""

    def count(batches):
        kept, size = [], 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
            if level == 1:
                word, n = _sum_by(columns[0], np.ones(len(columns[0]), np.uint64))
                yield R.blobs(word, bits, n)
                return
            key = T.chain(*columns)
            order_ = np.argsort(key, kind="stable")
            key = key[order_]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key))).astype(np.uint64)
            yield _pairs(columns[0][order_][first], columns[1][order_][first], n, bits)

        for batch in batches:
            for _, data, starts in T.slices(batch.column(0)):
                hashes, _, real = token_grams(data, starts, order)
                at = np.flatnonzero(real)
                below = levels(hashes, order)[max(level - 2, 0)]
                kept.append((below[at],) if level == 1 else (below[at - 1], below[at]))
                size += len(at)
                if size >= RUN_TOKENS:
                    yield from flush()
                    kept, size = [], 0
        if size:
            yield from flush()

    return docs.select(F.col(text)).mapInArrow(count, R.BLOB)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _file(level: int, shard: int) -> str:
    return f"{level}-{shard:06d}"


def _store(folder: Folder, level: int, shard: int, keys: np.ndarray, *columns: np.ndarray) -> None:
    """Keys, then each column in its narrowest type; a fixed-size head says where each starts."""
    columns = [_narrow(c) for c in columns]
    head = np.array([len(keys), len(columns), *(c.dtype.itemsize for c in columns)], np.uint64)
    parts = [head.tobytes(), keys.tobytes()]
    for c in columns:
        parts += [c.tobytes(), b"\0" * (-c.nbytes % 8)]
    folder.write(_file(level, shard), *parts)


def _load(folder: Folder, level: int, shard: int) -> list[np.ndarray]:
    raw = folder.mapped(_file(level, shard), "u1")
    n, columns = (int(x) for x in raw[:16].view(np.uint64))
    widths = [int(x) for x in raw[16 : 16 + 8 * columns].view(np.uint64)]
    at = 16 + 8 * columns
    out = [raw[at : at + 8 * n].view(np.uint64)]
    at += 8 * n
    for w in widths:
        out.append(raw[at : at + w * n].view(f"u{w}"))
        at += -(-w * n // 8) * 8
    return out


def _columns(runs: list, n: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*runs, strict=True)] if runs else [np.empty(0, np.uint64)] * n


def _distinct(runs: list) -> tuple[np.ndarray, ...]:
    """(key, context, suffix, count) of the distinct grams in runs of (context, suffix, count), by key."""
    context, suffix, times = _columns(runs, 3)
    key = T.chain(context, suffix)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.add.reduceat(times[order], first) if len(first) else times[:0]
    return key[first], context[order][first], suffix[order][first], count


def _gather(runs: DataFrame, level: int, order: int, bits: int, folder: Folder) -> DataFrame:
    """Add up the runs of each shard, write its arrays, and send sums to the level below and totals to the driver."""

    def add(batches):
        waiting, size = [], 0  # sums of several shards go down together, or there would be a run for each pair of shards
        for shard, blobs in R.shards(batches):
            runs_of = {2: [], 3: [], 6: []}  # (word, count), (context, suffix, count), what the level above sends
            for blob in blobs:
                columns = R.unpack(blob)
                runs_of[len(columns)].append(columns)
            key, context, suffix, count = _distinct(runs_of[3])
            types, tokens = len(key), int(count.sum())
            if level == order:
                _store(folder, level, shard, key, count)
            else:
                above = _sum_by(*_columns(runs_of[6], 6))
                words = _sum_by(*_columns(runs_of[2], 2))
                known = np.union1d(above[0], words[0] if level == 1 else key)
                table = [_spread(known, above[0], v) for v in above[1:]]
                if level == 1:
                    table.append(_spread(known, *words))
                    types, tokens, count = len(words[0]), int(words[1].sum()), table[0]
                else:
                    count = table[0][np.searchsorted(known, key)]
                _store(folder, level, shard, known, *table)
            yield _rows([shard], [None], [types, int(count.sum()), tokens, *(int((count == k).sum()) for k in (1, 2, 3, 4))])
            if level > 1:
                one = np.ones(len(key), np.uint64)
                none = one * np.uint64(0)
                seen = [(suffix, one, none, none, none, none), (context, none, count, *(x.astype(np.uint64) for x in (count == 1, count == 2, count > 2)))]
                waiting.append(_sum_by(*_columns(seen, 6)))
                size += len(waiting[-1][0])
                if size >= RUN_TOKENS:
                    yield _down(waiting, bits)
                    waiting, size = [], 0
        if waiting:
            yield _down(waiting, bits)

    return R.by_shard(runs).mapInArrow(add, RESULT)


def _down(waiting: list, bits: int) -> pa.RecordBatch:
    sums = _sum_by(*_columns(waiting, 6))
    batch = R.blobs(sums[0], bits, *sums[1:])
    return _rows(batch.column(0), batch.column(1), [None] * len(FACTS))


def _spread(known: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(known), np.uint64)
    out[np.searchsorted(known, keys)] = values
    return out


def _rows(shards, blobs, facts: list) -> pa.RecordBatch:
    arrays = [pa.array(shards, pa.int32()), pa.array(blobs, pa.binary()), *(pa.array([f] * len(shards), pa.int64()) for f in facts)]
    return pa.RecordBatch.from_arrays(arrays, names=["shard", "blob", *FACTS])


class Level(NamedTuple):
    """Of the counts that a level works with: raw ones at the top, distinct preceding words below."""

    types: int
    total: int
    tokens: int
    ones: int
    twos: int
    discounts: tuple[float, float, float]
    shards: frozenset[int]  # that exist


class Model(NamedTuple):
    folder: str
    order: int
    bits: int
    levels: list[Level]  # from level 1


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of grams counted once, twice, and more often."""
    if not (n1 and n2):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3.0]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def train(docs: DataFrame, folder: str, order: int = 2, text: str = "text") -> Model:
    """Count all of ``docs`` and write the model to ``folder``; one line per shard and level goes through the driver."""
    if order < 2:
        raise ValueError("a model has two levels at least")
    spark = docs.sparkSession
    bits = R.shard_bits(docs)
    found, sent = [], None
    for level in range(order, 0, -1):
        runs = _count(docs, text, order, level, bits)
        if sent is not None:
            runs = runs.unionByName(sent)
        at = f"{folder}/sums-{level}"
        # Written, not only planned: the arrays are a side effect, wanted once.
        _gather(runs, level, order, bits, Folder(f"{folder}/arrays")).write.parquet(at)
        done = spark.read.schema(RESULT).parquet(at)
        sent = done.where("blob IS NOT NULL").select("shard", "blob")
        facts = done.where("blob IS NULL").select("shard", *FACTS).collect()
        types, total, tokens, *n = (sum(r[f] for r in facts) for f in FACTS)
        found.insert(0, Level(types, total, tokens, n[0], n[1], discounts(*n), frozenset(r["shard"] for r in facts)))
    return Model(f"{folder}/arrays", order, bits, found)


class _Tables:
    """The mapped arrays of a model, looked up with many keys at once."""

    def __init__(self, model: Model):
        self.model, self.folder, self.maps = model, Folder(model.folder), {}

    def find(self, level: int, keys: np.ndarray) -> np.ndarray:
        """A row of the level's columns for every key, zeros for an unknown one."""
        width = 1 if level == self.model.order else 6 if level == 1 else 5
        asked, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(asked), width))
        cuts = R.split(asked, self.model.bits)
        for shard in np.flatnonzero(np.diff(cuts)):
            if shard not in self.model.levels[level - 1].shards:
                continue
            if (level, shard) not in self.maps:
                self.maps[level, shard] = _load(self.folder, level, int(shard))
            known, *columns = self.maps[level, shard]
            if not len(known):
                continue
            own = asked[cuts[shard] : cuts[shard + 1]]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.flatnonzero(known[at] == own)
            for c, column in enumerate(columns):
                out[cuts[shard] + hit, c] = column[at[hit]]
        return out[back]


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0)


def log_probabilities(tables: _Tables, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the tokens at ``at``, and how often each occurred in training."""
    model = tables.model
    keys = levels(hashes, model.order)
    base = model.levels[0]
    rows = tables.find(1, hashes)  # of tokens, and of contexts for the level above
    more = base.types - base.ones - base.twos
    free = sum(d * n for d, n in zip(base.discounts, (base.ones, base.twos, more), strict=True)) / base.total if base.total else 1.0
    p = free / (base.types + 1)
    if base.total:
        p = p + _discounted(rows[at, 0], base.discounts) / base.total
    p, seen = np.broadcast_to(p, at.shape), rows[at, 5]
    for k in range(2, model.order + 1):
        d = model.levels[k - 1].discounts
        context = rows[at - 1]  # total, ones, twos, more of the gram before
        rows = tables.find(k, keys[k - 1])
        total = context[:, 1]
        known = total > 0
        safe = np.where(known, total, 1.0)
        free = context[:, 2:5] @ np.array(d) / safe
        p = np.where(known, _discounted(rows[at, 0], d) / safe + free * p, p)
    return np.log10(p), seen


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), smoothing: float = 0.1) -> DataFrame:
    """Per row: ``keep``, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score, perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sizes and shard numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    columns = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches):
        tables = _Tables(shared.value)
        base = shared.value.levels[0]
        for batch in batches:
            found = []
            for _, data, starts in T.slices(batch.column(batch.num_columns - 1)):
                hashes, doc, real = token_grams(data, starts, shared.value.order)
                at = np.flatnonzero(real)
                logs, seen = log_probabilities(tables, hashes, at)
                plain = np.log10((seen + smoothing) / (base.tokens + smoothing * (base.types + 1)))
                n = len(starts) - 1
                found.append([np.bincount(doc[at], w, n) for w in (None, seen > 0, plain, logs)])
            tokens, known, plain, logs = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.empty(0)] * 4
            added = [tokens.astype(np.int64), known.astype(np.int64), np.full(len(tokens), base.tokens), plain, logs, 10 ** (-logs / np.maximum(tokens, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, added)], names=columns)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(
        run, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    )
