"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, capitalised words inside a sentence and
units after a number become typed placeholders.  Windows of ``width`` template words are
hash-joined between benchmark items and documents, and windows on one alignment
(document position - item position) must fill the item's placeholders consistently: one item
value never stands for two document values.  So a question with other numbers or names is
still found, and a chance likeness of templates is not.

Capitals tell names only where a text is written in the usual way, so two more kinds of window
are joined that know no case (Unicode folding): with placeholders for numbers and units alone,
and with the words as they are.  They find an item in capitals or in lower case, also with other
numbers; not one whose names were changed too.  Literal windows need no consistent alignment.

A pair is reported when its windows, of any kind, cover at least ``coverage`` of the item's.
Items shorter than a window are one window of their own length.  Windows with fewer than
half literal words count by their exact words alone, so only literal copies meet through them; where
numbers or names were changed, an item is judged on its other windows, if it has any.  Null and empty texts and
items match nothing; repeated rows of one id count as one document (or item); other columns are not read.

The documents are read once: a bitmap of fixed size (``BITS``) over the benchmark's window
hashes drops most windows in the task and never a matching one, and the rest are joined by
hash, whatever the size of the benchmark.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.llm import tokens as T
from gradloom.llm.storage import checked
from gradloom.plans.lineage import cut

WIDTH, COVERAGE, BITS = 8, 0.6, 1 << 22

# Units and number words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles g mg kg ton tons ounce ounces oz pound pounds lb lbs l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % degree degrees "
    "dollar dollars cent cents euro euros pence usd eur mph kmh km/h hz khz mhz ghz kb mb gb tb w kw v watt watts volt volts j kj cal kcal"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PUNCT[ord("%")] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xC4A12E))


def _hashes_of(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    first, end, _ = T.words(data, np.array([0, len(data)]))
    return np.sort(T.word_hashes(data, first, end))


#: Kinds of window: all placeholders, those that know no case, none.
TEMPLATE, CASELESS, LITERAL = KINDS = range(3)


class Template(NamedTuple):
    hashes: tuple[np.ndarray, ...]  # word, by kind of window
    slot: tuple[np.ndarray, ...]  # whether it is a placeholder, by kind of window
    doc: np.ndarray
    position: np.ndarray  # in its text
    first: np.ndarray
    end: np.ndarray


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _folded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without case; each keeps its words and their number."""
    if not len(data) or data.max() < 128:
        return data, starts  # word hashes fold A-Z
    texts = [data[a:b].tobytes().decode("utf-8", "replace").casefold().encode() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _trimmed(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without outer punctuation."""
    while True:
        trim = (end > first) & _PUNCT[data[np.maximum(end - 1, 0)]]
        if not trim.any():
            break
        end = end - trim
    while True:
        trim = (end > first) & _PUNCT[data[np.minimum(first, max(len(data) - 1, 0))]]
        if not trim.any():
            break
        first = first + trim
    return first, end


def template(data: np.ndarray, starts: np.ndarray) -> Template:
    first, end, doc = T.words(data, starts)
    stop = _STOP[data[end - 1]] if len(end) else np.empty(0, bool)
    first, end = _trimmed(data, first, end)
    opens = np.ones(len(first), bool)  # a sentence or text
    opens[1:] = stop[:-1] | (doc[1:] != doc[:-1])
    keep = end > first
    first, end, doc, opens = first[keep], end[keep], doc[keep], opens[keep]
    plain, plain_starts = _folded(data, starts)
    plain_first, plain_end = (first, end) if plain is data else (x[keep] for x in _trimmed(plain, *T.words(plain, plain_starts)[:2]))
    hashes = T.word_hashes(plain, plain_first, plain_end)
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    head = data[first]
    second = data[np.minimum(first + 1, max(len(data) - 1, 0))]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    number = (digits[end] > digits[first]) | _isin(hashes, _NUMBER_HASHES)
    name = capital & ~opens & ~number
    after = np.zeros(len(first), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after & ~number & _isin(hashes, _UNIT_HASHES)
    caseless = hashes.copy()
    caseless[number], caseless[unit] = NUMBER, UNIT
    named = caseless.copy()
    named[name] = NAME
    counts = np.bincount(doc, minlength=len(starts) - 1)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    slots = number | name | unit, number | unit, np.zeros(len(doc), bool)
    return Template((named, caseless, hashes), slots, doc, position, first, end)


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


def _windows(t: Template, width: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window, its first word and its number of placeholders; not those with more than half placeholders."""
    n = max(len(t.doc) - width + 1, 0)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    words = t.hashes[kind]
    window = T.mix(words[:n] + np.uint64(width))
    for k in range(1, width):
        window = T.chain(window, words[k : k + n])
    slots = np.zeros(len(t.doc) + 1, np.int64)
    np.cumsum(t.slot[kind], out=slots[1:])
    many = slots[width : width + n] - slots[:n]
    good = (t.doc[:n] == t.doc[width - 1 :]) & (2 * many <= width)
    at = np.flatnonzero(good)
    return window[at], at, many[at]


Found = tuple[np.ndarray, np.ndarray, int, int]  # hashes, first words, width and kind


def _emit(t: Template, data: np.ndarray, ids: list, found: list[Found]) -> pa.RecordBatch:
    rows = [(ids[t.doc[i]], int(h), int(t.position[i]), int(w), kind, i) for hashes, at, w, kind in found for h, i in zip(hashes.view(np.int64), at, strict=True)]
    values = []
    for *_, width, kind, i in rows:
        values.append([data[t.first[j] : t.end[j]].tobytes().decode("utf-8", "replace").casefold() for j in range(i, i + width) if t.slot[kind][j]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[3] for r in rows], pa.int32()),
            pa.array([r[4] for r in rows], pa.int32()),
            pa.array(values, pa.list_(pa.string())),
        ],
        names=["id", "window", "at", "width", "kind", "slots"],
    )


WINDOW = "id bigint, window bigint, at int, width int, kind int, slots array<string>"


def item_windows(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """All windows of the items; one of its own length for a shorter item."""

    def windows(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, starts in T.slices(batch.column(1)):
                t = template(data, starts)
                counts = np.bincount(t.doc, minlength=len(starts) - 1)
                found = []
                for w, kind in itertools.product(range(1, width + 1), KINDS):
                    hashes, at, _ = _windows(t, w, kind)
                    own = counts[t.doc[at]] == w if w < width else np.ones(len(at), bool)
                    found.append((hashes[own], at[own], w, kind))
                yield _emit(t, data, ids[row : row + len(starts) - 1], found)

    return items.select(F.col(key).cast("long"), F.col(text)).mapInArrow(windows, WINDOW)


def document_windows(docs: DataFrame, bitmap: np.ndarray, widths: list[int], key: str, text: str) -> DataFrame:
    """The windows of documents whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITS bits

    def windows(batches):
        bits = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, starts in T.slices(batch.column(1)):
                t = template(data, starts)
                found = []
                for w, kind in itertools.product(widths, KINDS):
                    hashes, at, many = _windows(t, w, kind)
                    place = hashes & np.uint64(BITS - 1)
                    hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    hit &= (many > 0) | (kind == LITERAL)  # without a placeholder all kinds say the same
                    found.append((hashes[hit], at[hit], w, kind))
                yield _emit(t, data, ids[row : row + len(starts) - 1], found)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(windows, WINDOW)


def matches(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    coverage: float = COVERAGE,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per contaminated document and item: key, item_key, matched, windows, coverage, exact (no slot changed)."""
    cuts = item_windows(items, item_key, item_text, width).persist()
    places = cuts.select(F.pmod("window", F.lit(BITS)).cast("int").alias("p"), "width").distinct().toPandas()  # BITS x width rows at most
    flags = np.zeros(BITS, np.uint8)
    flags[places["p"].to_numpy(np.int64)] = 1
    widths = sorted({int(w) for w in places["width"]})
    found = document_windows(docs, np.packbits(flags, bitorder="little"), widths, key, text)
    # The least kind that a place of an item has a window of says what evidence it can give.
    spots = cuts.groupBy("id", "at").agg(F.min("kind").alias("least"))
    sizes = spots.groupBy(F.col("id").alias("item")).agg(*[F.count_if(F.col("least") <= k).alias(f"windows{k}") for k in KINDS])
    spots = spots.select(F.col("id").alias("item"), F.col("at").alias("item_at"), "least")
    left = cuts.select("window", "width", "kind", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    left = left.join(spots, ["item", "item_at"])
    met = found.where(F.col("id").isNotNull()).join(left, ["window", "width", "kind"]).select(
        "id", "item", "kind", F.struct("item_at", "least").alias("place"), (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("item_slots", "slots").alias("pairs")
    )
    line = ["id", "item", "shift"]
    # A row per alignment and slot value first, so that a passage in many documents never meets in one task.
    values = met.select(*line, "kind", "place", F.explode_outer("pairs").alias("p")).groupBy(*line, "kind", F.col("p.item_slots").alias("value")).agg(
        F.min("p.slots").alias("low"), F.max("p.slots").alias("high"), F.collect_set("place").alias("places")
    )
    same = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    kept = F.coalesce(F.col("low").eqNullSafe(F.col("high")) & F.col("low").eqNullSafe(F.col("value")), F.lit(True))
    lines = values.groupBy(*line).agg(
        F.min(kept).alias("exact"),
        *[F.min(F.when(F.col("kind") == k, same)).alias(f"consistent{k}") for k in KINDS],
        *[F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("places")))).alias(f"places{k}") for k in KINDS],
    )
    places = [F.when(F.col(f"consistent{k}"), F.col(f"places{k}")).otherwise(F.expr("array()").cast("array<struct<item_at:int,least:int>>")) for k in KINDS]
    covered = lines.select("id", "item", "exact", F.explode(F.array_distinct(F.concat(*places))).alias("place"))
    covered = covered.groupBy("id", "item", "place").agg(F.max("exact").alias("exact"))
    pairs = covered.groupBy("id", "item").agg(F.max("exact").alias("exact"), *[F.count_if(F.col("place.least") <= k).alias(f"matched{k}") for k in KINDS])
    # An item with few templates is not lost where only they can match: the best covered of the three sets of places counts.
    shares = [
        F.when(F.col(f"windows{k}") > 0, F.struct((F.col(f"matched{k}") / F.col(f"windows{k}")).alias("coverage"), F.col(f"windows{k}").alias("windows"), F.col(f"matched{k}").alias("matched")))
        for k in KINDS
    ]
    best = pairs.join(sizes, "item").select("id", "item", "exact", F.greatest(*shares).alias("best"))
    out = best.select("id", "item", "exact", "best.*").where(F.col("coverage") >= coverage)
    return out.select(F.col("id").alias(key), F.col("item").alias(item_key), "matched", "windows", "coverage", "exact")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents without those that carry a benchmark item; rows without a key stay."""
    dirty = checked(cut(matches(docs, items, key=key, **settings).select(F.col(key).alias("__dirty")).distinct()))
    return docs.join(dirty, F.col(key) == F.col("__dirty"), "left_anti")
