"""N-gram Jaccard join: pivots, Voronoi regions and triangle-inequality windows.

A text is its set of distinct word shingles.  Texts with equal sets are one class, and classes
link when 100 * intersection >= ``percent`` * union.  Jaccard distance is a metric, and with all
texts at distance 1 from nearly every other, pivots drawn at random would leave one region
with everything in it.  So pivots come from the texts that may link:

* The shingles of each set are put in one order (shingles found often in any task last, the
  rest by hash), and two sets that link share one of their first n - ceil(n * percent) + 1.
  The order changes how much is compared, never what is found.
* Each such shared shingle has a pivot, the set made up most of frequent shingles.  Its
  region is every set that shares a shingle with that pivot, so that all links lie within
  regions, and sets on a boundary are in several.
* Of a region's sets only those stay whose histogram over parts of the hash range leaves room
  for a link: counts tell an upper bound of an intersection, so nothing is lost.
* Within a region distances to the pivot give windows: sets whose distances differ by more
  than the threshold cannot link.  A region too large for a task is cut into slices of
  that distance, and slices within a window of each other meet in tasks of their own.
  In a task a large region is again split among pivots, each set going to its nearest one
  and to those no more than two thresholds farther, until regions are small.

Regions yield a link for each set joined to a component, not all pairs; components come from
alternating star contraction in Spark.  Only frequent shingles (``MOST_FREQUENT`` at most) are
broadcast, and no link or component passes through the driver.

Defined cases: null text and text without words have an empty set and link with nothing; fewer
words than ``width`` make one shingle; repeated rows get the same result, and rows of one id with
other texts are judged by their own text.  Rows with a null id link like others and get the smallest
id of their component, null if it has none.  Ids of 2**62 or more raise.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm import components
from gradloom.llm import runs as R
from gradloom.llm import tokens as T
from gradloom.llm.storage import checked

PERCENT, WIDTH = 80, 5
#: Ids from here on stand for rows without one.
UNNAMED = 1 << 62
#: Words that a task looks at together when it looks for frequent shingles and packs runs.
RUN_WORDS = 1_000_000
#: A shingle is frequent when it is in so many different sets of a run, and of all runs together.
IN_RUN, IN_ALL, MOST_FREQUENT = 3, 24, 1 << 18
#: Sets that a task takes as one region, sets of one slice, and slices of the distance to a pivot.
REGION, SLICE, SLICES = 2048, 1024, 64
#: Sets below which a region is compared directly, and pivots it is split among otherwise.
DIRECT, PIVOTS = 256, 8


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts of a slice, sorted, one text after another; and where each text starts."""
    n = len(starts) - 1
    first, end, doc = T.words(data, starts)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    h, d = T.shingle_hashes(T.word_hashes(data, first, end), doc, n, width)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d = h[fresh], d[fresh]
    return h, np.searchsorted(d, np.arange(n + 1))


def _sums(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of h over each text, modulo 2**64."""
    before = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=before[1:])
    return before[at[1:]] - before[at[:-1]]


def identities(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set."""
    size = np.diff(at).astype(np.uint64)
    return T.chain(_sums(T.mix(h), at), size), T.chain(_sums(T.mix(h ^ T.START), at), size)


def classes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row per text, kind 0: id, n, a, b (names of its set).  Kind 1: a shingle of several sets of a run, and of how many."""

    def measure(batches):
        for batch in batches:
            kept, words = [], 0
            ids = batch.column(0)
            for row, data, starts in T.slices(batch.column(1)):
                h, at = shingle_sets(data, starts, width)
                a, b = identities(h, at)
                n = len(at) - 1
                yield _record([ids.slice(row, n), np.zeros(n, np.int8), np.diff(at), a.view(np.int64), b.view(np.int64)])
                kept.append((a, h, np.diff(at)))
                words += len(h)
                if words >= RUN_WORDS:
                    yield from _frequent(kept)
                    kept, words = [], 0
            yield from _frequent(kept)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(measure, "id bigint, kind tinyint, n bigint, a bigint, b bigint")


def _frequent(kept):
    if kept:
        a, h, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        _, once = np.unique(a, return_index=True)  # copies count once
        own = np.zeros(len(a), bool)
        own[once] = True
        shingle, count = np.unique(h[np.repeat(own, n)], return_counts=True)
        often = count >= IN_RUN
        shingle, count = shingle[often].view(np.int64), count[often]
        yield _record([pa.nulls(len(shingle), pa.int64()), np.ones(len(shingle), np.int8), count, shingle, np.zeros(len(shingle), np.int64)])


def _record(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "kind", "n", "a", "b"])


def frequent(measured: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted: ``MOST_FREQUENT`` at most, by a threshold found from a histogram."""
    counts = measured.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= IN_ALL)
    steps = F.floor(4 * F.log2("n")).alias("step")
    histogram = sorted(((r["step"], r["count"]) for r in counts.groupBy(steps).count().collect()), reverse=True)
    least, room = None, MOST_FREQUENT
    for step, n in histogram:
        if n > room:
            break
        least, room = step, room - n
    if least is None:
        return np.empty(0, np.uint64)
    chosen = counts.where(F.floor(4 * F.log2("n")) >= least).select("a").toPandas()["a"].to_numpy(np.int64)
    return np.sort(chosen.view(np.uint64))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def leading(h: np.ndarray, at: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text) of the first n - ceil(n * percent) + 1 of each set in the common order; share of frequent ones by text."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    often = _member(h, table)
    order = np.lexsort((h, often, doc))
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    keep = place < np.repeat(n + (-percent * n) // 100 + 1, n)
    share = np.bincount(doc, often, len(n)) / np.maximum(n, 1)
    return h[order][keep], doc[keep], share


def regions(docs: DataFrame, table: np.ndarray, text: str, width: int, percent: int) -> DataFrame:
    """(pivot, member) of all regions, by the first name of the set; every pivot is a member of its own."""
    bits = R.shard_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(kept):
        key, name, facts = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((name, key))
        key, name, facts = key[order], name[order], facts[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        return R.blobs(key[fresh], bits, name[fresh], facts[fresh])

    def cut(batches):
        kept, words = [], 0
        for batch in batches:
            for _, data, starts in T.slices(batch.column(0)):
                h, at = shingle_sets(data, starts, width)
                if not len(h):
                    continue
                name, _ = identities(h, at)
                key, doc, share = leading(h, at, shared.value, percent)
                facts = ((255 * share).astype(np.uint64) << np.uint64(56)) + np.diff(at).astype(np.uint64)  # and the size
                kept.append((key, name[doc], facts[doc]))
                words += len(key)
                if words >= RUN_WORDS:
                    yield run(kept)
                    kept, words = [], 0
        if kept:
            yield run(kept)

    def meet(batches):
        for _, blobs in R.shards(batches):
            key, name, facts = (np.concatenate(x) for x in zip(*map(R.unpack, blobs), strict=True))
            order = np.lexsort((name, key))
            key, name, facts = key[order], name[order], facts[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
            key, name, facts = key[fresh], name[fresh], facts[fresh]
            size, share = (facts & np.uint64((1 << 56) - 1)).astype(np.int64), (facts >> np.uint64(56)).astype(np.int64)
            # Between sizes too far apart to link a shingle's sets fall into groups of their own.
            order = np.lexsort((size, key))
            key, name, size, share = key[order], name[order], size[order], share[order]
            apart = np.concatenate([[True], (key[1:] != key[:-1]) | (percent * size[1:] > 100 * size[:-1])])
            key = np.cumsum(apart)
            order = np.lexsort((name, -share, key))
            key, name = key[order], name[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            pivot = np.repeat(name[first], n)
            both = np.unique(np.stack([pivot, name])[:, np.repeat(n, n) > 1], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["pivot", "member"])

    packed = docs.select(F.col(text)).mapInArrow(cut, R.BLOB)
    return R.by_shard(packed).mapInArrow(meet, "pivot bigint, member bigint").distinct()


class _Region:
    """Sets in one task: bit rows over the shingles that two of them share, and who is joined to whom so far."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], percent: int):
        self.names, self.percent = names, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.size)
        shingle, back, count = np.unique(every, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        inside = count[back] > 1
        words = (int((count > 1).sum()) + 63) // 64
        self.rows = np.zeros((len(sets), max(words, 1)), np.uint64)
        c = column[back[inside]]
        np.bitwise_or.at(self.rows, (doc[inside], c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def distance(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intersections and Jaccard distances."""
        both = np.bitwise_count(self.rows[others] & self.rows[i]).sum(1, dtype=np.int64)
        return both, 1 - both / (self.size[i] + self.size[others] - both)

    def linked(self, i: int, others: np.ndarray, both: np.ndarray) -> np.ndarray:
        return others[100 * both >= self.percent * (self.size[i] + self.size[others] - both)]

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others:
            if self.root[i] != self.root[j]:
                self.links.append((i, int(j)))
                self.root[self.root == self.root[j]] = self.root[i]

    def compare(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """All links within ``left``, or between it and ``right``, but for those between sets already joined."""
        pivot = left[0]
        _, far = self.distance(pivot, left)
        order = np.argsort(far, kind="stable")
        left, far = left[order], far[order]
        other, other_far = (left, far) if right is None else (right, self.distance(pivot, right)[1])
        order = np.argsort(other_far, kind="stable")
        other, other_far = other[order], other_far[order]
        reach = 1 - self.percent / 100 + 1e-9
        lo, hi = np.searchsorted(other_far, far - reach), np.searchsorted(other_far, far + reach, "right")
        for k, i in enumerate(left):
            near = other[max(lo[k], k + 1) : hi[k]] if right is None else other[lo[k] : hi[k]]
            n = self.size[near]
            near = near[(self.root[near] != self.root[i]) & (100 * n >= self.percent * self.size[i]) & (100 * self.size[i] >= self.percent * n)]
            if len(near):
                self.join(i, self.linked(i, near, self.distance(i, near)[0]))

    def split(self, members: np.ndarray) -> None:
        """Join a region by the regions of some of its members, as long as they get smaller."""
        if len(members) <= DIRECT:
            self.compare(members)
            return
        reach, pivots, far = 1 - self.percent / 100, [members[0]], []
        for _ in range(PIVOTS):  # each one as far as can be from those before
            both, d = self.distance(pivots[-1], members)
            far.append(d)
            self.join(pivots[-1], self.linked(pivots[-1], members, both))
            pivots.append(members[np.min(far, axis=0).argmax()])
        far = np.array(far)
        inside = far <= far.min(0) + 2 * reach + 1e-9
        if inside.sum() > 1.5 * len(members) or inside.sum(1).max() > 0.7 * len(members):
            self.compare(members)
            return
        for mine in inside:
            self.split(members[mine])

    def found(self) -> pa.RecordBatch:
        a, b = np.array(self.links, np.int64).reshape(-1, 2).T
        return _edges(self.names[a], self.names[b])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _groups(batches):
    """(key, rows as columns) of batches sorted by their first column."""
    now, kept = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if kept and keys[lo] != now:
                yield now, pa.Table.from_batches(kept)
                kept = []
            now = keys[lo]
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield now, pa.Table.from_batches(kept)


def _sets_of(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column(column).to_pylist()]


def sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(member, shingles) of the texts that have a wanted set: ``wanted`` has id and member."""

    def cut(batches):
        for batch in batches:
            names = batch.column(0)
            for row, data, starts in T.slices(batch.column(1)):
                h, at = shingle_sets(data, starts, width)
                mine = names.slice(row, len(at) - 1)
                # An id may have other texts too.
                right = np.flatnonzero(identities(h, at)[0].view(np.int64) == mine.to_numpy(zero_copy_only=False))
                blobs = [h[at[i] : at[i + 1]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(right)), pa.array(blobs, pa.binary())], names=["member", "shingles"])

    rows = docs.join(wanted, F.col("__id") == F.col("id")).select("member", "text")
    return rows.mapInArrow(cut, "member bigint, shingles binary")


def histograms(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(member, n, counts): how many shingles of the set lie in each of about n / 2 equal parts of the hash range."""

    def cut(batches):
        for batch in batches:
            names = batch.column(0)
            for row, data, starts in T.slices(batch.column(1)):
                h, at = shingle_sets(data, starts, width)
                mine = names.slice(row, len(at) - 1)
                right = np.flatnonzero(identities(h, at)[0].view(np.int64) == mine.to_numpy(zero_copy_only=False))
                n, counts = np.diff(at)[right], []
                for i in right:
                    part = h[at[i] : at[i + 1]] >> np.uint64(64 - _parts(at[i + 1] - at[i]))
                    counts.append(np.bincount(part.astype(np.int64), minlength=1 << _parts(at[i + 1] - at[i])).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(right)), pa.array(n), pa.array(counts, pa.binary())], names=["member", "n", "counts"])

    rows = docs.join(wanted, F.col("__id") == F.col("id")).select("member", "text")
    return rows.mapInArrow(cut, "member bigint, n bigint, counts binary")


def _parts(n: int) -> int:
    """Bits of the number of parts; sets that may link differ by one at most."""
    return max(int(n).bit_length() - 1, 3)


def _promising(n: np.ndarray, counts: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a region may link with another: an intersection is no larger than the sum of the smaller counts."""
    order = np.argsort(n, kind="stable")
    n, bits = n[order], np.array([_parts(x) for x in n[order]])
    rows, first = {}, {}
    for b in np.unique(bits):
        own = np.flatnonzero(bits == b)
        rows[b] = np.frombuffer(b"".join(counts[k] for k in order[own]), np.uint16).reshape(len(own), -1)
        first[b] = int(own[0])
    folded = {b: x.reshape(len(x), -1, 2).sum(2, dtype=np.uint16) for b, x in rows.items()}
    past = np.searchsorted(n, n * 100 // percent, "right")
    keep = np.zeros(len(n), bool)
    for i in range(len(n)):
        b = bits[i]
        for c, table in ((b, rows), (b + 1, folded)):
            if c in table:
                lo, hi = max(i + 1, first[c]), min(past[i], first[c] + len(table[c]))
                if lo < hi:
                    least = np.minimum(table[c][lo - first[c] : hi - first[c]], rows[b][i - first[b]]).sum(1, dtype=np.int64)
                    good = (100 + percent) * least >= percent * (n[i] + n[lo:hi])
                    keep[lo:hi] |= good
                    keep[i] |= good.any()
    out = np.empty(len(n), bool)
    out[order] = keep
    return out


def narrowed(docs: DataFrame, members: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """The (pivot, member) that may link with another member of the region."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pick(batches):
        for pivot, table in _groups(batches):
            good = _promising(table.column("n").to_numpy(), table.column("counts").to_pylist(), percent)
            names = table.column("member").to_numpy()[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), pivot)), pa.array(names)], names=["pivot", "member"])

    rows = histograms(docs, checked(wanted), width).join(checked(members), "member").select("pivot", "member", "n", "counts")
    rows = rows.repartition(parts, "pivot").sortWithinPartitions("pivot", "member")
    return rows.mapInArrow(pick, "pivot bigint, member bigint")


def links(docs: DataFrame, members: DataFrame, wanted: DataFrame, written, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between names that join all linked sets of every region."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = written(members.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > REGION).select("pivot"), "large")

    def whole(batches):
        for _, table in _groups(batches):
            r = _Region(table.column("member").to_numpy(), _sets_of(table, "shingles"), percent)
            r.split(np.arange(len(r.size)))
            yield r.found()

    small = members.join(count, "pivot", "left_anti")
    small = written(narrowed(docs, written(small, "small"), wanted, width, percent), "narrowed")
    some = written(wanted.join(small.select("member").distinct(), "member").select("id", "member"), "small-wanted")
    rows = sets(docs, checked(some), width).join(checked(small), "member").select("pivot", "member", "shingles")
    rows = rows.repartition(parts, "pivot").sortWithinPartitions("pivot", "member")
    found = rows.mapInArrow(whole, "a bigint, b bigint")
    if not count.isEmpty():
        found = found.unionByName(_large_links(docs, members.join(count, "pivot", "left_semi"), wanted, written, width, percent))
    return found


def _large_links(docs: DataFrame, members: DataFrame, wanted: DataFrame, written, width: int, percent: int) -> DataFrame:
    """Edges of regions too large for a task: slices of the distance to the pivot meet in pairs within reach."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = written(members, "large-members")
    some = written(wanted.join(members.select("member").distinct(), "member").select("id", "member"), "large-wanted")
    shingles = written(sets(docs, checked(some), width), "sets")

    def measure(batches):
        for batch in batches:
            mine, theirs = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(mine, theirs, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(mine, theirs, strict=True)], np.int64) - both
            d = 1 - both / np.maximum(union, 1)
            near = 100 * both >= percent * union
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.minimum(d * SLICES, SLICES - 1).astype(np.int32)), pa.array(near)], names=["pivot", "member", "slice", "near"]
            )

    center = members.select("pivot").distinct().join(shingles.toDF("pivot", "center"), "pivot").dropDuplicates(["pivot"])
    far = members.join(shingles, "member").join(center, "pivot").select("pivot", "member", "shingles", "center")
    far = written(far.mapInArrow(measure, "pivot bigint, member bigint, slice int, near boolean"), "distances")
    found = far.where("near AND pivot <> member").select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    slices = far.groupBy("pivot", "slice").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("cuts"), F.min("near").alias("core"))
    blocks = slices.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    left, right = (blocks.select("pivot", *[F.col(c).alias(f"{c}{k}") for c in ("slice", "cut", "core")]) for k in (1, 2))
    reach = int(np.ceil((1 - percent / 100) * SLICES)) + 1
    ordered = (F.col("slice1") < F.col("slice2")) | ((F.col("slice1") == F.col("slice2")) & (F.col("cut1") <= F.col("cut2")))
    # Two slices of sets linked to the pivot are joined already.
    pairs = left.join(right, "pivot").where(ordered & (F.col("slice2") - F.col("slice1") <= reach) & ~(F.col("core1") & F.col("core2")))
    pairs = pairs.withColumn("task", F.xxhash64("pivot", "slice1", "cut1", "slice2", "cut2"))
    placed = far.join(slices, ["pivot", "slice"]).withColumn("cut", F.pmod(F.xxhash64("member"), F.col("cuts")).cast("int"))
    sides = [
        placed.join(pairs.select("pivot", F.col(f"slice{k}").alias("slice"), F.col(f"cut{k}").alias("cut"), "task"), ["pivot", "slice", "cut"]).select(
            "task", F.lit(k).alias("side"), "member"
        )
        for k in (1, 2)
    ]

    def across(batches):
        for _, table in _groups(batches):
            side, names = table.column("side").to_numpy(), table.column("member").to_numpy()
            r = _Region(names, _sets_of(table, "shingles"), percent)
            a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            if np.array_equal(np.sort(names[a]), np.sort(names[b])):
                r.compare(a)
            else:
                r.compare(a, b)
            yield r.found()

    both = sides[0].unionByName(sides[1]).join(shingles, "member").select("task", "side", "member", "shingles")
    both = both.repartition(parts, "task").sortWithinPartitions("task", "side", "member")
    return found.unionByName(both.mapInArrow(across, "a bigint, b bigint"))


def join(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of every row; tables between the steps are written to ``folder``."""
    spark = docs.sparkSession
    # Rows without id stand under a name made of their text, above all ids: equal texts are one set anyway.
    ids, unnamed = F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(UNNAMED - 1)) + F.lit(UNNAMED)
    refused = F.raise_error(F.lit(f"ids of {UNNAMED} or more are not supported")).cast("long")
    named = F.when(ids.isNull(), unnamed).when(ids < UNNAMED, ids).otherwise(refused)
    docs = docs.select(named.alias("__id"), F.col(text).alias("text"))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    measured = written(classes(docs, "__id", "text", width), "measured")
    members = written(regions(docs, frequent(measured), "text", width, percent), "regions")
    texts = measured.where("kind = 0").select("id", "n", "a", "b")
    group = texts.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("least"))
    # One text stands for all with the same first name; another set has it by a chance of 1 in 2**64.
    names = group.groupBy("a").agg(F.min("least").alias("least"))
    wanted = members.select("member").distinct().join(names, F.col("member") == F.col("a"))
    wanted = written(wanted.select(F.col("least").alias("id"), "member"), "wanted")
    edges = written(links(docs, members, wanted, written, width, percent), "links")
    ends = edges.join(wanted.toDF("u", "a"), "a").join(wanted.toDF("v", "b"), "b")
    labels = components.label(ends.select("u", "v"))
    joined = group.join(labels, F.col("least") == F.col("node"), "left").select("a", "b", F.coalesce("label", "least").alias("component_id"))
    out = texts.join(joined, ["a", "b"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))

    def known(c: Column) -> Column:
        return F.when(c < UNNAMED, c)

    return out.select(known(F.col("id")).alias(key), F.col("n").alias("n_shingles"), known(component).alias("component_id"))
