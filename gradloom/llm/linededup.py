"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words.  It goes when an earlier line, by (document id,
line number), has a Jaccard similarity of ``percent`` or more to it, whether or not that line
goes too; so what goes does not depend on how the work is dealt out.  The join is exact:

* Lines equal as text are found by hash first, and only their first ones go on.
* Words are ordered rare first, by how often these lines have a word of their hash bucket
  (``BUCKETS`` counters at most, the only thing that passes through the driver), then by hash.
  Lines that match share one of their first n - ceil(n * percent) + 1 words (prefix).
* Two lines meet on such a word only if they may still match: their sizes are close enough
  (length), enough words follow the shared one in both (position), and few enough bits differ
  between their parity sketches.  Lines of n and m words that match share at least k = need - ceil(max(n, m)
  * percent) + 1 words of their prefixes, and the first k of them always pass; pairs with fewer go, which is
  what tells long lines apart, whose sketches are full.
* Each line is compared with the first line that has its word before all others (if it shares k
  words with that one), and is done if it matches: a line needs one match only, so large groups of near copies are no pairs.
* What is left is verified on the words themselves.

A frequent word, which its bucket's count tells, is dealt to ``SALTS`` parts; its lines meet all parts.

Defined cases: null text stays null, lines without words stay, and of rows that repeat an id and a text
all keep or lose the same lines; other texts of one id are told apart by a hash of the text and come in
its order.  A null id comes before all others.  Other columns are kept as they are, whatever their names
(but for those starting with ``__``).  Texts and lines may be of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

PERCENT = 80
BUCKETS = 1 << 23
#: Halves of the rarity table are laid upon each other while it has so many buckets for each word that lines share.
SPARSE = 8
SALTS = 16
#: Documents (with ten times as many of their lines' numbers) that may be broadcast, about 100 MB; as many single lines.
BROADCAST_ROWS = 1_000_000
#: Words that a pair has to share before its own words are compared, where its sizes ask for as many.
SHARED = 3
#: A word that lines have more often than this is split over ``SALTS`` parts.
HOT_LINES = 50_000
#: Its rank, three times the binary logarithm of that.
HOT_RANK = 3 * (HOT_LINES.bit_length() - 1)

_HASH_BITS = 56
_LINE = ["__id", "__row", "__pos"]
#: What parts words besides a blank; lines hold no line feed.
_SPACES = "\t\x0b\x0c\r"


def _parts(line: Column) -> Column:
    """The words of a line, with empty ones; split at blanks, which is plain text and not a pattern."""
    odd = F.lit(False)
    for c in _SPACES:
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.lower(F.when(odd, F.translate(line, _SPACES, " " * len(_SPACES))).otherwise(line)), " ")


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_parts(line)), "")


def _hashes(line: Column) -> Column:
    """Hashes of the different words of a line."""
    return F.array_remove(F.array_distinct(F.transform(_parts(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    least = F.lit(-(1 << 63)).cast("long")
    named = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), least)).withColumn("__row", F.xxhash64(F.col(text)))
    return named.withColumnRenamed(text, "__text")


class _Documents:
    """Documents, and tables of some of their places to be joined to them.

    A small table is broadcast and no text moves.  The first one that is not has the documents placed
    by (id, row) and kept: texts are moved once, and larger tables come to where they are.
    """

    def __init__(self, docs: DataFrame):
        self.docs, self._placed = docs, False

    def join(self, places: DataFrame, small: bool, how: str, columns: list[str] | None = None, split: bool = False) -> DataFrame:
        if not small and not self._placed:
            parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.docs, self._placed = self.docs.repartition(parts, "__id", "__row").persist(StorageLevel.MEMORY_AND_DISK), True
        docs = self.docs if columns is None else self.docs.select("__id", "__row", *columns)
        return (_split(docs) if split else docs).join(F.broadcast(places) if small else places.hint("shuffle_hash"), ["__id", "__row"], how)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word."""
    lines = docs.select("__id", "__row", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    return lines.where(F.col("__line").rlike(r"[^\x20\x09-\x0D]"))


def _split(docs: DataFrame) -> DataFrame:
    """Documents with ``__split``, their lines, in place of the text."""
    return docs.withColumn("__split", F.split("__text", "\n")).drop("__text")


def _others(places: str) -> Column:
    """The places of a split text that are not among ``places``, in order; hashed, so a text may have any number of lines."""
    return F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.coalesce(F.col(places), F.array().cast("array<int>")))


def _at(docs: DataFrame, places: Column) -> DataFrame:
    """A row for each line with a word at ``places`` of ``docs``, which have been split."""
    found = F.transform(places, lambda p: F.struct(p.alias("pos"), F.col("__split")[p].alias("line")))
    lines = docs.select("__id", "__row", F.explode(found).alias("__at")).select("__id", "__row", F.col("__at.pos").alias("__pos"), F.col("__at.line").alias("__line"))
    return lines.where(F.col("__line").rlike(r"[^\x20\x09-\x0D]"))


def _by_document(lines: DataFrame, written, name: str) -> tuple[DataFrame, bool]:
    """(id, row, places) of lines: as many places as the document has lines at most; and whether they may be broadcast."""
    found = lines.groupBy("__id", "__row").agg(F.sort_array(F.collect_set("__pos")).alias("__places"))
    size = Observation()
    found = written(found.observe(size, F.count("*").alias("n"), F.coalesce(F.sum(F.size("__places")), F.lit(0)).alias("places")), name)
    return found, size.get["n"] <= BROADCAST_ROWS and size.get["places"] <= 10 * BROADCAST_ROWS


def _copies(docs: DataFrame, written) -> DataFrame:
    """Lines equal to an earlier one."""
    low = F.lower("__line")
    lines = _lines(docs).select(*_LINE, F.xxhash64(low).alias("__a"), F.hash(low, F.lit(1)).alias("__b"))
    first = lines.groupBy("__a", "__b").agg(F.min(F.struct(*_LINE)).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # A written table, so that a line with very many copies can be split in the join.
    first = written(first.select("__a", "__b", "__first"), "first")
    return lines.join(first, ["__a", "__b"]).where(F.struct(*_LINE) > F.col("__first")).select(*_LINE)


def _folded(table: np.ndarray) -> np.ndarray:
    """The table as short as its words allow: what a task holds, and what passes through the driver, is in proportion to them."""
    some = np.count_nonzero(table)
    while len(table) > max(SPARSE * some, 1):
        table = table.reshape(2, -1).max(axis=0)  # a bucket is then the lower bits of the hash, one fewer
    return table


def _rarity(lines: DataFrame) -> tuple[DataFrame, int, bool]:
    """One row, a byte for each bucket of word hashes: three times the binary logarithm of how often lines have a word of it; 0 for once or never.

    And how many buckets there are, and whether any word is frequent.  Words are split and hashed in compiled code, one a row, so one that a line repeats counts again.
    """
    words = lines.select(F.explode(_parts(F.col("__line"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    packed = F.col("b").cast("long") * 128 + F.floor(3 * F.log2("n"))
    found = counts.groupBy((F.col("b") % 256).alias("g")).agg(F.collect_list(packed).alias("packed"))
    table = np.zeros(BUCKETS, np.uint8)
    for row in found.toLocalIterator():  # BUCKETS numbers at most, by 256ths
        some = np.array(row["packed"], np.int64)
        table[some >> 7] = some & 127
    table = _folded(table)
    return lines.sparkSession.createDataFrame([(bytearray(table),)], "rank binary"), len(table), int(table.max()) > HOT_RANK


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of two matching sets of these sizes."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _prefixes(lines: DataFrame, rarity: DataFrame, buckets: int, percent: int) -> DataFrame:
    """A row for each of a line's first words in the common order: word, its place, the line's size and parity sketch."""
    mask = (1 << _HASH_BITS) - 1
    # A subquery, not a literal: plans and their many descriptions on the driver would hold a megabyte for each use.
    lines = lines.withColumn("__rank", rarity.scalar())

    def ranked(h: Column) -> Column:
        rarity = F.ascii(F.substring("__rank", (h.bitwiseAND(F.lit(buckets - 1)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(F.coalesce(rarity.cast("long"), F.lit(0)), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(mask)))

    rows = lines.select(*_LINE, F.sort_array(F.transform(_hashes(F.col("__line")), ranked)).alias("__keys")).withColumn("__n", F.size("__keys"))
    bit = lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))
    rows = rows.withColumn("__parity", F.aggregate("__keys", F.lit(0).cast("long"), bit))
    first = F.slice("__keys", F.lit(1), F.col("__n") - F.ceil(percent * F.col("__n") / 100).cast("int") + 1)
    rows = rows.select(*_LINE, "__n", "__parity", F.posexplode(first).alias("__i", "__word"))
    rows = rows.where(F.shiftright("__word", _HASH_BITS) > 0)  # a word of one line is shared with none
    hot = F.shiftright("__word", _HASH_BITS) > HOT_RANK
    return rows.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(*_LINE), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int"))


def _shared(n: Column, m: Column, percent: int) -> Column:
    """How many words the prefixes of two matching sets of these sizes share at least; ``SHARED`` at most, below 1 if sizes are too far apart."""
    return F.least(F.lit(SHARED), _need(n, m, percent) - F.ceil(percent * F.greatest(n, m) / 100) + 1)


_ROW = [*_LINE, "__n", "__i", "__parity"]


def _may_match(percent: int) -> Column:
    """Whether an earlier line (columns with ``e``) and a later one that share a word may match.

    In whole numbers, cheap and seldom true parts first: need <= x if and only if percent * (n + m) <= (100 + percent) * x.
    """
    n, m = F.col("__n"), F.col("e__n")
    follow = F.least(n - F.col("__i"), m - F.col("e__i"))
    differ = F.bit_count(F.col("__parity").bitwiseXOR(F.col("e__parity")))
    need, shared = _need(n, m, percent), _shared(n, m, percent)
    return (
        (percent * (n + m) <= (100 + percent) * (follow + F.lit(SHARED - 1)))
        & (percent * (n + m) <= (100 + percent) * F.shiftright(n + m - differ, 1))
        & (shared >= 1)
        & (follow > need - shared)
        & (F.struct(*[F.col(f"e{c}") for c in _LINE]) < F.struct(*_LINE))
    )


def _earlier(rows: DataFrame) -> DataFrame:
    return rows.select("__word", "__salt", *[F.col(c).alias(f"e{c}") for c in _ROW])


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Pairs that met, with a row for each word they met on, as often as matching ones do."""
    ends = [*_LINE, *[f"e{c}" for c in _LINE]]
    met = joined.select(*ends, _shared(F.col("__n"), F.col("e__n"), percent).alias("least")).groupBy(*ends)
    return met.agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select(*ends)


def _verified(pairs: DataFrame, docs: _Documents, percent: int, written, name: str) -> tuple[DataFrame, bool]:
    """The later lines of pairs that match, and whether they may be broadcast."""
    pairs = written(pairs, f"{name}-pairs")
    ends = pairs.select(*_LINE).union(pairs.select(*[F.col(f"e{c}").alias(c) for c in _LINE]))
    places, few = _by_document(ends, written, f"{name}-lines")
    words = _at(docs.join(places, few, "inner", ["__text"], split=True), F.col("__places")).select(*_LINE, _words(F.col("__line")).alias("w")).dropDuplicates(_LINE)
    earlier = words.select(*[F.col(c).alias(f"e{c}") for c in _LINE], F.col("w").alias("v"))
    both = pairs.join(words, _LINE).join(earlier, [f"e{c}" for c in _LINE])
    shared = F.size(F.array_intersect("w", "v"))
    match = (100 + percent) * shared >= percent * (F.size("w") + F.size("v"))
    size = Observation()
    found = written(both.where(match).select(*_LINE).distinct().observe(size, F.count("*").alias("n")), name)
    return found, size.get["n"] <= BROADCAST_ROWS


def repeated(docs: _Documents, folder: str, percent: int = PERCENT) -> tuple[DataFrame, bool]:
    """(id, row, places) of the lines that go, and whether they may be broadcast; of identified documents."""
    spark = docs.docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    copies, few = _by_document(_copies(docs.docs, written), written, "copies")
    fresh = _at(docs.join(copies, few, "left", ["__text"], split=True).where("__split IS NOT NULL"), _others("__places"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rarity, buckets, frequent = _rarity(fresh)
    rows = _prefixes(fresh, rarity, buckets, percent).repartition(parts, "__word", "__salt")
    # Sorted once: sums by word and joins on it go along this order, and no part of a table is held for them.
    rows = rows.sortWithinPartitions("__word", "__salt").persist(StorageLevel.MEMORY_AND_DISK)

    # The first line that has a word, against the others that have it.
    first = rows.groupBy("__word", "__salt").agg(F.min(F.struct(*_ROW)).alias("f"), F.count("*").alias("k")).where("k > 1")
    first = first.select("__word", "__salt", *[F.col(f"f.{c}").alias(f"e{c}") for c in _ROW])
    met = rows.join(first.hint("merge"), ["__word", "__salt"]).where(_may_match(percent))
    done, few = _verified(_pairs(met, percent), docs, percent, written, "first-matches")

    # All others against all earlier lines; the parts of a frequent word, if there is one, meet each other too.
    left = rows.join(F.broadcast(done) if few else done, _LINE, "left_anti")
    met = left.where("__salt = 0").join(_earlier(rows.where("__salt = 0")).hint("merge"), ["__word", "__salt"]).where(_may_match(percent))
    both = [*_ROW, *[f"e{c}" for c in _ROW]]
    met = met.select(*both)
    if frequent:
        every = _earlier(rows.where("__salt > 0")).withColumn("__salt", F.explode(F.sequence(F.lit(1), F.lit(SALTS))))
        hot = left.where("__salt > 0").join(every, ["__word", "__salt"]).where(_may_match(percent))
        met = met.union(hot.select(*both))
    rest, _ = _verified(_pairs(met, percent), docs, percent, written, "other-matches")
    rows.unpersist()
    lines = copies.select("__id", "__row", F.explode("__places").alias("__pos"))
    return _by_document(lines.union(done).union(rest), written, "gone")


def dedup(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", percent: int = PERCENT, counts: bool = False) -> DataFrame:
    """``docs`` without repeated lines; with ``counts`` also __lines (with words) and __gone."""
    identified = _Documents(_identified(docs, key, text))
    rows = identified.join(*repeated(identified, folder, percent), "left")
    rows = rows.withColumn("__split", F.when(F.col("__places").isNotNull(), F.split("__text", "\n")))
    kept = F.array_join(F.transform(_others("__places"), lambda p: F.col("__split")[p]), "\n")
    rows = rows.withColumn("__kept", F.when(F.col("__places").isNotNull(), kept).otherwise(F.col("__text")))
    if counts:
        lines = F.size(F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        rows = rows.withColumn("__lines", F.when(F.col("__text").isNull(), 0).otherwise(lines).cast("long"))
        rows = rows.withColumn("__gone", F.coalesce(F.size("__places"), F.lit(0)).cast("long"))
    columns = [F.col("__kept").alias(text) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*columns, *(["__lines", "__gone"] if counts else []))
