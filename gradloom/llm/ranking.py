"""Ranked search by pipelined term partitioning: bundles of items go from one owner of terms to the next.

Documents are read once into an index: for each block of documents, the terms that any item
has, with the documents they occur in.  The terms of the items are dealt to owners by weight,
the rarest to the first.  A bundle holds a group of items and, for one block of documents, the
scores so far, only where there are any; at each owner it is cogrouped with that owner's
postings of the block, and the owner adds what its terms contribute, in integers.  After the
last owner a bundle gives its best documents, and the best of all bundles are the answer.

A bundle drops a document where the item's terms that are still to come, at their utmost, cannot
lift it to the block's k-th best score so far.  That loses nothing: scores never fall, so at
least k documents of the block stay ahead of it.

Frequent terms are no large groups: a posting list is spread over all blocks, and a block holds
about ``tokens.SLICE_BYTES`` of text (or one longer document).  Items are dealt to groups of
about ``GROUP`` by hash.  The terms of the items are broadcast to the reading tasks while they
are at most ``MOST_WANTED``; beyond it the index takes every term, with the same results.

Defined cases: null and termless texts are no documents, and an item without terms has no rows.
Rows that repeat an item id are one item with the terms of all of them; a null id is an id.
Repeated documents are ranked each; equal scores go by ascending id, null ids last.  Empty tables
give no rows.  Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm import tokens as T

#: Terms of items that reading tasks are sent, eight bytes each.
MOST_WANTED = 4_000_000
#: Items of a bundle, on average.
GROUP = 256
#: Entries of the items' terms in one band, on average; a band of one group is what a block is joined with.
BAND = 200_000
OWNERS = 4
#: No term contributes more than its weight times this.
UTMOST = 1_000_000

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[_first : _last + 1] = True

_INDEX = "block long, band int, some long, total long, ids array<bigint>, known array<boolean>, sizes array<bigint>, terms array<bigint>, ends array<int>, docs array<int>, tfs array<int>"
_POSTINGS = "grp int, block long, owner int, ids array<bigint>, known array<boolean>, ends array<int>, docs array<int>, parts array<bigint>, weights array<bigint>, iends array<int>, items array<int>, rest array<bigint>"
_BUNDLE = "grp int, block long, ids array<bigint>, known array<boolean>, places array<int>, scores array<bigint>"
_BEST = "grp int, item int, id bigint, score bigint"


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, term hashes, text of each) of slices of texts."""
    for row, data, starts in T.slices(column):
        first, end, doc = T.words(data, starts, _TERM)
        yield row, len(starts) - 1, T.word_hashes(data, first, end).view(np.int64), doc


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [_lists(list(c), f.type.value_type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _band(terms, bands: int):
    return (terms.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bands


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term): the different terms of each item."""

    def split(batches):
        for batch in batches:
            for row, _, terms, doc in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).take(pa.array(row + doc))), pa.array(terms)], names=["item", "term"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "item bigint, term bigint").distinct()


def build_index(docs: DataFrame, folder: str, wanted: np.ndarray | None, bands: int, key: str, text: str) -> DataFrame:
    """Blocks of documents in the order of their ids, each with its terms (the wanted ones) and where they occur, as a written table.

    A block's first band always has a row, which counts its documents and terms.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    schema = _schema(_INDEX)

    def read(batches):
        from pyspark import TaskContext

        block, sought = TaskContext.get().partitionId() << 33, shared.value
        for batch in batches:
            for row, n, terms, doc in _terms(batch.column(1)):
                ids = batch.column(0).slice(row, n)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                sizes = np.bincount(doc, minlength=n)
                order = np.lexsort((ids, ~known))
                order = order[sizes[order] > 0]
                place = np.zeros(n, np.int64)
                place[order] = np.arange(len(order))
                if sought is not None and len(terms):
                    at = np.searchsorted(sought, terms)
                    here = sought[np.minimum(at, len(sought) - 1)] == terms if len(sought) else np.zeros(len(terms), bool)
                    terms, doc = terms[here], doc[here]
                doc = place[doc]
                turn = np.lexsort((doc, terms))
                terms, doc = terms[turn], doc[turn]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
                starts = np.flatnonzero(new)
                tf = np.diff(starts, append=len(terms))
                terms, doc = terms[starts], doc[starts]
                band = _band(terms, bands)
                ids, known, sizes, rows = ids[order], known[order], sizes[order], []
                for b in range(bands):
                    mine = band == b
                    if b and not mine.any():
                        continue
                    t = terms[mine]
                    heads = np.flatnonzero(np.diff(t, prepend=~t[:1])) if len(t) else np.empty(0, np.int64)
                    count = (len(order), int(sizes.sum())) if not b else (0, 0)
                    rows.append([block, b, *count, ids, known, sizes, t[heads], np.append(heads[1:], len(t))[: len(heads)], doc[mine], tf[mine]])
                block += 1
                yield _batch(rows, schema)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows.mapInArrow(read, _INDEX).write.parquet(folder)
    return spark.read.parquet(folder)


def _document_counts(index: DataFrame) -> DataFrame:
    """(term, df): documents of every term in the index, summed in each task first."""

    def count(batches):
        for batch in batches:
            terms = [_array(batch, "terms", i) for i in range(batch.num_rows)]
            sizes = [np.diff(_array(batch, "ends", i), prepend=0) for i in range(batch.num_rows)]
            term, place = np.unique(np.concatenate([np.empty(0, np.int64), *terms]), return_inverse=True)
            total = np.bincount(place, np.concatenate([np.empty(0), *sizes]), len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total)], names=["term", "df"])

    return index.select("terms", "ends").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _dictionary(terms: DataFrame, counts: DataFrame, n: int, groups: int, bands: int, owners: int) -> tuple[DataFrame, DataFrame]:
    """(grp, band, terms, owners, weights, ends, items, rest): what a group's items want of a band; and (grp, item, id).

    ``items`` numbers the items of a group; ``rest`` holds, for each owner and item, the weights of
    the item's terms that later owners have, in all bands.
    """
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(counts, "term").select("item", "term", weight.alias("w")).persist()
    cuts = weighed.select("term", "w").distinct().agg(F.percentile_approx("w", [1 - i / owners for i in range(1, owners)], 1000)).first()[0] or []
    owner = sum((F.when(F.col("w") < c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # Ids beside null: a null item is an item.
    name = F.xxhash64(F.col("item").isNull(), "item")
    entries = weighed.select(F.pmod(name, F.lit(groups)).cast("int").alias("grp"), "item", "term", "w", owner.alias("owner"))
    members = entries.select("grp", "item").distinct().groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item"))).alias("members"))
    members = members.select("grp", F.posexplode("members.item").alias("i", "item"))
    entries = entries.join(members, (entries["grp"] == members["grp"]) & entries["item"].eqNullSafe(members["item"]), "inner").drop(members["grp"]).drop(members["item"])
    by_term = entries.groupBy("grp", "term", "owner", "w").agg(F.sort_array(F.collect_list("i")).alias("items"))
    after = [F.sum(F.when(F.col("owner") > o, F.col("w")).otherwise(0)).alias(f"r{o}") for o in range(owners)]
    left = entries.groupBy("grp", "i").agg(*after)
    left = left.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("i", *[f"r{o}" for o in range(owners)]))).alias("left"))
    rest = F.flatten(F.array(*[F.col(f"left.r{o}") for o in range(owners)]))
    band = F.pmod(F.shiftrightunsigned("term", 32), F.lit(bands)).cast("int")
    packed = by_term.select("grp", band.alias("band"), F.struct("term", "owner", "w", "items").alias("e")).groupBy("grp", "band").agg(F.sort_array(F.collect_list("e")).alias("e"))
    packed = packed.join(left.select("grp", rest.alias("rest")), "grp")
    packed = packed.select(
        "grp", "band", F.col("e.term").alias("dterms"), F.col("e.owner").alias("downers"), F.col("e.w").alias("dweights"),
        F.transform("e.items", F.size).alias("dsizes"), F.flatten("e.items").alias("ditems"), "rest",
    )
    return packed, members


def _length_terms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    if len(sizes) and 90 * int(sizes.max()) * n >= 1 << 63:
        return np.array([10 + 90 * int(s) * n // total for s in sizes], np.int64)
    return 10 + 90 * sizes * n // total


def _spread(index: DataFrame, packed: DataFrame, n: int, total: int, owners: int) -> DataFrame:
    """Postings that a group wants of a block, by owner: what each occurrence is worth, and which items it is worth it to."""
    schema = _schema(_POSTINGS)

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                a = {f: _array(batch, f, i) for f in ("ids", "known", "sizes", "terms", "ends", "docs", "tfs", "dterms", "downers", "dweights", "dsizes", "ditems", "rest")}
                at = np.minimum(np.searchsorted(a["terms"], a["dterms"]), max(len(a["terms"]) - 1, 0))
                here = a["terms"][at] == a["dterms"] if len(a["terms"]) else np.zeros(len(a["dterms"]), bool)
                first = np.concatenate([[0], a["ends"]])[:-1]
                istart = np.cumsum(a["dsizes"]) - a["dsizes"]
                tf = a["tfs"].astype(np.int64)
                m = _length_terms(a["sizes"], n, total)[a["docs"]]
                parts = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                rest = a["rest"].reshape(owners, -1)
                for o in range(owners):
                    mine = np.flatnonzero(here & (a["downers"] == o))
                    if not len(mine):
                        continue
                    runs = [np.arange(first[t], a["ends"][t]) for t in at[mine]]
                    wants = [np.arange(istart[t], istart[t] + a["dsizes"][t]) for t in mine]
                    places = np.concatenate(runs)
                    rows.append([
                        batch.column("grp")[i].as_py(), batch.column("block")[i].as_py(), o, a["ids"], a["known"],
                        np.cumsum([len(r) for r in runs]), a["docs"][places], parts[places], a["dweights"][mine],
                        np.cumsum([len(w) for w in wants]), a["ditems"][np.concatenate(wants)], rest[o],
                    ])
                if rows:
                    yield _batch(rows, schema)

    return index.join(packed, "band").drop("band", "some", "total").mapInArrow(deal, _POSTINGS)


def _visit(k: int):
    """One owner adds its terms to a bundle; the bundle keeps what may still be among the k best."""
    schema = _schema(_BUNDLE)

    def add(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not postings.num_rows:
            return bundle
        rows = postings.to_batches()
        ids, known, rest = (_array(rows[0], f, 0) for f in ("ids", "known", "rest"))
        scores = np.zeros((len(rest), len(ids)), np.int64)
        for batch in bundle.to_batches():
            for i in range(batch.num_rows):
                scores.reshape(-1)[_array(batch, "places", i)] = _array(batch, "scores", i)
        for batch in rows:
            for i in range(batch.num_rows):
                ends, docs, parts, weights, iends, items = (_array(batch, f, i) for f in ("ends", "docs", "parts", "weights", "iends", "items"))
                a = b = 0
                for past, w, ipast in zip(ends, weights, iends, strict=True):
                    scores[items[b:ipast, None], docs[None, a:past]] += w * parts[a:past]
                    a, b = past, ipast
        keep = scores > 0
        if scores.shape[1] > k:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            keep &= scores + rest[:, None] * UTMOST >= least[:, None]
        places = np.flatnonzero(keep)
        first = rows[0]
        return pa.Table.from_batches([_batch([[first.column("grp")[0].as_py(), first.column("block")[0].as_py(), ids, known, places, scores.reshape(-1)[places]]], schema)])

    return add


def _best(k: int):
    """The k best documents of each bundle, for each item; documents stand in the order of their ids."""

    def choose(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids, known, places, scores = (_array(batch, f, i) for f in ("ids", "known", "places", "scores"))
                item, doc = np.divmod(places, max(len(ids), 1))
                order = np.lexsort((doc, -scores, item))
                item, doc, scores = item[order], doc[order], scores[order]
                starts = np.flatnonzero(np.diff(item, prepend=-1))
                rank = np.arange(len(item)) - np.repeat(starts, np.diff(starts, append=len(item)))
                top = rank < k
                grp = np.full(int(top.sum()), batch.column("grp")[i].as_py(), np.int32)
                out.append((grp, item[top].astype(np.int32), pa.array(ids[doc[top]], pa.int64(), mask=~known[doc[top]]), scores[top]))
            for grp, item, ids, scores in out:
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(item), ids, pa.array(scores)], names=["grp", "item", "id", "score"])

    return choose


def rank(
    docs: DataFrame, items: DataFrame, folder: str, k: int = 10, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", owners: int = OWNERS, group: int = GROUP, most_wanted: int = MOST_WANTED, band: int = BAND,
) -> DataFrame:
    """(item, rank, doc, score) under the names of the two keys: the k best documents of every item; ``folder`` takes the index."""
    spark = docs.sparkSession
    wants = item_terms(items, item, item_text)
    wants.write.parquet(f"{folder}/items")
    wants = spark.read.parquet(f"{folder}/items")
    found = wants.agg(F.count("*").alias("entries"), F.approx_count_distinct(F.coalesce("item", F.lit(-1))).alias("items")).first()
    groups, bands = max(round(found["items"] / group), 1), max(round(found["entries"] / max(round(found["items"] / group), 1) / band), 1)
    wanted = None
    if found["entries"] <= most_wanted:
        wanted = np.sort(wants.select("term").distinct().toPandas()["term"].to_numpy(np.int64))
    index = build_index(docs, f"{folder}/index", wanted, bands, key, text)
    size = index.agg(F.coalesce(F.sum("some"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    packed, members = _dictionary(wants, _document_counts(index), size["n"], groups, bands, owners)
    packed.write.parquet(f"{folder}/dictionary")
    members.write.parquet(f"{folder}/members")
    packed, members = spark.read.parquet(f"{folder}/dictionary"), spark.read.parquet(f"{folder}/members")
    _spread(index, packed, size["n"], max(size["l"], 1), owners).write.partitionBy("owner").parquet(f"{folder}/postings")
    postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    bundles = spark.createDataFrame([], _BUNDLE)
    for o in range(owners):
        mine = postings.where(F.col("owner") == o).drop("owner")
        bundles = bundles.groupBy("grp", "block").cogroup(mine.groupBy("grp", "block")).applyInArrow(_visit(k), _BUNDLE)
    best = bundles.mapInArrow(_best(k), _BEST)
    order = Window.partitionBy("grp", "item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = members.select(F.col("grp").alias("g"), "i", F.col("item").alias("name"))
    top = top.join(names, (F.col("grp") == F.col("g")) & (F.col("item") == F.col("i")))
    return top.select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
