"""The registered queries of this subpackage and their SQL answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import curriculum, decontaminate, hamming, jaccard, langid, linededup, ngram, pii, prefixes, quality, ranking, warc, whitening
from gradloom.llm.storage import new_folder
from gradloom.llm.tokens import remainder


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_ngram(spark: SparkSession, sf: str, order: int = 2) -> DataFrame:
    """Probability of every document under a model of nine tenths of them, and under plain unigrams."""
    docs = _read(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    model = ngram.train(docs.where(~F.col("held_out")), new_folder(spark, "ngram"), order)
    return ngram.score(docs, model, keep=("doc_id", "held_out"))


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and found again through the capture index."""
    pages, folder = _read(spark, sf, "pages"), new_folder(spark, "warc")
    index = warc.build_index(warc.write(pages, folder), folder)
    wanted = pages.select(warc.url_key(F.col("url")).alias("urlkey"), F.col("page_id").alias("key"))
    records = warc.read(warc.lookup(index, wanted), folder)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""


def op3_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, lines that repeat an earlier one, and a digest of what is left, for every document."""
    done = linededup.dedup(_read(spark, sf, "documents"), new_folder(spark, "lines"), counts=True)
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Lines that go, by document id and line number, for documents of the table d.
LINE_CTES = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(line), '[^ 	-
]+')) AS ws, (doc_id, pos) AS id FROM l),
u AS (SELECT min(id) AS id, any_value(ws) AS ws FROM w WHERE len(ws) > 0 GROUP BY lower(line)),
f AS (SELECT x, count(*) AS c FROM (SELECT unnest(ws) AS x FROM u) GROUP BY x),
p AS (SELECT * FROM (SELECT id, x, n, row_number() OVER (PARTITION BY id ORDER BY c, x) AS i
  FROM (SELECT id, unnest(ws) AS x, len(ws) AS n FROM u) JOIN f USING (x)) WHERE i <= n - (80 * n + 99) // 100 + 1),
m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND b.id < a.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
r AS (SELECT DISTINCT m.a AS id FROM m JOIN u x ON m.a = x.id JOIN u y ON m.b = y.id
  WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (len(x.ws) + len(y.ws))),
g AS (SELECT w.*, len(ws) > 0 AS worded, len(ws) > 0 AND (id NOT IN (SELECT id FROM u) OR id IN (SELECT id FROM r)) AS gone FROM w)
"""

OP3_SQL = f"""
WITH d AS (SELECT * FROM documents), {LINE_CTES}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_lines, coalesce(s.k, 0)::BIGINT AS n_removed, md5(CASE WHEN s.k > 0 THEN coalesce(s.t, '') ELSE d.text END) AS text_md5
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (worded) AS n, count(*) FILTER (gone) AS k, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM g GROUP BY doc_id) s
  USING (doc_id)
"""


def op4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors, by Hamming distance of sign codes, of every twentieth vector."""
    rows = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.search(rows, rows.where("id % 20 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP4_SQL = """
WITH c AS (
  SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END))::UBIGINT AS code
  FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code))::BIGINT AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d) WHERE rank <= 10
"""


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that carry a benchmark item, literally or with other numbers, names or units."""
    return decontaminate.matches(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learned from labels of three quarters of the ids."""
    docs = _read(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = quality.fit(docs.where(~F.col("held_out")), _read(spark, sf, "labels"))
    done = quality.score(docs, model, keep=("doc_id", "held_out"))
    return done.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents under links of shingle Jaccard 0.8 or more."""
    return jaccard.join(_read(spark, sf, "documents"), new_folder(spark, "jaccard"))


def op8_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, targets, words taken and first training position of every document."""
    done = curriculum.mix(_read(spark, sf, "documents"), weights=(5, 2, 1), most=3.0, tilt=0.5)
    return done.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS n, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(n) OVER ()::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * n) OVER a, 0) AS below, sum(w) OVER (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM sources WINDOW a AS (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line AS (SELECT * FROM ranked WHERE 3.0::DOUBLE * n >= (total - below) * w / weights ORDER BY 3.0::DOUBLE * n / w, source LIMIT 1),
plan AS (
  SELECT s.source, s.n AS source_size,
         CASE WHEN 3.0::DOUBLE * s.n / s.w < 3.0::DOUBLE * l.n / l.w THEN 3.0::DOUBLE * s.n ELSE (l.total - l.below) * s.w / l.weights END AS target
  FROM sources s, line l),
shares AS (SELECT *, target / sum(target) OVER () AS share FROM plan),
lean AS (SELECT *, share - sum(share * share) OVER () AS x FROM shares),
sched AS (SELECT *, share * (1 - 0.5::DOUBLE * x / max(abs(x)) OVER ()) AS w0, share * (1 + 0.5::DOUBLE * x / max(abs(x)) OVER ()) AS w1 FROM lean),
placed AS (
  SELECT d.doc_id, d.size, s.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
         least(round(target), floor(3.0::DOUBLE * source_size))::BIGINT AS used
  FROM sized d JOIN sched s ON d.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT *, (greatest(least(b + size, used) - b, 0) + greatest(least(b + source_size + size, used) - b - source_size, 0)
         + greatest(least(b + 2 * source_size + size, used) - b - 2 * source_size, 0))::BIGINT AS taken, b / target * (w0 + w1) / 2 AS h FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN size > 0 AND taken > 0 THEN round(2 * h / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * h, 0.0))), 6) END AS position
FROM cut
"""


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = _read(spark, sf, "documents").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document, by patterns and by the tagger."""
    docs = _read(spark, sf, "documents")
    found = pii.find(docs, pii.fit(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op11_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranking.rank(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"), new_folder(spark, "ranking"))


OP11_SQL = r"""
WITH t AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, * FROM documents)),
tf AS (SELECT d, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
n AS (SELECT d, count(*)::BIGINT AS n FROM t GROUP BY d),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
r AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (d), s GROUP BY item_id, d, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""


def op12_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document, from the stored counts of all its prefixes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        table = prefixes.store(_read(spark, sf, "documents"), file.read(), new_folder(spark, "prefixes"))
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened coordinates of every vector, fitted on the different vectors."""
    rows = _read(spark, sf, "embeddings").where(whitening.whole("embedding"))
    rows = rows.select("vec_id", whitening.scaled("embedding").alias("x"))
    return whitening.whiten(rows, new_folder(spark, "whitening"), components=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram": op1_ngram,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_nearest": op4_nearest,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_curriculum": op8_curriculum,
    "op9_language": op9_language,
    "op10_pii": op10_pii,
    "op11_ranking": op11_ranking,
    "op12_prefixes": op12_prefixes,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op3_lines": OP3_SQL, "op4_nearest": OP4_SQL, "op8_curriculum": OP8_SQL, "op11_ranking": OP11_SQL}
