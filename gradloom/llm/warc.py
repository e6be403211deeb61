"""WARC archives with a two-level capture index.

``write`` stores one gzip member per row; of rows with equal payloads of at least
``min_bytes`` the one with the largest key is a response and the others are revisits that
refer to it.  ``build_index`` sorts the captures by (reversed-host URL key, key) over range
partitions and writes each partition as compressed blocks with a sparse directory of their
first keys at the end of the file; only one line per index file goes through the driver.
``lookup`` finds captures by binary search in the list of files, in a file's directory and
in a block, reading nothing but that directory and those blocks; ``read`` fetches the
records by byte range.

Defined cases: a null payload is empty, a null URL has the key ``)`` and no target header;
a null key sorts before all others and is only a response where no other row has its payload.
Equal rows give equal records, and a lookup of their key returns each of them.  Empty input
gives no archive and an empty index.  A file name has a random part and its rows are
committed with it, so a task that runs twice leaves an unused file at worst.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm.storage import Folder

ARCHIVE_BYTES = 1 << 30
BLOCK_ROWS = 3000

# Fixed values of the WARC format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MSGTYPE = "application/http;msgtype=response"

CAPTURE = "urlkey string, key bigint, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """``http://www.Example.org:80/a?b#c`` as ``org,example)/a?b``: host reversed, no scheme, port, www or fragment."""
    url = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[wW]{3}[0-9]*\.)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _member(key, url, payload: bytes, sha1: str, owner) -> bytes:
    """One record as a gzip member."""
    kept = b"" if owner is not None else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [f"WARC-Type: {'revisit' if owner is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{bare_digest(bytes.fromhex(sha1))}"]
    if owner is not None:
        lines += [f"WARC-Refers-To: <urn:page:{owner}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Type: {MSGTYPE}", f"Content-Length: {len(http) + len(kept)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = VERSION + "".join(f"{x}\r\n" for x in lines).encode() + b"\r\n"
    return b"".join((packer.compress(head + http), packer.compress(kept), packer.compress(b"\r\n\r\n"), packer.flush()))


def _parse(member: bytes) -> dict:
    """What a stored record says: key, url, type, refers_to, digest, bytes and payload (null for a revisit)."""
    record = zlib.decompress(member, 31)
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    out = {"key": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"]}
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": bare_digest(hashlib.sha1(payload).digest()), "refers_to": None}
    else:
        size = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        out |= {"payload": None, "payload_bytes": int(size.split(": ")[1]), "payload_digest": fields["WARC-Payload-Digest"].split(":")[1]}
        out["refers_to"] = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return out


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all rows to archives in ``folder``; returns their captures, a table in the same folder."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # Copies only, written first: its real size then decides between broadcast and shuffle.
    copies = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("key").alias("owner"), F.count("*").alias("n")).where("n > 1")
    copies.select("sha1", "owner").write.parquet(f"{folder}/copies")
    rows = rows.join(spark.read.parquet(f"{folder}/copies"), "sha1", "left")
    owner = F.when((F.col("owner") == F.col("key")) | (F.length("payload") < min_bytes), None).otherwise(F.col("owner"))
    rows = rows.select("key", "url", url_key(F.col("url")).alias("urlkey"), "payload", "sha1", owner.alias("owner"))
    target = Folder(f"{folder}/archives")

    def store(batches):
        name, file, out, at = None, None, None, 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    file, at = target.writer(name), 0
                    out = file.__enter__()
                member = _member(r["key"], r["url"], r["payload"], r["sha1"], r["owner"])
                out.write(member)
                found.append((r["urlkey"], r["key"], name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    file.__exit__(None, None, None)
                    out = None
            yield _batch(found)
        if out is not None:
            file.__exit__(None, None, None)

    rows.mapInArrow(store, CAPTURE).write.parquet(f"{folder}/captures")
    return spark.read.schema(CAPTURE).parquet(f"{folder}/captures")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("urlkey", pa.string()), ("key", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


class Index(NamedTuple):
    """Where the index files are, and the first key of each, in order."""

    folder: str
    firsts: list[tuple[str, int]]
    names: list[str]


def _rank(key) -> int:
    return -(1 << 63) if key is None else key


def build_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> Index:
    target = Folder(f"{folder}/index")
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["urlkey", "key", "file", "offset"]

    def store(batches):
        rows, directory, at, name = [], [], 0, f"{uuid.uuid4().hex}.idx"
        file = out = None
        for batch in _chunks(batches, block_rows):
            if out is None:
                file = target.writer(name)
                out = file.__enter__()
            rows = [[r["urlkey"], _rank(r["key"]), r["file"], r["offset"], r["length"]] for r in batch]
            block = zlib.compress("\n".join(map(json.dumps, rows)).encode())
            out.write(block)
            directory.append([rows[0][0], rows[0][1], at, len(block)])
            at += len(block)
        if out is not None:
            tail = zlib.compress("\n".join(map(json.dumps, directory)).encode())
            out.write(tail)
            out.write(struct.pack("<QQ", at, len(tail)))
            file.__exit__(None, None, None)
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]]), pa.array([name])], names=["urlkey", "key", "name"])

    placed = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = placed.mapInArrow(store, "urlkey string, key bigint, name string").collect()  # one row per partition
    files = sorted((r["urlkey"], r["key"], r["name"]) for r in files)
    return Index(f"{folder}/index", [f[:2] for f in files], [f[2] for f in files])


def _chunks(batches, n: int):
    rest = []
    for batch in batches:
        rest += batch.to_pylist()
        while len(rest) >= n:
            yield rest[:n]
            rest = rest[n:]
    if rest:
        yield rest


class _Reader:
    """Binary search over index files; keeps the last directory and block."""

    def __init__(self, index: Index):
        self.index, self.folder = index, Folder(index.folder)
        self.at = self.block_at = None
        self.directory = self.block = self.file = None

    def _enter(self, i: int) -> None:
        if i != self.at:
            self.file = self.folder.open(self.index.names[i])
            size = self.file.size()
            start, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
            self.directory = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, start)).split(b"\n")]
            self.at, self.block_at = i, None

    def find(self, urlkey: str, key: int):
        want = (urlkey, key)
        firsts = self.index.firsts
        i = max(bisect.bisect_left(firsts, want) - 1, 0)  # rows that repeat a key may lie in several files
        while i < len(firsts) and firsts[i] <= want:
            self._enter(i)
            yield from self._matches(want)
            i += 1

    def _matches(self, want: tuple[str, int]):
        b = max(bisect.bisect_left(self.directory, want, key=lambda e: (e[0], e[1])) - 1, 0)
        while b < len(self.directory) and (self.directory[b][0], self.directory[b][1]) <= want:
            if self.block_at != b:
                _, _, start, length = self.directory[b]
                self.block = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, start)).split(b"\n")]
                self.block_at = b
            k = bisect.bisect_left(self.block, want, key=lambda e: (e[0], e[1]))
            while k < len(self.block) and (self.block[k][0], self.block[k][1]) == want:
                yield self.block[k]
                k += 1
            b += 1


def lookup(index: Index, wanted: DataFrame) -> DataFrame:
    """Captures of every distinct (urlkey, key) of ``wanted``."""
    spark: SparkSession = wanted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(index)  # a line per index file
    keys = wanted.select("urlkey", F.col("key").cast("long").alias("key")).distinct()
    keys = keys.repartitionByRange(parts, "urlkey", "key").sortWithinPartitions("urlkey", "key")

    def search(batches):
        reader = _Reader(shared.value)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                hits = reader.find(r["urlkey"], _rank(r["key"]))
                found += [(r["urlkey"], r["key"], *hit[2:]) for hit in hits]
            yield _batch(found)

    return keys.mapInArrow(search, CAPTURE)


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, by range reads in file order: key, url, record_type, refers_to, payload_digest, payload_bytes, payload."""
    source = Folder(f"{folder}/archives")
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("key", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def fetch(batches):
        name = file = None
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 256):  # bounds the payloads in memory
                found = []
                for r in rows[i : i + 256]:
                    if r["file"] != name:
                        name, file = r["file"], source.open(r["file"])
                    found.append(_parse(file.read_at(r["length"], r["offset"])))
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, kinds, strict=True)], names=list(names))

    placed = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(
        fetch, "key bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
    )
