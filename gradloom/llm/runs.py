"""Packed sorted runs: what tasks send to the shards of a 64-bit key space instead of a row for each entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Which shard a run is for, and its arrays.
BLOB = "shard int, blob binary"


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length arrays of 64-bit values, the first sorted: byte planes of its steps, then of the others, compressed."""
    first, *rest = columns
    steps = np.diff(first, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in (steps, *(r.astype(np.uint64) for r in rest))]
    return pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True) + len(first).to_bytes(8, "little") + len(columns).to_bytes(1, "little")


def unpack(blob: bytes) -> list[np.ndarray]:
    columns, n = blob[-1], int.from_bytes(blob[-9:-1], "little")
    raw = np.frombuffer(pa.decompress(blob[:-9], decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    out = [np.ascontiguousarray(x.reshape(8, n).T).view(np.uint64).ravel() for x in raw.reshape(columns, 8 * n)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard (the first ``bits`` bits) begins among sorted keys, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def blobs(keys: np.ndarray, bits: int, *values: np.ndarray) -> pa.RecordBatch:
    """A packed run of sorted (key, values) for each shard that has any."""
    cuts = split(keys, bits)
    some = np.flatnonzero(np.diff(cuts))
    blobs = [pack(keys[cuts[s] : cuts[s + 1]], *(v[cuts[s] : cuts[s + 1]] for v in values)) for s in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def shards(batches):
    """(shard, its blobs) of batches sorted by shard."""
    now, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and blobs:
                yield now, blobs
                blobs = []
            now = shard
            blobs.append(blob)
    if blobs:
        yield now, blobs


def shard_bits(df: DataFrame) -> int:
    """Twice as many shards as shuffle partitions, which evens them out; a shard's arrays are what a task holds."""
    return max((2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), 1)


def by_shard(runs: DataFrame) -> DataFrame:
    """All runs of a shard in one task, one after another."""
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(partitions, "shard").sortWithinPartitions("shard")
