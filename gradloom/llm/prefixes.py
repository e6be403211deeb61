"""Token counts of every prefix of every text, by dynamic programming over prefixes.

For each prefix of a run of bytes that the tokenizer never splits, the table of the dynamic
program holds the number of its tokens and its last token.  The next entry follows from the
tokens that end there: the one that belongs is the one that stands behind the last token of the
prefix before it as byte-pair encoding would leave the two.  So a text is walked once, and the
count at *every* prefix comes with it; runs that occur again are looked up.

``store`` keeps the counts as steps, one byte for each code point (the count changes by few
tokens from one prefix to the next, up or down).  ``tokens_at`` and ``longest_within`` answer
truncation and budget questions from the stored steps alone: no text is read or encoded again.

Supported are byte-level BPE files as ``tokenizers`` writes them, without normalizer, prefix
space, truncation or padding; any other file raises ``ValueError``.  Strings of added tokens in
a text count as one token each, as the library counts them by default.

Defined cases: null is empty text; empty text has 0 tokens and no steps; texts may be of any
length; repeated rows give repeated results; an empty table gives none.  Columns in ``keep``
(null or not) are passed on, others are not read; result names are ``n_bytes``, ``n_tokens``
and ``steps``, and a column of ``keep`` may not have one of them.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: White space; the tokenizer never joins a solid character to white space behind it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces, and pairs of tokens, that a worker remembers; beyond it, it starts over.
REMEMBERED = 500_000
#: Pieces longer than this are not remembered.
LONG_PIECE = 256
#: Bytes of steps in one batch that leaves a worker.
BATCH_BYTES = 1 << 23
RESULTS = ("n_bytes", "n_tokens", "steps")


def _alphabet() -> dict[str, int]:
    """Byte of each character that byte-level files write: visible Latin-1 ones stand for themselves, the others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _unassigned() -> str:
    """Character class of code points without a category here: another Unicode version may know them."""
    odd = np.array([unicodedata.category(chr(c)) in ("Cn", "Cs") for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(odd, prepend=False, append=False)).reshape(-1, 2)
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist()) + "]"


def _pattern(engine, letters: str, numbers: str):
    """Pieces whose prefixes need no look at their neighbours; white space of more than one character goes with the solid ones behind it."""
    other = f"[^{_SPACE}{letters}{numbers}]"
    forms = ["'(?:[stmd]|re|ve|ll)", f" ?[{letters}]+", f" ?[{numbers}]+", f" ?{other}+", rf"[\t-\r\x85\xa0](?=[^{_SPACE}])", f"[{_SPACE}]+[^{_SPACE}]*"]
    return engine.compile("|".join(forms))


def checked_file(text: str) -> dict:
    """The file's content if its kind is supported."""
    file = json.loads(text)
    split, model = file["pre_tokenizer"] or {}, file["model"]
    plain = all(not t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    unset = not file["normalizer"] and not file["truncation"] and not file["padding"]
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not byte_level or not plain or not unset or model["type"] != "BPE" or odd:
        raise ValueError("not a plain byte-level BPE file")
    return file


class _Remembered(dict):
    """Steps by piece, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, piece: str) -> bytes:
        counts = self._make(piece)
        # A step that no byte holds raises struct.error; the caller then goes without bytes.
        steps = struct.pack(f"{len(counts)}b", *map(sub, counts, [0, *counts]))
        if len(piece) <= LONG_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = steps
        return steps


class Prefixes:
    """Counts of all prefixes of a text under one tokenizer file."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        file = checked_file(text)
        self._split = Tokenizer.from_str(text).pre_tokenizer.pre_tokenize_str
        byte = _alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        latin = {s: "".join(chr(byte[c]) for c in s) for s in file["model"]["vocab"] if all(c in byte for c in s)}
        self._rank = {(latin[a], latin[b]): i for i, (a, b) in enumerate(merges)}
        self._ends = ahocorasick.Automaton()
        for token in latin.values():
            self._ends.add_word(token, (token, len(token)))
        self._ends.make_automaton()
        added = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._latin = re.compile("[^\x00-ɏ]")
        self._odd = re.compile(_unassigned())
        # Letters and numbers below U+0250 are few, and re is faster than regex.
        self._latin_pieces = _pattern(re, "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe").findall
        self._all_pieces = _pattern(regex, r"\p{L}", r"\p{N}").findall
        self._units = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+$").findall
        self._blank = re.compile(f"[{_SPACE}]*").match
        self._piece_steps, self._unit_steps = _Remembered(self.piece), _Remembered(self.unit)
        self._pairs: dict[tuple[str, str], bool] = {}

    def _stays(self, left: str, right: str) -> bool:
        """Whether encoding the two tokens' bytes gives these two tokens (one, if left is empty)."""
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        parts, rank, none = list(left + right), self._rank.get, len(self._rank)
        while len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self._pairs[left, right] = stays = parts == ([left, right] if left else [right])
        return stays

    def run(self, piece: str) -> list[int]:
        """Counts of the prefixes of text that the tokenizer does not split, one for each code point."""
        latin = piece if piece.isascii() else piece.encode().decode("latin-1")
        count, last, known = [0] * (len(latin) + 1), [""] + [None] * len(latin), self._pairs.get
        for end, (token, size) in self._ends.iter(latin):
            at = end + 1
            if last[at] is None:
                before = last[at - size]
                # Exactly one of the tokens that end here passes.
                if before is not None:
                    stays = known((before, token))
                    if stays or stays is None and self._stays(before, token):
                        count[at], last[at] = count[at - size] + 1, token
        if latin is piece:
            return count[1:]
        return [count[i + 1] for i in range(len(latin)) if i + 1 == len(latin) or not "\x80" <= latin[i + 1] < "\xc0"]

    def _split_up(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self._split(text)] if text else []

    def piece(self, text: str) -> list[int]:
        """Counts of the prefixes of what a pattern found."""
        solid = text[0] != "'" and (not text[0].isspace() or len(text) == 1 or text[0] == " " and not text[1].isspace())
        return self.run(text) if solid else self.unit(text)

    def unit(self, text: str) -> list[int]:
        """Counts of the prefixes of white space (or none) and solid characters (or none) behind it."""
        blank = self._blank(text).end()
        if blank == 1 and text[0] == " ":
            blank = 0
        # A prefix that ends in white space is one run with all the white space before it.
        counts = self.run(text[:blank]) if blank else []
        done = base = 0
        for part in self._split_up(text):
            inside = self.run(part)
            past = done + len(part)
            if past > blank:
                if part[0] == "'" and len(part) > 2:  # a short form; until it is whole, its letters are a run of their own
                    inside = [sum(self.run(p)[-1] for p in self._split_up(part[:k])) for k in range(1, len(part))] + inside[-1:]
                counts += [base + c for c in inside[max(blank - done, 0) :]]
            done, base = past, base + inside[-1]
        return counts

    def steps(self, text: str) -> bytes | np.ndarray:
        """Steps of a text without added tokens."""
        known = self._piece_steps
        if not self._latin.search(text):
            pieces = self._latin_pieces(text)
        elif not self._odd.search(text):
            pieces = self._all_pieces(text)
        else:
            pieces, known = self._units(text), self._unit_steps
        try:
            return b"".join([known[p] for p in pieces])
        except struct.error:
            return np.concatenate([np.diff(self.unit(p), prepend=0) for p in pieces])

    def count(self, text: str) -> tuple[int, bytes]:
        """(tokens, steps as stored) of a text."""
        special = list(self._added.finditer(text)) if self._added else []
        if not special:
            steps = self.steps(text)
            return int(_numbers(steps).sum(dtype=np.int64)), _written(steps)
        parts, at = [], 0
        for match in special:
            # Until it is whole, an added token is ordinary text behind what comes before it.
            steps = _numbers(self.steps(text[at : match.end() - 1])).astype(np.int64)
            before = steps[: match.start() - at].sum()
            parts += [steps, [before + 1 - steps.sum()]]
            at = match.end()
        steps = np.concatenate([*parts, _numbers(self.steps(text[at:]))]).astype(np.int64)
        return int(steps.sum()), _written(steps)


def _numbers(steps: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(steps, np.int8) if isinstance(steps, bytes) else steps


def _written(steps: bytes | np.ndarray) -> bytes:
    """Steps behind a byte that tells their width; empty for no steps."""
    if not isinstance(steps, bytes):
        if len(steps) and (steps.min() < -128 or steps.max() > 127):
            return b"\x04" + steps.astype("<i4").tobytes()
        steps = steps.astype(np.int8).tobytes()
    return b"\x01" + steps if steps else b""


def counts_of(steps: bytes) -> np.ndarray:
    """Tokens of each prefix, from that of one code point on, of stored steps."""
    return np.cumsum(np.frombuffer(steps, "<i4" if steps[:1] == b"\x04" else np.int8, offset=1), dtype=np.int64) if steps else np.empty(0, np.int64)


_loaded: list[tuple[str, Prefixes]] = []


def _prefixes(text: str) -> Prefixes:
    """The worker's own table for a file, made once."""
    if not _loaded or _loaded[0][0] != text:
        _loaded[:] = [(text, Prefixes(text))]
    return _loaded[0][1]


def count(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes, n_tokens and the steps of every text; ``tokenizer`` is the content of a file (a few MB)."""
    checked_file(tokenizer)
    if set(keep) & set(RESULTS):
        raise ValueError(f"columns named {RESULTS} cannot be kept")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _prefixes(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            first, size, out = 0, 0, []
            for row, value in enumerate(texts):
                out.append(table.count(value.as_py() or ""))
                size += len(out[-1][1])
                if size >= BATCH_BYTES or row + 1 == len(texts):
                    totals, steps = zip(*out, strict=True)
                    columns = [c.slice(first, len(out)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(steps, pa.binary())], names=[*keep, "n_tokens", "steps"])
                    first, size, out = row + 1, 0, []

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(*keep, n_bytes.alias("n_bytes"), F.col(text).alias("__text"))
    keep = (*keep, "n_bytes")
    return rows.mapInArrow(walk, f"{schema}{', ' if schema else ''}n_bytes bigint, n_tokens bigint, steps binary")


def store(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The table of ``count``, written to ``folder`` and read from it."""
    count(docs, tokenizer, text, keep).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


@F.pandas_udf(LongType())
def _at(steps, length):
    found = []
    for blob, n in zip(steps, length, strict=True):
        counts = counts_of(blob or b"")
        n = min(max(int(n), 0), len(counts))
        found.append(int(counts[n - 1]) if n else 0)
    return type(length)(found, dtype="int64")


@F.pandas_udf(LongType())
def _within(steps, budget):
    found = []
    for blob, most in zip(steps, budget, strict=True):
        fits = np.flatnonzero(counts_of(blob or b"") <= most)
        found.append(int(fits[-1]) + 1 if len(fits) else 0)
    return type(budget)(found, dtype="int64")


def tokens_at(steps: Column | str, length: Column) -> Column:
    """Tokens of the prefix of so many code points; a longer one is the whole text."""
    return _at(steps, F.coalesce(length.cast("long"), F.lit(0)))


def longest_within(steps: Column | str, budget: Column) -> Column:
    """Code points of the longest prefix with at most so many tokens; a null budget allows none."""
    return _within(steps, F.coalesce(budget.cast("long"), F.lit(-1)))
