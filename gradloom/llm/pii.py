"""Personal data: patterns for what has a fixed form, and a character tagger for what has not.

The base finds e-mail addresses, IP addresses, card and phone numbers by their patterns.  The
tagger (``tagger.py``) learns from labelled spans: the base's own in a bounded sample of
documents (``Settings.rows``, those with the smallest md5 of their key), some of them rewritten in
forms that no pattern has, such as ``jo (at) mail (dot) org`` or a phone number without its plus,
in their own surroundings and in windows without any, half of them with a decoy: a hash, serial number, date,
version or amount that is nobody's data.  It reads every text in overlapping windows;
each character takes its label from the window in which it lies nearer the middle, and
spans are read from the labels of the whole text, across windows.  Spans of the tagger that
touch a base span, have too little in them for their kind, or are part of a longer run of letters and
digits, are left out; base spans always stay.

Positions are code points, ends exclusive.  Null text is empty and has no spans; texts of any
length are read whole; repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm import tagger
from gradloom.llm import tokens as T

KINDS = tagger.LABELS[1:]

# What follows the @ of an address, and the patterns of the other kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_DOT = r"(?:\s?[\[(]dot[\])]\s?|\sdot\s|\.)"
#: What an address that the tagger proposes must hold: a name, an at and a domain, in any of their spellings.
SPOKEN = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*(?:\s?@\s?|\s?[\[(]at[\])]\s?|\sat\s)[\w-]+(?:{_DOT}[\w-]+)+", re.I | re.A)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


class Settings(NamedTuple):
    rows: int = 3000  # of the sample
    windows: int = 4000  # learned from
    learn: int = 96  # characters of a window in training
    around: int = 4000  # characters of a text in training, about its first digit or @
    spans: int = 20  # of a text in training
    variants: int = 20  # of a span in training, at most
    units: int = 8
    epochs: int = 20
    window: int = 256
    overlap: int = 32
    together: int = 1024  # windows of a step


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost matches that do not overlap, kind by kind; those that fail their test go, without a second try."""
    out = []
    at = last = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            last = at = found.end()
        else:
            at += 1
            last = at
    # A run of digits is only ever entered at its first: from a later one the same match would fail or be shorter.
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _address(words: list[str], r: np.random.Generator) -> str:
    """An address made of the text's own words, so that its form is learned and not a corpus's habit of names."""
    part = [words[int(i)].lower() for i in r.integers(0, len(words), 3)]
    local = (part[0], f"{part[0]}{int(r.integers(1, 100))}", f"{part[0]}.{part[1]}", f"{part[0]}_{int(r.integers(10))}")[int(r.integers(4))]
    return f"{local}@{part[2]}{('.', '.mail.')[int(r.integers(4)) == 0]}{('com', 'org', 'net', 'de', 'io', 'co')[int(r.integers(6))]}"


def _rewrite(kind: int, s: str, r: np.random.Generator, words: list[str]) -> str:
    """The span in a form of its own, or as it is."""
    way = int(r.integers(6))
    if kind == 0:
        if words and r.integers(4):
            s = _address(words, r)
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("@", "."), ("@", "."))[way]
        return s.replace("@", at).replace(".", dot) if way < 3 else s.replace("@", at)
    if kind == 1:
        return s.replace(".", (" . ", "[.]", ".", ".", ".", ".")[way])
    d = _digits(s)
    if kind == 2:
        mark = (" ", "-", ".", "", "", "")[way]
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{d[:-10]} {a} {b} {c}", s, s)[way]


def _decoy(r: np.random.Generator) -> str:
    """Digits that are no personal data: part of a hash, a number with letters, a date, version, time, amount or year."""
    way, n = int(r.integers(7)), [int(x) for x in r.integers(0, 10, 12)]
    if way == 0:
        return "".join("0123456789abcdef"[x] for x in r.integers(0, 16, int(r.integers(8, 41))))
    if way == 1:
        return "".join("ABCDEFGHJKLMNPQRSTUVWXYZ"[x] for x in r.integers(0, 24, 2)) + "-" + "".join(map(str, n[: int(r.integers(4, 11))]))
    if way == 2:
        return f"20{n[0]}{n[1]}-0{n[2] % 9 + 1}-{n[3] % 3}{n[4] % 9 + 1}"
    if way == 3:
        return f"v{n[0]}.{n[1]}{n[2]}.{n[3]}"
    if way == 4:
        return f"{n[0] % 2}{n[1]}:{n[2] % 6}{n[3]}:{n[4] % 6}{n[5]}"
    return f"{n[0]}{n[1]},{n[2]}{n[3]}{n[4]}.{n[5]}{n[6]}" if way == 5 else f"{n[0] + 1}{n[1]}{n[2]}{n[3]}"


def examples(texts: list[str], settings: Settings, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (classes, labels, lengths) of labelled spans with their surroundings, and of text without any."""
    r, size = np.random.Generator(np.random.PCG64(seed)), settings.learn
    chars, labels, lengths = [], [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        code = tagger.CLASS[np.frombuffer(text[:size].encode("utf-32-le", "surrogatepass"), np.uint32)]
        label = np.zeros(size, np.uint8)
        for k, a, b in spans:
            label[a : min(b, size)] = k + 1
        row = np.full(size, tagger.NONE, np.uint8)
        row[: len(code)] = code
        chars.append(row)
        labels.append(label)
        lengths.append(max(len(code), 1))

    known = []
    for text in texts:
        spans = sorted(base_spans(text), key=lambda s: s[1])
        spans = [s for i, s in enumerate(spans) if not i or s[1] >= spans[i - 1][2]]
        known += [(text, spans, s) for s in spans[: settings.spans]]
        for _ in range(2):
            left = int(r.integers(max(len(text) - size, 1)))
            if text and not any(s < left + size and e > left for _, s, e in spans):
                part = text[left : left + size]
                gap = part.find(" ", int(r.integers(size // 2)))
                if gap >= 0 and r.integers(2):
                    part = f"{part[:gap]} {_decoy(r)}{part[gap:]}"
                add(part, [])
    # Half of what is learned from has no span; the spans come again in other forms until they are the other half.
    half = settings.windows // 2
    pick = r.permutation(len(chars))[:half].tolist()
    blank = len(chars)
    by_kind = [[x for x in known if x[2][0] == k] for k in range(len(KINDS))]
    kinds = [k for k in range(len(KINDS)) if by_kind[k]]
    for n in range(min(half, settings.variants * len(known))):
        mine = by_kind[kinds[n % len(kinds)]]
        text, spans, (k, a, b) = mine[int(r.integers(len(mine)))]
        before = int(r.integers(4, size // 2))
        left = a - min(a, before)
        left = max([left, *(e for _, s, e in spans if e <= a)])  # no other span may lie in the window
        right = min([len(text), *(s for _, s, e in spans if s >= b)])
        new = _rewrite(k, text[a:b], r, [w for w in text[left:right].split() if w.isalpha() and w.isascii()][:50])
        add(text[left:a] + new + text[b:right], [(k, a - left, a - left + len(new))])
    pick += range(blank, len(chars))
    if not pick:
        return np.zeros((0, size), np.uint8), np.zeros((0, size), np.uint8), np.zeros(0, np.int64)
    return np.array(chars)[pick], np.array(labels)[pick], np.array(lengths)[pick]


def fit(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> tagger.Weights:
    """Learn from the sample; only texts with a digit or @ can have a span and are drawn for it, half as many of the others."""
    rows = docs.select(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("o"), F.col(text).alias("t")).where("t IS NOT NULL")
    # Surroundings only, so what comes to the driver is bounded too.
    sign = F.regexp_instr("t", F.lit(r"[0-9@]"))
    begin = F.greatest(sign - settings.around // 2, F.lit(1))

    def sample(some: Column, n: int) -> list[str]:
        # The keys first: a task sends n hashes, and only texts of the sample.
        mine = rows.where(some)
        last = mine.select("o").orderBy("o").limit(n).agg(F.max("o")).first()[0]
        if last is None:
            return []
        parts = mine.where(F.col("o") <= last).select("o", F.substring("t", begin, F.lit(settings.around)).alias("t"))
        return [r["t"] for r in parts.orderBy("o", "t").limit(n).collect()]

    with_, without = sample(sign > 0, settings.rows), sample(sign <= 0, settings.rows // 2)
    return tagger.fit(*examples(with_ + without, settings), units=settings.units, epochs=settings.epochs)


def label(w: tagger.Weights, points: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """Label of every character of concatenated texts."""
    n, stride = np.diff(starts), s.window - s.overlap
    count = np.where(n > 0, np.maximum(-(-(n - s.overlap) // stride), 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    length = np.minimum(n[doc] - at, s.window)
    begin = starts[:-1][doc] + at
    # What each window decides: from the middle of the overlap with the one before to the middle of the next.
    lo = np.where(at > 0, s.overlap // 2, 0)
    hi = np.where(at + length < n[doc], s.window - s.overlap // 2, length)
    code = np.append(tagger.CLASS[points], np.uint8(tagger.NONE))
    out = np.zeros(len(points), np.uint8)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), s.together):
        some = order[i : i + s.together]
        steps = np.arange(int(length[some[0]]))[:, None]
        where = begin[some][None, :] + steps
        chars = code[np.where(steps < length[some], where, len(code) - 1)]
        e = tagger.emissions(w, tagger.states(w, chars, length[some]), length[some])
        best = tagger.decode(w, e, length[some])
        mine = (steps >= lo[some]) & (steps < hi[some]) & (best > 0)
        out[where[mine]] = best[mine]
    return out


def _enough(kind: int, s: str) -> bool:
    d = len(_digits(s))
    if kind == 0:
        return len(s) >= 8 and sum(c.isalpha() for c in s) >= 5
    return d >= (4, 13, 9)[kind - 1] and d <= (12, 19, 15)[kind - 1]


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of equal labels of one text that no base span touches."""
    edge = np.flatnonzero(np.diff(labels, prepend=0, append=0))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if labels[a]:
            part = text[a:b]
            a, b = int(a) + len(part) - len(part.lstrip()), int(b) - (len(part) - len(part.rstrip()))
            if labels[a] == 1:  # words before or after an address are not part of it
                address = SPOKEN.search(text, a, b)
                a, b = address.span() if address else (a, a)
            glued = (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())
            if not glued and _enough(int(labels[a]) - 1, text[a:b]) and not any(x < b and y > a for _, x, y in base):
                out.append((int(labels[a]) - 1, a, b))
    return out


def find(docs: DataFrame, w: tagger.Weights, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, base and spans (arrays of kind, start, end) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    columns = [*keep, "base", "spans"]

    def run(batches):
        for batch in batches:
            base, every = [], []
            for _, data, starts in T.slices(batch.column(batch.num_columns - 1), 1 << 20):
                points, at = T.characters(data, starts)
                labels = label(shared.value, points, at, settings)
                for i in range(len(at) - 1):
                    s = data[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace")
                    mine = base_spans(s)
                    own = labels[at[i] : at[i + 1]]
                    base.append(mine)
                    every.append(mine + added_spans(s, own, mine) if own.any() else mine)
            told = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(x)] for x in column], kind) for column in (base, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *told], names=columns)

    spans = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, base {spans}, spans {spans}")
