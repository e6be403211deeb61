"""A character-level bidirectional LSTM with CRF transitions, in numpy.

The gates use x / (1 + |x|) for tanh, and half of one plus that for the logistic function, in
training and use alike: they cost a division instead of an exponential.  Arrays are laid out
(direction, unit, window), so that one step of many windows is a few long loops.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LABELS = ("", "email", "ip", "card", "phone")

#: Letters without case, then marks of their own; then any digit, other letters, other marks, the rest, and no character.
OWN = "abcdefghijklmnopqrstuvwxyz @._%+-()[]{}<>,:;/#=\"'|&*!?$\n\t"
DIGIT, LETTER, MARK, OTHER, NONE = range(len(OWN), len(OWN) + 5)
KINDS = NONE + 1


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[0x21:0x7F] = MARK
    table[0xC0:0x24F] = LETTER
    for i, c in enumerate(OWN):
        table[ord(c)] = table[ord(c.upper())] = i
    table[ord("0") : ord("9") + 1] = DIGIT
    return table


CLASS = _classes()


class Weights(NamedTuple):
    embed: np.ndarray  # direction, 4 units, character class
    recur: np.ndarray  # direction, 4 units, unit
    out: np.ndarray  # label, 2 units
    bias: np.ndarray  # label
    move: np.ndarray  # from label, to label
    start: np.ndarray  # label


def fresh(units: int, seed: int = 7) -> Weights:
    r, k = np.random.Generator(np.random.PCG64(seed)), len(LABELS)
    f = np.float32
    embed = r.normal(0, 0.3, (2, 4 * units, KINDS)).astype(f)
    embed[:, units : 2 * units] += 1  # remember
    return Weights(embed, r.normal(0, 0.3, (2, 4 * units, units)).astype(f), r.normal(0, 0.3, (k, 2 * units)).astype(f), np.zeros(k, f), np.zeros((k, k), f), np.zeros(k, f))


def _turned(chars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each window's characters backwards, padding still last."""
    at = length[None, :] - 1 - np.arange(len(chars))[:, None]
    return np.where(at >= 0, np.take_along_axis(chars, np.maximum(at, 0), 0), NONE).astype(chars.dtype)


def states(w: Weights, chars: np.ndarray, length: np.ndarray, tape: list | None = None) -> np.ndarray:
    """(step, direction, unit, window); ``chars`` is (step, window), and the second direction's steps count from the end."""
    steps, n = chars.shape
    units = w.recur.shape[2]
    both = (chars, _turned(chars, length))
    h, c = np.zeros((2, units, n), np.float32), np.zeros((2, units, n), np.float32)
    hs = np.empty((steps, 2, units, n), np.float32)
    a, size, s = np.empty((2, 4 * units, n), np.float32), np.empty((2, 4 * units, n), np.float32), np.empty((2, units, n), np.float32)
    for t in range(steps):
        np.matmul(w.recur, h, out=a)
        for d in (0, 1):
            np.take(w.embed[d], both[d][t], axis=1, out=size[d], mode="clip")
        a += size
        np.abs(a, out=size)
        size += 1
        if tape is not None:
            gain = 1 / (size * size)
        a /= size
        gates = a[:, : 3 * units]
        gates *= 0.5
        gates += 0.5
        if tape is not None:
            before = c.copy()
        c *= a[:, units : 2 * units]
        np.multiply(a[:, :units], a[:, 3 * units :], out=s)
        c += s
        np.abs(c, out=s)
        s += 1
        h = hs[t]
        np.divide(c, s, out=h)
        if tape is not None:
            tape.append((a.copy(), gain, before, h.copy(), 1 / (s * s)))
        h *= a[:, 2 * units : 3 * units]
    return hs


def emissions(w: Weights, hs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(label, step, window)."""
    steps, _, units, n = hs.shape
    front = np.matmul(w.out[:, :units], hs[:, 0])  # step, label, window
    back = np.matmul(w.out[:, units:], hs[:, 1])
    at = np.maximum(length[None, :] - 1 - np.arange(steps)[:, None], 0)
    return (front + np.take_along_axis(back, at[:, None, :], 0) + w.bias[:, None]).transpose(1, 0, 2)


def decode(w: Weights, e: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best labels, (step, window).

    Windows where no label but the first can be on a best path are left at once: on any path
    a run of other labels has at most two moves into or out of it, or within it, for each step.
    """
    k, steps, n = e.shape
    best = np.zeros((steps, n), np.uint8)
    slack = 2 * max(float(w.move.max() - w.move[0, 0]), 0) + max(float(w.start.max() - w.start[0]), 0)
    inside = np.arange(steps)[:, None] < length[None, :]
    open_ = np.flatnonzero((((e[1:].max(0) - e[0]) + slack > 0) & inside).any(0))
    if not len(open_):
        return best
    e, length = e[:, :, open_], length[open_]
    score = w.start[:, None] + e[:, 0]
    came = np.zeros((steps, k, len(open_)), np.uint8)
    for t in range(1, steps):
        ways = score[:, None, :] + w.move[:, :, None]
        came[t] = ways.argmax(0)
        score = np.where(t < length, ways.max(0) + e[:, t], score)
    now = score.argmax(0)
    column = np.arange(len(open_))
    for t in range(steps - 1, -1, -1):
        best[t, open_] = np.where(t < length, now, 0)
        if t:
            now = np.where(t < length, came[t, now, column], now)
    return best


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def gradient(w: Weights, chars: np.ndarray, labels: np.ndarray, length: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log likelihood of the label paths of windows, and its gradient."""
    tape: list = []
    hs = states(w, chars, length, tape)
    e = emissions(w, hs, length).astype(np.float64)
    k, steps, n = e.shape
    move, start, column = w.move.astype(np.float64), w.start.astype(np.float64), np.arange(n)
    inside = np.arange(steps)[:, None] < length[None, :]
    alpha, beta = np.zeros((steps, k, n)), np.zeros((steps, k, n))
    alpha[0] = start[:, None] + e[:, 0]
    for t in range(1, steps):
        alpha[t] = np.where(inside[t], _log_sum(alpha[t - 1][:, None] + move[:, :, None], 0) + e[:, t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(inside[t + 1], _log_sum(move[:, :, None] + (e[:, t + 1] + beta[t + 1])[None], 1), beta[t + 1])
    total = _log_sum(alpha[-1], 0)
    d_e = np.exp(alpha + beta - total).transpose(1, 0, 2) * inside
    path = start[labels[0]] + e[labels[0], 0, column]
    d_start = d_e[:, 0].sum(1)
    np.add.at(d_start, labels[0], -1)
    d_move = np.zeros((k, k))
    for t in range(1, steps):
        both = np.exp(alpha[t - 1][:, None] + move[:, :, None] + (e[:, t] + beta[t])[None] - total) * inside[t]
        d_move += both.sum(2)
        np.add.at(d_move, (labels[t - 1], labels[t]), -inside[t].astype(float))
        path = path + inside[t] * (move[labels[t - 1], labels[t]] + e[labels[t], t, column])
    step = np.repeat(np.arange(steps)[:, None], n, 1)
    d_e[labels, step, column[None, :]] -= inside
    d_e = (d_e / n).astype(np.float32)
    units = w.recur.shape[2]
    at = np.maximum(length[None, :] - 1 - step, 0)
    d_back = np.take_along_axis(d_e, at[None], 1) * inside
    sides = (d_e, d_back)  # both by the step of their own direction
    g = Weights(*(np.zeros_like(x) for x in w))
    g.bias[:] = d_e.sum((1, 2))
    for d in (0, 1):
        g.out[:, d * units : (d + 1) * units] = np.einsum("ktn,tun->ku", sides[d], hs[:, d])
    g.move[:], g.start[:] = d_move / n, d_start / n
    both = (chars, _turned(chars, length))
    d_h, d_c = np.zeros((2, units, n), np.float32), np.zeros((2, units, n), np.float32)
    for t in range(steps - 1, -1, -1):
        a, gain, before, cell, cell_gain = tape[t]
        i, f, o, x = (a[:, j * units : (j + 1) * units] for j in range(4))
        for d in (0, 1):
            d_h[d] += w.out[:, d * units : (d + 1) * units].T @ sides[d][:, t]
        d_c += d_h * o * cell_gain
        d_a = np.concatenate([0.5 * d_c * x, 0.5 * d_c * before, 0.5 * d_h * cell, d_c * i], 1) * gain
        d_c = d_c * f
        last = hs[t - 1] if t else np.zeros_like(hs[0])
        g.recur[:] += d_a @ last.transpose(0, 2, 1)
        for d in (0, 1):
            np.add.at(g.embed[d].T, both[d][t], d_a[d].T)
        d_h = w.recur.transpose(0, 2, 1) @ d_a
    return float((total - path).mean()), g


def fit(chars: np.ndarray, labels: np.ndarray, length: np.ndarray, units: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Weights:
    """Adam over windows (window, step) with a label for each character."""
    w = fresh(units, seed)
    if not len(chars):
        w.bias[0] = 100
        return w
    r = np.random.Generator(np.random.PCG64(seed))
    first, second, n = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    turns = epochs * -(-len(chars) // batch)
    for _ in range(epochs):
        order = r.permutation(len(chars))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            _, g = gradient(w, chars[some].T, labels[some].T.astype(np.int64), length[some])
            n += 1
            size = np.sqrt(sum(float((x * x).sum()) for x in g))
            for x, y, m, v in zip(w, g, first, second, strict=True):
                y = y * min(1.0, 5.0 / max(size, 1e-9))
                m += 0.1 * (y - m)
                v += 0.01 * (y * y - v)
                x -= rate * (1 - 0.9 * n / turns) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)
    return w
