"""Linear-chain conditional random fields on hashed features, in numpy.

Chains are handled together: arrays are (step, chain, label). Features of a token are
bucket numbers; a token's score for a label is the sum of its buckets' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """weights: (buckets, labels); trans: (labels, labels), row to column."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray


def chains(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each chain: tokens of a row, ``most`` at a time."""
    pieces = -(-counts // most)
    row = np.repeat(np.arange(len(counts)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    base = np.cumsum(counts) - counts
    return base[row] + k * most, np.minimum(most, counts[row] - k * most)


def _laid_out(scores: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(length.max(initial=0))
    at = first[None, :] + np.arange(steps)[:, None]
    on = np.arange(steps)[:, None] < length[None, :]
    return np.where(on[:, :, None], scores[np.minimum(at, len(scores) - 1)], 0.0), on


def forward_backward(scores: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of all tokens (tokens, labels); with ``pairs`` also the expected
    transitions, summed over all chains. Every step is scaled to a sum of 1."""
    x, on = _laid_out(scores, first, length)
    steps, n, labels = x.shape
    e = np.exp(x - x.max(axis=2, keepdims=True)) if steps else x
    m = np.exp(trans)
    a, b = np.empty_like(e), np.ones_like(e)
    for t in range(steps):
        v = e[t] if t == 0 else (a[t - 1] @ m) * e[t]
        a[t] = v / v.sum(axis=1, keepdims=True)
        if t:
            a[t] = np.where(on[t][:, None], a[t], a[t - 1])
    for t in range(steps - 2, -1, -1):
        v = (b[t + 1] * e[t + 1]) @ m.T
        v /= v.sum(axis=1, keepdims=True)
        b[t] = np.where(on[t + 1][:, None], v, 1.0)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    out = np.zeros_like(scores)
    at = first[None, :] + np.arange(steps)[:, None]
    out[at[on]] = p[on]
    if not pairs:
        return out
    total = np.zeros((labels, labels))
    for t in range(1, steps):
        live = on[t]
        left, right = a[t - 1][live], (b[t] * e[t])[live]
        z = np.einsum("ni,ij,nj->n", left, m, right)
        total += m * (left.T @ (right / z[:, None]))
    return out, total


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of every token."""
    x, on = _laid_out(scores, first, length)
    steps, n, labels = x.shape
    out = np.zeros(len(scores), np.int64)
    if not steps:
        return out
    best, back = x[0].copy(), np.zeros((steps, n, labels), np.int64)
    for t in range(1, steps):
        v = best[:, :, None] + trans[None]
        back[t] = np.where(on[t][:, None], v.argmax(axis=1), np.arange(labels)[None])
        best = np.where(on[t][:, None], v.max(axis=1) + x[t], best)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        live = on[t]
        out[(first + t)[live]] = state[live]
        state = np.take_along_axis(back[t], state[:, None], axis=1)[:, 0] if t else state
    return out


def fit(labels: list[str], batches: list, buckets: int, epochs: int, rate: float = 0.3) -> Crf:
    """AdaGrad on the conditional likelihood. Each batch has what scores tokens:
    (token numbers, bucket numbers, values) of all features, the tokens' labels, and
    first token and length of the chains."""
    n = len(labels)
    w, t = np.zeros((buckets, n)), np.zeros((n, n))
    gw, gt = np.full((buckets, 1), 1e-3), np.full((n, n), 1e-3)
    for _ in range(epochs):
        for (token, bucket, value), y, first, length in batches:
            scores = np.zeros((len(y), n))
            np.add.at(scores, token, w[bucket] * value[:, None])
            p, pairs = forward_backward(scores, first, length, t, pairs=True)
            inner = np.ones(len(y), bool)
            inner[first] = False
            seen = np.zeros((n, n))
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            p[np.arange(len(y)), y] -= 1
            scale = 1.0 / max(len(first), 1)
            grad = np.zeros_like(w)
            np.add.at(grad, bucket, p[token] * value[:, None])
            grad *= scale
            used = np.unique(bucket)
            gw[used] += (grad[used] ** 2).sum(axis=1, keepdims=True)
            w[used] -= rate * grad[used] / np.sqrt(gw[used])
            g = (pairs - seen) * scale
            gt += g**2
            t -= rate * g / np.sqrt(gt)
    return Crf(labels, w.astype(np.float32), t)
