"""Hashed terms of texts as sparse rows, and scorers over them: a factorization machine and a linear model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trustwatch.llm import text as T

U = np.uint64


def hashed_terms(column: pa.Array, bits: int, shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(terms, ptr): the distinct terms of row r are terms[ptr[r]:ptr[r + 1]], sorted.

    Terms are words (A-Z lower-cased; letters, digits and non-ASCII characters) and their first four bytes. With ``shapes``:
    words as they stand, by length, case and marks instead, which tell layout rather than topic.
    """
    mask = U((1 << bits) - 1)
    found, sizes = [], []
    for lo, hi, buf, offs in T.slices(column):
        w = T.hash_words(buf, offs, T.SPACE if shapes else T.NOT_ALNUM, T.SAME if shapes else T.LOWER)
        rows = w.rows().astype(np.uint64)
        if shapes:
            n = np.minimum(w.end - w.start, 24).astype(np.uint64)
            head, tail = _class(buf[w.start]), _class(buf[w.end - 1])
            before = _class(buf[np.maximum(w.end - 2, w.start)])
            second = _class(buf[np.minimum(w.start + 1, w.end - 1)])
            terms = np.concatenate([T.mix(n + U(1000)), T.mix(head * U(64) + tail * U(8) + U(2000)), T.mix(tail * U(64) + before * U(8) + U(3000)), T.mix(head * U(64) + second * U(8) + U(4000)), T.mix(buf[w.end - 1].astype(np.uint64) + U(5000))])
            rows = np.tile(rows, 5)
        else:
            stem = np.zeros(len(w.start), np.uint64)
            for i in range(4):
                at = w.start + i
                ok = at < w.end
                stem[ok] = stem[ok] * U(257) + T.LOWER[buf[at[ok]]].astype(np.uint64) + U(1)
            terms = np.concatenate([w.hash, T.mix(stem + U(77))])
            rows = np.tile(rows, 2)
        keys = np.unique((rows << U(32)) | (terms & mask))
        found.append((keys & U(0xFFFFFFFF)).astype(np.int64))
        sizes.append(np.bincount((keys >> U(32)).astype(np.int64), minlength=hi - lo))
    terms = np.concatenate(found) if found else np.zeros(0, np.int64)
    return terms, np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)


def _class(b: np.ndarray) -> np.ndarray:
    out = np.full(len(b), 0, np.uint64)
    out[(b >= 97) & (b < 123)] = 1
    out[(b >= 65) & (b < 91)] = 2
    out[(b >= 48) & (b < 58)] = 3
    out[b >= 128] = 4
    out[(b == 46) | (b == 44)] = 5
    return out


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[r]:ptr[r + 1]]; empty rows give 0."""
    if values.ndim == 1:
        return np.bincount(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), weights=values, minlength=len(ptr) - 1)
    return np.stack([_sums(values[:, k], ptr) for k in range(values.shape[1])], 1)


@dataclass
class Machine:
    """bias + sum of w over a text's terms + sum over its pairs of terms of the product of their factors, through a logistic curve."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, terms: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        out = self.bias + _sums(self.w[terms].astype(np.float64), ptr)
        if self.v.shape[1]:
            f = self.v[terms].astype(np.float64)
            out += 0.5 * (_sums(f, ptr) ** 2 - _sums(f * f, ptr)).sum(1)
        return out

    def score(self, terms: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, ptr), -40, 40)))


def fit(terms: np.ndarray, ptr: np.ndarray, target: np.ndarray, bits: int, factors: int, epochs: int = 12, rate: float = 0.08, l2: float = 1e-4, batch: int = 256, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss; targets may be probabilities; both classes weigh alike."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(1 << bits, np.float32), rng.normal(0, 0.01, (1 << bits, factors)).astype(np.float32))
    gw, gv, gb = np.full(1 << bits, 1e-3, np.float32), np.full((1 << bits, factors), 1e-3, np.float32), 1e-3
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    size = np.diff(ptr)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            n = size[rows]
            p = np.r_[0, np.cumsum(n)]
            x = terms[np.repeat(ptr[rows] - p[:-1], n) + np.arange(p[-1])]
            y = target[rows]
            g = (m.score(x, p) - y) * np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(rows)
            per = np.repeat(g, n).astype(np.float32)
            uniq, inv = np.unique(x, return_inverse=True)
            dw = np.bincount(inv, weights=per, minlength=len(uniq)).astype(np.float32) + l2 * m.w[uniq]
            gw[uniq] += dw * dw
            if factors:
                f = m.v[x]
                pull = per[:, None] * (np.repeat(_sums(f, p), n, axis=0).astype(np.float32) - f)
                dv = np.stack([np.bincount(inv, weights=pull[:, k], minlength=len(uniq)) for k in range(factors)], 1).astype(np.float32) + l2 * m.v[uniq]
                gv[uniq] += dv * dv
                m.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            db = float(g.sum())
            gb += db * db
            m.bias -= rate * db / gb**0.5
    return m
