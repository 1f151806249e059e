"""Numbers on the driver: sequences of generators, and small dense matrices."""

from __future__ import annotations

import math

import numpy as np


class Generator:
    """Random numbers in order, by kind: xorshift, mt19937 (64 bits), or tausworthe (differences of a lagged sequence)."""

    KINDS = ("xorshift", "mt19937", "tausworthe")
    LENGTH, LAGS = 607, (334, 273)

    def __init__(self, kind: str = "xorshift", seed: int = 1) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no generator of kind {kind}")
        self.kind, self.state, self.spare = kind, seed & (1 << 64) - 1 or 1, None
        self.mt = np.random.Generator(np.random.MT19937(seed)) if kind != "xorshift" else None
        if kind == "tausworthe":
            self.past = [float(x) for x in self.mt.random(self.LENGTH)]

    def next(self) -> float:
        if self.kind == "xorshift":
            x, mask = self.state, (1 << 64) - 1
            x ^= x << 13 & mask
            x ^= x >> 7
            x ^= x << 17 & mask
            self.state = x
            return x / mask
        if self.kind == "mt19937":
            return float(self.mt.random())
        x = (self.past[-self.LAGS[0]] - self.past[-self.LAGS[1]]) % 1.0
        self.past.append(x)
        del self.past[0]
        return x

    def uniform(self, low: float = 0.0, high: float = 1.0) -> float:
        return self.next() * (high - low) + low

    def uniform_int(self, low: int, high: int) -> int:
        return math.floor((high - low) * self.next() + low)

    def gaussian(self) -> float:
        """Two numbers make two; the second is kept."""
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        r, angle = math.sqrt(-2.0 * math.log(max(self.next(), 1e-300))), 2.0 * math.pi * self.next()
        self.spare = r * math.sin(angle)
        return r * math.cos(angle)


class Factors:
    """A square matrix as lower and upper factors with its rows reordered by the largest pivot."""

    def __init__(self, matrix) -> None:
        a = np.array(matrix, float)
        if a.ndim != 2 or a.shape[0] != a.shape[1]:
            raise ValueError("a square matrix is needed")
        n = len(a)
        self.order, self.sign = np.arange(n), 1.0
        for k in range(n):
            p = k + int(np.argmax(np.abs(a[k:, k])))
            if a[p, k] == 0:
                raise ValueError("the matrix is singular")
            if p != k:
                a[[k, p]], self.order[[k, p]], self.sign = a[[p, k]], self.order[[p, k]], -self.sign
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        self.lu = a

    def solve(self, b) -> np.ndarray:
        x = np.array(b, float)[self.order]
        n = len(self.lu)
        for k in range(n):
            x[k] -= self.lu[k, :k] @ x[:k]
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - self.lu[k, k + 1 :] @ x[k + 1 :]) / self.lu[k, k]
        return x

    def inverse(self) -> np.ndarray:
        return self.solve(np.eye(len(self.lu)))

    def determinant(self) -> float:
        return self.sign * float(np.prod(np.diag(self.lu)))
