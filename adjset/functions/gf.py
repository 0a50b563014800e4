"""Arithmetic and polynomials in the field of 2**61 - 1 elements, many at once."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

P = (1 << 61) - 1


def to_field(h: np.ndarray) -> np.ndarray:
    """64-bit hashes to field elements."""
    x = h.astype(np.int64).view(np.uint64)
    x = (x & np.uint64(P)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product mod P of arrays of reduced values; halves of 31 bits keep every step within 64 bits."""
    lo, s = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> s, a & lo, b >> s, b & lo
    mid = a1 * b0 + a0 * b1
    x = ((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << s) + a0 * b0
    x = (x & np.uint64(P)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a + (np.uint64(P) - b)
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def points(n: int) -> list[int]:
    """The first n evaluation points, spread over the field by multiplication with a fixed odd number."""
    return [(0x9E3779B97F4A7C15 * (i + 1) ** 2 + 0x1234567) % P for i in range(n)]


def products(h: np.ndarray, starts: np.ndarray, zs: np.ndarray) -> np.ndarray:
    """Characteristic polynomials of the segments of h that begin at ``starts``, at each point: (segments, points).

    Pairs of neighbours are multiplied, round by round, until one value per segment is left.
    """
    v = sub(zs[None, :], h[:, None])
    lens = np.diff(np.append(starts, len(h)))
    while len(v) > len(lens):
        seg = np.repeat(np.arange(len(lens)), lens)
        at = np.arange(len(v)) - np.repeat(np.cumsum(lens) - lens, lens)
        first = at % 2 == 0
        i = np.flatnonzero(first)
        has = (i + 1 < len(v)) & ~first[np.minimum(i + 1, len(v) - 1)]
        out = v[i]
        out[has] = mul(out[has], v[i[has] + 1])
        v, lens = out, np.bincount(seg[i], minlength=len(lens))
    return v


def inverses(x: np.ndarray) -> np.ndarray:
    """1 / x, elementwise, as x to the power of P - 2 (0 stays 0): powers 2**k - 1 by doubling k, then the last three bits."""
    def squared(y, n):
        for _ in range(n):
            y = mul(y, y)
        return y

    power, k = x, 1  # x ** (2 ** k - 1)
    for bit in "11010":  # 58 = 0b111010: the first bit is done
        power, k = mul(squared(power, k), power), 2 * k
        if bit == "1":
            power, k = mul(squared(power, 1), x), k + 1
    # P - 2 = (2 ** 58 - 1) * 8 + 0b101
    return mul(squared(power, 3), mul(squared(x, 2), x))


def _powers(zs: np.ndarray, n: int) -> np.ndarray:
    """(points, n): z ** 0 .. z ** (n - 1)."""
    out = [np.ones(len(zs), np.uint64)]
    for _ in range(n - 1):
        out.append(mul(out[-1], zs))
    return np.stack(out, 1)


def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Systems of linear equations (systems, rows, unknowns + 1), by elimination in all systems at once: a solution each, in
    which unknowns that are free are 0, and whether there is one."""
    m = m.copy()
    n, rows, width = m.shape
    at, every = np.zeros(n, np.int64), np.arange(n)
    pivot_of = np.full((n, width - 1), -1)
    below = np.arange(rows)[None, :]
    for c in range(width - 1):
        usable = (m[:, :, c] != 0) & (below >= at[:, None])
        has, p = usable.any(1), usable.argmax(1)
        i = every[has]
        if not len(i):
            continue
        r, q = at[i], p[i]
        top = m[i, q].copy()
        m[i, q] = m[i, r]
        top = mul(top, inverses(top[:, c])[:, None])
        rest = sub(m[i], mul(m[i][:, :, c][:, :, None], top[:, None, :]))
        rest[np.arange(len(i)), r] = top
        m[i] = rest
        pivot_of[i, c] = r
        at[i] += 1
    ok = ~((m[:, :, -1] != 0) & (below >= at[:, None])).any(1)
    x = np.where(pivot_of >= 0, np.take_along_axis(m[:, :, -1], np.maximum(pivot_of, 0), 1), np.uint64(0))
    return x, ok


def _values(polys: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Polynomials (polynomials, coefficients), lowest power first, at the points of ``powers``."""
    y = np.zeros((len(polys), len(powers)), np.uint64)
    for k in range(polys.shape[1]):
        y = y + mul(polys[:, k, None], powers[None, :, k])
        y = np.where(y >= np.uint64(P), y - np.uint64(P), y)
    return y


#: Points that a solution must hold at besides those that it was made from, and the first degree bound.
CHECKS, FIRST_BOUND = 2, 4


def differences(ea: np.ndarray, eb: np.ndarray, na: np.ndarray, nb: np.ndarray, zs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many pairs of sets at once, from their evaluations (pairs, points) and sizes: polynomials that vanish at the
    elements of only A and of only B, highest power first with leading zeros, and which pairs are solved.

    With A and B these polynomials, the ratio of the sets' polynomials is A / B, so eb * A(z) = ea * B(z) at every point: linear
    equations in the coefficients, with leading ones. The bound of their degrees together doubles until the solution holds at
    CHECKS more points; pairs for which the points at hand don't suffice stay unsolved. If fewer elements differ than the
    bound allows, A and B have a factor in common, which has no root at an element but by a chance of one in 2**55.
    """
    n, most = len(ea), len(zs) - CHECKS
    z = np.array(zs, np.uint64)
    powers = _powers(z, most + 2)
    delta = na - nb
    pa, pb = np.zeros((n, most + 1), np.uint64), np.zeros((n, most + 1), np.uint64)
    solved = np.zeros(n, bool)
    bound = FIRST_BOUND
    while True:
        k = min(bound, most)
        # degrees that fit the bound and differ as the sizes do; one more unknown than the bound where it is odd
        la = (k + delta) // 2
        lb = la - delta
        i = np.flatnonzero(~solved & (la >= 0) & (lb >= 0))
        if len(i):
            a, b = la[i], lb[i]
            col = np.arange(k)[None, :]
            own, other = col < a[:, None], (col >= a[:, None]) & (col < (a + b)[:, None])
            power = np.where(own, col, np.where(other, col - a[:, None], 0))
            w = powers[:k].T[power]  # (pairs, unknowns, points): z ** power
            left, right = eb[i, None, :k], sub(np.uint64(0), ea[i, None, :k])
            m = np.where(own[:, :, None], mul(left, w), np.where(other[:, :, None], mul(right, w), np.uint64(0)))
            at = lambda e, d: mul(e[i, :k], powers[:k].T[d])
            rhs = sub(at(ea, b), at(eb, a))
            x, ok = solve(np.concatenate([m.transpose(0, 2, 1), rhs[:, :, None]], 2))
            fa, fb = np.zeros((len(i), most + 1), np.uint64), np.zeros((len(i), most + 1), np.uint64)
            row = np.arange(len(i))
            fa[:, :k] = np.where(own, x, np.uint64(0))
            fa[row, a] = 1
            r, c = np.nonzero(other)
            fb[r, c - a[r]] = x[r, c]
            fb[row, b] = 1
            more = slice(k, k + CHECKS)
            ok &= (mul(eb[i, more], _values(fa, powers[more])) == mul(ea[i, more], _values(fb, powers[more]))).all(1)
            done = i[ok]
            pa[done], pb[done], solved[done] = fa[ok, ::-1], fb[ok, ::-1], True
        if k == most:
            return pa, pb, solved
        bound *= 2


def roots(poly: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which h[i] is a root of the polynomial in row i of ``poly`` (highest power first, leading zeros allowed)."""
    y = np.zeros(len(h), np.uint64)
    for k in range(poly.shape[1]):
        y = mul(y, h) + poly[:, k]
        y = np.where(y >= np.uint64(P), y - np.uint64(P), y)
    return y == 0
