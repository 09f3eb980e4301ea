"""Singular values and right singular vectors of one small square factor: Householder, dqds, twisted factorisations.

The factor has as many rows as vectors have dimensions, whatever the number of vectors; it is what blockwise
QR leaves of them.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal v with ``r = u B v.T`` for some orthogonal u, by Householder reflections."""
    m = np.array(r, float)
    n = len(m)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if not np.abs(x[1:]).max(initial=0.0) > 0:
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        if (w := reflector(m[k:, k].copy())) is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k + 2 < n and (w := reflector(m[k, k + 1 :].copy())) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform with a shift, and its d; none if the shift was too large."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for i in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        up = d + e[i]
        qs.append(up)
        if up == 0:
            es.append(0.0)
            d = q[i + 1] - shift
        else:
            # products before quotients where these would leave the range
            part = q[i + 1] / up if _TINY * q[i + 1] < up else None
            es.append(e[i] * part if part is not None else q[i + 1] * (e[i] / up))
            d = (d * part if part is not None else q[i + 1] * (d / up)) - shift
    if d < 0:
        return None
    return [*qs, d], es, [*ds, d]


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, each to high relative accuracy, by dqds.

    Each round is a transform without shift, whose d hold the least value between 1 / sum(1 / d) and min(d), and
    one with a shift from there: the largest tried that keeps all d positive.
    """
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not scale:
        return np.zeros(len(a))
    todo = [(((a / scale) ** 2).tolist(), ((b / scale) ** 2).tolist(), 0.0)]
    values: list[float] = []
    while todo:
        q, e, moved = todo.pop()
        while True:
            if len(q) == 1:
                values.append(q[0] + moved)
                break
            if e[-1] <= _EPS * _EPS * (moved + q[-1]):
                values.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _qd(q, e, 0.0)
            safe, least = 0.0 if min(d) <= _TINY else (1 - 8 * len(q) * _EPS) / sum(1 / x for x in d), min(d)
            for shift in (0.97 * least, (safe * safe * least) ** (1 / 3), safe, safe / 2):
                if shift > _EPS * moved and (found := _qd(q, e, shift)) is not None:
                    q, e, _ = found
                    moved += shift
                    break
    return np.sort(np.array(values))[::-1] * scale**2


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector z with ``(L D L' - value) z`` zero but for one place, and what is there; L is unit bidiagonal with ``low``."""
    n = len(d)
    least = _EPS * _EPS * max(value, _TINY)
    nonzero = lambda x: x if abs(x) > least else (least if x >= 0 else -least)
    s, up = np.empty(n), np.empty(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):  # stationary transform, from the top
        up[i] = d[i] * low[i] / nonzero(s[i] + d[i])
        s[i + 1] = up[i] * low[i] * s[i] - value
    p, down = np.empty(n), np.empty(max(0, n - 1))
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):  # progressive transform, from the bottom
        below = nonzero(d[i] * low[i] * low[i] + p[i + 1])
        down[i] = low[i] * d[i] / below
        p[i] = p[i + 1] * (d[i] / below) - value
    gamma = s + p + value
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z, gamma[twist]


def _inverse_step(d: np.ndarray, low: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """``(L D L' - value)`` solved for ``x``, as in inverse iteration."""
    n, least = len(d), _EPS * max(value, _TINY)
    s, y, pivot, up = -value, x.copy(), np.empty(n), np.zeros(n)
    for i in range(n):
        pivot[i] = s + d[i]
        if abs(pivot[i]) < least:
            pivot[i] = least
        if i + 1 < n:
            up[i] = d[i] * low[i] / pivot[i]
            s = up[i] * low[i] * s - value
            y[i + 1] -= up[i] * y[i]
    y /= pivot
    for i in range(n - 2, -1, -1):
        y[i] -= up[i] * y[i + 1]
    return y


def leading_right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal right singular vectors, as columns, of the ``most`` largest of the squared singular ``values``.

    One twisted factorisation of ``B'B - value`` gives a vector, a Rayleigh quotient sharpens the value and a
    second factorisation the vector.  Where values are so close that vectors lean on each other, the later one
    is made orthogonal to the earlier and sent through inverse iteration, as often as it takes.
    """
    n = len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) or 1.0
    a, b, values = a / scale, b / scale, values / scale**2
    split = np.flatnonzero(np.abs(b) <= _EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) if n > 1 else np.zeros(0, int)
    edges = [0, *(split + 1).tolist(), n]
    owners: list[tuple[float, int, int]] = []  # the values of each unsplit piece
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        owners += [(v, first, last) for v in squared_singular_values(a[first:last], b[first : last - 1])]
    owners.sort(key=lambda o: (-o[0], o[1]))
    out = np.zeros((n, min(most, n)))
    rng = np.random.default_rng(0)
    for k, (value, first, last) in enumerate(owners[:most]):
        diagonal = np.where(np.abs(a[first:last]) > _EPS * _EPS, a[first:last], _EPS * _EPS)
        d, low = diagonal**2, b[first : last - 1] / diagonal[:-1]
        z, off = _twisted(d, low, value)
        better = value + off / (z @ z)
        if abs(better - value) <= 1e-8 * value:
            value = better
            z, _ = _twisted(d, low, value)
        before = out[first:last, :k]
        x = z / np.linalg.norm(z)
        if np.abs(before.T @ x).max(initial=0.0) > 4 * _EPS:
            for _ in range(6):
                x = x - before @ (before.T @ x)
                if not np.linalg.norm(x) > 0.1:  # nothing of its own is left
                    x = rng.standard_normal(last - first)
                    x -= before @ (before.T @ x)
                x = _inverse_step(d, low, value, x / np.linalg.norm(x))
                x /= np.linalg.norm(x)
                if np.abs(before.T @ x).max() <= 4 * _EPS:
                    break
            x = x - before @ (before.T @ x)
            x = x - before @ (before.T @ x)
            x /= np.linalg.norm(x)
        out[first:last, k] = x
    return out


def leading_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The squares of all singular values of ``r``, falling, and the right singular vectors of the ``most`` largest as columns."""
    if not len(r):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(r).max() or 1.0
    a, b, v = bidiagonalised(r / scale)
    values = squared_singular_values(a, b)
    return values * scale**2, v @ leading_right_vectors(a, b, values, most)
