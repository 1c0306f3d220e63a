"""Largest singular values and right vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations.

B is upper bidiagonal with diagonal a and superdiagonal b, q = a ** 2 and e = b ** 2. dqds works on (q, e) by sums, products
and quotients of positive numbers only, which keeps every singular value to high relative accuracy. For an eigenvalue of
B'B = L D L' the vector comes from joining the factorisation from the top and the one from the bottom where they meet best.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
HUGE = 1e100


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): (I - beta v v') x has zeros but in its first place."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0
    v = x / norm
    v[0] += 1.0 if v[0] >= 0 else -1.0
    return v, 2.0 / float(v @ v)


def bidiagonalised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, superdiagonal and the reflectors applied from the right, in order."""
    m = np.array(matrix, float)
    d, right = len(m), []
    for k in range(d):
        v, beta = reflector(m[k:, k].copy())
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v, beta = reflector(m[k, k + 1 :].copy())
            m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
            right.append((v, beta))
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def turned_back(y: np.ndarray, right: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """A vector of B's coordinates in those of the matrix."""
    y = y.copy()
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        y[k + 1 :] -= beta * float(v @ y[k + 1 :]) * v
    return y


def shifted(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with shift; None where the shift exceeds the least eigenvalue. The last number bounds it from above."""
    d = q[0] - tau
    least, qs, es = d, [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        if top <= 0.0:
            top = TINY
        ratio = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * ratio)
        d = d * ratio - tau
        least = min(least, d)
    if d < 0.0:
        return None
    return [*qs, d], es, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All eigenvalues of B'B, falling."""
    out: list[float] = []
    blocks = [(q.tolist(), e.tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        bound = 0.0  # of the least eigenvalue, from the last step
        for _ in range(100 * len(q) + 100):
            if len(q) == 1:
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] <= TINY), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e, bound = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if 1.5 * q[0] < q[-1]:  # large values first converge faster
                q, e = q[::-1], e[::-1]
            tau = bound * (1.0 - 4.0 * EPS)
            step = shifted(q, e, tau) if tau > 0.0 else None
            for part in (0.75, 0.25):
                if step is None and tau > 0.0:
                    tau = bound * part
                    step = shifted(q, e, tau)
            if step is None:
                tau = 0.0
                step = shifted(q, e, 0.0)
            q, e, bound = step
            moved += tau
        else:
            raise ArithmeticError("singular values did not converge")
        out.append(q[0] + moved)
    return np.sort(np.array(out))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> list[np.ndarray]:
    """Candidate eigenvectors of B'B at ``value``, the best twist first."""
    floor = EPS * max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)), TINY)
    a = np.where(np.abs(a) < floor, floor, a)
    d, low, n = (a * a).tolist(), (b / a[:-1]).tolist(), len(a)
    safe = lambda x: x if abs(x) > TINY else TINY
    s, up = [-value], []
    for i in range(n - 1):
        up.append(d[i] * low[i] / safe(s[i] + d[i]))
        s.append(up[i] * low[i] * s[i] - value)
    p, down = [0.0] * n, [0.0] * max(n - 1, 0)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] * low[i] + p[i + 1])
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(np.array(s) + np.array(p) + value)
    found = []
    for r in np.argsort(gamma, kind="stable")[:8].tolist():
        z = np.zeros(n)
        z[r] = 1.0
        for step, end, factor in ((-1, -1, up), (1, n, down)):
            for i in range(r + step, end, step):
                z[i] = -factor[min(i, i - step)] * z[i - step]
                if abs(z[i]) > HUGE:  # a poor twist may grow beyond all numbers
                    z /= HUGE
        found.append(z / np.linalg.norm(z))
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest squared singular values, falling, and their right vectors as rows, the entry largest in size positive.

    Parts of B between zeros of its superdiagonal are solved on their own, so equal values in different parts
    keep vectors at right angles; close values within a part take another twist if the best one repeats a vector.
    """
    a, b, right = bidiagonalised(matrix)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * size) + 1).tolist(), len(a)]
    values = [(v, i) for i, (f, t) in enumerate(zip(cuts[:-1], cuts[1:])) for v in dqds(a[f:t] ** 2, b[f : t - 1] ** 2).tolist()]
    values.sort(key=lambda x: (-x[0], x[1]))
    taken: list[np.ndarray] = []
    for value, i in values[:k]:
        f, t = cuts[i], cuts[i + 1]
        best, kept = None, -1.0
        for z in twisted(a[f:t], b[f : t - 1], value):
            y = np.zeros(len(a))
            y[f:t] = z
            for _ in range(2):
                for other in taken:
                    y -= float(other @ y) * other
            norm = float(np.linalg.norm(y))
            if norm > kept:
                best, kept = y / max(norm, TINY), norm
            if norm > 0.5:
                break
        taken.append(best)
    vectors = np.array([turned_back(y, right) for y in taken]).reshape(len(taken), len(a))
    for v in vectors:
        v *= -1.0 if v[np.argmax(np.abs(v))] < 0 else 1.0
    return np.array([v for v, _ in values[:k]]), vectors
