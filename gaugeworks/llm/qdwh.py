"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar decompositions.

The orthogonal polar factor of A - s I is 1 on the eigenvectors above s and -1 on those below, so
half of it plus the identity projects on the subspace above. QDWH iterations find the factor with
matrix products, QR and Cholesky factorisations only; the projector's range and its complement
split the matrix into two smaller ones, and so on until one dimension is left.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_RETRIES = (0.0, 0.05, -0.05, 0.15, -0.15, 0.3, -0.3)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps."""
    n = len(a)
    scale = np.linalg.norm(a)
    x, low = a / scale, _EPS / np.sqrt(n)
    for _ in range(20):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:  # far from orthogonal: the stable form
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(np.eye(n) + wc * (x.T @ x), x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if 1 - low < 10 * _EPS and np.linalg.norm(x - before) <= np.cbrt(5 * _EPS) * np.sqrt(n):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of the larger and the smaller eigenvalues; None if all are equal."""
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * _EPS * max(abs(middle), np.abs(a).max()):
        return None
    best = None
    start = np.random.default_rng(n).standard_normal((n, n))  # any start of full rank
    for off in _RETRIES:  # a shift that meets an eigenvalue has no clear split: try beside it
        projector = (polar_factor(a - (middle + off * spread) * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper, _ = np.linalg.qr(projector @ start[:, :rank])
        upper, _ = np.linalg.qr(projector @ upper)
        whole, _ = np.linalg.qr(upper, mode="complete")
        lower = whole[:, rank:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = (left, upper, lower)
        if left <= 20 * n * _EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def leading_eigenvectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of the ``count`` largest eigenvalues, falling.

    Parts that cannot hold any of them are not split further. Of each vector the entry of the
    largest size is positive.
    """
    open_, found = [((a + a.T) / 2, np.eye(len(a)))], []
    while open_ and len(found) < count:
        block, basis = open_.pop()
        halves = split(block) if len(block) > 1 else None
        if halves is None:
            found += list(basis.T)
            continue
        for half in (halves[1], halves[0]):  # the larger values are taken up next
            own = half.T @ block @ half
            open_.append(((own + own.T) / 2, basis @ half))
    vectors = np.array(found).reshape(-1, len(a)).T
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[order], vectors[:, order]
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors
