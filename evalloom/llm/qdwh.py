"""Eigenvectors of a symmetric matrix by spectral divide and conquer on QDWH polar decompositions.

The polar factor ``U`` of ``A - shift * I`` has eigenvalue 1 where ``A`` is above the shift and -1 below, so ``(U + I) / 2`` projects on the
upper invariant subspace. An orthonormal basis of it and of its complement splits ``A`` into two smaller matrices, and so on.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ITERATIONS = 30  # six are enough for any condition number that doubles hold


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix, by dynamically weighted Halley steps with QR factorisations."""
    size = len(a)
    eye = np.eye(size)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))  # and this one the smallest from below
    except np.linalg.LinAlgError:
        low = EPS
    low = float(min(max(low, EPS), 1.0))
    for _ in range(ITERATIONS):
        square = low * low
        d = np.cbrt(4 * max(0.0, 1 - square) / square**2)
        root = np.sqrt(1 + d)
        a_k = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, eye]))
        step = b_k / c_k * x + (a_k - b_k / c_k) / np.sqrt(c_k) * (q[:size] @ q[size:].T)
        moved = np.linalg.norm(step - x)
        x = step
        low = min(1.0, low * (a_k + b_k * square) / (1 + c_k * square))
        if moved <= 4 * size * EPS or (1 - low < EPS and moved < 1e-6):
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """Orthogonal basis whose first columns span the eigenvectors above ``shift``, and their number; None if an eigenvalue is too near."""
    size = len(a)
    u = polar(a - shift * np.eye(size))
    upper = (u + u.T) / 4 + np.eye(size) / 2
    rank = round(float(np.trace(upper)))
    if not 0 < rank < size or np.linalg.norm(upper @ upper - upper) > 1e-8:
        return None
    # one step of subspace iteration from a fixed random start, twice, for a basis accurate to rounding
    start = np.random.default_rng(size).standard_normal((size, rank))
    basis, _ = np.linalg.qr(upper @ start)
    basis, _ = np.linalg.qr(upper @ basis, mode="complete")
    return basis, rank


def shifts(a: np.ndarray) -> list[float]:
    """Places to cut: between the diagonal entries, the middle first, and the mean. Eigenvalues lie on both sides of each."""
    diagonal = np.sort(np.diag(a))
    middles = (diagonal[1:] + diagonal[:-1]) / 2
    by_middle = sorted(range(len(middles)), key=lambda i: (abs(2 * i + 2 - len(diagonal)), i))
    return [float(middles[i]) for i in by_middle] + [float(diagonal.mean())]


def eigen(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns; all of them by default.

    Only subspaces that hold wanted eigenvalues are split further. A block that is a multiple of the identity up to rounding is done.
    The largest entry of a vector by absolute value is positive.
    """
    a = (a + a.T) / 2
    size = len(a)
    wanted = size if wanted is None else min(wanted, size)
    noise = size * EPS * np.linalg.norm(a)
    found: list[np.ndarray] = []
    stack = [(a, np.eye(size))]
    while stack and len(found) < wanted:
        block, basis = stack.pop()
        cut = None
        if len(block) > 1 and np.linalg.norm(block - np.trace(block) / len(block) * np.eye(len(block))) > noise:
            cut = next((c for c in (split(block, s) for s in shifts(block)) if c is not None), None)
        if cut is None:
            found.extend(basis.T)
            continue
        turn, rank = cut
        inner = turn.T @ block @ turn
        inner = (inner + inner.T) / 2
        basis = basis @ turn
        stack.append((inner[rank:, rank:], basis[:, rank:]))
        stack.append((inner[:rank, :rank], basis[:, :rank]))
    vectors = np.array(found).reshape(-1, size)
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[order]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    top = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] if len(vectors) else np.empty(0)
    return values[order], (vectors * np.where(top < 0, -1, 1)[:, None]).T
