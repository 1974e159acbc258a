"""Eigenvectors of a symmetric matrix by spectral divide and conquer (QDWH-eig: Nakatsukasa and Higham, 2013).

The polar factor U of A - shift has eigenvalues 1 and -1: (U + 1) / 2 projects on the eigenvectors above the shift. Bases of that space
and of the rest turn the problem into two smaller ones, until blocks have one component or one eigenvalue. U comes from
dynamically weighted Halley steps, which need no inverse and take six steps for any matrix in double precision.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QDWH steps: each is one QR factorisation of (sqrt(c) X; I)."""
    n = len(a)
    scale = np.linalg.norm(a)
    x, low = a / scale, _EPS
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < 1e-14 * n and abs(1 - low) < 10 * _EPS:
            break
    return x


def _projected(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the spaces above and below ``shift``, or None where the shift is too near an eigenvalue or splits nothing."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if np.linalg.norm(moved) == 0:
        return None
    above = (polar_factor(moved) + np.eye(n)) / 2
    size = int(round(float(np.trace(above))))
    if not 0 < size < n or np.linalg.norm(above @ above - above) > 1e-6:
        return None
    # Subspace iteration from the projector's heaviest columns; one step and one correction settle it.
    columns = np.argsort(-np.diag(above), kind="stable")[:size]
    basis, _ = np.linalg.qr(above @ np.linalg.qr(above[:, columns] + 1e-3 * np.eye(n)[:, columns])[0])
    full, _ = np.linalg.qr(np.hstack([basis, np.eye(n)]))
    basis, _ = np.linalg.qr(above @ full[:, :size])
    full, _ = np.linalg.qr(np.hstack([basis, np.eye(n)]))
    up, down = full[:, :size], full[:, size:n]
    return (up, down) if np.linalg.norm(down.T @ a @ up) <= 1e-9 * max(np.linalg.norm(a), 1e-300) else None


def _divide(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    if n == 1:
        return np.diag(a).copy(), np.eye(1)
    centre = float(np.trace(a)) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= tiny:
        return np.full(n, centre), np.eye(n)  # one eigenvalue: every basis will do
    # The mean lies between the least and the largest eigenvalue; the other shifts serve where it meets one.
    middle = float(np.median(np.diag(a)))
    for shift in (middle, centre, *(centre + spread * step / n for step in (0.37, -0.41, 0.113, -0.127, 0.031, -0.029, 0.0071, -0.0073))):
        parts = _projected(a, shift)
        if parts is not None:
            out = []
            for basis in parts:
                inner = basis.T @ a @ basis
                values, vectors = _divide((inner + inner.T) / 2, tiny)
                out.append((values, basis @ vectors))
            return np.concatenate([v for v, _ in out]), np.hstack([v for _, v in out])
    return np.diag(a).copy(), np.eye(n)  # eigenvalues too near each other to tell apart


def _settle(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrects vectors that are nearly right: two first-order steps, each made orthonormal again."""
    for _ in range(2):
        inner = vectors.T @ a @ vectors
        values = np.diag(inner)
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > 1e-7 * max(np.abs(values).max(), 1e-300)
        turn = np.where(far, inner / np.where(far, gap, 1.0), 0.0)
        vectors, r = np.linalg.qr(vectors @ (np.eye(len(a)) + turn))
        vectors = vectors * np.sign(np.diag(r))
    return np.einsum("ij,ik,kj->j", vectors, a, vectors), vectors


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    n = len(a)
    if n == 0 or not np.any(a):
        return np.zeros(n), np.eye(n)
    scale = float(np.abs(a).max())
    unit = (a + a.T) / (2 * scale)
    _, vectors = _divide(unit, 4 * _EPS * np.linalg.norm(unit) * np.sqrt(n))
    values, vectors = _settle(unit, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, vectors[:, order]
