"""Eigenpairs of a symmetric matrix by contour integration (FEAST).

Sylvester's inertia of a shifted matrix counts the eigenvalues above the shift. Counts choose intervals that hold the wanted values;
for each interval the resolvent is integrated along a circle by Gauss-Legendre quadrature, which projects a block of vectors onto
the interval's eigenvectors; a Rayleigh-Ritz step gives the pairs, and the count of the interval tells whether any is missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NODES = 8


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of the LDL' factors of matrix - shift, with pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    n, at, positive = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8
    while at < n:
        rest = a[at:, at:]
        diagonal = np.abs(np.diag(rest))
        d = int(diagonal.argmax())
        column = np.abs(rest[:, d])
        column[d] = 0
        o = int(column.argmax())
        if diagonal[d] >= alpha * column[o]:
            order, size = [d], 1
        else:
            order, size = [d, o], 2
        keep = np.array([i for i in range(n - at) if i not in order])
        pivot = rest[np.ix_(order, order)]
        values = np.linalg.eigvalsh(pivot)
        positive += int((values > 0).sum())
        if len(keep):
            side = rest[np.ix_(keep, order)]
            if np.any(values == 0):  # the shift is an eigenvalue to the last bit
                return above(matrix, np.nextafter(shift, np.inf))
            a[at + size :, at + size :] = rest[np.ix_(keep, keep)] - side @ np.linalg.solve(pivot, side.T)
        at += size
    return positive


def span(matrix: np.ndarray) -> tuple[float, float]:
    """Bounds of all eigenvalues (Gershgorin)."""
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    return float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())


def intervals(matrix: np.ndarray, wanted: int, most: int = 8) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, count) from the top down that hold at least the ``wanted`` greatest eigenvalues.

    An interval holds at most ``most`` values unless they are closer together than rounding can tell.
    """
    low, high = span(matrix)
    margin = 1e-3 * max(high - low, abs(high), 1e-300)
    high, least = high + margin, 1e-13 * max(abs(low), abs(high), 1e-300)
    floor, found, out = high, 0, []
    while found < min(wanted, len(matrix)):
        a, b = low - margin, floor  # a: a shift with too many values above, b: with too few
        count_a = len(matrix)
        while True:
            mid = (a + b) / 2
            count = above(matrix, mid)
            if found < count <= found + most:
                at_least = mid
                break
            if count <= found:
                b = mid
            else:
                a, count_a = mid, count
            if b - a <= least:
                at_least, count = a, count_a
                break
        top = floor
        while above(matrix, (at_least + top) / 2) == found and top - at_least > 4 * least:  # a circle no wider than it must be
            top = (at_least + top) / 2
        floor = _in_gap(matrix, at_least, a, top, count)
        out.append((floor, top, count - found))
        found = count
    return out


def _in_gap(matrix: np.ndarray, shift: float, low: float, high: float, count: int, steps: int = 6) -> float:
    """A shift with as many values above it as ``shift`` has, about half way between the values next to it."""
    below, over = (low, shift), (shift, high)
    for _ in range(steps):
        mid = sum(below) / 2
        below = (below[0], mid) if above(matrix, mid) == count else (mid, below[1])
        mid = sum(over) / 2
        over = (mid, over[1]) if above(matrix, mid) == count else (over[0], mid)
    return (below[1] + over[0]) / 2


def contour(low: float, high: float) -> list[tuple[complex, complex]]:
    """Shifts and weights of the upper half of the circle through both ends; the lower half is its mirror image."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - points)
    unit = np.exp(1j * angle)
    centre, radius = (low + high) / 2, (high - low) / 2
    return [(centre + radius * u, w / 2 * radius * u) for u, w in zip(unit, weights)]


def solved(matrix: np.ndarray, shift: complex, weight: complex, block: np.ndarray) -> np.ndarray:
    """One node's share of the projection of ``block``."""
    return (weight * np.linalg.solve(shift * np.eye(len(matrix)) - matrix, block.astype(complex))).real


def eigenpairs(matrix: np.ndarray, wanted: int, project: Callable[[list[tuple[float, float, np.ndarray]]], list[np.ndarray]] | None = None,
               rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The greatest ``wanted`` eigenvalues, falling, and unit eigenvectors as columns.

    ``project`` gives for each (low, high, block) the sum of ``solved`` over the nodes of its contour; it may spread them over tasks.
    """
    project = project or (lambda jobs: [sum(solved(matrix, z, w, y) for z, w in contour(a, b)) for a, b, y in jobs])
    n = len(matrix)
    rng = np.random.default_rng(7)
    open_ = {k: (a, b, c, rng.standard_normal((n, min(n, c + max(4, c // 2))))) for k, (a, b, c) in enumerate(intervals(matrix, wanted))}
    scale = max(map(abs, span(matrix)))
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(rounds):
        keys = list(open_)
        for k, image in zip(keys, project([(a, b, y) for a, b, _, y in (open_[k] for k in keys)])):
            a, b, count, _ = open_[k]
            basis, size, _ = np.linalg.svd(image, full_matrices=False)
            basis = basis[:, size > 1e-13 * size[0]]
            small = basis.T @ matrix @ basis
            values, inner = np.linalg.eigh((small + small.T) / 2)
            vectors = basis @ inner
            inside = (values > a) & (values <= b)
            residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            good = inside & (residual <= 1e-12 * scale)
            if good.sum() == count:  # as many as the inertia counts: none is missed
                done[k] = values[good], vectors[:, good]
                del open_[k]
            else:
                fresh = rng.standard_normal((n, min(n, 2 * vectors.shape[1]) - vectors.shape[1]))  # neighbours outside that the circle lets through
                open_[k] = (a, b, count, np.hstack([vectors, fresh]))
        if not open_:
            break
    if open_:
        raise ArithmeticError(f"eigenvalues missing in {[(a, b, c) for a, b, c, _ in open_.values()]}")
    basis, _ = np.linalg.qr(np.hstack([done[k][1] for k in sorted(done)]))  # one more Ritz step over all intervals makes them orthogonal to the last bits
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    vectors = basis @ inner
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]
