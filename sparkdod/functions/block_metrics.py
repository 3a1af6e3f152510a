"""Distances between blocks of objects (U1): ``(n objects, m objects) -> n x m``.

A block of arrays is a 2-D array of DOUBLE, a block of anything else a 1-D array
of its values. A distance of one's own is any such function that is a metric:
symmetric, zero from an object to itself, and with the triangle inequality.
Coordinates are summed left to right, as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BlockMetric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _same_width(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of different lengths: {a.shape[1]} and {b.shape[1]}")


# a strip of differences that stays in a core's cache over all coordinates
STRIP_ROWS, STRIP_COLS = 64, 1_024


def _by_strips(a: np.ndarray, b: np.ndarray, add: Callable[[np.ndarray, np.ndarray], object]) -> np.ndarray:
    """``add(sums, differences)`` for coordinate after coordinate, strip by strip."""
    _same_width(a, b)
    out = np.zeros((len(a), len(b)))
    at, bt = np.ascontiguousarray(a.T, dtype=np.float64), np.ascontiguousarray(b.T, dtype=np.float64)
    for i in range(0, len(a), STRIP_ROWS):
        for j in range(0, len(b), STRIP_COLS):
            part = at[:, i:i + STRIP_ROWS, None], bt[:, None, j:j + STRIP_COLS]
            sums = np.zeros((part[0].shape[1], part[1].shape[2]))
            diff = np.empty_like(sums)
            for x, y in zip(*part):
                np.subtract(x, y, out=diff)
                add(sums, diff)
            out[i:i + STRIP_ROWS, j:j + STRIP_COLS] = sums
    return out


def _add_square(sums: np.ndarray, diff: np.ndarray) -> None:
    diff *= diff
    sums += diff


def _add_size(sums: np.ndarray, diff: np.ndarray) -> None:
    np.abs(diff, out=diff)
    sums += diff


def _keep_largest(sums: np.ndarray, diff: np.ndarray) -> None:
    np.abs(diff, out=diff)
    np.maximum(sums, diff, out=sums)


def euclidean_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_by_strips(a, b, _add_square))


def manhattan_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _by_strips(a, b, _add_size)


def chebyshev_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _by_strips(a, b, _keep_largest)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]

# more candidates than this share of all pairs: the whole strip is evaluated
DENSE_SHARE = 1 / 16
# strips of whole steps
STEP_ROWS, STEP_COLS = 32, 1_024
# below these the metric itself is as cheap
LEAST_DIMS, LEAST_PAIRS = 8, 2 ** 14


def _pairs_of(d: np.ndarray, limit: np.ndarray) -> Pairs:
    rows, cols = np.nonzero(d <= limit[:, None])
    return rows, cols, d[rows, cols]


def _decided(a: np.ndarray, b: np.ndarray, limit: np.ndarray, rows: np.ndarray, cols: np.ndarray, add: Callable[[np.ndarray, np.ndarray], object],
             end: Callable[[np.ndarray], np.ndarray]) -> Pairs:
    """The candidates within ``limit``, by the sums of the metric itself."""
    sums = np.zeros(len(rows))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        add(sums, x.take(rows) - y.take(cols))
    sums = end(sums)
    keep = sums <= limit[rows]
    return rows[keep], cols[keep], sums[keep]


def _joined(parts: list[Pairs]) -> Pairs:
    rows, cols, d = (np.concatenate(x) for x in zip(*parts))
    turn = np.argsort(rows * (cols.max(initial=0) + 1) + cols, kind="stable")
    return rows[turn], cols[turn], d[turn]


def _euclidean_pairs(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> Pairs:
    """A matrix product finds the candidates, with a margin far above its rounding."""
    _same_width(a, b)
    an, bn = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.column_stack([-2.0 * a, an, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), bn]).T
        most = limit * limit * (1 + 1e-12) + (an + bn.max(initial=0.0)) * 2.0 ** -40 + 1e-300
        maybe = ~(squares > most[:, None])
    if np.count_nonzero(maybe) > DENSE_SHARE * maybe.size:
        return _pairs_of(euclidean_blocks(a, b), limit)
    return _decided(a, b, limit, *np.nonzero(maybe), _add_square, np.sqrt)


def _steps(a: np.ndarray, b: np.ndarray, sums: bool) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Coordinates (first axis) as whole steps of one size from the low end of the range of ``b``, and that size. Values outside
    the range (or 8 standard deviations) count as its ends, which moves no two apart, so a difference is less than one step above
    that of the whole steps. ``sums``: the steps of all coordinates together fit 16 bits, else those of each fit 7.
    None where there is no such size."""
    with np.errstate(over="ignore", invalid="ignore"):
        mean, far = b.mean(axis=0), 8 * b.std(axis=0)
        low, high = np.maximum(b.min(axis=0), mean - far), np.minimum(b.max(axis=0), mean + far)
        step = float((high - low).sum() / 32_000 if sums else (high - low).max(initial=0.0) / 126)
    if not 1e-290 < step < 1e290:
        return None
    kind = np.int16 if sums else np.int8
    return *(np.ascontiguousarray(np.floor((np.clip(x, low, high) - low) / step).T.astype(kind)) for x in (a, b)), step


def _stepped_pairs(a: np.ndarray, b: np.ndarray, limit: np.ndarray, metric: BlockMetric, add: Callable[[np.ndarray, np.ndarray], object],
                   sums: bool) -> Pairs:
    """Distances in whole steps (``_steps``), many in one instruction, find the candidates of a metric that adds up
    (``sums``) or keeps the largest difference."""
    _same_width(a, b)
    steps = _steps(a, b, sums) if LEAST_DIMS <= a.shape[1] <= 16_000 and len(a) * len(b) >= LEAST_PAIRS else None
    if steps is None:
        return _pairs_of(metric(a, b), limit)
    qa, qb, step = steps
    with np.errstate(over="ignore"):
        most = np.floor(np.clip(limit / step * (1 + 1e-9), -2.0, 1e6) + (1.001 * a.shape[1] if sums else 1.001) + 1e-6).astype(np.int64)
    if sums:  # the sum of |x - y| is twice that of max(x, y) less both sums
        start = (-((qb.sum(axis=0, dtype=np.int64) + 1) // 2)).astype(np.int16)
        most = np.minimum((most + qa.sum(axis=0, dtype=np.int64)) // 2, 32_767).astype(np.int16)
    else:
        start, most = np.zeros(len(b), dtype=np.int8), np.minimum(most, 127).astype(np.int8)
    parts, rows, cols = [], [], []
    for i in range(0, len(a), STEP_ROWS):
        for j in range(0, len(b), STEP_COLS):
            x, y = qa[:, i:i + STEP_ROWS, None], qb[:, None, j:j + STEP_COLS]
            total = np.repeat(start[None, j:j + STEP_COLS], x.shape[1], axis=0)
            part = np.empty_like(total)
            for u, v in zip(x, y):
                if sums:
                    np.maximum(u, v, out=part)
                    np.add(total, part, out=total)
                else:
                    np.subtract(u, v, out=part)
                    np.abs(part, out=part)
                    np.maximum(total, part, out=total)
            maybe = total <= most[i:i + STEP_ROWS, None]
            n = np.count_nonzero(maybe)
            if n > DENSE_SHARE * maybe.size:
                r, c, d = _pairs_of(metric(a[i:i + STEP_ROWS], b[j:j + STEP_COLS]), limit[i:i + STEP_ROWS])
                parts.append((r + i, c + j, d))
            elif n:
                at = np.flatnonzero(maybe)
                rows.append(at // maybe.shape[1] + i)
                cols.append(at % maybe.shape[1] + j)
    none = np.zeros(0, dtype=np.int64)
    parts.append(_decided(a, b, limit, np.concatenate([none, *rows]), np.concatenate([none, *cols]), add, lambda s: s))
    return _joined(parts)


# points of a cube whose sides are this part of a radius are within the radius, by number of coordinates
euclidean_blocks.cube = lambda dims: dims ** -0.5
manhattan_blocks.cube = lambda dims: 1.0 / dims
chebyshev_blocks.cube = lambda dims: 1.0

euclidean_blocks.pairs = _euclidean_pairs
manhattan_blocks.pairs = lambda a, b, limit: _stepped_pairs(a, b, limit, manhattan_blocks, _add_size, True)
chebyshev_blocks.pairs = lambda a, b, limit: _stepped_pairs(a, b, limit, chebyshev_blocks, _keep_largest, False)


def pairs_within(metric: BlockMetric, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> Pairs:
    """(row, column, distance) of the pairs whose distance is within ``limit`` (one for each row of ``a``), rows and in them
    columns ascending. A metric may bring a faster form as its attribute ``pairs``, or as ``within`` a matrix
    that may hold any larger value beyond the limit."""
    pairs = getattr(metric, "pairs", None)
    return _pairs_of(getattr(metric, "within", lambda a, b, limit: metric(a, b))(a, b, limit), limit) if pairs is None else pairs(a, b, limit)


def absolute_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.float64)[:, None] - b.astype(np.float64)[None, :])
