"""Square grids of booleans, many at a time: what a cell reaches, and exact distances, in time linear in the cells."""

from __future__ import annotations

import numpy as np

#: Rings about the centre that are searched for a free cell where the centre is barred.
RINGS = 4


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' group, for pairs (a, b) of members that belong together.

    Union-find in rounds: each root goes below the least root it is paired with, then paths are halved until all point at
    roots.
    """
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def starts_of(barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each grid the cell where a flood begins: the centre or, if it is barred, the first free one by ring, row and column; and whether there is any."""
    count, n = len(barrier), barrier.shape[1]
    c = n // 2
    offsets = sorted((max(abs(y), abs(x)), y, x) for y in range(-RINGS, RINGS + 1) for x in range(-RINGS, RINGS + 1) if 0 <= c + y < n and 0 <= c + x < n)
    cells = np.array([(c + y) * n + c + x for _, y, x in offsets])
    free = ~barrier.reshape(count, -1)[:, cells]
    return cells[free.argmax(1)], free.any(1)


def flooded(barrier: np.ndarray) -> np.ndarray:
    """Cells that the start of each grid reaches in the four directions without crossing a barrier; barrier: (grids, n, n).

    Runs of free cells within rows are the members, overlaps of runs in neighbouring rows join them.
    """
    free = ~barrier
    count, n = free.shape[0], free.shape[1]
    begins = free.copy()
    begins[:, :, 1:] &= ~free[:, :, :-1]
    run = np.cumsum(begins.ravel()).reshape(free.shape) - 1
    # an overlap begins where both rows are free and a run begins in one of them
    overlap = free[:, 1:] & free[:, :-1] & (begins[:, 1:] | begins[:, :-1])
    root = joined(int(begins.sum()), run[:, :-1][overlap], run[:, 1:][overlap])
    start, any_free = starts_of(barrier)
    if not len(root):
        return np.zeros_like(free)
    own = root[np.maximum(run.reshape(count, -1)[np.arange(count), start], 0)]
    return free & (root[np.maximum(run, 0)] == own[:, None, None]) & any_free[:, None, None]


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Squared distance in cells from each cell to the nearest set one of its grid, infinite where none is; mask: (grids, n, n).

    Along columns from the last and the next set cell; then along rows as the lower envelope of parabolas, one for each
    column, all rows of all grids at once.
    """
    count, n = mask.shape[0], mask.shape[1]
    at = np.arange(n)[None, :, None]
    far = 4 * n
    last = np.maximum.accumulate(np.where(mask, at, -far), 1)
    following = np.minimum.accumulate(np.where(mask, at, far)[:, ::-1], 1)[:, ::-1]
    near = np.minimum(at - last, following - at)
    height = np.where(near < n, near.astype(np.float64) ** 2, np.inf).reshape(-1, n)  # a row of parabolas for each row of each grid
    rows = np.arange(len(height))
    vertex = np.zeros((len(height), n), np.int64)  # columns whose parabolas make up the envelope so far
    begin = np.full((len(height), n + 1), np.inf)  # where each of them begins to be the lowest
    top = np.full(len(height), -1)
    for q in range(n):
        here = rows[np.isfinite(height[:, q])]
        begin_q = np.full(len(height), -np.inf)
        todo = here[top[here] >= 0]
        while len(todo):  # parabolas that the new one hides go
            v = vertex[todo, top[todo]]
            cross = ((height[todo, q] + q * q) - (height[todo, v] + v * v)) / (2.0 * (q - v))
            hidden = cross <= begin[todo, top[todo]]
            begin_q[todo[~hidden]] = cross[~hidden]
            todo = todo[hidden]
            top[todo] -= 1
            todo = todo[top[todo] >= 0]
        top[here] += 1
        vertex[here, top[here]] = q
        begin[here, top[here]] = begin_q[here]
    out, k = np.full(height.shape, np.inf), np.zeros(len(height), np.int64)
    some = rows[top >= 0]
    for q in range(n):
        while True:
            next_ = some[(k[some] < top[some]) & (begin[some, np.minimum(k[some] + 1, n)] < q)]
            if not len(next_):
                break
            k[next_] += 1
        v = vertex[some, k[some]]
        out[some, q] = (q - v) ** 2 + height[some, v]
    return out.reshape(mask.shape)


def distances_m(mask: np.ndarray, radius_m: float) -> np.ndarray:
    """Metres to the nearest set cell, for grids that are two radii wide; the radius where none is set."""
    square = squared_distances(mask)
    metres = np.sqrt(square) * 2 * radius_m / mask.shape[1]
    return np.where(np.isfinite(square), metres, radius_m).astype(np.float32)


def beside(mask: np.ndarray) -> np.ndarray:
    """Set cells and their neighbours in the four directions."""
    wide = mask.copy()
    wide[:, 1:] |= mask[:, :-1]
    wide[:, :-1] |= mask[:, 1:]
    wide[:, :, 1:] |= mask[:, :, :-1]
    wide[:, :, :-1] |= mask[:, :, 1:]
    return wide
