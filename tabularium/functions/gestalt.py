"""Gestalt similarity of many pairs of strings at a time.

Two strings have in common their longest block of equal letters, and what the parts to
the left of it, and to the right of it, have in common again; of equal blocks the first
in ``a`` counts, then the first in ``b``. The ratio is twice the letters in common over
the letters of both. Pairs are arrays of letters here: a table of block lengths grows
row by row for all pairs at once, and the parts make the pairs of the next round.

Letters that are frequent in a ``b`` of ``LONG`` letters or more begin no block but may lengthen one, or stand
for one at the very beginning where there is none.
"""

from __future__ import annotations

import numpy as np

# From which length frequent letters are set apart, and how often such a letter stands.
LONG, FREQUENT = 200, 100
CELLS = 4_000_000  # of a table held at a time


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and where each begins and ends."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _bag_bound(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """How many letters each pair shares, order aside; letters share 64 bins, so it is no less than what is in common."""
    n = len(a_ends) - 1
    bag = lambda x, ends: np.bincount(np.repeat(np.arange(n), np.diff(ends)) * 64 + x % 64, minlength=64 * n).reshape(n, 64)
    return np.minimum(bag(a, a_ends), bag(b, b_ends)).sum(1)


def _frequent(b: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """Which letters of long strings are frequent there; None where no string is long."""
    if (np.diff(ends) < LONG).all():
        return None
    out = np.zeros(len(b), bool)
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if e - s >= LONG:
            _, place, n = np.unique(b[s:e], return_inverse=True, return_counts=True)
            out[s:e] = n[place] > (e - s) // FREQUENT + 1
    return out


def _blocks(a: np.ndarray, b: np.ndarray, often: np.ndarray | None, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part ``a_from, a_to, b_from, b_to`` the longest block: its places in ``a`` and ``b`` and its length."""
    n = len(parts)
    wide, high = int((parts[:, 3] - parts[:, 2]).max()), int((parts[:, 1] - parts[:, 0]).max())
    at = parts[:, 2, None] + np.arange(wide)
    inside = at < parts[:, 3, None]
    right = b[np.minimum(at, len(b) - 1)]
    begins = inside if often is None else inside & ~often[np.minimum(at, len(b) - 1)]
    size, i_end, j_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    row = np.zeros((n, wide + 1), np.int32)
    for step in range(high):
        i = parts[:, 0] + step
        live = i < parts[:, 1]
        left = a[np.minimum(i, len(a) - 1)]
        row[:, 1:] = np.where((right == left[:, None]) & begins & live[:, None], row[:, :-1] + 1, 0)
        j = row.argmax(1)
        best = row[np.arange(n), j]
        more = best > size
        size[more], i_end[more], j_end[more] = best[more], i[more] + 1, parts[more, 2] + j[more]
    none = size == 0
    i, j = np.where(none, parts[:, 0], i_end - size), np.where(none, parts[:, 2], j_end - size)
    if often is not None:
        for edge_a, edge_b, back in ((0, 2, True), (1, 3, False)):
            while True:
                p, q = (i - 1, j - 1) if back else (i + size, j + size)
                room = (p >= parts[:, edge_a]) & (q >= parts[:, edge_b]) if back else (p < parts[:, edge_a]) & (q < parts[:, edge_b])
                grow = room & (a[np.clip(p, 0, len(a) - 1)] == b[np.clip(q, 0, len(b) - 1)])
                if not grow.any():
                    break
                size = size + grow
                if back:
                    i, j = i - grow, j - grow
    return i, j, size


def common_letters(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Letters in common of each pair."""
    often = _frequent(b, b_ends)
    out = np.zeros(len(a_ends) - 1, np.int64)
    parts = np.stack([a_ends[:-1], a_ends[1:], b_ends[:-1], b_ends[1:]], 1)
    owner = np.arange(len(parts))
    while True:
        full = (parts[:, 0] < parts[:, 1]) & (parts[:, 2] < parts[:, 3])
        parts, owner = parts[full], owner[full]
        if not len(parts):
            return out
        order = np.argsort(parts[:, 3] - parts[:, 2], kind="stable")
        parts, owner = parts[order], owner[order]
        widths, cut = (parts[:, 3] - parts[:, 2] + 1).tolist(), [0]
        for k, w in enumerate(widths):  # rows of a table: the widest is the last
            if (k - cut[-1]) * w >= CELLS:
                cut.append(k)
        found = [_blocks(a, b, often, parts[s:e]) for s, e in zip(cut, [*cut[1:], len(parts)])]
        i, j, size = (np.concatenate(x) for x in zip(*found))
        np.add.at(out, owner, size)
        some = size > 0
        parts, owner, i, j, size = parts[some], owner[some], i[some], j[some], size[some]
        left = np.stack([parts[:, 0], i, parts[:, 2], j], 1)
        right = np.stack([i + size, parts[:, 1], j + size, parts[:, 3]], 1)
        parts, owner = np.concatenate([left, right]), np.concatenate([owner, owner])


def ratios(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """The ratio of each pair; where ``least`` is given, 0 for pairs whose letters, order aside, allow less than that."""
    if not len(a):
        return np.zeros(0)
    x, x_ends = _letters(a)
    y, y_ends = _letters(b)
    both = np.diff(x_ends) + np.diff(y_ends)
    out = np.where(both == 0, 1.0, 0.0)
    chosen = np.flatnonzero(both) if least is None else np.flatnonzero((both > 0) & (2 * _bag_bound(x, x_ends, y, y_ends) >= least * both - 1e-9))
    if len(chosen):
        x, x_ends = _letters([a[k] for k in chosen.tolist()])
        y, y_ends = _letters([b[k] for k in chosen.tolist()])
        out[chosen] = 2.0 * common_letters(x, x_ends, y, y_ends) / both[chosen]
    return out
