"""Nearest centres of many points at once, and bounds that spare most distances.

Points are matrices with one row per coordinate, centres with one row each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Distances that one matrix holds.
CELLS = 1_000_000
# Share by which bounds are widened whenever a centre moves, far above what rounding changes.
SLACK = 1e-12


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of every point to every centre; squares are summed in the order of the coordinates."""
    total = np.zeros((points.shape[1], len(centres)))
    for coordinate, of_centres in zip(points, centres.T):
        gap = coordinate[:, None] - of_centres[None, :]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def nearest(points: np.ndarray, centres: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centre, the distance to it and to the second nearest; the smaller number wins a tie."""
    n, step = points.shape[1], max(1, cells // len(centres))
    label, first, second = np.empty(n, np.int32), np.empty(n), np.full(n, np.inf)
    for a in range(0, n, step):
        part = slice(a, a + step)
        found = distances(points[:, part], centres)
        label[part] = found.argmin(axis=1)
        if len(centres) > 1:
            least = np.partition(found, 1, axis=1)
            first[part], second[part] = least[:, 0], least[:, 1]
        else:
            first[part] = found[:, 0]
    return label, first, second


class Bounds(NamedTuple):
    """Of each point the number of its centre, at most its distance to it, and at least that to any other."""

    label: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Move(NamedTuple):
    """Centres of a round, and for each centre of the round before its new number (-1: gone) and how far it went."""

    centres: np.ndarray
    number: np.ndarray
    way: np.ndarray


def started(points: np.ndarray, centres: np.ndarray) -> Bounds:
    return Bounds(*nearest(points, centres))


def half_gaps(centres: np.ndarray) -> np.ndarray:
    """Half the distance of each centre to the nearest other one; no point nearer than that has another centre."""
    if len(centres) == 1:
        return np.array([np.inf])
    _, _, second = nearest(centres.T, centres)
    return second / 2


def advanced(points: np.ndarray, bounds: Bounds, move: Move, gaps: np.ndarray) -> tuple[Bounds, int]:
    """Bounds after the centres moved, and the number of points that needed all distances.

    A point keeps its centre if its distance to it is below what any other
    centre can have: by the triangle inequality no centre comes nearer than it
    moves, and none is nearer to a point than half the gap between centres
    leaves. ``gaps`` are the ``half_gaps`` of the new centres.
    """
    label = move.number[bounds.label].astype(np.int32)
    own = move.way[bounds.label]
    ways = np.where(move.number >= 0, move.way, 0.0)
    farthest = int(ways.argmax())
    others = np.delete(ways, farthest).max(initial=0.0)
    most = np.where(bounds.label == farthest, others, ways[farthest])
    upper = (bounds.upper + own) * (1 + SLACK)
    lower = bounds.lower - most
    finite = np.isfinite(lower)
    lower[finite] -= SLACK * (bounds.lower + most)[finite]
    limit = np.maximum(gaps[label] * (1 - SLACK), lower)
    unsure = np.flatnonzero(upper >= limit)
    if len(unsure):
        away = points[:, unsure] - move.centres[label[unsure]].T
        upper[unsure] = np.sqrt((away * away).sum(axis=0))
        unsure = unsure[upper[unsure] * (1 + SLACK) >= limit[unsure]]
    if len(unsure):
        label[unsure], upper[unsure], lower[unsure] = nearest(points[:, unsure], move.centres)
    return Bounds(label, upper, lower), len(unsure)
