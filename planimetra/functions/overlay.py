"""Union, difference and intersection of plan regions with holes, in NumPy. A region is a list of closed rings; a point is inside if an odd number of rings go around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from planimetra.functions.shapes import is_convex, signed_area

#: Corners this near are one; the sides of an edge are looked at this far from it.
SNAP, ASIDE = 1e-7, 1e-6
#: Pairs of edges, or of pieces and edges, that are held at once.
PAIRS = 500_000

Rings = list[np.ndarray]


def _edges(rings: Rings) -> np.ndarray:
    """(n, 2, 2) of snapped ends, without edges of no length."""
    out = [np.stack([r, np.roll(r, -1, axis=0)], axis=1) for r in (np.round(np.asarray(r, float) / SNAP) * SNAP for r in rings) if len(r) > 2]
    edges = np.concatenate(out) if out else np.zeros((0, 2, 2))
    return edges[(edges[:, 0] != edges[:, 1]).any(axis=1)]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _blocks(own: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each row i and the rows from start to start + count of its place, own, in runs of about PAIRS."""
    size = count[own]
    total, at = np.cumsum(size), 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = size[at:to]
        done = np.cumsum(n)
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(done[-1]) - np.repeat(done - n, n) + start[own[i]]
        at = to


def split(edges: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of many places (ascending), cut wherever those of a place meet, each piece once, and the place of each piece."""
    if not len(edges):
        return np.zeros((0, 2, 2)), np.zeros(0, np.int64)
    count = np.bincount(place)
    a, d = edges[:, 0], edges[:, 1] - edges[:, 0]
    size = np.linalg.norm(d, axis=1)
    low, high = edges.min(axis=1) - 2 * SNAP, edges.max(axis=1) + 2 * SNAP
    number = np.arange(len(edges))
    owner, where = [number, number], [np.zeros(len(edges)), np.ones(len(edges))]
    for i, j in _blocks(place, np.cumsum(count) - count, count):
        near = (low[i, 0] <= high[j, 0]) & (low[j, 0] <= high[i, 0])
        i, j = i[near], j[near]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1]) & (i != j)
        i, j = i[near], j[near]
        det, apart = _cross(d[i], d[j]), a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = _cross(apart, d[j]) / det, _cross(apart, d[i]) / det
        ei, ej = SNAP / size[i], SNAP / size[j]
        meets = (np.abs(det) > 1e-9 * size[i] * size[j]) & (s > -ei) & (s < 1 + ei) & (t > -ej) & (t < 1 + ej)
        owner.append(i[meets])
        where.append(s[meets])
        # ends of others that lie on this edge, those of parallel ones among them
        for end in (0, 1):
            to = edges[j, end] - a[i]
            along, off = (to * d[i]).sum(axis=1) / size[i] ** 2, np.abs(_cross(d[i], to)) / size[i]
            on = (off <= SNAP) & (along > 0) & (along < 1)
            owner.append(i[on])
            where.append(along[on])
    owner, where = np.concatenate(owner), np.clip(np.concatenate(where), 0, 1)
    order = np.lexsort((where, owner))
    owner, where = owner[order], where[order]
    at = np.round((a[owner] + where[:, None] * d[owner]) / SNAP).astype(np.int64)
    piece = (owner[1:] == owner[:-1]) & (at[1:] != at[:-1]).any(axis=1)
    p, q, own = at[:-1][piece], at[1:][piece], place[owner[:-1][piece]]
    swap = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    flat = np.concatenate([np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)], axis=1)
    order = np.lexsort((*flat.T[::-1], own))
    flat, own = flat[order], own[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]).any(axis=1) | (own[1:] != own[:-1])
    return flat[new].reshape(-1, 2, 2) * SNAP, own[new]


def _inside(points: np.ndarray, own: np.ndarray, edges: np.ndarray, place: np.ndarray, region: np.ndarray, regions: int) -> np.ndarray:
    """(points, regions): whether an odd number of rings of each region of a point's place go around it."""
    count = np.bincount(place, minlength=int(own.max(initial=0)) + 1)
    out = np.zeros(len(points) * regions, np.int64)
    ay, by = edges[:, 0, 1], edges[:, 1, 1]
    for i, j in _blocks(own, np.cumsum(count) - count, count):
        y = points[i, 1]
        beside = (ay[j] > y) != (by[j] > y)
        i, j = i[beside], j[beside]
        at = edges[j, 0, 0] + (points[i, 1] - ay[j]) / (by[j] - ay[j]) * (edges[j, 1, 0] - edges[j, 0, 0])
        right = points[i, 0] < at
        out += np.bincount(i[right] * regions + region[j[right]], minlength=len(out))
    return (out % 2 == 1).reshape(len(points), regions)


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    none = lambda x: np.zeros(len(x), np.int64)
    return _inside(points, none(points), edges, none(edges), none(edges), 1)[:, 0]


def sides(edges: np.ndarray, place: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the edges of many places, the place of each, and in which of its regions the points to the left and to the right of it are."""
    pieces, own = split(edges, place)
    way = pieces[:, 1] - pieces[:, 0]
    normal = np.stack([-way[:, 1], way[:, 0]], axis=1) / np.linalg.norm(way, axis=1)[:, None] * ASIDE
    left, right = (_inside(pieces.mean(axis=1) + side * normal, own, edges, place, region, int(region.max(initial=0)) + 1) for side in (1, -1))
    return pieces, own, left, right


def combined(regions: list[Rings], rule: Callable[[np.ndarray], np.ndarray]) -> Rings:
    """Boundary of the points for which rule, given whether they are inside each region (rows), holds; outer rings run counter-clockwise, holes clockwise."""
    own = [_edges(r) for r in regions]
    if not any(map(len, own)):
        return []
    edges, region = np.concatenate(own), np.repeat(np.arange(len(own)), [len(e) for e in own])
    pieces, _, *both = sides(edges, np.zeros(len(edges), np.int64), region)
    left, right = (rule(np.pad(x, ((0, 0), (0, len(own) - x.shape[1]))).T) for x in both)
    return _linked(np.concatenate([pieces[left & ~right], pieces[right & ~left][:, ::-1]]))


def areas(x: np.ndarray, z: np.ndarray, ring: np.ndarray, place: np.ndarray, first: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Area of all rings of each place together, and of what its first region (first, by corner) leaves of it; each ring is a region.

    Corners are in order of place and ring; a ring's number is its own in the whole. Areas need no rings of the boundary, only its edges.
    """
    corner = np.round(np.column_stack([x, z]) / SNAP) * SNAP
    start = np.flatnonzero(np.diff(ring, prepend=-1))
    size = np.diff(start, append=len(ring))
    after = np.arange(1, len(ring) + 1)
    after[start + size - 1] = start
    edges = np.stack([corner, corner[after]], axis=1)
    kept = (edges[:, 0] != edges[:, 1]).any(axis=1) & np.repeat(size > 2, size)
    edges, place, ring, first = edges[kept], place[kept], ring[kept], first[kept]
    if not len(edges):
        return np.zeros(places), np.zeros(places)
    # regions are numbered from 1 in each place, 0 is the first one
    new = np.diff(ring, prepend=ring[0]) != 0
    number = np.cumsum(new)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    region = np.where(first, 0, number - np.repeat(number[begin], np.diff(begin, append=len(place))) + 1)
    pieces, own, left, right = sides(edges, place, region)
    twice = _cross(pieces[:, 0], pieces[:, 1])
    told = []
    for covers in (lambda m: m.any(axis=1), lambda m: m[:, 1:].any(axis=1) & ~m[:, 0]):
        turn = covers(left).astype(int) - covers(right)
        told.append(np.bincount(own, turn * twice, places) / 2)
    return told[0], told[1]


def _linked(edges: np.ndarray) -> Rings:
    """Rings of directed edges; where several leave a corner the one furthest to the left, so that regions that touch in a corner stay apart."""
    name = lambda p: tuple(np.round(p / SNAP).astype(np.int64).tolist())
    leaving: dict[tuple, list[int]] = {}
    for i, e in enumerate(edges):
        leaving.setdefault(name(e[0]), []).append(i)
    used, out = np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        ring, i = [], first
        while not used[i]:
            used[i] = True
            ring.append(edges[i, 0])
            way = edges[i, 1] - edges[i, 0]
            ways = [(float(np.arctan2(_cross(way, d), way @ d)), j) for j in leaving.get(name(edges[i, 1]), ()) if not used[j] for d in (edges[j, 1] - edges[j, 0],)]
            if not ways:
                break
            i = max(ways)[1]
        if len(ring) > 2:
            out.append(_straightened(np.array(ring)))
    return [r for r in out if len(r) > 2]


def _straightened(ring: np.ndarray) -> np.ndarray:
    """Without corners on a straight line."""
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    return ring[np.abs(_cross(before, after)) > 1e-9 * np.linalg.norm(before, axis=1) * np.linalg.norm(after, axis=1)]


def area(rings: Rings) -> float:
    """Of rings as combined() gives them."""
    return sum(signed_area(r) for r in rings)


def union(regions: list[Rings]) -> Rings:
    return combined(regions, lambda x: x.any(axis=0))


def _meet(one: Rings, two: Rings) -> bool:
    a, b = (np.concatenate(r) for r in (one, two))
    return bool((a.min(axis=0) <= b.max(axis=0) + SNAP).all() and (b.min(axis=0) <= a.max(axis=0) + SNAP).all())


def difference(one: Rings, others: list[Rings]) -> Rings:
    others = [o for o in others if one and o and _meet(one, o)]
    if not others and len(one) == 1 and is_convex(list(map(tuple, one[0].tolist()))):
        return [one[0] if signed_area(one[0]) > 0 else one[0][::-1]]
    return combined([one, *others], lambda x: x[0] & ~x[1:].any(axis=0))


def intersection(regions: list[Rings]) -> Rings:
    return combined(regions, lambda x: x.all(axis=0))
