"""NumPy kernels for grouped functions: hulls, clipping, planes. Each takes one small entity."""

from __future__ import annotations

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[list[float]] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def signed_area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clipped(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex one."""
    if signed_area(convex) < 0:
        convex = convex[::-1]
    out = list(subject)
    for a, b in zip(convex, np.roll(convex, -1, axis=0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: E731, B023
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append(p + (q - p) * (s / (s - t)))
        out = kept
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def triangles(polygon: np.ndarray) -> list[np.ndarray]:
    """Triangles that fill a simple polygon, by cutting ears."""
    p = polygon[::-1] if signed_area(polygon) < 0 else polygon
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    left, out = list(range(len(p))), []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = (p[left[(i + k) % len(left)]] for k in (-1, 0, 1))
            others = [p[j] for j in left if j not in (left[i - 1], left[i], left[(i + 1) % len(left)])]
            if turn(a, b, c) > 0 and not any(min(turn(a, b, q), turn(b, c, q), turn(c, a, q)) > 0 for q in others):
                out.append(np.array([a, b, c]))
                break
            if turn(a, b, c) == 0:
                break
        else:
            i = 0  # not simple: drop a corner
        del left[i]
    return [*out, p[left]]


def is_convex(p: list[tuple[float, float]]) -> bool:
    """Whether the corners turn one way only, and once around."""
    n, way, changes, last = len(p), 0, 0, 0
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = p[i - 2], p[i - 1], p[i]
        turn = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if turn * way < 0:
            return False
        way = way or turn
        step = (bx > ax) - (bx < ax)
        if step and last and step != last:
            changes += 1
        last = step or last
    return n >= 3 and changes <= 2


def convex_overlap(subject: list[tuple[float, float]], ring: list[tuple[float, float]]) -> float:
    """Common area of a polygon and a convex one, clipped edge by edge over plain floats: most pairs are rectangles."""
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) < 0:
        ring = ring[::-1]
    out = subject
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        dx, dy, kept = bx - ax, by - ay, []
        sides = [dx * (y - ay) - dy * (x - ax) for x, y in out]
        for k in range(len(out)):
            s, t = sides[k - 1], sides[k]
            if s * t < 0:
                (px, py), (qx, qy), r = out[k - 1], out[k], s / (s - t)
                kept.append((px + (qx - px) * r, py + (qy - py) * r))
            if t >= 0:
                kept.append(out[k])
        out = kept
        if not out:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2


def overlap(one: np.ndarray, two: np.ndarray) -> float:
    """Common area of two simple polygons of any shape."""
    a, b = (list(map(tuple, p.tolist())) for p in (one, two))
    for subject, ring in ((a, b), (b, a)):
        if is_convex(ring):
            return convex_overlap(subject, ring)
    return sum(abs(signed_area(clipped(a, b))) for a in triangles(one) for b in triangles(two))


def segment_gap(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    """Least distance of two segments."""
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    if cross(b - a, c - a) * cross(b - a, d - a) < 0 and cross(d - c, a - c) * cross(d - c, b - c) < 0:
        return 0.0

    def point(p, s, e):
        w = e - s
        n = float(w @ w)
        t = 0.0 if n < 1e-12 else min(1.0, max(0.0, float((p - s) @ w) / n))
        return float(np.linalg.norm(p - (s + t * w)))

    return min(point(a, c, d), point(b, c, d), point(c, a, b), point(d, a, b))


def polygon_gap(one: np.ndarray, two: np.ndarray) -> float:
    """0 if the polygons touch or overlap."""
    if inside(one[0], two) or inside(two[0], one):
        return 0.0
    return min(segment_gap(a, b, c, d) for a, b in zip(one, np.roll(one, -1, axis=0)) for c, d in zip(two, np.roll(two, -1, axis=0)))


def _edge_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ends of each edge of the first polygons (k, n, 2) beside each of the second ones (k, m, 2): a, b (k, n, 1, 2), c, d (k, 1, m, 2)."""
    return one[:, :, None], np.roll(one, -1, axis=1)[:, :, None], two[:, None], np.roll(two, -1, axis=1)[:, None]


def polygon_gaps(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """polygon_gap() of many pairs of polygons (k, n, 2) and (k, m, 2)."""
    a, b, c, d = _edge_pairs(one, two)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    meet = (cross(b - a, c - a) * cross(b - a, d - a) < 0) & (cross(d - c, a - c) * cross(d - c, b - c) < 0)

    def away(p, s, e):
        w = e - s
        n = (w * w).sum(axis=-1)
        t = np.where(n < 1e-12, 0.0, np.clip(((p - s) * w).sum(axis=-1) / np.where(n < 1e-12, 1.0, n), 0, 1))
        return np.linalg.norm(p - (s + t[..., None] * w), axis=-1)

    def within(point, polygon):
        s, e = polygon, np.roll(polygon, -1, axis=1)
        x, y = point[:, None, 0], point[:, None, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = s[..., 0] + (y - s[..., 1]) / (e[..., 1] - s[..., 1]) * (e[..., 0] - s[..., 0])
        return (((s[..., 1] > y) != (e[..., 1] > y)) & (x < at)).sum(axis=1) % 2 == 1

    least = np.minimum(np.minimum(away(a, c, d), away(b, c, d)), np.minimum(away(c, a, b), away(d, a, b)))
    gap = np.where(meet, 0.0, least).reshape(len(one), -1).min(axis=1)
    return np.where(within(one[:, 0], two) | within(two[:, 0], one), 0.0, gap)


def contact_lengths(one: np.ndarray, two: np.ndarray, reach: float = 0.24) -> np.ndarray:
    """Length along which the edges of many pairs of polygons (k, n, 2) and (k, m, 2) run side by side within reach."""
    s, e, u, v = _edge_pairs(one, two)
    size, other = np.linalg.norm(e - s, axis=-1), np.linalg.norm(v - u, axis=-1)
    long = (size >= 1e-9) & (other >= 1e-9)
    along, way = (e - s) / np.where(size < 1e-9, 1.0, size)[..., None], (v - u) / np.where(other < 1e-9, 1.0, other)[..., None]
    dot = lambda p, q: (p * q).sum(axis=-1)
    off = np.abs(along[..., 0] * (u - s)[..., 1] - along[..., 1] * (u - s)[..., 0])
    p, q = dot(u - s, along), dot(v - s, along)
    common = np.maximum(0.0, np.minimum(size, np.maximum(p, q)) - np.maximum(0.0, np.minimum(p, q)))
    return np.where(long & (np.abs(dot(along, way)) >= 0.98) & (off <= reach), common, 0.0).reshape(len(one), -1).sum(axis=1)


def inside(point: np.ndarray, polygon: np.ndarray) -> bool:
    x, y = point
    a, b = polygon, np.roll(polygon, -1, axis=0)
    crosses = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((crosses & (x < at)).sum() % 2)


def fitted_plane(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit normal and offset of the least-squares plane."""
    centre = points.mean(axis=0)
    normal = np.linalg.eigh((points - centre).T @ (points - centre))[1][:, 0]
    return normal, -float(normal @ centre)


def kabsch(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rigid 4x4 that takes source to target with the least squares."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((source - a).T @ (target - b))
    fix = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    out = np.eye(4)
    out[:3, :3] = vt.T @ fix @ u.T
    out[:3, 3] = b - out[:3, :3] @ a
    return out
