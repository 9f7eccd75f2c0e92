"""NumPy kernels for stacks of rigid motions: rotations (n, 3, 3) and places (n, 3)."""

from __future__ import annotations

import numpy as np


def hat(v: np.ndarray) -> np.ndarray:
    """Matrices of cross products with v (n, 3)."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def turned(w: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors (n, 3)."""
    angle = np.linalg.norm(w, axis=-1)[..., None, None]
    k = hat(w)
    safe = np.where(angle > 1e-8, angle, 1.0)
    a = np.where(angle > 1e-8, np.sin(safe) / safe, 1 - angle**2 / 6)
    b = np.where(angle > 1e-8, (1 - np.cos(safe)) / safe**2, 0.5 - angle**2 / 24)
    return np.eye(3) + a * k + b * (k @ k)


def turns(r: np.ndarray) -> np.ndarray:
    """Rotation vectors (n, 3) of rotations, up to half a turn."""
    # the quaternion's largest part first: exact near half a turn too
    t = np.trace(r, axis1=-2, axis2=-1)
    d = np.stack([t, r[..., 0, 0], r[..., 1, 1], r[..., 2, 2]], axis=-1)
    q = np.empty((*t.shape, 4))
    for k in range(4):
        own = np.argmax(d, axis=-1) == k
        m = r[own]
        if k == 0:
            v = np.stack([1 + t[own], m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=-1)
        else:
            i, j, l = k - 1, k % 3, (k + 1) % 3
            v = np.empty((len(m), 4))
            v[:, 0] = m[:, l, j] - m[:, j, l]
            v[:, 1 + i] = 1 + m[:, i, i] - m[:, j, j] - m[:, l, l]
            v[:, 1 + j] = m[:, j, i] + m[:, i, j]
            v[:, 1 + l] = m[:, l, i] + m[:, i, l]
        q[own] = v / np.linalg.norm(v, axis=-1, keepdims=True)
    q = np.where(q[..., :1] < 0, -q, q)
    sine = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(sine, q[..., :1])
    return q[..., 1:] * np.where(sine > 1e-12, angle / np.where(sine > 1e-12, sine, 1), 2.0)


def unturned_jacobian(w: np.ndarray) -> np.ndarray:
    """How the rotation vector w changes with a small turn on its right (n, 3, 3)."""
    angle = np.linalg.norm(w, axis=-1)[..., None, None]
    k = hat(w)
    safe = np.where(angle > 1e-4, angle, 1.0)
    c = np.where(angle > 1e-4, 1 / safe**2 - (1 + np.cos(safe)) / (2 * safe * np.sin(np.where(np.abs(np.sin(safe)) > 1e-9, safe, 1.0))), 1 / 12)
    return np.eye(3) + 0.5 * k + c * (k @ k)


def split(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and places of rows of 16."""
    m = np.asarray(matrices, float).reshape(-1, 4, 4)
    return m[:, :3, :3].copy(), m[:, :3, 3].copy()


def joined(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Rows of 16."""
    out = np.zeros((len(r), 4, 4))
    out[:, :3, :3], out[:, :3, 3], out[:, 3, 3] = r, t, 1
    return out.reshape(-1, 16)


def between(rj: np.ndarray, tj: np.ndarray, ri: np.ndarray, ti: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of the motions j times the motions i."""
    back = np.swapaxes(rj, -1, -2)
    return back @ ri, np.einsum("nij,nj->ni", back, ti - tj)
