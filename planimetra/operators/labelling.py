"""Placement of labels in a plan without overlaps, the more important first."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.operators.shared import spread

#: A letter's width and a label's height by font size, the space beside the text, the least distance of two labels in m.
LETTER, HEIGHT, PADDING, MARGIN = 0.55, 1.4, 0.6, 0.02
#: Other places that a wall's label may take, each a STEP further from the wall than OFFSET.
ATTEMPTS, OFFSET, STEP = 3, 0.15, 0.15


def _spots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each label's own place and its other ones beside the middle of its wall (n, 1 + ATTEMPTS), and how many it has; walls shorter than 0.1 mm move theirs to the middle."""
    x, y, x1, y1, x2, y2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    walled = batch.column("walled").to_numpy(zero_copy_only=False)
    dx, dy = x2 - x1, y2 - y1
    size = np.hypot(dx, dy)
    far = OFFSET + np.arange(1, ATTEMPTS + 1) * STEP
    with np.errstate(divide="ignore", invalid="ignore"):
        aside = [np.where(size < 1e-4, 0.0, d / size)[:, None] * far for d in (-dy, dx)]
    px, py = (np.column_stack([own, ((p + q) / 2)[:, None] + off]) for own, p, q, off in ((x, x1, x2, aside[0]), (y, y1, y2, aside[1])))
    return px, py, np.where(walled, ATTEMPTS + 1, 1)


class _Shown:
    """Boxes of the labels that are shown in one place, by the cells of a grid that they touch."""

    def __init__(self, cell: float):
        self.cell, self.cells, self.n = cell, {}, 0

    def _touched(self, x: float, y: float, w: float, h: float) -> list[tuple[int, int]]:
        low = lambda c, r: math.floor((c - r - MARGIN) / self.cell)
        high = lambda c, r: math.floor((c + r + MARGIN) / self.cell) + 1
        return [(i, j) for i in range(low(x, w), high(x, w)) for j in range(low(y, h), high(y, h))]

    def take(self, x: float, y: float, w: float, h: float) -> bool:
        """Shows a label there if it is free: apart by a margin at least on either axis. A place that is not finite meets nothing."""
        touched = self._touched(x, y, w, h) if math.isfinite(x + y + w + h) else []
        for at in touched:
            for bx, by, bw, bh in self.cells.get(at, ()):
                if abs(x - bx) < w + bw + MARGIN and abs(y - by) < h + bh + MARGIN:
                    return False
        for at in touched:
            self.cells.setdefault(at, []).append((x, y, w, h))
        self.n += 1
        return True


def placed(labels: DataFrame, keys: list[str], most: int | None = None, cell: float = 1.0) -> DataFrame:
    """keys, label_id, visible, x, y: each label at its own place, or the first of its other places that no more important one covers; hidden if there is none.

    labels: keys, label_id, text, font, priority (the least first, then the least label_id), x, y and, for walls, x1, y1, x2, y2 (null for others). most: how many are shown at most
    in each place, the most important first. A label without a text, font, priority or place is hidden, and a hidden label keeps its own place. Labels come to a task sorted by place
    and importance, so one pass decides them all; a task holds the boxes shown in its current place and nothing else.
    """
    known = lambda *names: functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    kinds = dict(labels.dtypes)
    named = [*keys, "label_id"]
    width, height = F.col("font") * LETTER * F.length("text") + F.col("font") * PADDING, F.col("font") * HEIGHT
    row = labels.select(
        *named, "priority", known("text", "font", "priority", "x", "y").alias("sound"), known("x1", "y1", "x2", "y2").alias("walled"),
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "x1", "y1", "x2", "y2")], (width / 2).cast("double").alias("hw"), (height / 2).cast("double").alias("hh"),
    )

    def run(batches):
        place, shown = None, _Shown(cell)
        for batch in batches:
            px, py, tries = _spots(batch)
            visible, at = np.zeros(len(px), bool), np.zeros(len(px), np.int64)
            columns = (batch.column(c).to_pylist() for c in ("sound", "hw", "hh"))
            for i, (own, sound, w, h) in enumerate(zip(zip(*[batch.column(k).to_pylist() for k in keys]), *columns)):
                if own != place:
                    place, shown = own, _Shown(cell)
                if not sound or (most is not None and shown.n >= most):
                    continue
                for k in range(tries[i]):
                    if shown.take(float(px[i, k]), float(py[i, k]), w, h):
                        visible[i], at[i] = True, k
                        break
            number = np.arange(len(px))
            told = [pa.array(p[number, at], mask=~(visible | batch.column(c).is_valid().to_numpy(zero_copy_only=False))) for p, c in ((px, "x"), (py, "y"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], pa.array(visible), *told], names=[*named, "visible", "x", "y"])

    sorted_ = spread(row, keys).sortWithinPartitions(*keys, "priority", "label_id")
    return sorted_.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in named], "visible boolean, x double, y double"]))
