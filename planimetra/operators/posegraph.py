"""Pose graphs: keyframes with rotations, tied by odometry and loops, adjusted together and judged before use.

A trajectory is one group: its keyframes are few (one each half metre), and its memory grows with its edges, as the normal equations are never
written out. Trajectories are spread over tasks by the shuffle on their key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions import motions, vectors
from planimetra.operators.shared import spread

#: An uncertain loop weighs this much of a certain one.
UNCERTAIN_WEIGHT = 0.2
#: A solution is refused if loops fit worse by over RESIDUAL_SLACK m, or a node moves over LARGEST_SHIFT m; under LEAST_GAIN percent it is neutral.
RESIDUAL_SLACK, LARGEST_SHIFT, LEAST_GAIN = 0.01, 1.2, 5.0
#: Uncertain loops whose confidence falls below this after the first solution are taken out, and the rest is solved again.
PRUNED_BELOW = 0.25


#: Graphs of so many nodes at most are solved directly; larger ones by conjugate gradients, whose memory grows with the edges alone.
DIRECT = 200


def odometry(nodes: DataFrame, key: str, turn_weight: float = 100.0, shift_weight: float = 100.0) -> DataFrame:
    """Edges between consecutive nodes (key, node, matrix), from the first into the second's frame, with a diagonal information matrix of 36."""
    order = Window.partitionBy(key).orderBy("node")
    table = nodes.select(key, F.col("node").alias("source"), F.lead("node").over(order).alias("target"), "matrix", F.lead("matrix").over(order).alias("_next")).filter("target is not null")
    information = F.array(*[F.lit(0.0 if i % 7 else turn_weight if i < 21 else shift_weight) for i in range(36)])
    return table.select(key, "source", "target", vectors.relative_transform(F.col("_next"), F.col("matrix")).alias("matrix"), information.alias("information"), F.lit(False).alias("is_loop"), F.lit(False).alias("uncertain"))


def loops(registered: DataFrame) -> DataFrame:
    """Loop edges of judged registrations (key.., source, target, matrix, information, decision): rejected ones go, uncertain ones weigh less."""
    uncertain = F.col("decision") == "uncertain"
    weighed = F.transform("information", lambda x: x * F.when(uncertain, UNCERTAIN_WEIGHT).otherwise(1.0))
    return registered.filter(F.col("decision").isin("accepted", "uncertain")).withColumns({"information": weighed, "is_loop": F.lit(True), "uncertain": uncertain}).drop("decision")


@dataclass
class Graph:
    """One trajectory's graph; an edge's motion takes points of its source's frame into its target's."""

    source: np.ndarray
    target: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    information: np.ndarray
    uncertain: np.ndarray

    def errors(self, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each edge's error (turn, then shift), and how it changes with a small motion, on the right, of its source and of its target."""
        ri, ti = motions.between(r[self.target], t[self.target], r[self.source], t[self.source])
        re, te = motions.between(self.turn, self.shift, ri, ti)
        w = motions.turns(re)
        at_source = np.zeros((len(w), 6, 6))
        at_source[:, :3, :3], at_source[:, 3:, 3:] = motions.unturned_jacobian(w), re
        # a motion of the target is one of the source seen through the inverse of the way between them
        back = np.swapaxes(ri, -1, -2)
        across = np.zeros((len(w), 6, 6))
        across[:, :3, :3] = across[:, 3:, 3:] = back
        across[:, 3:, :3] = motions.hat(-np.einsum("nij,nj->ni", back, ti)) @ back
        return np.concatenate([w, te], axis=1), at_source, -at_source @ across

    def confidence(self, error: np.ndarray, reach: float) -> np.ndarray:
        """1 for certain edges; uncertain ones lose it as their weighted error passes what a shift of reach would cost."""
        cost = np.einsum("ni,nij,nj->n", error, self.information, error)
        scale = reach**2 * self.information[self.uncertain][:, 5, 5].mean() if self.uncertain.any() else 1.0
        return np.where(self.uncertain, (scale / (scale + cost)) ** 2 if scale > 0 else 0.0, 1.0)

    def without(self, gone: np.ndarray) -> Graph:
        return Graph(*(x[~gone] for x in (self.source, self.target, self.turn, self.shift, self.information, self.uncertain)))


def _solved(diagonal: np.ndarray, apply, right: np.ndarray, rounds: int, tolerance: float = 1e-10) -> np.ndarray:
    """Conjugate gradients with the inverse of each node's own block before them."""
    inverse = np.linalg.inv(diagonal)
    x, rest = np.zeros_like(right), right.copy()
    z = np.einsum("nij,nj->ni", inverse, rest)
    way, size = z.copy(), float((rest * z).sum())
    first = size
    for _ in range(rounds):
        if size <= tolerance**2 * first or size == 0.0:
            break
        image = apply(way)
        step = size / float((way * image).sum())
        x += step * way
        rest -= step * image
        z = np.einsum("nij,nj->ni", inverse, rest)
        size, before = float((rest * z).sum()), size
        way = z + (size / before) * way
    return x


def adjusted(graph: Graph, r: np.ndarray, t: np.ndarray, reach: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations and places that fit all edges best, the first node fixed, and each edge's confidence: damped Gauss-Newton steps on rigid motions."""
    n, s, e = len(r), graph.source, graph.target
    confidence, damping = np.ones(len(s)), 1e-4
    cost_of = lambda error, weight: float((weight * np.einsum("ni,nij,nj->n", error, graph.information, error)).sum())
    error, js, je = graph.errors(r, t)
    for _ in range(rounds):
        confidence = graph.confidence(error, reach)
        cost = cost_of(error, confidence)
        weighed = confidence[:, None, None] * graph.information
        ws, we = np.swapaxes(js, 1, 2) @ weighed, np.swapaxes(je, 1, 2) @ weighed
        gradient, diagonal = np.zeros((n, 6)), np.zeros((n, 6, 6))
        np.add.at(gradient, s, np.einsum("nij,nj->ni", ws, error))
        np.add.at(gradient, e, np.einsum("nij,nj->ni", we, error))
        np.add.at(diagonal, s, ws @ js)
        np.add.at(diagonal, e, we @ je)
        gradient[0] = 0
        if n <= DIRECT:
            whole = np.zeros((n, n, 6, 6))
            for i, wi in ((s, ws), (e, we)):
                for j, jj in ((s, js), (e, je)):
                    np.add.at(whole, (i, j), wi @ jj)
            square = whole.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n)[6:, 6:]
        while True:
            extra = damping * np.einsum("nii->ni", diagonal) + 1e-9
            blocks = diagonal + extra[:, :, None] * np.eye(6)

            def apply(v: np.ndarray, extra=extra) -> np.ndarray:
                change = np.einsum("nij,nj->ni", js, v[s]) + np.einsum("nij,nj->ni", je, v[e])
                out = extra * v
                np.add.at(out, s, np.einsum("nij,nj->ni", ws, change))
                np.add.at(out, e, np.einsum("nij,nj->ni", we, change))
                out[0] = 0
                return out

            if n <= DIRECT:
                step = np.zeros((n, 6))
                step[1:] = np.linalg.solve(square + np.diag(extra[1:].ravel()), -gradient[1:].ravel()).reshape(-1, 6)
            else:
                step = _solved(blocks, apply, -gradient, 6 * n)
            new_r, new_t = r @ motions.turned(step[:, :3]), t + np.einsum("nij,nj->ni", r, step[:, 3:])
            new_error, *jacobians = graph.errors(new_r, new_t)
            new_cost = cost_of(new_error, confidence)
            if new_cost <= cost or damping > 1e8:
                break
            damping *= 10
        done = new_cost > cost or np.abs(step).max(initial=0) < 1e-9 or cost - new_cost <= 1e-12 * cost
        if new_cost <= cost:
            r, t, error, (js, je) = new_r, new_t, new_error, jacobians
        damping = max(damping / 10, 1e-9)
        if done:
            break
    return r, t, graph.confidence(error, reach)


def _residual(r: np.ndarray, t: np.ndarray, source: np.ndarray, target: np.ndarray, shift: np.ndarray) -> float:
    """Mean distance between where loops put their source and where it is."""
    return float(np.linalg.norm(t[source] - t[target] - np.einsum("nij,nj->ni", r[target], shift), axis=1).mean()) if len(source) else 0.0


def optimised(nodes: DataFrame, edges: DataFrame, key: str, reach: float = 1.0) -> DataFrame:
    """nodes (key, node, matrix of 16, camera to world) adjusted to edges, with status, raw_residual, residual, gain_pct, largest_shift, reasons.

    edges: key, source, target, matrix, information (36; turn before shift), is_loop, uncertain. Status is 'improved', 'neutral' (too small a gain, or
    no loops: reason no_loop_closures_present) or 'rejected', with the old poses. Edges with a null part or of unknown nodes are left out;
    of nodes that repeat, the first counts. Loops pruned as untrue still count in both residuals.
    """
    fields = f"`{key}` {dict(nodes.dtypes)[key]}, node long, matrix array<double>, status string, raw_residual double, residual double, gain_pct double, largest_shift double, reasons array<string>"

    columns = [key, "node", "matrix", "status", "raw_residual", "residual", "gain_pct", "largest_shift", "reasons"]

    def run(k, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if own.empty:  # edges of no nodes
            return pd.DataFrame(columns=columns)
        own = own.drop_duplicates("node").sort_values("node").reset_index(drop=True)
        index = {n: i for i, n in enumerate(own["node"])}
        links = links[links["source"].isin(index) & links["target"].isin(index) & links["matrix"].notna() & links["information"].notna()].sort_values(["source", "target"])
        raw_r, raw_t = motions.split(np.array(own["matrix"].tolist(), float).reshape(-1, 16))
        loop = links["is_loop"].to_numpy(bool)
        turn, shift = motions.split(np.array(links["matrix"].tolist(), float).reshape(-1, 16))
        information = np.array(links["information"].tolist(), float).reshape(-1, 6, 6)
        graph = Graph(links["source"].map(index).to_numpy(int), links["target"].map(index).to_numpy(int), turn, shift, information, links["uncertain"].to_numpy(bool))
        tied = (graph.source[loop], graph.target[loop], shift[loop])
        r, t, reasons = raw_r, raw_t, []
        before = after = _residual(raw_r, raw_t, *tied)
        if not loop.any():
            status, reasons = "neutral", ["no_loop_closures_present"]
        else:
            r, t, confidence = adjusted(graph, raw_r, raw_t, reach)
            untrue = graph.uncertain & (confidence < PRUNED_BELOW)
            if untrue.any():
                r, t, _ = adjusted(graph.without(untrue), raw_r, raw_t, reach)
            after = _residual(r, t, *tied)
        largest = float(np.linalg.norm(t - raw_t, axis=1).max(initial=0))
        gain = (before - after) / before * 100 if before > 1e-4 else 0.0
        if loop.any():
            if not np.isfinite(after) or after > before + RESIDUAL_SLACK:
                reasons.append(f"residual_increased_from_{before:.3f}m_to_{after:.3f}m")
            if not largest <= LARGEST_SHIFT:
                reasons.append(f"excessive_node_displacement_{largest:.2f}m_above_{LARGEST_SHIFT}m")
            status = "rejected" if reasons else "improved" if gain >= LEAST_GAIN else "neutral"
            if reasons:
                r, t = raw_r, raw_t
        n = len(own)
        return pd.DataFrame({
            key: own[key], "node": own["node"], "matrix": list(motions.joined(r, t)), "status": [status] * n, "raw_residual": [before] * n, "residual": [after] * n,
            "gain_pct": [gain] * n, "largest_shift": [largest] * n, "reasons": [reasons] * n,
        })

    ready = edges.select(F.col(key).alias(key), "source", "target", "matrix", "information", F.coalesce("is_loop", F.lit(False)).alias("is_loop"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    own = nodes.filter("node is not null and matrix is not null").select(F.col(key).alias(key), F.col("node").cast("long").alias("node"), "matrix")
    return spread(own, [key]).groupBy(key).cogroup(spread(ready, [key]).groupBy(key)).applyInPandas(run, fields)


def corrected_poses(poses: DataFrame, keyframes: DataFrame, key: str) -> DataFrame:
    """poses (key, frame, ts_s, matrix) moved by the corrections of the keyframes around them, turned along the shorter arc and shifted in proportion to time.

    keyframes: key, ts_s, raw, matrix (before and after). Both neighbours come from one window over all rows in order of time; before the first and
    after the last keyframe its own correction holds. A trajectory with under two keyframes keeps its poses.
    """
    mark = keyframes.select(key, F.col("ts_s").cast("double").alias("ts_s"), F.struct(F.col("ts_s").cast("double").alias("at"), "raw", F.col("matrix").alias("new")).alias("_k"))
    both = poses.withColumn("_pose", F.struct(*poses.columns)).select(key, F.col("ts_s").cast("double").alias("ts_s"), "_pose").unionByName(mark, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("ts_s", F.col("_k").isNull())
    before = F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    n = F.count("_k").over(Window.partitionBy(key))
    table = both.withColumns({"_a": F.coalesce(before, after), "_b": F.coalesce(after, before), "_n": n}).filter("_pose is not null")

    def moved(pose: pd.Series, old_a: pd.Series, new_a: pd.Series, old_b: pd.Series, new_b: pd.Series, share: pd.Series) -> pd.Series:
        rows = lambda x: motions.split(np.array(x.tolist(), float))

        def correction(old: pd.Series, new: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            (ro, to), (rn, tn) = rows(old), rows(new)
            r = rn @ np.swapaxes(ro, 1, 2)
            return r, tn - np.einsum("nij,nj->ni", r, to)

        if not len(pose):
            return pd.Series([], dtype=object)
        (ra, ta), (rb, tb), (r, t), s = correction(old_a, new_a), correction(old_b, new_b), rows(pose), share.to_numpy()[:, None]
        turn = ra @ motions.turned(s * motions.turns(np.swapaxes(ra, 1, 2) @ rb))
        return pd.Series(list(motions.joined(turn @ r, np.einsum("nij,nj->ni", turn, t) + (1 - s) * ta + s * tb)))

    span = F.col("_b.at") - F.col("_a.at")
    share = F.when(span > 0, (F.col("ts_s") - F.col("_a.at")) / span).otherwise(0.0)
    parts = ["_pose.matrix", "_a.raw", "_a.new", "_b.raw", "_b.new"]
    few = table.filter("_n < 2").select("_pose.*")
    many = table.filter("_n >= 2").select("_pose", F.pandas_udf(moved, "array<double>")(*[F.col(p) for p in parts], share).alias("_m"))
    return many.select(*[F.col("_m").alias(c) if c == "matrix" else F.col(f"_pose.{c}").alias(c) for c in poses.columns]).unionByName(few)
