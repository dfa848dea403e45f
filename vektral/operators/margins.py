"""Support vector machines and support vector descriptions by consensus dual coordinate ascent.

Both are dual problems of one form, for each class: the greatest sum of c_i a_i - q/2 |sum of a_i s_i x_i|^2
with 0 <= a_i <= C_i and sum of a_i s_i = m.  The machine of a class against all others has c = 1, q = 1,
s = 1 for its samples and -1 for the others, m = 0; a class's sphere has c = |x|^2, q = 2, s = 1, m = 1.  The
multiplier of the equality is the machine's bias, or the sphere's squared radius less its centre's square.

Samples are dealt into blocks of bounded size that stay with their executors.  In a round each block goes up
its own dual by coordinates, against the weights of all, and gives back what it would add to them; the driver
adds up the blocks' moves as far as the joint dual rises (an exact line search), and moves the multiplier.  What
travels is a block's dual values, to the block itself, and weights of classes x dimensions.  Blocks' moves are
summed by Spark before they reach the driver.  Dual values are a checkpoint a round, so a lost executor costs
its blocks' part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifiers import _mapped
from .graphs import cut


@dataclass
class Margins:
    """By class (in order): weights and multiplier; value of the primal and dual at the end, rounds taken."""

    classes: np.ndarray
    weights: np.ndarray
    multiplier: np.ndarray
    primal: np.ndarray
    dual: np.ndarray
    rounds: int


def _ascended(x: np.ndarray, sign: np.ndarray, linear: np.ndarray, cap: np.ndarray, q: float, alpha: np.ndarray, weights: np.ndarray, mass: np.ndarray, shift: np.ndarray, mu: np.ndarray, sigma: float, epochs: int, seed: list[int]) -> np.ndarray:
    """The dual values of a block after some passes over its coordinates in random orders; each row moves the
    values of all classes.  The move is taken sigma times, for the other blocks that move at the same time."""
    a, v, s = alpha.copy(), weights.copy(), mass.copy()
    steep = sigma * (q * (x * x).sum(1)[:, None] + mu)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            slope = linear[i] - q * sign[i] * (v @ x[i]) - sign[i] * (shift + mu * s)
            new = np.minimum(np.maximum(a[i] + slope / steep[i], 0), cap[i])
            move = sigma * (new - a[i]) * sign[i]
            if move.any():
                a[i] = new
                v += move[:, None] * x[i]
                s = s + move
    return a


def consensus_margins(ds: DataFrame, kind: str = "machine", c: float = 1.0, outside: float = 0.2, block_rows: int = 4096, epochs: int = 8, most_rounds: int = 60, tolerance: float = 1e-3, seed: int = 1) -> Margins:
    """Fits a machine for each class against all others, with hinge losses weighed by c, or (kind sphere) the
    sphere of each class that leaves at most the share outside of it outside.

    It ends when primal and dual values are within tolerance of each other, and the equality within tolerance of
    the mass.  Samples without a class, or whose vectors are null, empty or hold null or non-finite components,
    take no part; a class's samples that repeat count each; no samples give no classes."""
    whole = F.forall("feat", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("feat") > 0)
    ds = ds.filter(F.col("cls").isNotNull() & whole).select("sample_id", "cls", "feat")
    head = ds.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.aggregate("feat", F.lit(0.0), lambda t, v: t + v * v)).alias("s"), F.min(F.size("feat")).alias("lo"), F.max(F.size("feat")).alias("hi")).orderBy("cls").collect()  # a row a class
    if not head:
        none = np.zeros(0)
        return Margins(none.astype(int), np.zeros((0, 0)), none, none, none, 0)
    dims = head[0]["hi"]
    if any(r["lo"] != dims or r["hi"] != dims for r in head):
        raise ValueError("vectors of one length are needed")
    sphere = kind == "sphere"
    classes, count = np.array([r["cls"] for r in head]), np.array([r["n"] for r in head], float)
    total, k = int(count.sum()), len(head)
    n_blocks = max(1, -(-total // block_rows))
    q, aim = (2.0, 1.0) if sphere else (1.0, 0.0)
    limit = 1 / (outside * count) if sphere else np.full(k, float(c))
    square = sum(r["s"] for r in head) / total
    mu = np.full(k, max(q * square, 1e-12) * (0.1 if sphere else 0.01))

    def packed(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("sample_id", "ascending"), ("cls", "ascending")])
        x = np.asarray(part["feat"].combine_chunks().flatten(), float)
        y = np.asarray(part["cls"], np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "y": pa.array([y.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    dealt = ds.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(n_blocks)).cast("int"))
    blocks = dealt.groupBy("block").applyInArrow(packed, "block int, y binary, x binary")
    # the partitioning stays known, so that only dual values move when they meet their block
    blocks = blocks.repartition(min(n_blocks, 4 * ds.sparkSession.sparkContext.defaultParallelism), "block").persist(StorageLevel.DISK_ONLY)

    def round_of(model: dict, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"]).reshape(-1, dims)
                    own = np.frombuffer(row["y"], np.int64)[:, None] == classes
                    sign = np.ones((len(x), k)) if sphere else np.where(own, 1.0, -1.0)
                    linear = (x * x).sum(1)[:, None] if sphere else np.ones((len(x), 1))
                    cap = np.where(own, limit, 0.0) if sphere else np.tile(limit, (len(x), 1))
                    if row["alpha"] is None:
                        alpha = np.zeros((len(x), k))
                    else:
                        alpha = np.frombuffer(row["alpha"]).reshape(-1, k) + model["taken"] * np.frombuffer(row["move"]).reshape(-1, k)
                    loss = (cap * np.maximum(0, linear - q * sign * (x @ model["weights"].T) - sign * model["bias"])).sum(0)
                    move = np.zeros_like(alpha)
                    if not last:
                        move = _ascended(x, sign, linear, cap, q, alpha, model["weights"], model["mass"], model["shift"], mu, model["sigma"], epochs, [seed, model["round"], row["block"]]) - alpha
                    signed = move * sign
                    sums = np.concatenate([loss, (move * linear).sum(0), signed.sum(0), (signed.T @ x).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([alpha.tobytes()], pa.binary()), pa.array([move.tobytes()], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["block", "alpha", "move", "sums"])

        return run

    weights, mass, height, beta, taken = np.zeros((k, dims)), np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k)
    state = None
    try:
        for r in range(most_rounds + 1):
            shift = beta - mu * aim
            bias = shift + mu * mass
            model = {"weights": weights, "mass": mass, "shift": shift, "bias": bias, "taken": taken, "round": r, "sigma": float(n_blocks)}
            here = blocks.join(state.select("block", "alpha", "move"), "block") if state is not None else blocks.withColumns({c: F.lit(None).cast("binary") for c in ("alpha", "move")})
            state = cut(here.select("block", "y", "x", "alpha", "move").mapInArrow(round_of(model, r == most_rounds), "block int, alpha binary, move binary, sums array<double>"))
            rows = state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
            got = np.array([v for _, v in sorted((x["i"], x["v"]) for x in rows)])
            loss, rise, turn, step = got[:k], got[k : 2 * k], got[2 * k : 3 * k], got[3 * k :].reshape(k, dims)
            primal = q / 2 * (weights**2).sum(1) + aim * bias + loss
            dual = height - q / 2 * (weights**2).sum(1)
            scale = np.maximum(np.abs(primal), 1e-12)
            if r == most_rounds or (r and (np.abs(primal - dual) <= tolerance * scale).all() and (np.abs(mass - aim) <= tolerance * (1.0 if sphere else limit * count)).all()):
                return Margins(classes, weights, bias, primal, dual, r)
            slope = rise - q * (weights * step).sum(1) - bias * turn
            bend = q * (step**2).sum(1) + mu * turn**2
            taken = np.clip(slope / np.maximum(bend, 1e-300), 0, 1)
            weights, mass, height = weights + taken[:, None] * step, mass + taken * turn, height + taken * rise
            beta = beta + mu * (mass - aim)
    finally:
        blocks.unpersist()
    raise AssertionError("the last round returns")


def machine_values(fit: Margins, x: np.ndarray) -> np.ndarray:
    """Each class's value of each vector: above 0 on its own side."""
    return x @ fit.weights.T + fit.multiplier


def machine_recognition(train: DataFrame, probes: DataFrame, **kw) -> DataFrame:
    """(sample_id, cls, predicted): the class of greatest value, ties to the smaller."""
    fit = consensus_margins(train, "machine", **kw)
    return _mapped(probes, lambda x: fit.classes[machine_values(fit, x).argmax(1)], fit.weights.size)


def spheres(fit: Margins) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of a fit of kind sphere."""
    return fit.weights, fit.multiplier + (fit.weights**2).sum(1)


def sphere_members(ds: DataFrame, fit: Margins) -> DataFrame:
    """(sample_id, cls, d2, r2): each sample's squared distance from its own class's centre, and that sphere's
    squared radius."""
    centre, radius = spheres(fit)
    rows = ds.sparkSession.createDataFrame([(int(c), a.tolist(), float(r)) for c, a, r in zip(fit.classes, centre, radius)], "cls int, centre array<double>, r2 double")
    away = F.aggregate(F.zip_with("feat", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return ds.join(F.broadcast(rows), "cls").select("sample_id", "cls", away.alias("d2"), "r2")  # a row a class


def sphere_recognition(train: DataFrame, probes: DataFrame, **kw) -> DataFrame:
    """(sample_id, cls, predicted): the class in whose sphere, measured by its radius, a probe lies deepest."""
    fit = consensus_margins(train, "sphere", **kw)
    centre, radius = spheres(fit)
    deep = lambda x: ((x * x).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ centre.T) / np.maximum(radius, 1e-12)
    return _mapped(probes, lambda x: fit.classes[deep(x).argmin(1)], centre.size)
