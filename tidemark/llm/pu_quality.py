"""Quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

A logistic model of a text's inputs (:mod:`text_features`) minimises the non-negative
unbiased risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

over all positives and all unlabelled rows. With the logistic loss it is the larger of two
convex functions (the risk with the second term and that without it), so it is convex, with
a crease where the second term is zero: there the model stops explaining away the unlabelled
rows. The crease is rounded: the maximum is taken as SMOOTH * ln(1 + exp(term / SMOOTH)),
which is at most 0.7 * SMOOTH above it and still convex. A limited-memory quasi-Newton method
(L-BFGS) minimises that, on either side of the crease and along it, with a pass of Spark over
the saved inputs for each value and gradient; one pass before gives the inputs' covariance,
from which the first step and the measure of what is still to be gained come. The walk ends
when that is below ENOUGH. The driver holds weights and covariance alone. The class prior is
estimated as the share of good rows among the labelled ones that may be learned from. The
logistic loss is unbounded, so the risk of well parted rows is near zero along a whole crease and
says little on where a half lies; the bias is therefore set last, by the prior: that share of the
unlabelled rows (a percentile of their margins over all of them) is scored above a half.

Measurements enter as they are and as steps at quantiles of the corpus, which Spark
estimates over all rows; nothing is tuned to a corpus by hand. Labels, lang, source and
doc_id are never inputs.

A null text is an empty one and gets a score too. Repeated rows score alike, and count in
the fit as often as they occur. Rows whose doc_id is null count as neither labelled nor
learnable. Without any positive or unlabelled row every score is the prior (1/2 without
labels). An empty table gives no rows. Labels with several rows a document count as their
least value. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .text_features import AT_ONCE, MEASURED, SEQUENCES, WORDS, measure_array
from .tokens import pieces_of

#: Width of the rounded crease, what may still be gained of the risk when the walk ends, weight decay, steps remembered.
SMOOTH, ENOUGH, DECAY, MEMORY = 0.005, 1e-4, 1e-3, 12
#: Passes over the inputs at most, for a walk that rounding errors keep from ending.
PASSES = 200
#: Where measurements have steps.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.85, 0.9, 0.95, 0.98)
INPUTS = "doc_id long, measured array<float>, hashed binary"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, measured and hashed (a byte a bucket) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in pieces_of(batch.column(1), AT_ONCE):
                measured, hashed = measure_array(part)
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(MEASURED), pa.array(measured.astype(np.float32).ravel()))
                columns = [batch.column(0).slice(at, len(part)), lists, pa.array([row.tobytes() for row in hashed], pa.binary())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "measured", "hashed"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, INPUTS)


def fold(parts: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


class Model:
    """Steps of the measurements, and weights and bias over measurements, steps and hashed counts."""

    def __init__(self, steps: np.ndarray, weights: np.ndarray, bias: float):
        self.steps, self.weights, self.bias = steps, weights, bias
        #: How the fit ended; None where there was nothing to fit.
        self.walk: Walk | None = None

    def inputs(self, measured: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        over = (measured[:, :, None] > self.steps[None]).reshape(len(measured), -1)
        return np.hstack([measured, over, hashed / 255.0])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


WIDTH = len(MEASURED) * (1 + len(QUANTILES)) + SEQUENCES + WORDS


def _matrices(batches: Iterator[pa.RecordBatch], first: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of each batch with measured and hashed, the columns from first on, as matrices."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            measured = part.column(first).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURED)).astype(float)
            hashed = np.frombuffer(b"".join(part.column(first + 1).to_pylist()), np.uint8).reshape(-1, SEQUENCES + WORDS)
            yield part, measured, hashed


def summed(rows: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over rows (good, measured, hashed) of a vector of the given size; of(good, measured, hashed) gives it for some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part, measured, hashed in _matrices(batches, 1):
            total += of(part.column(0).to_numpy(zero_copy_only=False), measured, hashed)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    found = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # size rows
    out = np.zeros(size)
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return out


def outer(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of x'x over rows (good, measured, hashed), x = of(measured, hashed) with size columns and a last one of ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for _, measured, hashed in _matrices(batches, 1):
            x = np.hstack([of(measured, hashed), np.ones((len(measured), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array([row.tobytes() for row in total], pa.binary())], ["place", "held"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in group.column("held").to_pylist())
        return pa.table({"place": group.column("place")[:1], "held": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "place int, held binary").groupBy("place").applyInArrow(added, "place int, held binary").toArrow()  # a row a column
    out = np.zeros((size + 1, size + 1))
    for place, held in zip(found["place"].to_pylist(), found["held"].to_pylist(), strict=True):
        out[place] = np.frombuffer(held, float)
    return out


class Walk:
    """How a minimisation ended: at theta, after passes, with so much of the risk still to be gained, and whether that was enough."""

    def __init__(self, theta: np.ndarray, value: float, passes: int, gain: float):
        self.theta, self.value, self.passes, self.gain, self.converged = theta, value, passes, gain, gain <= ENOUGH


def descend(risk: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, curve: np.ndarray) -> Walk:
    """Minimises a smooth convex risk(theta) = (value, gradient) by L-BFGS; curve: a guess of its second derivatives."""
    root = np.linalg.cholesky(curve)

    def solved(x: np.ndarray) -> np.ndarray:
        return np.linalg.solve(root.T, np.linalg.solve(root, x))

    value, gradient = risk(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 1
    while True:
        step, kept = -gradient, []
        for s, y in reversed(moves):
            kept.append((s @ step) / (s @ y))
            step = step - kept[-1] * y
        scale = (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ solved(moves[-1][1])) if moves else 1.0
        step = scale * solved(step)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            step = step + s * (a - (y @ step) / (s @ y))
        gain = -(gradient @ step) / 2
        if gain <= ENOUGH or passes >= PASSES:
            return Walk(theta, value, passes, float(gain))
        length = 1.0
        while True:
            there = theta + length * step
            new, slope = risk(there)
            passes += 1
            if new <= value + 1e-4 * length * (gradient @ step) or passes >= PASSES:
                break
            # the least value of the parabola through what is known, within bounds
            length *= min(0.5, max(0.1, -(gradient @ step) * length / (2 * (new - value - length * (gradient @ step)))))
        if new > value:
            return Walk(theta, value, passes, float(gain))
        s, y = there - theta, slope - gradient
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-MEMORY:]
        theta, value, gradient = there, new, slope


def train(inputs: DataFrame, labels: DataFrame, learnable: Column, path: str) -> Model:
    """The model of those rows of inputs (from features(), saved) and labels whose doc_id is learnable."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(learnable & F.col("quality").isNotNull())
    counts = marks.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("good")).first()
    prior = counts.good / counts.n if counts.n else 0.5
    held = inputs.where(F.col("doc_id").isNotNull() & learnable).join(marks, "doc_id", "left")
    held = held.where("quality IS NULL OR quality = 1").select(F.col("quality").isNotNull().alias("good"), "measured", "hashed")
    held = saved(held, f"{path}/fitted")
    steps = held.agg(*[F.percentile_approx(F.col("measured")[k], list(QUANTILES), 1000).alias(f"q{k}") for k in range(len(MEASURED))]).first()
    if steps[0] is None or not 0 < prior < 1:
        return _constant(prior)
    model = Model(np.array(steps, float), np.zeros(WIDTH), 0.0)

    found = outer(held, model.inputs, WIDTH)
    n_good, n = held.where("good").count(), found[-1, -1]
    if not n_good or n_good == n:
        return _constant(prior)
    n_rest = n - n_good
    mean = found[-1, :-1] / n
    covariance = found[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    used = scale > 1e-6
    scale[~used] = 1.0
    curve = np.zeros((WIDTH + 1, WIDTH + 1))
    curve[:-1, :-1] = covariance * np.outer(used / scale, used / scale) / 4 + DECAY * np.eye(WIDTH)
    curve[-1, -1] = 0.25

    def risk(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, bias = theta[:-1] * used / scale, theta[-1]

        def terms(good: np.ndarray, measured: np.ndarray, hashed: np.ndarray) -> np.ndarray:
            x = model.inputs(measured, hashed)
            z = np.clip((x - mean) @ weights + bias, -40, 40)
            p = 1 / (1 + np.exp(-z))
            soft = np.logaddexp(0, z)  # the loss of a negative; a positive's is z less
            first = np.where(good, (p - 1) * prior / n_good, 0)
            second = np.where(good, -p * prior / n_good, p / n_rest)
            slopes = np.stack([first, second])
            onto = np.hstack([(slopes @ x - slopes.sum(axis=1, keepdims=True) * mean) * used / scale, slopes.sum(axis=1, keepdims=True)])
            return np.append(onto, [(soft - z)[good].sum() / n_good, soft[good].sum() / n_good, soft[~good].sum() / n_rest])

        sums = summed(held, 2 * (WIDTH + 1) + 3, terms)
        second = sums[-1] - prior * sums[-2]
        share = 1 / (1 + np.exp(-np.clip(second / SMOOTH, -700, 700)))
        decay = np.append(DECAY * theta[:-1], 0)
        value = prior * sums[-3] + SMOOTH * np.logaddexp(0, second / SMOOTH) + decay @ theta / 2
        return value, sums[: WIDTH + 1] + share * sums[WIDTH + 1 : 2 * WIDTH + 2] + decay

    start = np.zeros(WIDTH + 1)
    start[-1] = np.log(prior / (1 - prior))
    model.walk = descend(risk, start, curve)
    model.weights = model.walk.theta[:-1] * used / scale
    model.bias = float(model.walk.theta[-1] - mean @ model.weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, measured, hashed in _matrices(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(model.margin(model.inputs(measured, hashed)))], ["z"])

    # as many unlabelled rows as the prior says are scored above a half
    at = held.where("NOT good").mapInArrow(margins, "z double").agg(F.percentile_approx("z", 1 - prior, 10_000)).first()[0]
    model.bias -= float(at)
    return model


def _constant(prior: float) -> Model:
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(np.zeros((len(MEASURED), len(QUANTILES))), np.zeros(WIDTH), float(np.log(prior / (1 - prior))))


def score(inputs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, measured, hashed in _matrices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(model.inputs(measured, hashed)))], ["doc_id", "score"])

    return inputs.select("doc_id", "measured", "hashed").mapInArrow(run, "doc_id long, score double")
