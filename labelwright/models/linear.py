"""Linear models fitted by passes over stored features, many models in each pass.

Rows are packed into blocks once: the sparse entries of up to ``BLOCK_ROWS`` rows in row
order, ``BLOCK_ENTRIES`` at most unless a single row has more. A pass sends the weights of
all models to the tasks, each of which adds losses and
gradients over its blocks, for the models that have not converged and have rows in a block;
the sums of tasks meet in a tree of ``FAN_IN`` branches, so the driver gets at most that
many. The folds of a cross-validation, the classes of a classifier and the variants of a
comparison differ only in which rows count and for what, so they share every pass. Blocks
are kept as an RDD, because a pass over one is a job without planning, and on the executors'
disks: in their memory they would fill the heap, where their pieces of 1 MB take two regions
each, and the system keeps files in what memory is left anyway. Steps are L-BFGS,
whose count falls with the steps remembered: what the driver holds is the models, bounded by
features x classes x models, and of each up to ``MEMORY`` steps within ``MEMORY_BYTES`` in all.

Losses, with C the inverse penalty:
- squared hinge, each class against the rest: |w|^2/2 + b^2/2 + C sum(max(0, 1 - y s)^2);
  of two classes each is the other with its sign turned, so one is fitted
- logistic: |w|^2/2 + C sum(log loss), intercept free; two classes have one weight vector
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, functions as F

from labelwright.session import spool

BLOCK_ROWS = 1024
BLOCK_ENTRIES = 1 << 17
#: Bytes of rows that a task hands to Python at once; Spark holds several times as much outside the heap meanwhile.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
FAN_IN = 32
TOLERANCE = 1e-8
#: Steps that L-BFGS remembers: as many as fit the bytes, between these.
LEAST_MEMORY, MEMORY = 30, 200
MEMORY_BYTES = 192 << 20
HINGE, LOGISTIC = "hinge", "logistic"

BLOCKS = "n int, starts binary, columns binary, weights binary, targets binary, members binary"


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of each block; ``lengths`` are the rows' entries."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        held = ends[start - 1] if start else 0
        fitting = int(np.searchsorted(ends, held + BLOCK_ENTRIES, "right")) - start
        rows = min(max(fitting, 1), BLOCK_ROWS, len(lengths) - start)
        yield start, rows
        start += rows


def _pack(batches: Iterator[pa.RecordBatch], n_models: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, n_rows in _cuts(batch.column("indices").value_lengths().to_numpy()):
            part = batch.slice(start, n_rows)
            columns, weights = part.column("indices"), part.column("values")
            starts = np.zeros(part.num_rows + 1, np.int64)
            np.cumsum(columns.value_lengths().to_numpy(), out=starts[1:])
            members = np.zeros((part.num_rows, n_models), bool)
            models = part.column("models")
            rows = np.repeat(np.arange(part.num_rows), models.value_lengths().to_numpy())
            members[rows, models.flatten().to_numpy()] = True
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([part.num_rows], pa.int32()),
                "starts": [starts.tobytes()],
                "columns": [columns.flatten().to_numpy().astype(np.int32).tobytes()],
                "weights": [weights.flatten().to_numpy().astype(np.float64).tobytes()],
                "targets": [part.column("target").to_numpy().astype(np.int32).tobytes()],
                "members": [members.tobytes()],
            })


def pack(rows: DataFrame, n_models: int) -> DataFrame:
    """Blocks of rows (features, target, models); models are the numbers of those that a row trains."""
    flat = rows.select("features.indices", "features.values", F.col("target").cast("int"), "models")
    conf = rows.sparkSession.conf
    given = conf.get(_BATCH_SETTING)
    conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        return spool(flat.mapInArrow(lambda batches: _pack(batches, n_models), BLOCKS), "blocks", wide=True)
    finally:
        conf.set(_BATCH_SETTING, given)


@dataclass(frozen=True)
class Shape:
    """What the columns of the weights mean; the last row of weights is the intercepts."""

    loss: str
    n_models: int
    n_classes: int
    n_features: int
    inverse_penalty: float

    @property
    def outputs(self) -> int:
        """Columns that are fitted for a model."""
        return 1 if self.n_classes == 2 else self.n_classes

    @property
    def problems(self) -> list[slice]:
        """Columns that are optimised together."""
        width = self.outputs if self.loss == LOGISTIC else 1
        return [slice(at, at + width) for at in range(0, self.n_models * self.outputs, width)]

    def model_of(self, problem: int) -> int:
        return problem if self.loss == LOGISTIC else problem // self.outputs

    def losses(
        self, problem: int, scores: np.ndarray, targets: np.ndarray, members: np.ndarray
    ) -> tuple[float, np.ndarray]:
        """(loss, derivative by score) of one problem, summed over, and at, the rows that count.

        Scores and derivatives have a row for each column of the problem.
        """
        counted = members * self.inverse_penalty
        if self.loss == HINGE:
            sign = np.where(targets == (1 if self.outputs == 1 else problem % self.outputs), 1.0, -1.0)
            short = np.maximum(0.0, 1.0 - sign * scores)
            return (counted * short * short).sum(), -2.0 * counted * sign * short
        if self.outputs == 1:
            hit = targets == 1
            value = np.logaddexp(0.0, scores) - hit * scores
            return (counted * value).sum(), counted * (_sigmoid(scores) - hit)
        shifted = scores - scores.max(axis=0)
        total = np.log(np.exp(shifted).sum(axis=0))
        hit = targets == np.arange(self.n_classes)[:, None]
        return (counted * ((total - shifted) * hit).sum(axis=0)).sum(), counted * (np.exp(shifted - total) - hit)

    def penalised(self, weights: np.ndarray, losses: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = weights.copy()
        if self.loss == LOGISTIC:
            held[-1] = 0.0
        squares = (held * held).sum(axis=0)
        return losses + [0.5 * squares[p].sum() for p in self.problems], gradient + held

    def every_class(self, weights: np.ndarray) -> np.ndarray:
        """A column for each class where the loss has one; see ``outputs``."""
        if self.loss == LOGISTIC or self.outputs == self.n_classes:
            return weights
        return np.stack([-weights, weights], axis=2).reshape(len(weights), -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _opened(block: Row) -> tuple[np.ndarray, ...]:
    """A block's arrays: row starts, columns, weights, targets, and members by model."""
    starts, columns, weights, targets = (
        np.frombuffer(block[name], kind)
        for name, kind in (("starts", np.int64), ("columns", np.int32), ("weights", np.float64), ("targets", np.int32))
    )
    return starts, columns, weights, targets, np.frombuffer(block.members, bool).reshape(block.n, -1).T.copy()


def _gradients(
    task: int, blocks: Iterator[tuple[np.ndarray, ...]], shape: Shape, weights: np.ndarray, live: Sequence[int]
) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    by_column = np.ascontiguousarray(weights.T)
    gradient, losses, problems = np.zeros_like(by_column), np.zeros(len(shape.problems)), shape.problems
    for starts, columns, values, targets, members in blocks:
        lengths = np.diff(starts)
        filled = np.flatnonzero(lengths)
        first, at = starts[filled], columns.astype(np.intp)
        for problem in live:
            counts = members[shape.model_of(problem)]
            if not counts.any():
                continue
            own = range(problems[problem].start, problems[problem].stop)
            scores = np.repeat(by_column[own, -1][:, None], len(targets), axis=1)
            if len(filled):
                for score, column in zip(scores, own):
                    score[filled] += np.add.reduceat(values * by_column[column].take(at), first)
            loss, slopes = shape.losses(problem, scores, targets, counts)
            losses[problem] += loss
            for slope, column in zip(slopes, own):
                gradient[column, -1] += slope.sum()
                gradient[column, :-1] += np.bincount(at, values * np.repeat(slope, lengths), shape.n_features)
    yield task, (losses, gradient)


def _added(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(a + b for a, b in zip(left, right))


def one_pass(
    blocks: RDD, shape: Shape, weights: np.ndarray, live: Sequence[int]
) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each problem, gradient) at ``weights``, without the penalty; zeros for problems not ``live``."""
    sent = blocks.context.broadcast(weights)
    sums = blocks.mapPartitionsWithIndex(lambda task, part: _gradients(task, part, shape, sent.value, live))
    tasks = blocks.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.map(lambda held: (held[0] // FAN_IN, held[1])).reduceByKey(_added, tasks, int)
    total = np.zeros(len(shape.problems)), np.zeros_like(weights.T)
    for _, part in sums.collect():
        total = _added(total, part)
    sent.destroy()
    return total[0], total[1].T


def _memory(shape: Shape) -> int:
    """Steps that each problem remembers; one takes two vectors of doubles."""
    step = 16 * (shape.n_features + 1) * shape.n_models * shape.outputs
    return min(MEMORY, max(LEAST_MEMORY, MEMORY_BYTES // step))


def _steps(point: np.ndarray, max_iter: int, tolerance: float, memory: int):
    """L-BFGS as a generator: yields points, is sent (value, gradient) there, returns the last one."""
    value, gradient = yield point
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= tolerance * max(1.0, np.linalg.norm(point)):
            break
        way = gradient.copy()
        shares = []
        for moved, turned in reversed(history):
            shares.append(moved @ way / (moved @ turned))
            way -= shares[-1] * turned
        if history:
            moved, turned = history[-1]
            way *= moved @ turned / (turned @ turned)
        for (moved, turned), share in zip(history, reversed(shares)):
            way += (share - turned @ way / (moved @ turned)) * moved
        slope = -(way @ gradient)
        step = 1.0 if history else min(1.0, 1.0 / np.linalg.norm(gradient))
        while True:
            new_value, new_gradient = yield point - step * way
            # At the rounding of the value, the slope decides.
            flat = abs(new_value - value) <= 1e-13 * max(1.0, abs(value)) and abs(new_gradient @ way) <= -0.9 * slope
            if new_value <= value + 1e-4 * step * slope or flat:
                break
            step /= 2.0
            if step < 1e-12:
                return point
        moved, turned = -step * way, new_gradient - gradient
        if moved @ turned > 1e-14 * np.linalg.norm(moved) * np.linalg.norm(turned):
            history = [*history[-(memory - 1):], (moved, turned)]
        point, value, gradient = point + moved, new_value, new_gradient
    return point


def fit(
    blocks: DataFrame, shape: Shape, max_iter: int, tolerance: float = TOLERANCE,
) -> tuple[np.ndarray, int]:
    """(weights, passes): columns by model and class (logistic of two classes: by model), the intercepts last.

    Every pass serves all models that have not converged.
    """
    weights = np.zeros((shape.n_features + 1, shape.n_models * shape.outputs))
    held = blocks.rdd.map(_opened).persist(StorageLevel.DISK_ONLY)
    running = [_steps(weights[:, p].flatten(), max_iter, tolerance, _memory(shape)) for p in shape.problems]
    asked = {number: next(steps) for number, steps in enumerate(running)}
    passes = 0
    while asked:
        for number, point in asked.items():
            weights[:, shape.problems[number]] = point.reshape(len(weights), -1)
        losses, gradient = shape.penalised(weights, *one_pass(held, shape, weights, list(asked)))
        passes += 1
        for number in list(asked):
            problem = shape.problems[number]
            try:
                asked[number] = running[number].send((losses[number], gradient[:, problem].ravel()))
            except StopIteration as end:
                weights[:, problem] = end.value.reshape(len(weights), -1)
                del asked[number]
    held.unpersist()
    return shape.every_class(weights), passes


# -- scores ------------------------------------------------------------------------------


def doubles(values: Sequence[float]) -> "F.Column":
    """An array of doubles as one constant, however long."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def score(features, weights: Sequence[float]):
    """The weighted sum of a (indices, values) column; ``weights`` has the intercept last."""
    held = doubles(weights)
    return F.aggregate(
        F.zip_with(features["indices"], features["values"], lambda at, value: value * F.get(held, at)),
        F.lit(float(weights[-1])), lambda total, part: total + part,
    )


def probabilities(features, weights: np.ndarray, n_classes: int):
    """Class probabilities as an array; ``weights`` are the columns of one logistic model."""
    if weights.shape[1] == 1:
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-score(features, weights[:, 0])))
        return F.transform(F.array(one), lambda p: F.array(F.lit(1.0) - p, p))[0]
    scores = F.array(*[score(features, weights[:, k]) for k in range(n_classes)])
    shifted = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(
        F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    )[0]


# -- the same as tables ------------------------------------------------------------------


def relational_scores(weighted: DataFrame, weights: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(id, class, score) from TF-IDF rows (id, term, weight) and a model's table (class, term, weight).

    The intercepts are the rows whose term is null. ``ids``: all documents, those without terms included.
    """
    intercepts = weights.where("term IS NULL").agg(
        F.collect_list(F.struct("class", F.col("weight").alias("_free")))
    ).scalar()
    parts = weighted.select(id_col, "term", F.col("weight").alias("_x")).join(
        F.broadcast(weights.where("term IS NOT NULL")), "term"
    ).groupBy(id_col, "class").agg(F.sum(F.col("_x") * F.col("weight")).alias("_sum"))
    # One row per document and class: the result itself.
    every = ids.select(id_col, intercepts.alias("_classes")).select(id_col, F.inline("_classes"))
    return every.join(parts, [id_col, "class"], "left").select(
        id_col, "class", (F.col("_free") + F.coalesce("_sum", F.lit(0.0))).alias("score")
    )


def best_class(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, prediction): the class with the largest score, the smaller class where two are equal."""
    first = F.max_by("class", F.struct("score", (-F.col("class")).alias("smaller")))
    return scores.groupBy(id_col).agg(first.alias("prediction"))


def hinge_certificate(
    weighted: DataFrame, labels: DataFrame, weights: DataFrame, id_col: str, label_col: str, inverse_penalty: float,
) -> DataFrame:
    """(class, gradient_norm) of the squared hinge objective at a model, from tables alone.

    At the only optimum the norm is 0; the weights lie within the norm of it, because the
    objective grows at least as half the squared distance.
    """
    scores = relational_scores(weighted, weights, labels, id_col).join(labels, id_col)
    sign = F.when(F.col(label_col) == F.col("class"), 1.0).otherwise(-1.0)
    slope = scores.select(
        id_col, "class", (-2.0 * inverse_penalty * sign * F.greatest(F.lit(0.0), 1.0 - sign * F.col("score"))).alias("_slope")
    )
    by_term = weighted.join(slope, id_col).groupBy("class", "term").agg(F.sum(F.col("weight") * F.col("_slope")).alias("_g"))
    free = slope.groupBy("class").agg(F.sum("_slope").alias("_g")).select("class", F.lit(None).cast("string").alias("term"), "_g")
    gradient = weights.alias("w").join(
        by_term.unionByName(free).alias("g"),
        (F.col("w.class") == F.col("g.class")) & F.col("w.term").eqNullSafe(F.col("g.term")), "left",
    ).select("w.class", (F.col("w.weight") + F.coalesce("_g", F.lit(0.0))).alias("_g"))
    return gradient.groupBy("class").agg(F.sqrt(F.sum(F.col("_g") * F.col("_g"))).alias("gradient_norm"))
