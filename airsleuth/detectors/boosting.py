"""Histogram boosting of binary outputs on all rows, in one Spark job of tasks that work side by side.

Features are cut into bins at quantiles of all rows. Rows that are equal in all bins and outputs become one with their
count. They are dealt to tasks, which keep them and their margins in files mapped to memory. A level of the trees of all
outputs is grown at once: each task adds up gradients by node, feature and bin of its rows, each task sums up some
features of all tasks and finds their best cuts, and the best of all features is every task's next step. So each row
counts in every cut and every leaf, no row is moved or binned twice, and what a task holds in memory besides the mapped
files is bounded by parameters.
"""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.detectors.runs import COUNT, fewest_copies, for_each_run, run_lengths, run_starts
from airsleuth.schema import FEATURES
from airsleuth.session import cut_lineage, scratch_path

#: Different rows that a task grows trees on alone; with more of them other tasks take their share.
FIT_ROWS = 20_000
#: Bins of a feature; codes fit a byte.
BINS = 64
#: Rows that are worked on at once.
STEP_ROWS = 1 << 15
#: Seconds between looks for what other tasks have written.
PAUSE = 0.001
# --- fixed values: defaults of the usual histogram boosting --------------------------
ROUNDS, DEPTH, RATE, RIDGE, MIN_HESSIAN = 200, 6, 0.3, 1.0, 1.0
#: A cut that sends all rows left.
NO_CUT = 255
#: The code of an output that does not learn from a row.
NOT_OF = 2
#: Shares of a gain by which it is taken for another.
EQUAL = 1e-10


def bin_edges(rows: DataFrame, columns: Sequence[str] = FEATURES, bins: int = BINS) -> list[list[float]]:
    """Ascending values between the bins of each column, from one aggregate over all rows."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, 20 * bins) for c in columns]).first()
    return [sorted(set(edges or [])) for edges in found]


def codes_of(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin numbers, one row for each feature: the number of edges below the value."""
    return np.stack([np.searchsorted(e, v, "left").astype("u1") for e, v in zip(edges, values.T)])


def leaves_of(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches in a complete tree; inner nodes stand level by level."""
    node, every = np.zeros(codes.shape[1], "i4"), np.arange(codes.shape[1])
    for _ in range(int(np.log2(len(feature) + 1))):
        node = 2 * node + 1 + (codes[feature[node], every] > cut[node])
    return node - len(feature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def histograms(codes: np.ndarray, at: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cells: int) -> np.ndarray:
    """Sums of gradients and Hessians by feature and cell; a row's cell is its ``at`` and its code. Features x 2 x cells."""
    out, place = np.empty((len(codes), 2, cells)), np.empty(len(at), "i8")
    for sums, c in zip(out, codes):
        np.add(at, c, out=place)
        sums[0], sums[1] = np.bincount(place, gradient, cells), np.bincount(place, hessian, cells)
    return out


def best_cuts(sums: np.ndarray) -> np.ndarray:
    """Gain, feature, cut, and gradient and Hessian left of it and of all rows, one column for each node.

    ``sums`` holds gradients and Hessians: features x 2 x nodes x bins. Gains that differ by rounding are equal, and of
    equal ones the first counts, so that the order in which rows were added up decides nothing. Without gain: ``NO_CUT``.
    """
    left = sums.cumsum(axis=3)
    g, h = left[:, 0], left[:, 1]
    all_g, all_h = g[..., -1:], h[..., -1:]
    gain = g ** 2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
    gain[(h < MIN_HESSIAN) | (all_h - h < MIN_HESSIAN)] = 0
    nodes, bins = gain.shape[1:]
    flat, every = gain.transpose(1, 0, 2).reshape(nodes, -1), np.arange(nodes)
    best = (flat >= flat.max(axis=1, keepdims=True) * (1 - EQUAL)).argmax(axis=1)
    feature, cut = best // bins, best % bins
    whole = sums[0].sum(axis=2)
    good = flat[every, best] > 1e-9
    there = np.where(good, np.stack([g[feature, every, cut], h[feature, every, cut]]), whole)
    return np.stack([np.where(good, flat[every, best], 0), np.where(good, feature, 0), np.where(good, cut, NO_CUT), *there, *whole])


def first_best(found: np.ndarray) -> np.ndarray:
    """Of what ``best_cuts`` found in each part of the features (parts x 7 x nodes) the first of the best."""
    gain = found[:, 0]
    part = (gain >= gain.max(axis=0) * (1 - EQUAL)).argmax(axis=0)
    return found[part, :, np.arange(found.shape[2])].T


def grow_tree(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of the inner nodes. A node is cut where the gain is largest, if there is any."""
    feature, cut = np.zeros(2 ** depth - 1, "i4"), np.full(2 ** depth - 1, NO_CUT, "i4")
    node, every = np.zeros(codes.shape[1], "i4"), np.arange(codes.shape[1])
    for level in range(depth):
        nodes = 2 ** level
        sums = histograms(codes, node * bins, gradient, hessian, nodes * bins)
        first = nodes - 1
        feature[first:first + nodes], cut[first:first + nodes] = best_cuts(sums.reshape(len(codes), 2, nodes, bins))[1:3]
        node = 2 * node + (codes[feature[first + node], every] > cut[first + node])
    return feature, cut


def leaf_values(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    return -RATE * gradient / (hessian + RIDGE)


class Boosted:
    """Trees of several outputs: features, cuts and leaf values by output and round."""

    def __init__(self, names: list[str], edges: list[list[float]], feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.names, self.edges, self.feature, self.cut, self.leaf = names, edges, feature, cut, leaf

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """One row for each row of features, one column for each output."""
        codes = codes_of(values, self.edges)
        margins = [sum(leaf[leaves_of(codes, f, c)] for f, c, leaf in zip(*trees)) for trees in zip(self.feature, self.cut, self.leaf)]
        return _sigmoid(np.stack(margins, axis=1)) if len(values) else np.zeros((0, len(self.names)))

    def column(self) -> Column:
        """The outputs' probabilities as an array, computed once for each row."""
        model = self

        @F.pandas_udf("array<double>")
        def boosted(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(for_each_run(rows.to_numpy(dtype=float), model.probabilities)))

        return boosted.asNondeterministic()(F.struct(*FEATURES))

    def state(self) -> dict[str, Any]:
        return {"names": self.names, "edges": self.edges} | {n: getattr(self, n).tolist() for n in ("feature", "cut", "leaf")}

    @classmethod
    def of(cls, state: dict[str, Any]) -> Boosted:
        return cls(state["names"], state["edges"], np.array(state["feature"], "i4"), np.array(state["cut"], "i4"), np.array(state["leaf"], "f8"))


class Tasks:
    """What tasks of one stage tell each other, by files in a folder that all of them reach.

    Every task writes one message a step and goes on once it has seen those of all others; so when it has, all have read
    the step before, and a task deletes its own message of that step.
    """

    def __init__(self, folder: str, number: int, tasks: int, stage: str) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.base, self.number, self.tasks, self.step = f"{base}/{stage}", number, tasks, 0
        self.fs.create_dir(self.base)

    def _path(self, task: int, step: int) -> str:
        return f"{self.base}/{step}-{task}"

    def tell(self, message: bytes) -> list[str]:
        """Where the messages of all tasks lie, in the order of tasks."""
        self.step += 1
        mine = self._path(self.number, self.step)
        with self.fs.open_output_stream(f"{mine}.part") as out:
            out.write(message)
        self.fs.move(f"{mine}.part", mine)
        paths = [self._path(t, self.step) for t in range(self.tasks)]
        missing = paths
        while missing := [i.path for i in self.fs.get_file_info(missing) if i.type == pafs.FileType.NotFound]:
            time.sleep(PAUSE)
        if self.step > 1:
            self.fs.delete_file(self._path(self.number, self.step - 1))
        return paths

    def read(self, path: str, begin: int = 0, size: int | None = None) -> bytes:
        with self.fs.open_input_file(path) as file:
            return file.read_at(file.size() if size is None else size, begin)

    def told(self, values: np.ndarray) -> np.ndarray:
        """The arrays of all tasks that have any, one after the other."""
        found = [self.read(p) for p in self.tell(values.tobytes())]
        return np.stack([np.frombuffer(f, values.dtype).reshape(values.shape[-2:]) for f in found if f])


def _local_file():
    """A file among the task's local ones, which is gone once nothing holds it."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _mapped(shape: tuple[int, ...], kind: str, file=None) -> np.ndarray:
    """An array in a file: what the file holds, or zeros in one of its own."""
    if not np.prod(shape):
        return np.zeros(shape, kind)
    with file or _local_file() as held:
        return np.asarray(np.memmap(held, kind, "r+" if file else "w+", shape=shape))


def _spooled(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bytes and their counts, mapped; one batch at a time is held."""
    rows, counts, size = _local_file(), _local_file(), 0
    for batch in batches:
        lines = batch.column(0).cast(pa.binary(width))
        rows.write(lines.buffers()[1][lines.offset * width:(lines.offset + len(lines)) * width] if len(lines) else b"")
        counts.write(batch.column(1).to_numpy().tobytes())
        size += len(lines)
    rows.flush(), counts.flush()
    return _mapped((size, width), "u1", rows), _mapped((size,), "i8", counts)


class Grower:
    """A task's rows in blocks of ``STEP_ROWS``: codes by feature, targets and margins by output, and counts."""

    def __init__(self, lines: np.ndarray, counts: np.ndarray, outputs: int, depth: int) -> None:
        """A line has a row's codes and then its targets."""
        size, features = len(lines), lines.shape[1] - outputs
        self.outputs, self.depth, self.counts = outputs, depth, counts
        self.blocks = [slice(i, min(i + STEP_ROWS, size)) for i in range(0, size, STEP_ROWS)]
        self.codes = _mapped((features, size), "u1")
        self.targets = _mapped((outputs, size), "u1")
        self.margin, self.node = _mapped((outputs, size), "f8"), _mapped((outputs, size), "u1" if depth <= 8 else "u4")
        for b in self.blocks:
            self.codes[:, b], self.targets[:, b] = lines[b, :features].T, lines[b, features:].T

    def nodes_rows(self, nodes: int) -> np.ndarray:
        """Rows that each output learns from, by node."""
        out = np.zeros((self.outputs, nodes))
        for k in range(self.outputs):
            for b in self.blocks:
                out[k] += np.bincount(self.node[k, b][self.targets[k, b] != NOT_OF], minlength=nodes)
        return out

    def sums(self, counted: np.ndarray, bins: int) -> np.ndarray:
        """Gradients and Hessians of the ``counted`` nodes (outputs x nodes; as many of each output):
        features x 2 x outputs x nodes x bins."""
        cells = int(counted[0].sum()) * bins
        out = np.zeros((len(self.codes), 2, self.outputs, cells))
        for k, of in enumerate(counted):
            begin = (np.cumsum(of) - 1) * bins
            for b in self.blocks:
                node, y = self.node[k, b], self.targets[k, b]
                at = np.flatnonzero(of[node] & (y != NOT_OF))
                if not len(at):
                    continue
                p, n = _sigmoid(self.margin[k, b][at]), self.counts[b][at]
                codes = self.codes[:, b]
                out[:, :, k] += histograms(codes if len(at) == len(y) else codes.take(at, axis=1), begin[node[at]], n * (p - y[at]), n * p * (1 - p), cells)
        return out.reshape(len(self.codes), 2, self.outputs, -1, bins)

    def send_down(self, feature: np.ndarray, cut: np.ndarray) -> None:
        """Each row to its node one level below, by the cuts of this level (outputs x nodes)."""
        for k in range(self.outputs):
            for b in self.blocks:
                node = self.node[k, b].astype("i8")
                codes, every = self.codes[:, b], np.arange(len(node))
                self.node[k, b] = 2 * node + (codes[feature[k, node], every] > cut[k, node])

    def add(self, leaf: np.ndarray) -> None:
        """Margins after a tree, whose rows start at its root again."""
        for k in range(self.outputs):
            for b in self.blocks:
                self.margin[k, b] += leaf[k, self.node[k, b]]
                self.node[k, b] = 0

    def trees(self, rounds: int, tasks: Tasks | None = None, bins: int = BINS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features, cuts and leaf values of one tree of each output after the other; the same in all tasks.

        A level counts only the smaller of each two nodes; the other's sums are what is left of the node above.
        """
        width, outputs = len(self.codes), self.outputs
        parts = np.array_split(np.arange(width), min(width, tasks.tasks)) if tasks else [np.arange(width)]
        for _ in range(rounds):
            feature, cut = (np.zeros((outputs, 2 ** self.depth - 1), "i4") for _ in range(2))
            above = None
            for level in range(self.depth):
                nodes, first = 2 ** level, 2 ** level - 1
                counted = np.ones((outputs, 1), bool)
                if level:
                    rows = self.nodes_rows(nodes)
                    rows = (rows if tasks is None else tasks.told(rows).sum(axis=0)).reshape(outputs, -1, 2)
                    right = rows[..., 1] < rows[..., 0]
                    counted = np.stack([~right, right], axis=2).reshape(outputs, nodes)
                sums = self.sums(counted, bins)
                if tasks is not None:
                    sums = self._part(sums, parts, tasks)
                if level and len(sums):
                    whole = np.empty((len(sums), 2, outputs, nodes, bins))
                    whole[:, :, counted], whole[:, :, ~counted] = (x.reshape(len(sums), 2, -1, bins) for x in (sums, above - sums))
                    sums = whole
                above = sums
                found = np.zeros((0, 7, outputs * nodes))
                if len(sums):
                    found = best_cuts(sums.reshape(len(sums), 2, outputs * nodes, bins))[None]
                    found[0, 1] += parts[tasks.number if tasks else 0][0]
                if tasks is not None:
                    found = tasks.told(found)
                found = first_best(found).reshape(7, outputs, nodes)
                feature[:, first:first + nodes], cut[:, first:first + nodes] = found[1:3]
                self.send_down(feature[:, first:first + nodes], cut[:, first:first + nodes])
            left, whole = found[3:5], found[5:7]
            leaf = leaf_values(*np.stack([left, whole - left], axis=3).reshape(2, outputs, -1))
            self.add(leaf)
            yield feature, cut, leaf

    @staticmethod
    def _part(sums: np.ndarray, parts: list[np.ndarray], tasks: Tasks) -> np.ndarray:
        """The sums of all tasks for this task's part of the features; tasks beyond the features have none."""
        paths = tasks.tell(sums.tobytes())
        if tasks.number >= len(parts):
            return sums[:0]
        own, size = parts[tasks.number], sums[0].nbytes
        total = np.zeros((len(own), *sums.shape[1:]))
        for path in paths:
            total += np.frombuffer(tasks.read(path, int(own[0]) * size, len(own) * size)).reshape(total.shape)
        return total


def _coded(rows: DataFrame, edges: list[list[float]], outputs: int) -> DataFrame:
    """Different ``row``s of codes and targets (a byte each) and how many rows of a counted table are so (``n``)."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]).astype(float)
            targets = batch.column(len(FEATURES)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, outputs)
            counts = batch.column(len(FEATURES) + 1).to_numpy()
            starts = run_starts([*values.T, *np.nan_to_num(targets, nan=NOT_OF).T])
            found = np.vstack([codes_of(values[starts], edges), np.nan_to_num(targets[starts], nan=NOT_OF).T.astype("u1")])
            lines = np.ascontiguousarray(found.T)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in lines], pa.binary()), pa.array(np.add.reduceat(counts, np.flatnonzero(starts)), pa.int64())], names=["row", "n"])

    coded = rows.select(*FEATURES, "targets", COUNT).mapInArrow(code, "row binary, n long")
    return coded.groupBy("row").agg(F.sum("n").alias("n"))


def _slots(spark: SparkSession) -> int:
    """Tasks that run at the same time for sure."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _grown(coded: DataFrame, names: list[str], edges: list[list[float]], rounds: int, depth: int, fit_rows: int) -> Boosted:
    """Trees on all rows of a written table of codes, targets and counts."""
    spark, width, outputs = coded.sparkSession, len(FEATURES), len(names)
    tasks = max(1, min(_slots(spark), -(-coded.count() // fit_rows)))
    folder = scratch_path(spark, "trees")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grower = Grower(*_spooled(batches, width + outputs), outputs, depth)
        context = BarrierTaskContext.get() if tasks > 1 else None
        # A stage that is run again has messages of its own.
        others = None if context is None else Tasks(folder, context.partitionId(), tasks, context.allGather(str(context.taskAttemptId()))[0])
        for t, tree in enumerate(grower.trees(rounds, others)):
            if others is None or others.number == 0:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(
                    {"output": range(outputs), "tree": t, **{n: v.tolist() for n, v in zip(("feature", "cut", "leaf"), tree)}}), schema=schema, preserve_index=False)

    schema = pa.schema([("output", pa.int32()), ("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("cut", pa.list_(pa.int32())), ("leaf", pa.list_(pa.float64()))])
    # The sum of gradients depends on the order of rows, so it is fixed.
    dealt = coded.repartition(tasks, "row").sortWithinPartitions("row")
    trees = dealt.mapInArrow(grow, "output int, tree int, feature array<int>, cut array<int>, leaf array<double>", barrier=tasks > 1).toPandas()
    trees = trees.sort_values(["output", "tree"])
    shaped = {n: np.array(trees[n].tolist()).reshape(outputs, rounds, -1) for n in ("feature", "cut", "leaf")}
    return Boosted(names, edges, shaped["feature"].astype("i4"), shaped["cut"].astype("i4"), shaped["leaf"])


def _gradient_sums(rows: DataFrame, model: Boosted) -> DataFrame:
    """Gradient and Hessian sums by ``output``, ``tree`` and ``leaf`` over all rows, each at the margin that the trees before gave.

    Leaf values of any trees follow from them; trees that were grown here have theirs already, from the same sums.
    """
    schema = pa.schema([("output", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])
    outputs, rounds, leaves = model.leaf.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, outputs, rounds, leaves))
        for batch in batches:
            values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]).astype(float)
            targets = batch.column(len(FEATURES))
            targets = targets.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, outputs)
            # Rows that are equal to the one before are counted with it, in all outputs.
            starts = run_starts([*values.T, *np.nan_to_num(targets, nan=-1).T])
            counts, targets, codes = run_lengths(starts), targets[starts], codes_of(values[starts], model.edges)
            for k in range(outputs):
                mine = ~np.isnan(targets[:, k])
                own, y, n = codes[:, mine], targets[mine, k], counts[mine]
                margin = np.zeros(len(y))
                for t in range(rounds):
                    at, p = leaves_of(own, model.feature[k, t], model.cut[k, t]), _sigmoid(margin)
                    sums[0, k, t] += np.bincount(at, n * (p - y), leaves)
                    sums[1, k, t] += np.bincount(at, n * (p * (1 - p)), leaves)
                    margin += model.leaf[k, t][at]
        at = np.nonzero(sums[1])
        yield pa.RecordBatch.from_arrays([*(pa.array(i.astype("i4")) for i in at), *(pa.array(s[at]) for s in sums)], schema=schema)

    return rows.select(*FEATURES, "targets").mapInArrow(run, "output int, tree int, leaf int, g double, h double").groupBy(
        "output", "tree", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def fit_boosting(rows: DataFrame, targets: dict[str, Column], rounds: int = ROUNDS, depth: int = DEPTH, fit_rows: int = FIT_ROWS) -> Boosted:
    """Boosted trees for outputs of 1, 0, or null for rows that an output does not learn from.

    ``rows`` is a written table, counted or not, all of which is learned from; ``fit_rows`` is how many different rows one task grows trees on alone.
    """
    counted = rows if COUNT in rows.columns else rows.withColumn(COUNT, F.lit(1).cast("long"))
    marked = counted.withColumn("targets", F.array(*[t.cast("double") for t in targets.values()]))
    edges = bin_edges(fewest_copies(counted))
    return _grown(cut_lineage(_coded(marked, edges, len(targets))), list(targets), edges, rounds, depth, fit_rows)
