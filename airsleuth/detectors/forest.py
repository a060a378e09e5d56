"""Random forest on histograms, one Spark job for a level of all trees.

Features are cut into bins at quantiles of all rows. Equal rows that follow one another are kept once with their
count, as binned codes in blocks. Each level passes all blocks: a task draws the bootstrap of a tree (each row
counts Poisson(its count) times), sends its rows down, and adds up class counts by (node, drawn feature, bin). Counts are
summed and the best cuts found by groups of nodes; the driver gets a cut and class counts for each node. A task holds up to
``TASK_ROWS`` coded rows and the counts of one tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.detectors.boosting import NO_CUT, bin_edges, codes_of, leaves_of
from airsleuth.detectors.runs import COUNT, counted_runs, fewest_copies, for_each_run
from airsleuth.schema import FEATURES
from airsleuth.session import cut_lineage

#: Coded rows of a task: at most so many where there are many, at least so many where there are few.
TASK_ROWS, FEWEST_ROWS = 2_000_000, 20_000
#: Rows that a task passes down a tree at once.
STEP_ROWS = 1 << 15
#: Nodes whose counts are summed in one group.
NODES = 64
# --- fixed values: defaults of the usual random forest ----------------------------------
TREES, DEPTH, BINS = 200, 10, 32
_STEPS = 1 << 16


def drawn_features(seed: int, tree: int, level: int, width: int) -> np.ndarray:
    """The features that each node of a level may be cut by: the square root of their number."""
    draw = np.random.default_rng([seed, tree, level]).random((2 ** level, width))
    return draw.argsort(axis=1)[:, :int(np.ceil(np.sqrt(width)))]


def bootstrap(counts: np.ndarray, seed: list[int]) -> np.ndarray:
    """How often each row is drawn: a row that stands for n rows counts Poisson(n) times.

    Equal counts share a table of 65,536 steps of the distribution.
    """
    draw = np.random.default_rng(seed)
    if not len(counts) or counts[0] > 50 or (counts != counts[0]).any():
        return draw.poisson(counts)
    return _poisson_steps(int(counts[0]))[draw.integers(0, _STEPS, len(counts), "u2")]


@cache
def _poisson_steps(mean: int) -> np.ndarray:
    times = np.arange(1, 200)
    mass = np.exp(-mean + np.r_[0.0, times * np.log(mean) - np.cumsum(np.log(times))])
    return np.searchsorted(np.cumsum(mass), (np.arange(_STEPS) + 0.5) / _STEPS).astype("u1")


def best_cuts(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the drawn feature and bin of the largest Gini gain (``NO_CUT``: none), and class counts left and right.

    ``sums`` holds class counts by node, drawn feature, bin and class.
    """
    left = sums.astype("f8").cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def purity(counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=-1)
        return (counts ** 2).sum(axis=-1) / np.maximum(n, 1)

    rows = whole.sum(axis=-1)
    gain = (purity(left) + purity(right) - purity(whole)) / np.maximum(rows, 1)
    gain[(left.sum(axis=-1) < 1) | (right.sum(axis=-1) < 1)] = 0
    flat, every = gain.reshape(len(gain), -1), np.arange(len(gain))
    best = flat.argmax(axis=1)
    good, bins = flat[every, best] > 1e-12, sums.shape[2]
    slot, cut = best // bins, best % bins
    there = left[every, slot, cut]
    there = np.where(good[:, None], there, whole[:, 0, 0])
    return slot, np.where(good, cut, NO_CUT), there, whole[:, 0, 0] - there


def _packed(counted: DataFrame, edges: list[list[float]], classes: list[str]) -> DataFrame:
    """Blocks of rows: codes (a byte for each feature, row by row), places of labels, and counts."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                codes = codes_of(rows[FEATURES].to_numpy(dtype=float), edges)
                labels = pd.Categorical(rows["fault_type"], classes).codes.astype("u1")
                yield pd.DataFrame({"rows": [len(rows)], "codes": [np.ascontiguousarray(codes.T).tobytes()], "labels": [labels.tobytes()],
                                    "counts": [rows[COUNT].to_numpy("i8").tobytes()]})

    return counted.mapInPandas(pack, "rows long, codes binary, labels binary, counts binary")


class Forest:
    """Features, cuts and class counts of the leaves by tree; inner nodes of a complete tree stand level by level."""

    def __init__(self, edges: list[list[float]], feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.edges, self.feature, self.cut, self.leaf = edges, feature, cut, leaf

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Means over the trees of the class shares of a row's leaf."""
        codes, total = codes_of(values, self.edges), np.zeros((len(values), self.leaf.shape[2]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            shares = leaf / np.maximum(leaf.sum(axis=1, keepdims=True), 1)
            total += shares[leaves_of(codes, feature, cut)]
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    def column(self) -> Column:
        """The classes' probabilities as an array, computed once for each row."""
        model = self

        @F.pandas_udf("array<double>")
        def voted(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(for_each_run(rows.to_numpy(dtype=float), model.probabilities)))

        return voted.asNondeterministic()(F.struct(*FEATURES))

    def state(self) -> dict[str, Any]:
        return {"edges": self.edges} | {n: getattr(self, n).tolist() for n in ("feature", "cut", "leaf")}

    @classmethod
    def of(cls, state: dict[str, Any]) -> Forest:
        return cls(state["edges"], np.array(state["feature"], "i4"), np.array(state["cut"], "i4"), np.array(state["leaf"], "i8"))


def _level_counts(blocks: DataFrame, level: int, feature: np.ndarray, cut: np.ndarray, open_nodes: np.ndarray, classes: int,
                  bins: int, seed: int) -> DataFrame:
    """Class counts by (node, drawn feature, bin) of each tree's open nodes, from each task's rows; ``NODES`` nodes a row."""
    trees, width = len(feature), len(FEATURES)
    cell = bins * classes
    kind = "u1" if cell <= 256 else "u2"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        held = pd.concat(found, ignore_index=True).sort_values("block")
        labels = np.concatenate([np.frombuffer(b, "u1") for b in held["labels"]])
        codes = np.concatenate([np.frombuffer(b, "u1") for b in held["codes"]]).reshape(-1, width).astype(kind)
        codes = (codes * np.array(classes, kind) + labels[:, None].astype(kind)).ravel()
        counts, ids = [np.frombuffer(b, "i8") for b in held["counts"]], held["block"].tolist()
        del held, found
        for tree in range(trees):
            nodes = np.flatnonzero(open_nodes[tree])
            if not len(nodes):
                continue
            place = np.full(2 ** level, -1)
            place[nodes] = np.arange(len(nodes))
            drawn = np.ascontiguousarray(drawn_features(seed, tree, level, width).T)
            # A code holds bin and class, so that "above the cut" is "from the first class of the next bin".
            bound = np.where(cut[tree] == NO_CUT, cell, (cut[tree] + 1) * classes)
            times = np.concatenate([bootstrap(n, [seed, tree, block]) for n, block in zip(counts, ids)])
            sums = np.zeros((len(drawn), len(nodes) * cell))
            for begin in range(0, len(times), STEP_ROWS):
                at = np.flatnonzero(times[begin:begin + STEP_ROWS]) + begin
                base, node = at * width, np.zeros(len(at), "i8")
                for _ in range(level):
                    node = 2 * node + 1 + (codes.take(feature[tree].take(node) + base) >= bound.take(node))
                node -= 2 ** level - 1
                if len(nodes) < 2 ** level:
                    kept = np.flatnonzero(place.take(node) >= 0)
                    at, base, node = at.take(kept), base.take(kept), node.take(kept)
                mine, weight = place.take(node) * cell, times.take(at).astype("f8")
                for s, features in enumerate(drawn):
                    sums[s] += np.bincount(codes.take(features.take(node) + base) + mine, weight, sums.shape[1])
            sums = sums.reshape(len(drawn), len(nodes), cell).transpose(1, 0, 2)
            sums = sums.astype("i8" if sums.max(initial=0) >= 2 ** 32 else "u4").reshape(len(nodes), -1)
            for part in range(0, len(nodes), NODES):
                yield pd.DataFrame({"tree": [tree], "part": [part // NODES], "size": [sums.dtype.itemsize], "sums": [sums[part:part + NODES].tobytes()]})

    return blocks.mapInPandas(run, "tree int, part int, size int, sums binary")


def _best(partial: DataFrame, slots: int, bins: int, classes: int) -> pd.DataFrame:
    """The cuts of all open nodes of a level, collected: one row for each tree and group of nodes."""
    def choose(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for some in rows:
            for size, sums in zip(some["size"], some["sums"]):
                total = total + np.frombuffer(sums, "u4" if size == 4 else "i8").astype("i8")
        slot, cut, left, right = best_cuts(total.reshape(-1, slots, bins, classes))
        yield pd.DataFrame({"tree": [key[0]], "part": [key[1]], **{n: [v.astype("i8").tobytes()] for n, v in
                            (("slot", slot), ("cut", cut), ("left", left), ("right", right))}})

    return partial.groupBy("tree", "part").applyInPandas(
        choose, "tree int, part int, slot binary, cut binary, left binary, right binary").orderBy("tree", "part").toPandas()


def fit_forest(rows: DataFrame, classes: list[str], seed: int = 42, numTrees: int = TREES, maxDepth: int = DEPTH, maxBins: int = BINS) -> Forest:
    """``rows`` is a written table of FEATURES and ``fault_type``; every row counts in every tree as often as it is drawn."""
    counted = cut_lineage(counted_runs(rows, [*FEATURES, "fault_type"]))
    edges = bin_edges(fewest_copies(counted), bins=maxBins)
    blocks = cut_lineage(_packed(counted, edges, classes).withColumn("block", F.monotonically_increasing_id()))
    n = blocks.agg(F.sum("rows")).first()[0]
    spread = -(-n // rows.sparkSession.sparkContext.defaultParallelism)
    tasks = -(-n // min(TASK_ROWS, max(FEWEST_ROWS, spread)))
    # Blocks are dealt out, a batch of rows each, so that the tasks are of one size.
    blocks = blocks.repartition(tasks)
    kinds, inner = len(classes), 2 ** maxDepth - 1
    feature, cut = np.zeros((numTrees, inner), "i4"), np.full((numTrees, inner), NO_CUT, "i4")
    leaf = np.zeros((numTrees, inner + 1, kinds), "i8")
    open_nodes = np.ones((numTrees, 1), bool)
    for level in range(maxDepth):
        first, below = 2 ** level - 1, 2 ** (maxDepth - level - 1)
        reached = np.zeros((numTrees, 2 ** (level + 1)), bool)
        slots = drawn_features(seed, 0, 0, len(FEATURES)).shape[1]
        found = _best(_level_counts(blocks, level, feature, cut, open_nodes, kinds, maxBins, seed), slots, maxBins, kinds)
        for tree, parts in found.groupby("tree"):
            nodes = np.flatnonzero(open_nodes[tree])
            slot, at, left, right = (np.concatenate([np.frombuffer(b, "i8") for b in parts[c]]) for c in ("slot", "cut", "left", "right"))
            feature[tree, first + nodes] = drawn_features(seed, tree, level, len(FEATURES))[nodes, slot]
            cut[tree, first + nodes] = at
            sides = np.stack([left.reshape(-1, kinds), right.reshape(-1, kinds)], axis=1)
            # Leaves below a node: its first one stands for rows that are not cut further.
            leaf[tree, 2 * nodes * below] = sides[:, 0]
            leaf[tree, (2 * nodes + 1) * below] = sides[:, 1]
            for side in (0, 1):
                reached[tree, 2 * nodes + side] = (at != NO_CUT) & ((sides[:, side] > 0).sum(axis=1) > 1)
        open_nodes = reached
        if not open_nodes.any():
            break
    return Forest(edges, feature, cut, leaf)
