"""The random forest on binned and counted rows, beside plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from airsleuth.detectors.boosting import NO_CUT, codes_of
from airsleuth.detectors.forest import Forest, best_cuts, bootstrap, drawn_features, fit_forest
from airsleuth.schema import FEATURES
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


def _gini(counts: np.ndarray) -> float:
    return 1 - ((counts / counts.sum()) ** 2).sum() if counts.sum() else 0.0


def test_best_cut_by_trying_all():
    sums = np.random.default_rng(1).integers(0, 9, (5, 3, 6, 2))
    sums[:, 1:] = 0
    sums[:, 1, 0] = sums[:, 0].sum(axis=1)  # a feature of one value
    sums[:, 2, [1, 4]] = np.stack([sums[:, 0, :2].sum(axis=1), sums[:, 0, 2:].sum(axis=1)], axis=1)
    sums[4] = 0
    sums[4, :, 3, 0] = 7  # one class only
    slot, cut, left, right = best_cuts(sums)
    for node in range(5):
        whole = sums[node, 0].sum(axis=0)
        gains = {}
        for s in range(3):
            for c in range(6):
                a = sums[node, s, :c + 1].sum(axis=0)
                b = whole - a
                if a.sum() and b.sum():
                    gains[s, c] = _gini(whole) - (a.sum() * _gini(a) + b.sum() * _gini(b)) / whole.sum()
        best = max(gains.values(), default=0)
        if best < 1e-12:
            assert cut[node] == NO_CUT and left[node].tolist() == whole.tolist()
        else:
            assert np.isclose(gains[slot[node], cut[node]], best)
            assert left[node].tolist() == sums[node, slot[node], :cut[node] + 1].sum(axis=0).tolist()
        assert (left[node] + right[node]).tolist() == whole.tolist()


def test_a_row_for_many_is_drawn_as_often_as_they_are():
    """Not all together: n copies are drawn Poisson(n) times, which varies by n and not by n squared."""
    for counts in (np.full(40_000, 5), np.r_[np.full(39_999, 5), 4]):
        times = bootstrap(counts, [1, 2, 3]).astype(float)
        assert abs(times.mean() - 5) < 0.1 and abs(times.var() - 5) < 0.3
        assert (times == bootstrap(counts, [1, 2, 3])).all()


def test_every_row_counts_in_each_tree(spark):
    """Leaves hold what the bootstrap drew of the rows that reach them, copies lie together or apart."""
    frame = separable_frame(30)
    copied = cut_lineage(spark.createDataFrame(frame).withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).coalesce(2))
    classes = sorted(frame["fault_type"].unique())
    forest = fit_forest(copied, classes, 7, numTrees=6, maxDepth=4)
    drawn = forest.leaf.sum(axis=(1, 2))
    assert (abs(drawn - 3 * len(frame)) < 6 * np.sqrt(3 * len(frame))).all() and len(set(drawn)) > 1
    values = frame[FEATURES].to_numpy(float)
    codes, got = codes_of(values, forest.edges), forest.probabilities(values)
    for row in range(0, len(frame), 17):
        shares = []
        for tree in range(6):
            node = 0
            for level in range(4):
                feature = forest.feature[tree][node]
                if forest.cut[tree][node] != NO_CUT:
                    place = node - 2 ** level + 1
                    assert feature in drawn_features(7, tree, level, len(FEATURES))[place]
                node = 2 * node + 1 + int(codes[feature, row] > forest.cut[tree][node])
            leaf = forest.leaf[tree][node - 15]
            shares.append(leaf / leaf.sum())
        assert np.allclose(got[row], np.mean(shares, axis=0))
    assert (np.array(classes)[got.argmax(axis=1)] == frame["fault_type"]).mean() > 0.9
    again = Forest.of(forest.state())
    assert (again.probabilities(values) == got).all()


def test_one_class(spark):
    frame = separable_frame(20)
    frame = frame[frame["fault_type"] == frame["fault_type"].iloc[0]]
    forest = fit_forest(cut_lineage(spark.createDataFrame(frame)), [frame["fault_type"].iloc[0]], 1, numTrees=3, maxDepth=3)
    assert (forest.cut == NO_CUT).all() and np.allclose(forest.probabilities(frame[FEATURES].to_numpy(float)), 1)
