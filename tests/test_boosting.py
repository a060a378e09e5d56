"""Histogram boosting beside plain searches and sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsleuth.detectors.boosting import (
    BINS, MIN_HESSIAN, NO_CUT, RATE, RIDGE, Boosted, _gradient_sums, _sigmoid, bin_edges, codes_of, fit_boosting, grow_tree, leaves_of,
)
from airsleuth.schema import FEATURES
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(spark.createDataFrame(separable_frame()).repartition(5))


def _best_cut(codes, g, h, bins):
    """The largest gain of one node, feature by feature and cut by cut."""
    part = lambda mask: (g[mask].sum(), h[mask].sum())
    worth = lambda s: s[0] ** 2 / (s[1] + RIDGE)
    best = (1e-9, 0, NO_CUT)
    for f in range(len(codes)):
        for cut in range(bins):
            left, right = part(codes[f] <= cut), part(codes[f] > cut)
            if min(left[1], right[1]) >= MIN_HESSIAN and worth(left) + worth(right) - worth((g.sum(), h.sum())) > best[0] + 1e-9:
                best = (worth(left) + worth(right) - worth((g.sum(), h.sum())), f, cut)
    return best


def test_every_node_takes_the_best_cut():
    draw = np.random.default_rng(2)
    for n in (0, 3, 200):
        codes = draw.integers(0, 8, (5, n)).astype("u1")
        y = (codes[1] > 3) ^ (codes[2] > 4) if n else np.zeros(0, bool)
        g, h = draw.normal(0, 0.1, n) + np.where(y, -0.5, 0.5), np.full(n, 0.25)
        feature, cut = grow_tree(codes, g, h, 3, 8)
        at = np.zeros(n, int)
        for level in range(3):
            for node in range(2 ** level):
                here, place = at == node, 2 ** level - 1 + node
                gain, f, c = _best_cut(codes[:, here], g[here], h[here], 8)
                assert (feature[place], cut[place]) == (f, c), (n, level, node, gain)
            at = 2 * at + (codes[feature[2 ** level - 1 + at], np.arange(n)] > cut[2 ** level - 1 + at])
        assert leaves_of(codes, feature, cut).tolist() == at.tolist()


def test_codes_count_the_edges_below():
    edges = [[1.0, 2.0], [], [0.5]]
    values = np.array([[0.0, 5.0, 0.5], [1.0, 5.0, 0.6], [1.5, -1.0, -3.0], [9.0, 0.0, 0.0]])
    assert codes_of(values, edges).tolist() == [[0, 0, 1, 2], [0, 0, 0, 0], [0, 1, 0, 0]]


def test_gradient_sums_are_those_of_all_rows(rows):
    """Each tree's sums at the margins of the trees before it, row by row, for outputs of all rows and of some."""
    targets = F.array((F.col("fault_type") == "normal").cast("double"),
                      F.when(F.col("fault_type") != "normal", (F.col("fault_type") == "oa_bias").cast("double")))
    draw = np.random.default_rng(4)
    edges = bin_edges(rows, bins=8)
    model = Boosted(["a", "b"], edges, draw.integers(0, 31, (2, 4, 7)).astype("i4"), draw.integers(0, 8, (2, 4, 7)).astype("i4"), draw.normal(0, 1, (2, 4, 8)))
    got = {(r.output, r.tree, r.leaf): (r.g, r.h) for r in _gradient_sums(rows.withColumn("targets", targets), model).collect()}
    frame = rows.toPandas()
    expected = {}
    for _, row in frame.iterrows():
        codes = [sum(e < row[f] for e in edges[i]) for i, f in enumerate(FEATURES)]
        for k, y in enumerate((float(row.fault_type == "normal"), None if row.fault_type == "normal" else float(row.fault_type == "oa_bias"))):
            margin = 0.0
            for t in range(4 if y is not None else 0):
                node = 0
                while node < 7:
                    node = 2 * node + 1 + (codes[model.feature[k, t, node]] > model.cut[k, t, node])
                p = 1 / (1 + np.exp(-margin))
                g, h = expected.get((k, t, node - 7), (0, 0))
                expected[k, t, node - 7] = (g + p - y, h + p * (1 - p))
                margin += model.leaf[k, t, node - 7]
    assert got.keys() == expected.keys()
    for key, sums in expected.items():
        assert got[key] == pytest.approx(sums, abs=1e-9)


def test_leaf_values_come_from_all_rows_beyond_the_sample(rows):
    """Shapes grow on 60 of 600 rows; the first tree's leaves are the Newton steps of all 600."""
    model = fit_boosting(rows, {"normal": F.col("fault_type") == "normal"}, rounds=2, depth=3, fit_rows=60)
    frame = rows.toPandas()
    codes = codes_of(frame[FEATURES].to_numpy(float), model.edges)
    at, y = leaves_of(codes, model.feature[0, 0], model.cut[0, 0]), (frame["fault_type"] == "normal").to_numpy(float)
    for leaf in set(at.tolist()):
        here = at == leaf
        assert model.leaf[0, 0, leaf] == pytest.approx(-RATE * (0.5 - y[here]).sum() / (0.25 * here.sum() + RIDGE))


def test_probabilities_in_spark_and_after_saving(rows):
    model = fit_boosting(rows, {"normal": F.col("fault_type") == "normal", "oa": F.when(F.col("fault_type") != "normal", F.col("fault_type") == "oa_bias")}, rounds=60, depth=4)
    again = Boosted.of(model.state())
    found = rows.withColumn("p", again.column()).select(*FEATURES, "fault_type", "p").toPandas()
    expected = model.probabilities(found[FEATURES].to_numpy(float))
    assert np.array_equal(np.array(found["p"].tolist()), expected)
    normal = (found["fault_type"] == "normal").to_numpy()
    assert ((expected[:, 0] > 0.5) == normal).mean() > 0.95
    assert model.probabilities(np.zeros((0, 31))).shape == (0, 2) and _sigmoid(np.array([-1e9, 1e9])).tolist() == pytest.approx([0, 1])


def test_the_same_rows_in_other_order_give_the_same_trees(spark, rows):
    target = {"normal": F.col("fault_type") == "normal"}
    a, b = (fit_boosting(r, target, rounds=4, depth=3, fit_rows=120) for r in (rows, cut_lineage(rows.repartition(3, "sa_temp_error_c"))))
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.leaf, b.leaf)


def test_cuts_are_those_of_all_rows_however_many_tasks_share_them(rows):
    """What one node's plain search over all rows finds is the first cut of each output, also where rows are dealt to several tasks."""
    targets = {"normal": F.col("fault_type") == "normal", "oa": F.when(F.col("fault_type") != "normal", F.col("fault_type") == "oa_bias")}
    alone, shared = (fit_boosting(rows, targets, rounds=3, depth=4, fit_rows=n) for n in (1000, 40))
    assert np.array_equal(alone.feature, shared.feature) and np.array_equal(alone.cut, shared.cut) and np.allclose(alone.leaf, shared.leaf)
    frame = rows.toPandas()
    codes, faulty = codes_of(frame[FEATURES].to_numpy(float), alone.edges), (frame["fault_type"] != "normal").to_numpy()
    for k, (here, y) in enumerate(((faulty | True, ~faulty), (faulty, (frame["fault_type"] == "oa_bias").to_numpy()))):
        _, feature, cut = _best_cut(codes[:, here], 0.5 - y[here], np.full(here.sum(), 0.25), BINS)
        assert (alone.feature[k, 0, 0], alone.cut[k, 0, 0]) == (feature, cut)
