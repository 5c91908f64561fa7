"""Small tables: every query gets all candidates where there are few."""

import collections

import numpy as np

from linkloom.llm import neighbours


def test_few_vectors_are_all_found(spark):
    points = np.random.default_rng(30).normal(size=(21, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v >= 0).collect()
    assert collections.Counter(r.query_id for r in found) == {i: 20 for i in range(21)}


def test_visits_go_on_until_enough_vectors_are_seen():
    points = np.random.default_rng(31).normal(size=(200, 8))
    forest = neighbours.fit_forest(points, 64)
    sizes = np.bincount(forest.assign(points).ravel(), minlength=forest.cells).tolist()
    for p in points:
        cells = set(forest.visit(p, 1, sizes, 21))
        assert sum(bool(cells & set(own)) for own in forest.assign(points).tolist()) >= 21
