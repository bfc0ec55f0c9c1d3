"""Connected components, solved by one task and in steps."""

import numpy as np

from parcelyze.operators import components as c


def test_components_are_the_same_in_one_task_and_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5000 + i) for i in range(1, 40)]
    wild = [tuple(map(int, x)) for x in rng.integers(-400, 400, (350, 2))]
    edges = spark.createDataFrame(path + star + wild + [(7, 7)], "u long, v long")
    out = {tuple(r) for r in c.components(edges).collect()}
    monkeypatch.setattr(c, "FEW", 0)
    assert out == {tuple(r) for r in c.components(edges).collect()}
    assert (1060, 1000) in out and (5039, 5000) in out
    assert not c.components(edges.limit(0)).collect()
