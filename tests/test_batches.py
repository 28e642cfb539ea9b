"""Lines are worked out in batches: one Python process for steps in a row, none for each pulse or interval."""

import numpy as np
from pyspark.sql import functions as F

from echogrid.operators import lines
from echogrid.plans import registry

registry.load()
c = F.col


def pulses(spark, n):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(n, 8)) + 1j * rng.normal(size=(n, 8))
    return z, spark.createDataFrame([(k, z[k].real.tolist(), z[k].imag.tolist()) for k in range(n)], "row long, re array<double>, im array<double>")


def test_pulses_are_summed_without_a_group_in_python(spark):
    z, df = pulses(spark, 12)
    w = spark.createDataFrame([(k, i, float(k + i)) for k in range(10) for i in range(k, min(k + 3, 12)) if (k, i) != (4, 5)], "k long, i long, w double")
    d = lines.presum(df, w)
    assert "FlatMapGroups" not in d._jdf.queryExecution().sparkPlan().toString()
    found = {r.row: np.array(r.re) + 1j * np.array(r.im) for r in d.collect()}
    assert len(found) == 10
    for k, v in found.items():
        assert np.allclose(v, sum((k + i) * z[i] for i in range(k, min(k + 3, 12)) if (k, i) != (4, 5)))


def test_intervals_of_both_lengths_lose_what_is_loud(spark):
    z, df = pulses(spark, 20)
    d = lines.remove_loud(df, 16, 3, 2.0)
    assert "FlatMapGroups" not in d._jdf.queryExecution().sparkPlan().toString()
    found = {r.row: np.array(r.re) + 1j * np.array(r.im) for r in d.collect()}
    for lo, hi in ((0, 16), (16, 20)):
        g = z[lo:hi]
        w, v = np.linalg.eigh(g @ g.conj().T / 8)
        u = v[:, [k for k in range(len(w) - 1, max(-1, len(w) - 4), -1) if w[k] > 2.0 * max(np.median(w), 1e-30)]]
        assert np.allclose(np.stack([found[k] for k in range(lo, hi)]), g - u @ (u.conj().T @ g), atol=1e-8)


def test_focused_lines_run_two_python_steps(spark):
    plan = registry.QUERIES["l5_focused_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and "FlatMapGroups" not in plan
