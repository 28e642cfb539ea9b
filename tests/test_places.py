"""Targets of one place are worked on once, multiplied rows are not broadcast, and weights of rounding alone do not count."""

from pyspark.sql import functions as F

from echogrid.operators import asof, footprint, geometry, grid
from echogrid.plans import registry

registry.load()
c = F.col


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def image(spark):
    return spark.range(20).select(c("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("col")).withColumn("v", c("row") * 10.0 + c("col"))


def targets(spark, n=30):
    return spark.range(n).select("id", (c("id") % 3 + 5).alias("row"), F.lit(4).alias("col"))


def test_chips_and_boxes_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(footprint.chips(targets(spark), image(spark), 2))
    boxes = spark.range(30).select("id", F.lit(1.0).alias("y0"), F.lit(3.0).alias("y1"), F.lit(1.0).alias("x0"), F.lit(3.0).alias("x1"))
    g = footprint.area_mean(boxes, image(spark), ["id"], ["v"])
    # One box is dealt, and what was found for it is given to all.
    assert {(r.id, r.v) for r in g.collect()} == {(k, 16.5) for k in range(30)}
    assert "Aggregate" in plan(footprint.chips(footprint.places(targets(spark)), image(spark), 2))


def test_back_projection_is_not_broadcast(spark):
    cells = spark.range(5).select(F.lit(0).alias("s"), "id", F.lit(0).alias("first"), F.lit(9).alias("last"), *(F.lit(0.0).alias(k) for k in "xyz"))
    line = F.array(*(F.lit(1.0) for _ in range(8)))
    pulses = spark.range(10).select(F.lit(0).alias("s"), c("id").alias("k"), F.lit(3.0).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("r0"), line.alias("re"), line.alias("im"))
    d = geometry.back_project(cells, pulses, ["s"], 1.0, 0.24)
    assert "BroadcastHashJoin" not in plan(d)
    assert [r.n for r in d.collect()] == [10] * 5


def test_found_for_every_target_of_a_place(spark):
    d = footprint.chip_peaks(targets(spark), image(spark).withColumnRenamed("v", "p"), 1, c("p"))
    assert sorted((r.id, r.prow, r.pcol, r.power) for r in d.collect()) == [(k, k % 3 + 6, 5, (k % 3 + 6) * 10.0 + 5) for k in range(30)]


def test_copies_of_a_place_are_not_compared_in_pairs(spark, monkeypatch):
    met, smallest = [], grid.smallest
    monkeypatch.setattr(grid, "smallest", lambda df, *rest: (met.append(df.count()), smallest(df, *rest))[1])
    points = spark.range(83).select("id", F.when(c("id") < 80, 0.0).otherwise(c("id") - 79.0).alias("y"), F.lit(0.0).alias("x"))
    found = {(r.id, r.n): r.other for r in grid.k_nearest(points, 2, 4.0).collect()}
    assert max(met) < 200
    at = {k: 0.0 if k < 80 else k - 79.0 for k in range(83)}
    assert found == {(k, n): o for k in at for n, o in enumerate(sorted((o for o in at if o != k), key=lambda o: (abs(at[o] - at[k]), o))[:2], 1)}


def test_a_weight_of_rounding_alone_gives_no_pulse(spark):
    d = spark.createDataFrame([(1, 2.0000000000000004, 5.0)], "g long, t double, v double")
    assert sorted(r.k for r in asof.uniform(d, ["g"], 4.0, 6.0, ["v"]).collect()) == [0, 1]


def test_one_response_for_targets_of_one_cell(spark, monkeypatch):
    from echogrid.plans import signals

    kept, own = [], signals.lines.target_response
    monkeypatch.setattr(signals.lines, "target_response", lambda chips, *rest: (kept.append(chips), own(chips, *rest))[1])
    d = registry.QUERIES["g12_target_response"](spark, "/root/testdata/sf0.01")
    assert kept[0].select("id").distinct().count() <= 200
    assert "id" in d.columns


def test_multiplied_rows_start_in_many_tasks(spark):
    boxes = spark.range(1, numPartitions=1).select("id", F.lit(0).alias("orbit_id"), *(F.lit(0.0).alias(k) for k in "xyz"))
    states = F.array(*(F.struct(F.lit(10.0 * k).alias("t"), F.lit(9.0).alias("px"), F.lit(10.0 * k - 15).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("vx"), F.lit(1.0).alias("vy"), F.lit(0.0).alias("vz")) for k in range(4)))
    d = geometry.corner_spacing(boxes, spark.range(1).select(F.lit(0).alias("orbit_id"), states.alias("states")), 2.0, ["orbit_id"])
    assert "RepartitionByExpression" in d._jdf.queryExecution().logical().toString()
    assert [(r.dt, round(r.dr, 9)) for r in d.collect()] == [(2.0, round(0.0, 9))]


def test_missed_crossings_stay_null(spark):
    t = spark.range(2).select("id", F.lit(0).alias("orbit_id"), F.lit(0.0).alias("x"), (c("id") * 1000.0).alias("y"), F.lit(0.0).alias("z"))
    states = F.array(*(F.struct(F.lit(10.0 * k).alias("t"), F.lit(9.0).alias("px"), F.lit(10.0 * k - 15).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("vx"), F.lit(1.0).alias("vy"), F.lit(0.0).alias("vz")) for k in range(4)))
    d = geometry.ground_to_radar(t, spark.range(1).select(F.lit(0).alias("orbit_id"), states.alias("states")))
    assert sorted((r.id, r.t, r.r) for r in d.collect()) == [(0, 15.0, 9.0), (1, None, None)]


def test_edges_of_polygons_start_in_many_tasks(spark):
    corners = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0.5, 0.0), (2.5, 0.0), (2.5, 2.0))))
    d = footprint.line_intervals(spark.range(1).select("id", corners.alias("corners")))
    assert "RepartitionByExpression" in d._jdf.queryExecution().logical().toString()
    assert sorted((r.row, r.start, r.stop) for r in d.collect()) == [(1, 0.0, 0.5), (2, 0.0, 1.5)]
