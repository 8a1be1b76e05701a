"""Operators against analytic expectations and plain restatements."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinegrain.functions import colour, curves, geometry, kernels
from kinegrain.operators import matching, motion, raster, zoom


def test_marks_on_a_cadence():
    r = np.random.default_rng(5)
    true = np.arange(300) * 0.04
    late = np.where(r.random(300) < 0.05, 0.02, r.random(300) * 4e-4)
    got = motion.fit_marks(true + late, np.ones(300, bool), 25.0)
    assert got["lost"] == 0 and abs(got["late"] - (late > 0.01).sum()) <= 1
    assert np.abs(got["marks"] - true - got["typical"]).max() < 5e-4
    dropped = np.where(np.arange(300) >= 150, true + 0.08, true)
    assert motion.fit_marks(dropped + r.random(300) * 4e-4, np.ones(300, bool), 25.0)["lost"] == 2
    few = motion.fit_marks(true[:5], np.ones(5, bool), 25.0)
    assert (few["marks"] == true[:5]).all()


def test_integration_of_a_constant_turn():
    q = motion.integrate(np.tile([0.0, 0.5, 0.0], (1001, 1)), 0.002)
    assert np.allclose(q[-1], [np.cos(0.5), 0, np.sin(0.5), 0], atol=1e-9)
    rates = np.random.default_rng(1).normal(size=(257, 3))
    step, p = motion.turns(rates, 0.01), np.array([1.0, 0, 0, 0])
    for k, s in enumerate(step):
        p = motion.unit(motion.product(p, s))
        assert np.allclose(p, motion.integrate(rates, 0.01)[k], atol=1e-9)


def track(seconds=8.0, rate=500.0, amplitude=0.02):
    t = np.arange(int(seconds * rate)) / rate
    w = np.stack((amplitude * np.sin(7 * t), amplitude * 2 * np.cos(5 * t), amplitude * np.sin(3 * t)), axis=1)
    return motion.integrate(w * 20, 1 / rate), rate


LENS = zoom.Lens(3264, 2170, 12, 5, 3240, 2160, 2800.0)


@pytest.mark.parametrize("dynamic", [False, True])
@pytest.mark.parametrize("limit", [1.02, 1.5])
def test_borders_stay_hidden(dynamic, limit):
    q, rate = track()
    t = np.arange(180) * 0.04 + 0.2
    valid = np.ones(180, bool)
    valid[60:65] = False
    clip = zoom.Clip(q, rate, t, valid, LENS, zoom.Settings(smoothness=0.4, readout_s=0.02, max_zoom=limit, dynamic=dynamic, zoom_smooth=0.5, first=10, last=150))
    got = clip.solve()
    i = np.flatnonzero(valid)
    assert clip.fits(clip.rotations(i, got["shutter"][i], got["virtual"][i]), got["zoom"][i] * 1.0005).all()
    assert got["zoom"].max() <= limit + 1e-9 and (got["zoom"] >= 1).all()
    beside = np.array([59, 65])
    assert np.allclose(np.abs((got["virtual"][beside] * clip.actual[beside]).sum(axis=1)), 1) and np.allclose(got["zoom"][beside], 1)


def test_calm_clip_needs_no_zoom():
    q, rate = track(amplitude=0.0)
    got = zoom.Clip(q, rate, np.arange(100) * 0.04, np.ones(100, bool), LENS, zoom.Settings()).solve()
    assert (got["zoom"] == 1).all() and got["limited"] == 0


def test_smoothing_keeps_a_pan():
    t = np.arange(200) * 0.04
    half = 0.1 * t
    q = np.stack((np.cos(half), 0 * t, np.sin(half), 0 * t), axis=1)
    out = zoom.smooth_path(t, q, 0.3, 0, 199)
    assert np.allclose(out[50:150], q[50:150], atol=1e-6)


def test_bands_equal_the_whole(spark):
    picture = np.random.default_rng(3).random((70, 24))
    rows = spark.createDataFrame([(0, y, picture[y].tolist()) for y in range(70)], "img bigint, y bigint, r array<double>")
    for name, kernel, want in (
            ("demosaic", lambda a: kernels.demosaic(a)[0], kernels.demosaic(picture)[0]), ("blur", kernels.blur, kernels.blur(picture)),
            ("row_phase", lambda a: kernels.row_phase(a, -0.125), kernels.row_phase(picture, -0.125))):
        got = raster.apply_kernel(rows, kernel, name, band_rows=16).orderBy("y").collect()
        assert np.allclose([r.r0 for r in got], want, atol=1e-12), name


def test_flat_mosaic_stays_flat():
    for plane in kernels.demosaic(np.full((20, 20), 0.4)):
        assert np.allclose(plane, 0.4)


def test_resampling():
    picture = np.random.default_rng(4).random((12, 14))
    y, x = np.mgrid[0:12, 0:14]
    same = kernels.resample(picture, x.ravel() + 0.5, y.ravel() + 0.5).reshape(12, 14)
    assert (same == picture).all()
    assert np.allclose(kernels.resample(np.full((9, 9), 0.3), np.array([4.2, 0.1]), np.array([3.3, 8.9]), kx=2.5, ky=3.0), 0.3)


def test_curves_are_inverse(spark):
    df = spark.range(200).select((F.col("id") / 150).alias("v"))
    for c in curves.HOST_CURVES:
        assert df.select(F.max(F.abs(curves.decode(curves.encode(F.col("v"), c), c) - F.col("v")))).first()[0] < 2e-5, c


def test_temperature_and_back(spark):
    df = spark.createDataFrame([(t, i) for t in (2000.0, 3200.0, 5600.0, 9000.0) for i in (-40.0, 0.0, 40.0)], "t double, i double")
    x, y = colour.chromaticity(F.col("t"), F.col("i"))
    t, i = colour.temperature_tint(x, y)
    assert df.select(F.max(F.abs(t - F.col("t")) / F.col("t")), F.max(F.abs(i - F.col("i")))).first()[0] < 2e-3
    for k, n in ((2856.0, 3.0), (6500.0, -10.0)):
        assert abs(colour.kelvin_of(*colour.chromaticity_of(k, n)) - k) / k < 2e-3


def test_colour_setup_keeps_white():
    cm = [0.9, -0.2, -0.1, -0.4, 1.2, 0.2, -0.1, 0.2, 0.7]
    for space in colour.SPACES:
        got = colour.colour_setup(cm, None, 21, 0, [1, 1, 1], temp=5600, tint=5, space=space)
        assert got["gains"][1] == 1 and np.allclose(got["matrix"] @ np.ones(3), 1, atol=1e-3)
    neutral = 1 / got["gains"]
    again = colour.colour_setup(cm, None, 21, 0, [1, 1, 1], neutral=neutral)
    assert abs(again["kelvin"] - 5600) < 15
    fitted = {17: np.eye(3) * 0.9 + 0.05, 21: np.eye(3) * 0.8 + 0.1}
    whites = {17: (0.4476, 0.4074), 21: (0.3127, 0.3290)}
    once = colour.chart_fitted(np.reshape(cm, (3, 3)), None, 21, 0, fitted, whites)
    twice = colour.chart_fitted(once[0], once[1], once[2], once[3], fitted, whites)
    assert np.allclose(once[0], twice[0]) and np.allclose(once[1], twice[1])


def test_transform_geometry(spark):
    p = F.lit(30.0), F.lit(40.0)
    assert geometry.transform_matrix(geometry.Transform(), 64) is None
    moved = geometry.through_transform(p, geometry.transform_matrix(geometry.Transform(pos_x=3, pos_y=2), 64), 64.0, 100.0)
    flipped = geometry.through_transform(p, geometry.transform_matrix(geometry.Transform(flip_h=True), 64), 64.0, 100.0)
    got = spark.range(1).select(*moved, *flipped).first()
    assert np.allclose(got, [27, 42, 34, 40])
    assert geometry.place(100, 50, 200, 200) == geometry.Placement(2.0, 2.0, 0.0, 50.0, False)
    assert geometry.place(100, 50, 100, 50).nearest


def test_stream_of_blocks(spark, tmp_path):
    from kinegrain.streaming import tracks

    rows = [("a", k, (2**32 - 50_000 + k * 40_000) % 2**32, 100, 7 if k == 3 else 0) for k in range(6)] + [("b", 0, 5, 10, 0), ("a", 2, 0, 9, 0)]
    for k in range(0, 8, 2):
        spark.createDataFrame(rows[k: k + 2], "clip string, frame bigint, clock bigint, n bigint, lost bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # A state with a timeout would otherwise run batches without data for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema("clip string, frame bigint, clock bigint, n bigint, lost bigint").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = tracks.tracks(stream).writeStream.format("memory").queryName("blocks_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = spark.table("blocks_out").where("clip = 'a'").orderBy("frame").collect()
    assert [r.elapsed for r in got] == [r.frame * 40_000 - got[0].frame * 40_000 for r in got]
    assert got[-1].after - got[0].after == 100 * (len(got) - 1) + 7 * (got[0].frame < 3)


def test_names_of_the_same_words_meet_once(spark, monkeypatch):
    """Many rows of few names: lists of words meet, not rows; all places come out, ties in the offered order."""
    met = []
    monkeypatch.setattr(matching, "meet", lambda left, right, on, whole=matching.meet: met.append(whole(left, right, on)) or met[-1])
    monkeypatch.setattr(matching, "MEET_ROWS", 1)
    names = ["red ring 35mm f2.8", "ring red 35mm F2.8", "blue ring 35mm F2.8"]
    rows = [(i, names[i % 3]) for i in range(300)]
    got = matching.best_names(spark.createDataFrame(rows, "w_id int, name string"), spark.createDataFrame(rows, "o_id int, name string"), top=250).collect()
    assert len(got) == 300 * 250 and met[0].count() == 4
    same = [i for i in range(300) if i % 3 < 2]
    assert [(g.o_id, g.score) for g in sorted((g for g in got if g.w_id == 1), key=lambda g: g["rank"])] == (
        [(i, 1.0) for i in same] + [(i, 0.75) for i in range(2, 150, 3)])


def test_a_clip_keeps_few_points_of_a_bucket(spark, monkeypatch):
    """Points are found by bisection: what comes back for a clip does not grow with its bucket, and is the best."""
    r = np.random.default_rng(5)
    some = lambda n, values: [float(v) if v else None for v in r.choice(values, n)]
    n, m = 60, 400
    clips = list(zip(range(n), some(n, [0, 50, 51, 52]), some(n, [0, 2, 2.8, 4]), [None, 0.0, *map(float, r.uniform(0.3, 200, n - 2))]))
    points = list(zip(range(m), some(m, [0, 50, 51, 53]), some(m, [0, 2, 4]), [None, 0.0, *map(float, r.uniform(0.3, 200, m - 2))])) * 2
    made = [spark.createDataFrame(clips, "clip int, focal double, aperture double, distance double"), spark.createDataFrame(points, "point int, p_focal double, p_aperture double, p_distance double")]
    monkeypatch.setattr(matching, "BUCKET_CLIPS", 7)
    got = {g.clip: (g.point, g.cost) for g in matching.nearest_point(*made, True).collect()}
    apart = lambda x, y, w: abs(np.log(x / y)) * w if x and y else 0.0
    end = lambda d: 100.0 if d is None else min(d, 100.0)
    for c, f, a, d in clips:
        cost, point = min((apart(pf, f, 8.0) + apart(q, a, 2.0) + apart(end(pd), end(d), 0.5), p) for p, pf, q, pd in points)
        assert got[c][0] == point and abs(got[c][1] - cost) < 1e-9
    table = [pa.Table.from_pandas(x.toPandas().astype(float)) for x in made]
    kept = matching._nearest_of(table[0], table[1].slice(0, m))
    assert n <= kept.num_rows < 8 * n and set(kept.column("clip").to_pylist()) == set(range(n))
