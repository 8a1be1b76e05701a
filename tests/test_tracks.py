"""Whole chains: blocks to a track, and a mosaic to a picture."""

import numpy as np

from kinegrain.functions import geometry
from kinegrain.operators import develop, track

RATE, FPS, PER = 2500.0, 25.0, 100


def clip_rows(missing=(), lost=None, foreign=(), frames=40):
    """Blocks of a steady turn; ``missing`` frames have no block and their samples come with the next one."""
    rows, start, wave = [], 0, lambda k: int(1000 * np.sin(k / 300))
    for f in range(frames):
        stop = (f + 1) * PER
        if f in missing:
            continue
        gone = (lost or {}).get(f, 0)
        s = [(wave(k), wave(k + 50), 7) for k in range(start + gone, stop)]
        rows.append(("c", f, f + 1000, (2**32 - 300_000 + (f + 1) * 40_000) % 2**32, min(gone, 99), 9 if f in foreign else 3, s))
        start = stop
    return rows


SCHEMA = "clip string, number bigint, frame bigint, clock_us bigint, lost int, take bigint, samples array<struct<x:smallint,y:smallint,z:smallint>>"


def build(spark, rows, frames=40):
    blocks = spark.createDataFrame(rows, SCHEMA)
    files = spark.range(frames).selectExpr("'c' AS clip", "id AS number")
    timed = track.timed_blocks(blocks).cache()
    return track.samples(timed).orderBy("i").collect(), track.frame_table(timed, files, FPS).orderBy("frame").collect(), track.clip_rates(timed).collect(), timed


def test_clean_clip(spark):
    samples, table, rates, timed = build(spark, clip_rows())
    assert [r.i for r in samples] == list(range(4000)) and samples[77].x == int(1000 * np.sin(77 / 300))
    assert [r.n for r in table] == [PER * (k + 1) for k in range(40)] and all(r.valid for r in table)
    assert abs(rates[0].rate_hz - RATE) < 1e-6
    fitted = track.marks(spark.createDataFrame(table), track.clip_rates(timed), FPS).orderBy("frame").collect()
    assert np.allclose(np.diff([r.mark for r in fitted]), 0.04, atol=1e-6)


def test_lost_samples_are_bridged(spark):
    samples, table, rates, _ = build(spark, clip_rows(lost={20: 60}))
    assert [r.i for r in samples] == list(range(4000)) and rates[0].lost == 60
    assert all(abs(r.x - int(1000 * np.sin(r.i / 300))) < 20 for r in samples)
    assert all(r.valid for r in table)


def test_missing_block_and_foreign_take(spark):
    samples, table, _, _ = build(spark, clip_rows(missing=(5,), foreign=(12,)))
    assert table[5].valid and table[5].n == 600
    # The other take's samples are gone: the frame between has no data, and the gap is bridged.
    assert not table[12].valid and [r.i for r in samples] == list(range(4000))


def test_too_few_blocks(spark):
    assert track.timed_blocks(spark.createDataFrame(clip_rows()[:1], SCHEMA)).count() == 0


def test_development_of_a_grey_frame(spark):
    rows = spark.createDataFrame([(0, y, [0.18] * 24) for y in range(20)], "img bigint, y bigint, r array<double>")
    look = develop.Look(curve="linear", gains=(1.0, 1.0, 1.0))
    out = develop.develop(rows, look, 24, 20, geometry.place(24, 20, 24, 20), (0, 0, 24, 20)).collect()
    assert len(out) == 480 and all(np.allclose((p.r, p.g, p.b), 0.18, atol=1e-9) for p in out)
    wide = develop.develop(rows, look, 48, 20, geometry.place(24, 20, 48, 20), (0, 0, 24, 20)).collect()
    assert sum(p.r == 0 for p in wide) == 480 and all(p.r == 0 for p in wide if p.x < 12)
    graded = develop.Look(exposure=1.0, contrast=1.2, saturation=1.3, boost=0.2, gamut=True, shoulder=True, lift=0.01, gain=1.05, soft_clip=True, recover=True, sharpen=0.3)
    got = develop.develop(rows, graded, 24, 20, geometry.place(24, 20, 24, 20), (0, 0, 24, 20), geometry.transform_matrix(geometry.Transform(flip_h=True), 24)).collect()
    assert len({(round(p.r, 9), round(p.g, 9), round(p.b, 9)) for p in got}) == 1 and 0 < got[0].r < 1


def stream_blocks(spark, tmp_path, rows, order, per_batch, rate, name):
    """The rows in the given order, a few to a micro-batch."""
    from kinegrain.streaming import tracks

    schema = "clip string, number bigint, frame bigint, clock bigint, n bigint, lost bigint"
    for k in range(0, len(order), per_batch):
        spark.createDataFrame([rows[i] for i in order[k: k + per_batch]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    q = tracks.tracks(stream, rate).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_shuffled_batches_give_the_batch_track(spark, tmp_path):
    import random

    blocks = clip_rows(missing=(5,), lost={12: 60, 20: 130}, frames=24)
    timed = track.timed_blocks(spark.createDataFrame(blocks, SCHEMA)).orderBy("number").collect()
    rows = [(c, number, frame, clock, len(s), lost) for c, number, frame, clock, lost, _, s in blocks] + [("c", 5, None, None, None, None)]
    order = list(range(len(rows)))
    random.Random(8).shuffle(order)
    got = stream_blocks(spark, tmp_path, rows, order, 4, timed[0].block_rate, "shuffled").orderBy("frame").collect()
    assert [(r.frame, r.elapsed, r.after, r.gap, r.broken) for r in got] == [(r.frame, r.elapsed, r.after, r.gap, r.broken) for r in timed]
    assert {r.skipped for r in got} == {0} and any(r.gap > 99 for r in got)


def test_waiting_blocks_and_repeats():
    """The state function by hand: a gap in the numbers waits for silence, a repeat is counted, a resumed clip goes on."""
    import pandas as pd

    from kinegrain.streaming import tracks

    class State:
        def __init__(self):
            self.value, self.hasTimedOut = None, False

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, ms):
            pass

        def remove(self):
            self.value = None

    state, run = State(), tracks.advance(2500.0, 0)
    frame = lambda *rows: iter([pd.DataFrame([(k, k + 10, k * 40_000, 100, 0) for k in rows], columns=["number", "frame", "clock", "n", "lost"])])
    call = lambda *rows: [r.frame for piece in run(("c",), frame(*rows), state) for r in piece.itertuples()]
    assert call(1, 0) == [10, 11] and call(4, 3) == [] and call(1) == []
    state.hasTimedOut = True
    out = pd.concat(list(run(("c",), iter([]), state)))
    assert out["frame"].tolist() == [13, 14] and out["gap"].tolist() == [100, 0] and out["skipped"].tolist() == [1, 1]
    state.hasTimedOut = False
    assert call(5) == [15] and state.exists
    state.hasTimedOut = True
    for _ in range(tracks.MOST_IDLE + 1):
        list(run(("c",), iter([]), state))
    assert not state.exists


def test_assembled_track(spark):
    blocks = spark.createDataFrame(clip_rows(lost={20: 60}), SCHEMA)
    files = spark.range(40).selectExpr("'c' AS clip", "id AS number")
    orientations, frames = track.assemble(blocks, files, FPS, 16.4, (2, -1, 3))
    q = orientations.orderBy("i").collect()
    assert len(q) == 4000 and (q[0].w, q[0].x) == (1.0, 0.0) and all(abs(r.w**2 + r.x**2 + r.y**2 + r.z**2 - 1) < 1e-9 for r in q)
    # By hand: the axis map and the trapezoid of the first step.
    samples = track.samples(track.timed_blocks(blocks)).orderBy("i").limit(2).collect()
    k = np.pi / 180 / 16.4
    turn = lambda s: np.array([s.x * k, s.y * k, s.z * k])[[1, 0, 2]] * [1, -1, 1]
    v = (turn(samples[0]) + turn(samples[1])) / 2 / RATE
    want = np.array([-v[1], v[0], v[2]])
    half = np.linalg.norm(want) / 2
    assert np.allclose([q[1].x, q[1].y, q[1].z], want / (2 * half) * np.sin(half), atol=1e-12)
    marks = frames.orderBy("frame").collect()
    assert [r.frame for r in marks] == list(range(40)) and np.allclose(np.diff([r.mark for r in marks]), 0.04, atol=1e-4)
    assert track.assemble(spark.createDataFrame(clip_rows()[:1], SCHEMA), files, FPS, 16.4, (1, 2, 3))[0].count() == 0


def test_warps_of_frames():
    from kinegrain.operators import zoom
    from kinegrain.operators.motion import unit

    r = np.random.default_rng(2)
    samples = unit(np.cumsum(r.normal(size=(200, 4)) * 0.002, axis=0) + [1, 0, 0, 0])
    lens = zoom.Lens(3264, 2170, 12, 5, 3240, 2160, 2800.0)
    valid = np.ones(60, bool)
    valid[7] = False
    clip = zoom.Clip(samples, 100.0, np.arange(60) * 0.03, valid, lens, zoom.Settings(readout_s=0.02))
    solved = clip.solve()
    on, inv_zoom, knots = clip.warps(solved, 1.25)
    assert on.all() and np.isclose(inv_zoom[7], 0.8) and np.allclose(knots[7], np.eye(3).ravel())
    assert np.allclose(inv_zoom[20], 1 / (1.25 * solved["zoom"][20])) and np.allclose(knots[20].reshape(33, 3, 3) @ knots[20].reshape(33, 3, 3).transpose(0, 2, 1), np.eye(3), atol=1e-9)
    assert not clip.warps(solved, 1.0)[0][7]


def plain_picture(planes, g, knots, inv_zoom, scale):
    """Output pixel by output pixel: the chain of maps, and one sample there; NaN where it is black."""
    from kinegrain.functions import kernels

    cx, cy, w, h = g.crop
    out = np.full((3, g.height, g.width), np.nan)
    where = np.full((2, g.height, g.width), np.nan)
    inside = lambda x, y: cx <= x < cx + w and cy <= y < cy + h
    for oy in range(g.height):
        for ox in range(g.width):
            x, y = (ox + 0.5 - g.place.off_x) / g.place.scale_x + cx, (oy + 0.5 - g.place.off_y) / g.place.scale_y + cy
            if not inside(x, y):
                continue
            if g.warp is not None:
                ray = np.array([(x - g.warp.cx) * inv_zoom, (y - g.warp.cy) * inv_zoom, g.warp.focal])
                for _ in range(3):
                    at = min(max(y / g.warp.rows * 32, 0), 32)
                    k = min(int(at), 31)
                    q = (knots[k] + (at - k) * (knots[k + 1] - knots[k])).reshape(3, 3) @ ray
                    x, y = q[0] / q[2] * g.warp.focal + g.warp.cx, q[1] / q[2] * g.warp.focal + g.warp.cy
                if not inside(x, y):
                    continue
            if g.lens is not None:
                dx, dy = (x - g.lens[0]) / g.lens[2], (y - g.lens[1]) / g.lens[2]
                f = sum(c * np.hypot(dx, dy) ** k for k, c in enumerate(g.lens[3]))
                x, y = dx * f * g.lens[2] + g.lens[0], dy * f * g.lens[2] + g.lens[1]
                if not inside(x, y):
                    continue
            where[:, oy, ox] = x, y
            for k, p in enumerate(planes):
                if g.resampler == "bilinear":
                    out[k, oy, ox] = kernels.bilinear(p, np.array([x - 0.5]), np.array([y - 0.5]))[0]
                else:
                    out[k, oy, ox] = kernels.resample(p[cy: cy + h, cx: cx + w], np.array([x - cx]), np.array([y - cy]), g.resampler, *scale)[0]
    return out, where


def test_whole_geometry(spark, monkeypatch):
    """Warp, lens and kernel in one chain, over several bands, against pixels made one by one."""
    from kinegrain.operators import raster, zoom

    r = np.random.default_rng(3)
    planes = r.uniform(0.05, 0.9, size=(3, 40, 48))
    pictures = spark.createDataFrame([(i, y, *[p[y].tolist() for p in planes]) for i in (0, 1) for y in range(40)], "img bigint, y bigint, r0 array<double>, r1 array<double>, r2 array<double>")
    q = np.array([[1, 0.004 * k / 32, -0.003, 0.01] for k in range(33)])
    knots = zoom.matrices(q / np.linalg.norm(q, axis=1)[:, None]).reshape(33, 9)
    warps = spark.createDataFrame([(0, True, 1 / 1.1, knots.tolist()), (1, False, 1 / 1.1, knots.tolist())], "img bigint, on boolean, inv_zoom double, knots array<array<double>>")
    lens = (24.0, 20.0, 30.0, [0.97, 0.0, 0.05, 0.0, -0.02, 0.0, 0.01])
    for resampler in ("bilinear", "lanczos3", "catmull"):
        g = develop.Geometry(30, 28, geometry.place(44, 36, 30, 28), (2, 2, 44, 36), None, geometry.Warp(60.0, 24.0, 20.0, 40.0), lens, resampler)
        scale = develop.widening(pictures, g, warps)
        assert resampler == "bilinear" or 1.2 < scale[0] < 1.6
        got = develop.pass_through(pictures, g, warps).collect()
        sampled = raster.sample_kernel(pictures, develop.recorded(pictures, g, warps).where("px IS NOT NULL"), ["r0"], resampler, *scale, area=g.crop, band_rows=8) if resampler != "bilinear" else None
        for img, flat in ((0, False), (1, True)):
            one = develop.replace(g, warp=None) if flat else g
            want, _ = plain_picture(planes, one, knots, 1 / 1.1, scale)
            for p in got:
                if p.img == img:
                    assert np.allclose((p.r, p.g, p.b), np.nan_to_num(want[:, p.y, p.x]), atol=1e-9)
            if sampled is not None and img == 0:
                assert all(np.isclose(s.r0, want[0, s.oy, s.ox]) for s in sampled.where("img = 0").collect())


def test_pass_through_takes_the_vignette_out(spark):
    pictures = spark.createDataFrame([(0, y, [0.5] * 16, [0.5] * 16, [0.5] * 16) for y in range(12)], "img bigint, y bigint, r0 array<double>, r1 array<double>, r2 array<double>")
    g = develop.Geometry(16, 12, geometry.place(16, 12, 16, 12), (0, 0, 16, 12))
    got = {(p.y, p.x): p.r for p in develop.pass_through(pictures, g, None, (8.0, 6.0, 0.1, (0.3, 0.1, 0.0, 0.0)), "linear").collect()}
    r2 = lambda y, x: ((x + 0.5 - 8) ** 2 + (y + 0.5 - 6) ** 2) * 0.01
    assert all(np.isclose(v, 0.5 * min(max(1 + 0.3 * r2(*k) + 0.1 * r2(*k) ** 2, 0.5), 8)) for k, v in got.items())


def test_development_with_sharpening_and_edges(spark):
    """A sharpened step overshoots; edge smoothing leaves a flat picture as it is."""
    rows = spark.createDataFrame([(0, y, [0.2 if x < 12 else 0.6 for x in range(24)]) for y in range(20)], "img bigint, y bigint, r array<double>")
    g = develop.Geometry(24, 20, geometry.place(24, 20, 24, 20), (0, 0, 24, 20), resampler="lanczos3")
    look = develop.Look(curve="linear", hot_pixels=False)
    flat = {(p.y, p.x): p.g for p in develop.develop_with(rows, look, g).collect()}
    sharp = {(p.y, p.x): p.g for p in develop.develop_with(rows, develop.replace(look, sharpen=0.5, edges=0.8), g).collect()}
    assert np.isclose(flat[10, 4], 0.2) and np.isclose(sharp[10, 4], 0.2) and sharp[10, 12] > flat[10, 12] + 0.02
