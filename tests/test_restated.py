"""Operators without SQL, and searches that prune, against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.functions import dezigzag as dz
from kinegrain.operators import matching as mt
from kinegrain.operators import motion, zoom


def at(p, x, y):
    return p[min(max(y, 0), p.shape[0] - 1), min(max(x, 0), p.shape[1] - 1)]


def luma_of(c):
    return math.sqrt(max(0.25 * c[0] + 0.5 * c[1] + 0.25 * c[2], 0))


def plain_smooth(planes, tensors, strength, longest, spread, steepest, least):
    """Pixel by pixel: the published rule, with the eigenvectors taken from numpy."""
    h, w = planes[0].shape
    out = [p.copy() for p in planes]
    ramp = lambda a, b, v: (lambda u: u * u * (3 - 2 * u))(min(max((v - a) / (b - a), 0), 1))
    luma = lambda x, y: luma_of([at(p, x, y) for p in planes])
    for y in range(h):
        for x in range(w):
            xx, yy, xy = (t[y, x] for t in tensors)
            values, vectors = np.linalg.eigh([[xx, xy], [xy, yy]])
            if yy <= xx or xx + yy < least:
                continue
            dx, dy = vectors[:, 0] * (1 if vectors[0, 0] >= 0 else -1)
            slope = abs(dy) / max(dx, 1e-6)
            gate = ramp(0.4, 0.75, (values[1] - values[0]) / (xx + yy)) * (1 - ramp(0.25, steepest, slope))
            best = 0
            for k in (-1, 0, 1):
                v = {d: luma(x, y + k + d) for d in (-3, -1, 0, 1, 3)}
                step = {d: max(abs(v[d] - v[-d]), abs(2 * v[0] - v[d] - v[-d])) for d in (1, 3)}
                best = max(best, step[1] / (step[3] + 1e-4))
            gate *= ramp(0.5, 0.8, best)
            if gate <= 0:
                continue
            sigma = min(longest, max(1.5, 1.2 * strength / max(slope, 1e-3)))
            own = [p[y, x] for p in planes]
            total, weight = list(own), 1.0
            for t in range(-math.ceil(2.5 * sigma), math.ceil(2.5 * sigma) + 1):
                if t:
                    px, py = x + t * dx, y + t * dy
                    x0, y0 = math.floor(px), math.floor(py)
                    c = [sum(at(p, x0 + i, y0 + j) * (px - x0 if i else 1 - px + x0) * (py - y0 if j else 1 - py + y0) for i in (0, 1) for j in (0, 1)) for p in planes]
                    f = math.exp(-t * t / (2 * sigma**2) - (luma_of(c) - luma_of(own)) ** 2 / (2 * spread**2))
                    total = [a + f * b for a, b in zip(total, c)]
                    weight += f
            for k in range(3):
                out[k][y, x] += gate * (total[k] / weight - own[k])
    return out


@pytest.mark.parametrize("slope", [0.0, 0.08, 0.2, 0.4])
def test_edge_smoothing(slope):
    from kinegrain.functions.kernels import blur, tensor

    y, x = np.mgrid[0:30, 0:40]
    step = (np.floor((y + slope * x) / 2) * 2 > 18) * 0.6 + 0.1  # rows in pairs, as binning leaves them
    r = np.random.default_rng(1)
    planes = [step * k + r.normal(size=step.shape) * 1e-3 + 0.01 for k in (1.0, 0.9, 0.7)]
    got = dz.smooth_edges(*planes)
    want = plain_smooth(planes, [blur(t) for t in tensor(*planes)], 0.8, 12.0, 0.06, 0.6, 1e-5)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, want))
    if slope == 0.08:
        assert np.abs(got[0] - planes[0]).max() > 0.01
    flat = [np.full((12, 12), 0.3)] * 3
    assert all(np.array_equal(a, b) for a, b in zip(dz.smooth_edges(*flat), flat))


def cost_of(c, p, vignette):
    term = lambda a, b, k: k * abs(math.log(a / b)) if a and b and a > 0 and b > 0 else 0.0
    least = lambda v: min(v, 100.0) if v is not None else 100.0
    return term(p[1], c[1], 8.0) + (term(p[2], c[2], 2.0) if vignette else 0) + term(least(p[3]), least(c[3]), 0.5)


@pytest.mark.parametrize("vignette", [False, True])
def test_nearest_point(spark, vignette):
    r = random.Random(4)
    some = lambda low, high: r.choice([None, 0.0, -1.0]) if r.random() < 0.1 else r.uniform(low, high)
    points = [(i, some(10, 600) if i % 3 else r.choice([50.0, 51.0]), some(1, 20), some(0.2, 300)) for i in range(150)]
    clips = [(i, some(1, 3000), some(1, 20), some(0.2, 300)) for i in range(120)]
    names = "p_focal double, p_aperture double, p_distance double"
    for ps in (points, points[:1], [(7, None, 2.0, 3.0)], [(0, 50.0, None, None), (1, 50.0, None, None)]):
        got = mt.nearest_point(
            spark.createDataFrame(clips, "clip int, focal double, aperture double, distance double"), spark.createDataFrame(ps, "point int, " + names), vignette)
        found = {g.clip: (g.cost, g.point) for g in got.collect()}
        assert set(found) == set(range(120))
        for c in clips:
            best = min((round(cost_of(c, p, vignette), 9), p[0]) for p in ps)
            assert round(found[c[0]][0], 9) == best[0]
            if sum(round(cost_of(c, p, vignette), 9) == best[0] for p in ps) == 1:
                assert found[c[0]][1] == best[1]
    nothing = mt.nearest_point(spark.createDataFrame(clips, "clip int, focal double, aperture double, distance double"), spark.createDataFrame([], "point int, " + names), vignette)
    assert nothing.count() == 0


def test_best_names(spark):
    r = random.Random(9)
    parts = ["24mm", "50mm", "70mm", "f2.8", "F4", "5.6", "art", "dg", "os", "II", "sport", "c"]
    names = [(i, " ".join(r.choices(parts, k=r.randint(0, 7)))) for i in range(120)] + [(200, None), (201, ""), (202, "24mm 24mm"), (203, "24mm 50mm f2.8"), (204, "24mm 50mm f2.8")]

    def words(t):
        import re

        return [re.sub("^f(?=[0-9])", "", w) for w in re.findall("[a-z0-9.-]+", (t or "").lower())]

    aperture = lambda w: w[0].isdigit() and "mm" not in w and ("." in w or len(w) <= 2)
    want = {}
    for i, a in names:
        x, scored = words(a), []
        for j, b in names:
            y = words(b)
            if any("mm" in w and w in x for w in y) and all(not aperture(w) or w in y for w in x):
                s = sum(w in y for w in x) / math.sqrt(len(x) * len(y))
                if s >= 0.5:
                    scored.append((-s, j))
        want[i] = [j for _, j in sorted((round(s, 9), j) for s, j in scored)][:16]
    frame = lambda key: spark.createDataFrame(names, f"{key} int, name string")
    got = {}
    for g in mt.best_names(frame("w_id"), frame("o_id")).orderBy("w_id", "rank").collect():
        got.setdefault(g.w_id, []).append(g.o_id)
    assert got == {i: v for i, v in want.items() if v}


def test_values_at_ranks(spark):
    r = random.Random(3)
    rows = [("a", float(r.randint(0, 5))) for _ in range(500)] + [("b", r.gauss(0, 1e6)) for _ in range(301)] + [("c", 2.0)] + [("d", None), (None, 1.0), ("e", 1e300), ("e", -1e300)]
    picks = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1, "beyond": F.col("n")}
    for steps in (1, 7, 1024):
        got = {g.k: (g.low, g.mid, g.top, g.beyond) for g in motion.values_at_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", picks, steps).collect()}
        want = {}
        for k in "abce":
            v = sorted(x for key, x in rows if key == k)
            want[k] = (v[0], v[len(v) // 2], v[-1], None)
        assert got == want


def test_smooth_path():
    r = np.random.default_rng(5)
    n = 150
    q = motion.unit(np.cumsum(r.normal(size=(n, 4)) * 0.2, axis=0) + [1, 0, 0, 0]) * r.choice([-1, 1], n)[:, None]
    t = np.cumsum(r.uniform(0.01, 0.05, n))
    for first, last, before, after in ((0, n - 1, False, False), (20, 120, False, True), (70, 71, True, True)):
        got = zoom.smooth_path(t, q, 0.1, first, last, before, after)
        for i in range(n):
            piece = 0 if i < first else 2 if i > last else 1
            lo, hi = [(0, first - 1), (0 if before else first, n - 1 if after else last), (last + 1, n - 1)][piece]
            total = np.zeros(4)
            for j in range(lo, hi + 1):
                if abs(t[j] - t[i]) <= 0.3 + 1e-12:
                    total += np.exp(-0.5 * ((t[j] - t[i]) / 0.1) ** 2) * q[j] * (-1 if q[j] @ q[i] < 0 else 1)
            assert np.allclose(got[i], total / np.linalg.norm(total))


def test_needed_zoom_is_the_smallest_that_fits():
    r = np.random.default_rng(6)
    n = 60
    samples = motion.unit(np.cumsum(r.normal(size=(n * 2, 4)) * 0.004, axis=0) + [1, 0, 0, 0])
    lens = zoom.Lens(3264, 2170, 12, 5, 3240, 2160, 2800.0)
    clip = zoom.Clip(samples, 50.0, np.arange(n) * 0.02, np.ones(n, bool), lens, zoom.Settings(readout_s=0.02))
    path = zoom.smooth_path(clip.t, clip.actual, 0.3, 0, n - 1)
    every = np.arange(n)
    need, over = clip.need(every, np.ones(n), path, 1.05, 14)
    rot = clip.rotations(every, np.ones(n), path)
    for i in every:
        fits = lambda z, i=i: bool(clip.fits(rot[i: i + 1], np.array([z]))[0])
        if over[i]:
            assert not fits(1.05) and need[i] == 1.05
        else:
            assert fits(need[i]) and (need[i] == 1 or not fits(need[i] - 0.05 / 2**13))
    assert over.any() and (need > 1).any()
