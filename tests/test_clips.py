"""Profiles and reports against plain restatements."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kinegrain.functions import geometry
from kinegrain.operators import profiles, reports

PARTS = ["24mm", "50mm", "f2.8", "F4", "5.6", "art", "dg", "c019", "019", "c020", "l", "mount", "II"]


def words(t):
    return [re.sub("^f(?=[0-9])", "", w) for w in re.findall("[a-z0-9.-]+", (t or "").lower())]


def plain_choice(clip, offered, entries, vignette):
    _, model, focal = clip
    want, known = words(model), bool(focal and focal > 0)
    aperture = lambda w: w[0].isdigit() and "mm" not in w and ("." in w or len(w) <= 2)
    same = lambda h, w: h == w or (len(w) >= 3 and w.isdigit() and len(h) == len(w) + 1 and h.endswith(w))
    fits = []
    for order, (path, name, preferred) in enumerate(offered):
        found = [any(same(h, w) for h in name) for w in want]
        if any(aperture(w) and not f for w, f in zip(want, found)) or not known and not any("mm" in w and f for w, f in zip(want, found)):
            continue
        score = sum(found) / math.sqrt(len(want) * len(name)) if want else 0
        if score >= 0.5:
            fits.append((-(score + 0.05 * preferred), order, path))
    best = (0, None)
    for score, _, path in sorted((round(s, 12), o, p) for s, o, p in fits)[:16]:
        for e_path, e_focal, warp, vig, factor in entries:
            near = not known or not (e_focal and e_focal > 0) or abs(math.log(e_focal / focal)) < 0.08
            if e_path == path and (vig if vignette else warp) and near and -score - 0.3 * (factor > 1.1) > best[0] + 1e-12:
                best = (-score - 0.3 * (factor > 1.1), path)
    return best[1] if best[0] >= 0.5 else None


@pytest.mark.parametrize("vignette", [False, True])
def test_profile_choice(spark, vignette):
    r = random.Random(7)
    some = lambda n: " ".join(r.choices(PARTS, k=n))
    files = [f"/p/{i}/{r.choice(['LEICA SL', 'FUJIFILM X', 'Om Digital'] if i % 5 == 0 else ['SONY'])} ({some(r.randint(0, 5))}{r.choice([' vignette', ''])}) - RAW.{r.choice(['lcp', 'LCP', 'xml'])}" for i in range(80)] + ["/p/none.lcp", "/p/x ) ( y.lcp"]
    rows = profiles.installed(spark.createDataFrame([(f,) for f in files], "path string")).collect()
    want = []
    for f in files:
        m = re.match(r"([^(]*)\((.*)\)", f.rsplit("/", 1)[1])
        name = [w for w in words(m[2]) if w not in profiles.CONTENT] if m else []
        if m and name and f.lower().endswith(".lcp") and not any(b in m[1].lower() for b in profiles.SMALL_SENSORS):
            want.append((f, name, "mount" in name and "l" in name))
    assert sorted((p.path, p.name, p.preferred) for p in rows) == sorted(want)
    entries = [(f, r.choice([None, 24.0, 25.0, 50.0]), r.random() < 0.7, r.random() < 0.7, r.choice([1.0, 1.5])) for f in files for _ in range(r.randint(0, 3))]
    clips = [(i, some(r.randint(0, 5)), r.choice([None, 0.0, 24.0, 50.0])) for i in range(60)] + [(99, None, 24.0)]
    offered = spark.createDataFrame([(p, n, q, i) for i, (p, n, q) in enumerate(want)], "path string, name array<string>, preferred boolean, ordinal int")
    got = profiles.choose(
        spark.createDataFrame(clips, "clip int, lens_model string, focal_mm double"), offered,
        spark.createDataFrame(entries, "path string, focal double, has_warp boolean, has_vignette boolean, format_factor double"), vignette)
    found = {g.clip: g.path for g in got.collect()}
    assert found == {c[0]: p for c in clips if (p := plain_choice(c, want, entries, vignette))}
    assert found


def test_hash_of_names(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("/Clips/é.dng",), (None,)], "t string")
    got = [r.h for r in rows.select(reports.fnv1a(F.col("t")).alias("h")).collect()]
    assert got[:3] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]

    def plain(data, h):
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}.fpgc"

    names = [r.n for r in rows.where("t IS NOT NULL").select(reports.cache_name(F.col("t")).alias("n")).collect()]
    assert names == [plain(t.encode(), reports.CACHE_START) for t in ("", "A", "FOOBAR", "\\CLIPS\\é.DNG")]


def test_reports(spark):
    place = geometry.place(100, 50, 200, 120)
    turn = geometry.transform_matrix(geometry.Transform(zoom_x=2.0, zoom_y=2.0), 200)
    points = spark.createDataFrame([(10.0, 20.0), (100.0, 60.0)], "x double, y double")
    got = [json.loads(r.report) for r in reports.map_report(points, place, turn, 200.0, 120.0).collect()]
    assert got[0]["scale"] == [2.0, 2.0] and got[0]["offset"] == [0.0, 10.0] and got[0]["xform"] == 1
    assert got[0]["point"]["source_x"] == (100 + (10 - 100) / 2) / 2 and got[1]["point"]["source_y"] == (60 - 10) / 2
    clip = spark.createDataFrame([("c", 3, 1.0, 0.0, 0.0, 0.0, None)], "file string, frames int, w double, x double, y double, z double, fps double")
    assert json.loads(reports.gyro_report(clip).first().report) == {"file": "c", "frames": 3, "orientation": [1.0, 0.0, 0.0, 0.0]}


def test_profiles_of_the_same_words_are_judged_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(profiles, "meet", lambda left, right, on, whole=profiles.meet: met.append(whole(left, right, on)) or met[-1])
    offered = [(f"/p/{i}", ["a", "35mm", "2.8"] if i % 2 else ["b", "35mm", "2.8"], False, i) for i in range(200)]
    entries = [(p, 35.0, i >= 20, True, 1.0) for p, _, _, i in offered]
    clips = [(i, "A 35mm f2.8" if i % 2 else "35mm 2.8 a", 35.0 if i % 4 else None) for i in range(100)]
    got = profiles.choose(
        spark.createDataFrame(clips, "clip int, lens_model string, focal_mm double"), spark.createDataFrame(offered, "path string, name array<string>, preferred boolean, ordinal int"),
        spark.createDataFrame(entries, "path string, focal double, has_warp boolean, has_vignette boolean, format_factor double"), False).collect()
    # 16 places, the first of which hold no warp: /p/1 to /p/31 by twos, of which /p/21 is the first with one.
    assert sorted((g.clip, g.path) for g in got) == [(i, "/p/21") for i in range(100)]
    assert met[0].count() == 4


CHOICE = ("clip int, lens_model string, focal_mm double", "path string, name array<string>, preferred boolean, ordinal int",
          "path string, focal double, has_warp boolean, has_vignette boolean, format_factor double")


def test_every_profile_that_fits_is_judged(spark):
    """Profiles behind any number of better fits that do not cover the clip, or of a smaller sensor, are found."""
    offered, entries = [], []

    def offer(n, name, warp, focal, factor=1.0):
        for _ in range(n):
            path = f"/p/{len(offered)}"
            offered.append((path, [f"x{len(offered)}" if w == "x" else w for w in name.split()], False, len(offered)))
            entries.append((path, focal, warp, not warp, factor))

    offer(40, "a 35mm 2.8", False, 35.0)  # 0 to 39: the same words, none with a warp
    offer(2, "a 35mm 2.8", True, 35.0)  # 40
    offer(40, "b 35mm 2.8 x", False, 35.0)  # 42 to 81: other words each, which fit better
    offer(1, "35mm 2.8", True, 35.0)  # 82
    offer(20, "c 35mm 2.8", True, 35.0, 1.5)  # 83 to 102: of a smaller sensor
    offer(20, "c 35mm 2.8 x", True, 35.0, 1.5)  # 103 to 122
    offer(1, "c 35mm 2.8 z", True, 35.0)  # 123
    offer(20, "d 35-70mm 2.8", True, 35.0)  # 124 to 143: at another focal length
    offer(1, "d 35-70mm 2.8 z", True, 70.0)  # 144
    clips = [(1, "A 35mm f2.8", 35.0), (2, "A 35mm f2.8", None), (3, "b 35mm F2.8", 35.0), (4, "b 35mm F2.8", 0.0), (5, "c 35mm 2.8", 35.0), (6, "c 35mm 2.8", None), (7, "d 35-70mm 2.8", 70.0), (8, "d 35-70mm 2.8", None)]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in zip((clips, offered, entries), CHOICE)]
    got = {g.clip: (g.path, round(g.score, 6)) for g in profiles.choose(*tables, False).collect()}
    assert got == {
        1: ("/p/40", 1.0), 2: ("/p/40", 1.0), 3: ("/p/82", 0.816497), 4: ("/p/82", 0.816497), 5: ("/p/123", 0.866025), 6: ("/p/123", 0.866025), 7: ("/p/144", 0.866025), 8: ("/p/124", 1.0)}


def test_focal_lengths_are_met_across_buckets(spark):
    r = random.Random(3)
    at = [None, 0.0, -1.0, math.nan, math.inf, 1e-300, 1e300, *(35 * math.exp(0.08 * k + d) for k in range(-3, 4) for d in (-1e-6, 0.0, 1e-6, 0.04))]
    offered = [(f"/p/{i}", r.choice([["a", "z"], ["a", "y"], ["b", "a"]]), False, i) for i in range(3 * len(at))]
    entries = [(p, at[i // 3], True, True, r.choice([1.0, 1.0, 1.5])) for p, _, _, i in offered]
    r.shuffle(entries)
    clips = [(i, r.choice(["a z", "a y w", "a"]), f) for i, f in enumerate(at[3:] * 2)]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in zip((clips, offered[::-1], entries), CHOICE)]
    for hidden in (0, 9):  # with and without the entries that cover every clip
        kept = entries if not hidden else [e for e in entries if int(e[0][3:]) >= hidden]
        got = {g.clip: g.path for g in profiles.choose(tables[0], tables[1], spark.createDataFrame(kept, CHOICE[2]), False).collect()}
        want = {}
        for clip, model, own in clips:
            best = []
            for path, focal, _, _, factor in kept:
                _, name, _, order = offered[int(path[3:])]
                fit = sum(w in name for w in model.split()) / math.sqrt(len(model.split()) * len(name))
                covers = focal is None or focal <= 0 or (0 < focal < math.inf and 0 < own < math.inf and 0.9 < focal / own < 1.1 and abs(math.log(focal / own)) < 0.08)
                score = fit - (0.3 if factor > 1.1 else 0.0)
                if fit >= 0.5 and covers and score >= 0.5:
                    best.append((-score, -fit, order, path))
            if best:
                want[clip] = min(best)[3]
        assert got == want
        assert len(want) > 20
