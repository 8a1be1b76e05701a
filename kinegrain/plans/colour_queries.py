"""Pointwise queries: curves, tone, colour and geometry. Line items stand in for pixel signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.functions import colour, curves, geometry, tone
from kinegrain.plans.oracle import RASTER
from kinegrain.session import table

KEYS = ["l_orderkey", "l_linenumber"]
MATRIX = [1.62, -0.48, -0.14, -0.21, 1.45, -0.24, 0.03, -0.36, 1.33]
LUMA = (0.2126, 0.7152, 0.0722)
LENS = [1.0, 0.01, -0.04, 0.02, -0.01, 0.003, 0.001]
TURN = geometry.Transform(zoom_x=1.2, zoom_y=1.1, pos_x=3.0, pos_y=-2.0, rotation=7.0, anchor_x=4.0, pitch=3.0, yaw=-5.0, flip_h=True)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals from -0.05 to 1.2 for each line item."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        *KEYS, (F.col("l_quantity") / 40 - 0.05).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12 - 0.02).alias("b"))


def rgb() -> tone.RGB:
    return F.col("r"), F.col("g"), F.col("b")


def named(values: tone.RGB) -> list:
    return [F.round(v, 6).alias(n) for v, n in zip(values, "rgb")]


def encode_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *[F.round(curves.encode(F.col("r"), c), 6).alias(c) for c in dict.fromkeys(curves.OUTPUT_CURVES + curves.HOST_CURVES)])


def decode_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *[F.round(curves.decode(F.col("r"), c), 6).alias(c) for c in curves.HOST_CURVES])


def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = tone.tone(rgb(), tone.luminance(rgb(), LUMA), 1.2, 0.3, -0.4, 0.25)
    return signals(spark, sf_dir).select(*KEYS, *named(v))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *named(tone.saturate(rgb(), tone.luminance(rgb(), LUMA), 1.3173, 0.4137)))


def gamut_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *named(tone.compress_gamut(rgb())))


def lift_gain_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = tone.shoulder(rgb())
    return signals(spark, sf_dir).select(*KEYS, *named(tone.finish(shaped, "rec709", 0.05, 1.1, True)))


def linear_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *named(tone.finish(rgb(), "linear", 0.05, 1.1)))


def highlight_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select(*KEYS, *named(tone.recover_highlights(rgb(), (1.1, 1.0, 1.05))))


def expose_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tone.clip_highlights(tone.remove_pedestal(rgb(), 0.1, 1.05), 1.0)
    return signals(spark, sf_dir).select(*KEYS, *named(tone.apply_matrix(v, MATRIX, 2.0**0.7)))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"))
    return rows.select("y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))


def position() -> geometry.Point:
    return F.col("x") + 0.5, F.col("y") + 0.5


def _mapped(p: geometry.Point) -> list:
    return ["y", "x", F.round(p[0], 6).alias("sx"), F.round(p[1], 6).alias("sy")]


def xform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select(*_mapped(geometry.through_transform(position(), geometry.transform_matrix(TURN, 64.0), 64.0, 500.0)))


def lens_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select(*_mapped(geometry.through_lens(position(), 32.0, 250.0, 252.0, LENS)))


def knots() -> list[list[float]]:
    """Small turns about z and y that grow along the readout."""
    out = []
    for k in range(geometry.KNOTS):
        a, b = 0.001 * k, 0.0005 * (k - 16)
        ca, sa, cb, sb = np.cos(a), np.sin(a), np.cos(b), np.sin(b)
        out.append([float(v) for v in (ca * cb, -sa, ca * sb, sa * cb, ca, sa * sb, -sb, 0.0, cb)])
    return out


def stab_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.array(*[F.array(*map(F.lit, row)) for row in knots()])
    warped = geometry.through_warp(position(), geometry.Warp(400.0, 32.0, 250.0, 500.0, 1.1), k)
    return grid(spark, sf_dir).select(*_mapped(warped))


def knot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated middle element of the knots at every row."""
    at = F.least(F.greatest((F.col("y") + 0.5) / 500 * 32, F.lit(0.0)), F.lit(32.0))
    k = F.least(F.floor(at), F.lit(31)).cast("int")
    table_ = F.array(*[F.lit(row[0]) for row in knots()])
    v = F.get(table_, k) + (at - k) * (F.get(table_, k + 1) - F.get(table_, k))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("y")).select("y", k.alias("knot"), F.round(v, 6).alias("m00"))


def crop_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that are black, for each map of the chain and for all of it."""
    t = geometry.through_transform(position(), geometry.transform_matrix(TURN, 64.0), 64.0, 500.0)
    q = geometry.through_placement(t, geometry.place(64, 500, 64, 480), 2.0, 3.0)
    l = geometry.through_lens(q, 32.0, 250.0, 252.0, LENS)
    return grid(spark, sf_dir).select("y", "x", geometry.inside(q, 2.0, 3.0, 60.0, 490.0).alias("in_frame"), geometry.inside(l, 2.0, 3.0, 60.0, 490.0).alias("in_lens"))


def fit_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of sizes from the part table in an output of 1920 x 1080, for every fit."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 640).cast("double").alias("w"), (F.col("p_partkey") % 30 * 36 + 480).cast("double").alias("h"))
    x, y = F.lit(1920.0) / F.col("w"), F.lit(1080.0) / F.col("h")
    fits = {"fit": (F.least(x, y),) * 2, "fill": (F.greatest(x, y),) * 2, "stretch": (x, y), "native": (F.lit(1.0),) * 2, "width": (x, x), "height": (y, y)}
    options = F.array(*[F.struct(F.lit(n).alias("fit"), a.alias("sx"), b.alias("sy")) for n, (a, b) in fits.items()])
    f = p.select("p_partkey", "w", "h", F.explode(options).alias("o")).select("p_partkey", "o.*", "w", "h")
    off = lambda size, extent, s: F.round((size - F.col(extent) * F.col(s)) / 2, 6)
    return f.select("p_partkey", "fit", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), off(1920.0, "w", "sx").alias("ox"), off(1080.0, "h", "sy").alias("oy"))


def temp_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select(*KEYS, (F.col("g") * 0.15 + 0.25).alias("x"), (F.col("r") * 0.08 + 0.31).alias("y"))
    t, tint = colour.temperature_tint(F.col("x"), F.col("y"))
    return s.select(*KEYS, F.round(t, 4).alias("temperature"), F.round(tint, 4).alias("tint"))


def tint_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select(*KEYS, (F.col("g") * 9000 + 2000).alias("t"), (F.col("r") * 100 - 50).alias("tint"))
    x, y = colour.chromaticity(F.col("t"), F.col("tint"))
    return s.select(*KEYS, F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def color_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance weights and the adaptation's first row for every output space."""
    rows = [(n, *[round(float(v), 6) for v in colour.to_xyz(n)[1]], *[round(float(v), 6) for v in colour.adapt(colour.D50, colour.SPACES[n][1])[0]]) for n in colour.SPACES]
    return spark.createDataFrame(rows, "space string, lr double, lg double, lb double, a0 double, a1 double, a2 double")


def color_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera gains and matrix for as many clips as there are parts, by temperature."""
    import pandas as pd

    cm1, cm2 = [0.9, -0.2, -0.1, -0.4, 1.2, 0.2, -0.1, 0.2, 0.7], [0.8, -0.3, -0.1, -0.5, 1.3, 0.2, -0.1, 0.1, 0.6]

    def run(batches):
        for b in batches:
            got = [colour.colour_setup(cm1, cm2, 17, 21, [1, 1, 1], temp=float(t), tint=float(i)) for t, i in zip(b.temp, b.tint)]
            out = pd.DataFrame({"p_partkey": b.p_partkey})
            for k, n in enumerate("rgb"):
                out[f"gain_{n}"] = [round(float(g["gains"][k]), 6) for g in got]
            out["white"] = [round(float((g["matrix"] @ np.ones(3)) @ g["luminance"]), 6) for g in got]
            yield out

    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 150 + 2000).cast("double").alias("temp"), (F.col("p_partkey") % 41 - 20).cast("double").alias("tint"))
    return p.mapInPandas(run, "p_partkey bigint, gain_r double, gain_g double, gain_b double, white double")


def illuminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 26).alias("code"))
    return p.select("p_partkey", "code", colour.illuminant_kelvin(F.col("code")).alias("kelvin"))


def vignette_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the normal equations of the radial gain's fit."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    n = rows.agg(F.count_distinct("y").alias("n"))
    r = rows.crossJoin(F.broadcast(n))
    x, y = (F.col("x") / 63 - 0.5) * 6048, (F.col("y") / (F.col("n") - 1) - 0.5) * 4032
    q = (x * x + y * y) / (0.25 * (6048.0**2 + 4032.0**2))
    r = r.select(q.alias("q"), F.col("v").cast("double").alias("b"))
    sums = [F.round(F.sum(F.pow("q", F.lit(float(k)))), 3).alias(f"m{k}") for k in range(2, 9)]
    sums += [F.round(F.sum(F.pow("q", F.lit(float(k))) * F.col("b")), 3).alias(f"b{k}") for k in range(1, 5)]
    return r.agg(*sums)


QUERIES = {f.__name__: f for f in (
    encode_curves, decode_curves, tone_map, saturation, gamut_map, lift_gain_clip, linear_lift, highlight_recover, expose_matrix, xform_map, lens_map,
    stab_map, knot_lookup, crop_reject, fit_geometry, temp_tint, tint_point, color_matrix, color_setup, illuminants, vignette_fit)}

_S = "s AS (SELECT l_orderkey, l_linenumber, l_quantity / 40 - 0.05::DOUBLE AS r, l_discount * 10 AS g, l_tax * 12 - 0.02::DOUBLE AS b FROM lineitem)"
_K = "l_orderkey, l_linenumber"
_Y = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def _three(f) -> str:
    return ", ".join(f"round({f(c)}, 6) AS {c}" for c in "rgb")


def _film(v: str, name: str, decode: bool) -> str:
    k = curves.FILM[name]
    low = f"(exp(({k.cut} - {k.c}) / {k.a}::DOUBLE) - {k.b})"
    if decode:
        return f"CASE WHEN {v} >= {k.cut} THEN exp(({v} - {k.c}) / {k.a}::DOUBLE) - {k.b} ELSE {low} + ({v} - {k.cut}) * ({low} + {k.b}) / {k.a} END"
    return f"CASE WHEN {v} >= {low} THEN {k.a} * ln({v} + {k.b}) + {k.c} ELSE {k.cut} + ({v} - {low}) * {k.a} / ({low} + {k.b}) END"


def _encode(v: str) -> dict[str, str]:
    return {
        "linear": v, **{n: f"CASE WHEN {v} > 0 THEN pow({v}, 1.0::DOUBLE / {p}) ELSE {v} END" for n, p in (("gamma22", 2.2), ("gamma24", 2.4), ("gamma26", 2.6))},
        "rec709": f"CASE WHEN {v} < 0.018 THEN 4.5 * {v} ELSE 1.099 * pow({v}, 0.45) - 0.099 END",
        "srgb": f"CASE WHEN {v} <= 0.0031308 THEN 12.92 * {v} ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END",
        "intermediate": f"CASE WHEN {v} <= 0.00262409 THEN {v} * 10.44426855 ELSE (log2({v} + 0.0075) + 7) * 0.07329248 END",
        "acescct": f"CASE WHEN {v} <= 0.0078125 THEN {v} * 10.5402377416545 + 0.0729055341958355 ELSE (log2({v}) + 9.72) / 17.52::DOUBLE END",
        **{n: _film(v, n, False) for n in curves.FILM}}


def _decode(v: str) -> dict[str, str]:
    return {
        "linear": v, **{n: f"CASE WHEN {v} > 0 THEN pow({v}, {p}) ELSE {v} END" for n, p in (("gamma22", 2.2), ("gamma24", 2.4), ("gamma26", 2.6))},
        "rec709": f"CASE WHEN {v} < 0.081 THEN {v} / 4.5::DOUBLE ELSE pow(({v} + 0.099) / 1.099::DOUBLE, 1 / 0.45::DOUBLE) END",
        "srgb": f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92::DOUBLE ELSE pow(({v} + 0.055) / 1.055::DOUBLE, 2.4) END",
        "intermediate": f"CASE WHEN {v} <= 0.00262409::DOUBLE * 10.44426855 THEN {v} / 10.44426855::DOUBLE ELSE pow(2, {v} / 0.07329248::DOUBLE - 7) - 0.0075 END",
        "acescct": f"CASE WHEN {v} <= 0.155251141552511 THEN ({v} - 0.0729055341958355) / 10.5402377416545::DOUBLE ELSE pow(2, {v} * 17.52 - 9.72) END",
        **{n: _film(v, n, True) for n in curves.FILM}}


def _step(low: float, high: float, v: str) -> str:
    t = f"least(greatest(({v} - {low}) / ({high} - {low})::DOUBLE, 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _tone_sql() -> str:
    moved = f"1.2 * l + 0.3 * exp(-pow(l / 2.5::DOUBLE, 2)) - 0.8 * {_step(0, 4, 'l')} + 0.5 * {_step(0, 5, '(-l)')}"
    return f"""WITH {_S}, y AS (SELECT *, CASE WHEN {_Y} > 1e-6 THEN log2({_Y} / 0.18::DOUBLE) END AS l FROM s), k AS (SELECT *, coalesce(pow(2, {moved} - l), 1) AS k FROM y)
SELECT {_K}, {_three(lambda c: f'{c} * k')} FROM k"""


def _turn_cte() -> str:
    m = geometry.transform_matrix(TURN, 64.0)
    row = lambda i: f"({m[3 * i]!r}::DOUBLE * (x + 0.5 - 32) + {m[3 * i + 1]!r}::DOUBLE * (250 - (y + 0.5)) + {m[3 * i + 2]!r}::DOUBLE)"
    return f"t AS (SELECT y, x, CASE WHEN {row(2)} > 1e-6 THEN {row(0)} / {row(2)} + 32 END AS tx, CASE WHEN {row(2)} > 1e-6 THEN 250 - {row(1)} / {row(2)} END AS ty FROM px)"


def _lens(x: str, y: str) -> tuple[str, str]:
    r = f"sqrt(pow(({x} - 32) / 252::DOUBLE, 2) + pow(({y} - 250) / 252::DOUBLE, 2))"
    f = "(" + " + ".join(f"{c}::DOUBLE * pow({r}, {k})" for k, c in enumerate(LENS)) + ")"
    return f"32 + ({x} - 32) * {f}", f"250 + ({y} - 250) * {f}"


def _knots_cte() -> str:
    return "kn AS (SELECT [" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in knots()) + "] AS m)"


def _stab_sql() -> str:
    ctes = [RASTER, _knots_cte(), "p0 AS (SELECT y, x, (x + 0.5::DOUBLE - 32) / 1.1::DOUBLE AS u, (y + 0.5::DOUBLE - 250) / 1.1::DOUBLE AS v, x + 0.5::DOUBLE AS sx, y + 0.5::DOUBLE AS sy FROM px)"]
    for i in range(3):
        e = lambda j: f"(m[k + 1][{j}] + (a - k) * (m[k + 2][{j}] - m[k + 1][{j}]))"
        q = lambda r: f"({e(3 * r + 1)} * u + {e(3 * r + 2)} * v + {e(3 * r + 3)} * 400)"
        ctes.append(f"a{i} AS (SELECT *, least(greatest(sy / 500 * 32, 0), 32) AS a, CAST(least(floor(least(greatest(sy / 500 * 32, 0), 32)), 31) AS INTEGER) AS k FROM p{i}, kn)")
        ctes.append(f"p{i + 1} AS (SELECT y, x, u, v, CASE WHEN qz >= 0.4 THEN 32 + 400 * qx / qz END AS sx, CASE WHEN qz >= 0.4 THEN 250 + 400 * qy / qz END AS sy FROM (SELECT *, {q(0)} AS qx, {q(1)} AS qy, {q(2)} AS qz FROM a{i}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT y, x, round(sx, 6) AS sx, round(sy, 6) AS sy FROM p3"


def _crop_sql() -> str:
    q = geometry.place(64, 500, 64, 480)
    lx, ly = _lens("qx", "qy")
    keep = lambda a, b: f"coalesce({a} >= 2 AND {b} >= 3 AND {a} < 60 AND {b} < 490, false)"
    return f"""WITH {RASTER}, {_turn_cte()},
q AS (SELECT y, x, (tx - {q.off_x!r}::DOUBLE) / {q.scale_x!r}::DOUBLE + 2 AS qx, (ty - {q.off_y!r}::DOUBLE) / {q.scale_y!r}::DOUBLE + 3 AS qy FROM t),
l AS (SELECT *, {lx} AS lx, {ly} AS ly FROM q)
SELECT y, x, {keep('qx', 'qy')} AS in_frame, {keep('lx', 'ly')} AS in_lens FROM l"""


_ISO = "iso AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {r}::DOUBLE, {u}::DOUBLE, {v}::DOUBLE, {t}::DOUBLE)" for k, (r, u, v, t) in enumerate(colour.ISOTHERMS)) + ") AS z(k, r, u, v, t))"
TEMP_SQL = f"""WITH {_S}, {_ISO},
p AS (SELECT {_K}, g * 0.15 + 0.25 AS x, r * 0.08 + 0.31 AS y FROM s),
d AS (SELECT DISTINCT x, y, 2 * x / (1.5 - x + 6 * y) AS u, 3 * y / (1.5 - x + 6 * y) AS v FROM p),
side AS (SELECT d.*, k, iso.r AS ir, iso.u AS iu, iso.v AS iv, 1 / sqrt(1 + t * t) AS du, t / sqrt(1 + t * t) AS dv, ((d.v - iso.v) - (d.u - iso.u) * t) / sqrt(1 + t * t) AS dt FROM d, iso),
hit AS (SELECT x, y, coalesce(min(k) FILTER (k >= 1 AND dt <= 0), 30) AS k FROM side GROUP BY x, y),
f AS (SELECT h.x, h.y, b.u, b.v, a.ir AS ar, b.ir AS br, a.iu AS au, b.iu AS bu, a.iv AS av, b.iv AS bv, CASE WHEN h.k = 1 THEN 0 ELSE a.du END AS adu, CASE WHEN h.k = 1 THEN 0 ELSE a.dv END AS adv, b.du AS bdu, b.dv AS bdv,
    CASE WHEN h.k = 1 THEN 0 ELSE greatest(-b.dt, 0) / (a.dt + greatest(-b.dt, 0)) END AS f
  FROM hit h JOIN side a ON a.x = h.x AND a.y = h.y AND a.k = h.k - 1 JOIN side b ON b.x = h.x AND b.y = h.y AND b.k = h.k),
o AS (SELECT x, y, 1000000 / (ar * f + br * (1 - f)) AS temperature,
    -3000 * ((u - (au * f + bu * (1 - f))) * (bdu * (1 - f) + adu * f) + (v - (av * f + bv * (1 - f))) * (bdv * (1 - f) + adv * f)) / sqrt(pow(bdu * (1 - f) + adu * f, 2) + pow(bdv * (1 - f) + adv * f, 2)) AS tint FROM f)
SELECT {_K}, round(temperature, 4) AS temperature, round(tint, 4) AS tint FROM p JOIN o ON p.x = o.x AND p.y = o.y"""
POINT_SQL = f"""WITH {_S}, {_ISO},
p AS (SELECT {_K}, 1000000 / (g * 9000 + 2000) AS q, (r * 100 - 50) / -3000::DOUBLE AS o FROM s),
n AS (SELECT a.k, a.r AS ar, b.r AS br, a.u AS au, b.u AS bu, a.v AS av, b.v AS bv, 1 / sqrt(1 + a.t * a.t) AS adu, a.t / sqrt(1 + a.t * a.t) AS adv, 1 / sqrt(1 + b.t * b.t) AS bdu, b.t / sqrt(1 + b.t * b.t) AS bdv FROM iso a JOIN iso b ON b.k = a.k + 1),
f AS (SELECT *, (br - q) / (br - ar) AS f FROM p JOIN n ON (q >= ar AND q < br) OR (k = 29 AND q >= br)),
m AS (SELECT *, adu * f + bdu * (1 - f) AS du, adv * f + bdv * (1 - f) AS dv FROM f),
w AS (SELECT *, au * f + bu * (1 - f) + du / sqrt(du * du + dv * dv) * o AS u, av * f + bv * (1 - f) + dv / sqrt(du * du + dv * dv) * o AS v FROM m)
SELECT {_K}, round(1.5 * u / (u - 4 * v + 2), 6) AS x, round(v / (u - 4 * v + 2), 6) AS y FROM w"""


def _space_sql() -> str:
    rows = ", ".join("('%s', %s)" % (n, ", ".join(f"{v}::DOUBLE" for v in (*p, *w))) for n, (p, w) in colour.SPACES.items())
    c = [[float(v) for v in r] for r in colour.CONE]
    ci = [[float(v) for v in r] for r in np.linalg.inv(colour.CONE)]
    d50 = [0.3457 / 0.3585, 1.0, (1 - 0.3457 - 0.3585) / 0.3585]
    old = [sum(a * b for a, b in zip(r, d50)) for r in c]
    gain = [f"(({c[i][0]} * x + {c[i][1]} + {c[i][2]} * z) / {old[i]!r}::DOUBLE)" for i in range(3)]
    first = ", ".join("round(" + " + ".join(f"{ci[0][i] * c[i][j]!r}::DOUBLE * {gain[i]}" for i in range(3)) + f", 6) AS a{j}" for j in range(3))
    det = "(r1 * (g2 * b3 - g3 * b2) - g1 * (r2 * b3 - r3 * b2) + b1 * (r2 * g3 - r3 * g2))"
    return f"""WITH s AS (SELECT * FROM (VALUES {rows}) AS t(space, rx, ry, gx, gy, bx, by_, wx, wy)),
m AS (SELECT space, rx / ry AS r1, 1 AS r2, (1 - rx - ry) / ry AS r3, gx / gy AS g1, 1 AS g2, (1 - gx - gy) / gy AS g3, bx / by_ AS b1, 1 AS b2, (1 - bx - by_) / by_ AS b3, wx / wy AS x, (1 - wx - wy) / wy AS z FROM s)
SELECT space, round((x * (g2 * b3 - g3 * b2) - g1 * (b3 - z * b2) + b1 * (g3 - z * g2)) / {det}, 6) AS lr,
  round((r1 * (b3 - z * b2) - x * (r2 * b3 - r3 * b2) + b1 * (r2 * z - r3)) / {det}, 6) AS lg,
  round((r1 * (g2 * z - g3) - g1 * (r2 * z - r3) + x * (r2 * g3 - r3 * g2)) / {det}, 6) AS lb, {first} FROM m"""


_P = "p AS (SELECT p_partkey, (p_size * 40 + 640)::DOUBLE AS w, (p_partkey % 30 * 36 + 480)::DOUBLE AS h FROM part)"
_Q = "q AS (SELECT pow((x / 63::DOUBLE - 0.5) * 6048, 2) / (0.25 * (6048.0::DOUBLE * 6048 + 4032.0::DOUBLE * 4032)) + pow((src.y / (n - 1)::DOUBLE - 0.5) * 4032, 2) / (0.25 * (6048.0::DOUBLE * 6048 + 4032.0::DOUBLE * 4032)) AS q, r[x + 1] AS b FROM src JOIN px ON px.y = src.y, (SELECT count(*) AS n FROM src))"
SQL = {
    "encode_curves": f"WITH {_S} SELECT {_K}, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _encode("r").items()) + " FROM s",
    "decode_curves": f"WITH {_S} SELECT {_K}, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _decode("r").items()) + " FROM s",
    "tone_map": _tone_sql(),
    "saturation": f"""WITH {_S}, k AS (SELECT *, {_Y} AS y, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM s),
f AS (SELECT *, 1.3173 * (1 + 0.4137 * (1 - CASE WHEN hi > 1e-6 THEN least(greatest((hi - lo) / hi, 0), 1) ELSE 0 END)) AS f FROM k)
SELECT {_K}, {_three(lambda c: f'y + ({c} - y) * f')} FROM f""",
    "gamut_map": f"WITH {_S}, a AS (SELECT *, greatest(r, g, b) AS a FROM s) SELECT {_K}, " + _three(
        lambda c: f"CASE WHEN a > 0 AND (a - {c}) / a > 0.8 THEN a - a * (0.8 + 0.4 * (((a - {c}) / a - 0.8) / 0.4::DOUBLE) / (1 + ((a - {c}) / a - 0.8) / 0.4::DOUBLE)) ELSE {c} END") + " FROM a",
    "lift_gain_clip": f"""WITH {_S}, t AS (SELECT {_K}, {', '.join(f'CASE WHEN greatest({c}, 0) < 0.6 THEN greatest({c}, 0) ELSE 0.6 + 0.4 * (1 - exp(-({c} - 0.6) / 0.4::DOUBLE)) END AS {c}' for c in 'rgb')} FROM s),
e AS (SELECT {_K}, {', '.join(f'{_encode(c)["rec709"]} AS {c}' for c in 'rgb')} FROM t),
l AS (SELECT {_K}, {', '.join(f'{c} * 1.1 + 0.05 * (1 - least(greatest({c}, 0), 1)) AS {c}' for c in 'rgb')} FROM e)
SELECT {_K}, {_three(lambda c: f'CASE WHEN {c} > 0.8 THEN 0.8 + 0.2 * tanh(({c} - 0.8) / 0.2::DOUBLE) ELSE {c} END')} FROM l""",
    "linear_lift": f"""WITH {_S}, e AS (SELECT {_K}, {', '.join(f'{_encode(c)["gamma24"]} AS {c}' for c in 'rgb')} FROM s),
l AS (SELECT {_K}, {', '.join(f'{c} * 1.1 + 0.05 * (1 - least(greatest({c}, 0), 1)) AS {c}' for c in 'rgb')} FROM e)
SELECT {_K}, {_three(lambda c: _decode(c)['gamma24'])} FROM l""",
    "highlight_recover": f"WITH {_S}, t AS (SELECT *, greatest(r, g, b) AS hi, {_step(0.85, 1.0, 'greatest(r / 1.1::DOUBLE, g, b / 1.05::DOUBLE)')} AS t FROM s) SELECT {_K}, {_three(lambda c: f'{c} + t * (hi - {c})')} FROM t",
    "expose_matrix": f"WITH {_S}, n AS (SELECT {_K}, {', '.join(f'least(({c} - 0.1::DOUBLE) * 1.05::DOUBLE, 1) AS {c}' for c in 'rgb')} FROM s) SELECT {_K}, " + ", ".join(
        f"round(pow(2, 0.7) * ({MATRIX[3 * i]}::DOUBLE * r + {MATRIX[3 * i + 1]}::DOUBLE * g + {MATRIX[3 * i + 2]}::DOUBLE * b), 6) AS {c}" for i, c in enumerate("rgb")) + " FROM n",
    "xform_map": f"WITH {RASTER}, {_turn_cte()} SELECT y, x, round(tx, 6) AS sx, round(ty, 6) AS sy FROM t",
    "lens_map": f"WITH {RASTER} SELECT y, x, round({_lens('(x + 0.5)', '(y + 0.5)')[0]}, 6) AS sx, round({_lens('(x + 0.5)', '(y + 0.5)')[1]}, 6) AS sy FROM px",
    "stab_map": _stab_sql(),
    "knot_lookup": f"""WITH {RASTER}, {_knots_cte()}, a AS (SELECT y, m, least(greatest((y + 0.5::DOUBLE) / 500 * 32, 0), 32) AS a FROM src, kn), k AS (SELECT *, CAST(least(floor(a), 31) AS INTEGER) AS k FROM a)
SELECT y, k AS knot, round(m[k + 1][1] + (a - k) * (m[k + 2][1] - m[k + 1][1]), 6) AS m00 FROM k""",
    "crop_reject": _crop_sql(),
    "fit_geometry": f"""WITH {_P}, f AS (SELECT *, unnest([{{'fit': 'fit', 'sx': least(1920 / w, 1080 / h), 'sy': least(1920 / w, 1080 / h)}}, {{'fit': 'fill', 'sx': greatest(1920 / w, 1080 / h), 'sy': greatest(1920 / w, 1080 / h)}},
  {{'fit': 'stretch', 'sx': 1920 / w, 'sy': 1080 / h}}, {{'fit': 'native', 'sx': 1, 'sy': 1}}, {{'fit': 'width', 'sx': 1920 / w, 'sy': 1920 / w}}, {{'fit': 'height', 'sx': 1080 / h, 'sy': 1080 / h}}]) AS o FROM p)
SELECT p_partkey, o.fit AS fit, round(o.sx, 6) AS sx, round(o.sy, 6) AS sy, round((1920 - w * o.sx) / 2, 6) AS ox, round((1080 - h * o.sy) / 2, 6) AS oy FROM f""",
    "temp_tint": TEMP_SQL,
    "tint_point": POINT_SQL,
    "color_matrix": _space_sql(),
    "illuminants": "SELECT p_partkey, p_size % 26 AS code, CASE " + " ".join(f"WHEN p_size % 26 = {k} THEN {t}" for k, t in colour.ILLUMINANTS.items()) + " END AS kelvin FROM part",
    "vignette_fit": f"WITH {RASTER}, {_Q} SELECT " + ", ".join([f"round(sum(pow(q, {k})), 3) AS m{k}" for k in range(2, 9)] + [f"round(sum(pow(q, {k}) * b), 3) AS b{k}" for k in range(1, 5)]) + " FROM q",
}
