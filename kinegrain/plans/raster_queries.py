"""Queries over pictures. Embeddings stand in for one picture of 64 columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.functions import dezigzag as dz
from kinegrain.functions import kernels as k
from kinegrain.functions import tone
from kinegrain.operators import raster
from kinegrain.plans.oracle import RASTER, Stencil, clamped, pixels
from kinegrain.session import table

WHITE, AMOUNT, PHASE = 1.0, 0.7, -0.125
VIGNETTE = (0.30, 0.12, -0.05, 0.02)


def picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.from_embeddings(table(spark, sf_dir, "embeddings"))


def _unit(a: np.ndarray) -> np.ndarray:
    """Signals between 0 and 1, as a mosaic has them."""
    return np.abs(a) / (1 + np.abs(a))


def _run(kernel, halo, plane: str = "r0", planes: int = 1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = raster.apply_kernel(picture(spark, sf_dir), kernel, halo, planes)
        return raster.pixels(out, plane).select("y", "x", F.round("v", 6).alias("v"))

    return query


def _demosaic_red_blue(a: np.ndarray, at_green: bool) -> tuple[np.ndarray, np.ndarray]:
    cfa = _unit(a)
    vh = k.vh_direction(cfa)
    g = k.green(cfa, vh, k.low_pass(cfa))
    red, blue = k.rb_diagonal(cfa, g, k.pq_direction(cfa))
    return k.rb_at_green(g, vh, red, blue) if at_green else (red, blue)


def two_planes(at_green: bool, halo: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = raster.apply_kernel(picture(spark, sf_dir), lambda a: _demosaic_red_blue(a, at_green), halo, 2)
        both = out.select("y", F.posexplode(F.arrays_zip("r0", "r1")).alias("x", "p"))
        return both.select("y", "x", F.round("p.r0", 6).alias("red"), F.round("p.r1", 6).alias("blue"))

    return query


def structure_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.apply_kernel(picture(spark, sf_dir), lambda a: k.tensor(_unit(a), _unit(a), _unit(a)), "tensor", 3)
    p = out.select("y", F.posexplode(F.arrays_zip("r0", "r1", "r2")).alias("x", "p"))
    return p.select("y", "x", *[F.round(f"p.r{i}", 6).alias(n) for i, n in enumerate(("xx", "yy", "xy"))])


def half_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.apply_kernel(picture(spark, sf_dir), lambda a: tuple(k.half_size(_unit(a))), "half", 3)
    p = out.select("y", F.posexplode(F.arrays_zip("r0", "r1", "r2")).alias("x", "p"))
    return p.select("y", "x", *[F.round(f"p.r{i}", 6).alias(n) for i, n in enumerate("rgb")])


def dezigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(a: np.ndarray) -> np.ndarray:
        u = _unit(a)
        return dz.smooth_edges(u, u, u)[1]

    return _run(kernel, "dezigzag")(spark, sf_dir)


def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a slightly turned and enlarged grid over the picture."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"))
    x = F.explode(F.sequence(F.lit(0), F.lit(63)))
    grid = rows.select("y", x.alias("x"))
    return grid.select(
        F.lit(0).cast("bigint").alias("img"), "y", "x",
        (F.col("x") * 0.9 + F.col("y") * 0.05 - 2.3).alias("px"), (F.col("y") * 0.95 - F.col("x") * 0.04 + 1.7).alias("py"))


def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.sample_points(picture(spark, sf_dir), sample_grid(spark, sf_dir))
    return out.select("y", F.col("x").cast("int").alias("x"), F.round("v", 6).alias("v"))


def lanczos_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanczos-3 at every pixel moved by a constant part of a pixel."""
    def kernel(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        y, x = np.mgrid[0:h, 0:w]
        return k.resample(a, x.ravel() + 0.5 + 0.3, y.ravel() + 0.5 - 0.2, "lanczos3").reshape(h, w)

    return _run(kernel, 4)(spark, sf_dir)


def vignette_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.pixels(picture(spark, sf_dir).select("img", "y", F.transform("r", lambda v: F.abs(v) / (1 + F.abs(v))).alias("r0")))
    gain = tone.vignette_gain(F.col("x") + 0.5, F.col("y") + 0.5, 32.0, 250.0, 1 / 252.0, VIGNETTE)
    return p.select("y", "x", F.round(tone.remove_vignette(F.col("v"), gain, "rec709"), 6).alias("v"))


def picture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = picture(spark, sf_dir)
    soft = raster.apply_kernel(rows, k.blur, "blur")
    d = raster.difference(raster.pixels(rows.withColumnRenamed("r", "r0")), raster.pixels(soft))
    return d.select(F.round("largest", 6).alias("largest"), F.round("mean", 6).alias("mean"), "not_finite")


def max_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest gain of every map, at least 1; maps are blocks of ten rows."""
    rows = picture(spark, sf_dir)
    return rows.groupBy(F.floor(F.col("y") / 10).alias("map")).agg(F.round(F.greatest(F.lit(1.0), F.max(F.array_max("r"))), 6).alias("brightness"))


def flip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in bottom-up order, as 16-bit samples."""
    rows = picture(spark, sf_dir)
    top = rows.agg(F.max("y").alias("top"))
    out = rows.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("y")).alias("y"), F.posexplode("r").alias("x", "v"))
    return out.select("y", "x", F.round(tone.clamp(F.col("v"), 0.0, 1.0) * 65535).cast("bigint").alias("v"))


QUERIES = {
    "hot_pixels": _run(lambda a: k.hot_pixels(a, WHITE), "hot"),
    "row_phase_cubic": _run(lambda a: k.row_phase(a, PHASE), "row_phase"),
    "vh_discrimination": _run(lambda a: k.vh_direction(_unit(a)), "vh"),
    "pq_discrimination": _run(lambda a: k.pq_direction(_unit(a)), "pq"),
    "lowpass_rb": _run(lambda a: k.low_pass(_unit(a)), "lowpass"),
    "green_at_rb": _run(lambda a: k.green(_unit(a), k.vh_direction(_unit(a)), k.low_pass(_unit(a))), 10),
    "rb_diag": two_planes(False, "demosaic"),
    "rb_green": two_planes(True, "demosaic"),
    "half_bin": half_bin,
    "structure_tensor": structure_tensor,
    "blur9": _run(k.blur, "blur"),
    "unsharp": _run(lambda a: k.unsharp(a, AMOUNT), "unsharp"),
    "dezigzag": dezigzag,
    "bilinear_sample": bilinear_sample,
    "lanczos_sample": lanczos_sample,
    "vignette_remove": vignette_remove,
    "picture_diff": picture_diff,
    "max_gain": max_gain,
    "flip_rows": flip_rows,
}


def _hot_sql() -> str:
    s = Stencil()
    eight = [s.at("src", dx, dy) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dx or dy]
    own = s.at("src")
    mean = "(" + " + ".join(eight) + ") / 8"
    square = "(" + " + ".join(f"{n} * {n}" for n in eight) + ") / 8"
    top = f"greatest({', '.join(eight)})"
    n = "size.n"
    s.stage("hot", f"CASE WHEN x >= 2 AND px.y >= 2 AND x < 62 AND px.y < {n} - 2 AND {own} > {top} + greatest(4 * sqrt(greatest({square} - ({mean}) * ({mean}), 0)), 0.012::DOUBLE) THEN {top} ELSE {own} END")
    return s.sql(pixels("hot"))


def _row_phase_sql() -> str:
    return f"""WITH {RASTER},
n AS (SELECT count(*) AS n FROM src),
w AS (SELECT parity, base, d AS k, t,
    CASE WHEN abs(q) < 1 THEN 1.5::DOUBLE * abs(q) ** 3 - 2.5::DOUBLE * q ** 2 + 1
      WHEN abs(q) < 2 THEN -0.5::DOUBLE * abs(q) ** 3 + 2.5::DOUBLE * q ** 2 - 4 * abs(q) + 2 ELSE 0 END AS w
  FROM (SELECT parity, base, d, t, d - t AS q FROM (VALUES (0, -1, 0.875::DOUBLE), (1, 0, 0.125::DOUBLE)) AS v(parity, base, t), unnest([-1, 0, 1, 2]) AS u(d))),
m AS (SELECT src.y, w.w, 2 * least(greatest(src.y // 2 + w.base + w.k, 0), (n - src.y % 2 + 1) // 2 - 1) + src.y % 2 AS at FROM src, n, w WHERE w.parity = src.y % 2),
o AS (SELECT m.y, x, sum(m.w * s.r[x + 1]) AS v FROM m JOIN src s ON s.y = m.at, unnest(range(0, 64)) AS t(x) GROUP BY m.y, x)
SELECT y, x, round(v, 6) AS v FROM o"""


_UNIT = "u AS (SELECT y, list_transform(r, lambda v: abs(v) / (1 + abs(v))) AS r FROM src)"
_SITE = "((px.y % 2) * 2 + x % 2)"


def _mosaic() -> Stencil:
    s = Stencil()
    s.ctes.append(_UNIT)
    return s


def _directional(s: Stencil, name: str, sx: int, sy: int) -> None:
    def high_pass(c: int) -> str:
        at = lambda k: s.at("u", (c + k) * sx, (c + k) * sy)
        return f"pow(({at(-3)} - {at(-1)} - {at(1)} + {at(3)}) - 3 * ({at(-2)} + {at(2)}) + 6 * {at(0)}, 2)"

    s.stage(f"d_{name}", f"greatest(1e-10, {high_pass(-1)} + {high_pass(0)} + {high_pass(1)})")


def _vh(s: Stencil) -> None:
    _directional(s, "v", 0, 1)
    _directional(s, "h", 1, 0)
    s.stage("vh", f"{s.at('d_v')} / ({s.at('d_v')} + {s.at('d_h')})")


def _pq(s: Stencil) -> None:
    _directional(s, "p", 1, 1)
    _directional(s, "q", -1, 1)
    s.stage("pq", f"CASE WHEN {_SITE} IN (1, 2) THEN 0.5::DOUBLE ELSE {s.at('d_p')} / ({s.at('d_p')} + {s.at('d_q')}) END")


def _low(s: Stencil) -> None:
    near = " + ".join(s.at("u", dx, dy) for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0)))
    far = " + ".join(s.at("u", dx, dy) for dx, dy in ((-1, -1), (1, -1), (-1, 1), (1, 1)))
    s.stage("lp", f"CASE WHEN {_SITE} IN (1, 2) THEN 0::DOUBLE ELSE {s.at('u')} + ({near}) / 2 + ({far}) / 4 END")


def _decided(s: Stencil, plane: str) -> str:
    around = "(" + " + ".join(s.at(plane, dx, dy) for dx in (-1, 1) for dy in (-1, 1)) + ") / 4"
    own = s.at(plane)
    return f"(CASE WHEN abs(0.5 - {own}) < abs(0.5 - {around}) THEN {around} ELSE {own} END)"


def _blend(g: dict, e: dict, d: str, one: tuple[str, str], two: tuple[str, str]) -> str:
    pair = lambda a, b: f"(({g[b]}) * ({e[a]}) + ({g[a]}) * ({e[b]})) / (({g[a]}) + ({g[b]}))"
    return f"({d} * {pair(*one)} + (1 - {d}) * {pair(*two)})"


_AXES = {"n": (0, -1), "s": (0, 1), "w": (-1, 0), "e": (1, 0)}
_DIAGONALS = {"a": (-1, -1), "b": (1, -1), "c": (-1, 1), "d": (1, 1)}


def _green(s: Stencil) -> None:
    _vh(s)
    _low(s)
    g, e = {}, {}
    for n, (sx, sy) in _AXES.items():
        at = lambda k: s.at("u", k * sx, k * sy)  # noqa: B023, E731
        g[n] = f"1e-5 + abs({at(1)} - {at(-1)}) + abs({at(0)} - {at(2)}) + abs({at(1)} - {at(3)}) + abs({at(2)} - {at(4)})"
        own, far = f"greatest({s.at('lp')}, 0)", f"greatest({s.at('lp', 2 * sx, 2 * sy)}, 0)"
        e[n] = f"{at(1)} * (1 + ({own} - {far}) / (1e-5 + {own} + {far}))"
    value = _blend(g, e, _decided(s, "vh"), ("w", "e"), ("n", "s"))
    s.stage("g", f"CASE WHEN {_SITE} IN (1, 2) THEN {s.at('u')} ELSE least(greatest({value}, 0), 2) END")


def _diag(s: Stencil) -> None:
    _green(s)
    _pq(s)
    g, e = {}, {}
    for n, (sx, sy) in _DIAGONALS.items():
        at = lambda k: s.at("u", k * sx, k * sy)  # noqa: B023, E731
        g[n] = f"1e-5 + abs({at(1)} - {at(-1)}) + abs({at(1)} - {at(3)}) + abs({s.at('g')} - {s.at('g', 2 * sx, 2 * sy)})"
        e[n] = f"{at(1)} - {s.at('g', sx, sy)}"
    value = f"least(greatest({s.at('g')} + {_blend(g, e, _decided(s, 'pq'), ('b', 'c'), ('a', 'd'))}, 0), 2)"
    s.stage("other", value)
    s.stage("red0", f"CASE {_SITE} WHEN 0 THEN {s.at('u')} WHEN 3 THEN {s.at('other')} ELSE 0 END")
    s.stage("blue0", f"CASE {_SITE} WHEN 3 THEN {s.at('u')} WHEN 0 THEN {s.at('other')} ELSE 0 END")


def _at_green(s: Stencil, plane: str) -> None:
    g, e = {}, {}
    for n, (sx, sy) in _AXES.items():
        at = lambda k: s.at(plane + "0", k * sx, k * sy)  # noqa: B023, E731
        g[n] = f"1e-5 + abs({s.at('g')} - {s.at('g', 2 * sx, 2 * sy)}) + abs({at(1)} - {at(-1)}) + abs({at(1)} - {at(3)})"
        e[n] = f"{at(1)} - {s.at('g', sx, sy)}"
    value = _blend(g, e, _decided(s, "vh"), ("e", "w"), ("n", "s"))
    s.stage(plane, f"CASE WHEN {_SITE} IN (1, 2) THEN least(greatest({s.at('g')} + {value}, 0), 2) ELSE {s.at(plane + '0')} END")


def _two(red: str, blue: str) -> str:
    return f"SELECT y, x, round(red, 6) AS red, round(blue, 6) AS blue FROM (SELECT a.y AS y, unnest(range(0, 64)) AS x, unnest(a.r) AS red, unnest(b.r) AS blue FROM {red} a JOIN {blue} b ON a.y = b.y)"


def _stencil(build, select: str) -> str:
    s = _mosaic()
    build(s)
    return s.sql(select)


def _rb_green_sql() -> str:
    s = _mosaic()
    _diag(s)
    _at_green(s, "red")
    _at_green(s, "blue")
    return s.sql(_two("red", "blue"))


_TAPS = [float(np.exp(-d * d / 4.5)) for d in range(-4, 5)]


def _blur(s: Stencil) -> None:
    total = repr(sum(_TAPS))
    s.stage("across", "(" + " + ".join(f"{w!r}::DOUBLE * {s.at('src', d, 0)}" for w, d in zip(_TAPS, range(-4, 5))) + f") / {total}::DOUBLE")
    s.stage("soft", "(" + " + ".join(f"{w!r}::DOUBLE * {s.at('across', 0, d)}" for w, d in zip(_TAPS, range(-4, 5))) + f") / {total}::DOUBLE")


def _blur_sql() -> str:
    s = Stencil(clamped)
    _blur(s)
    return s.sql(pixels("soft"))


def _diff_sql() -> str:
    s = Stencil(clamped)
    _blur(s)
    return s.sql("""SELECT round(max(abs(a - b)), 6) AS largest, round(avg(abs(a - b)), 6) AS mean, count(*) FILTER (NOT isfinite(a) OR NOT isfinite(b)) AS not_finite
FROM (SELECT unnest(src.r) AS a, unnest(soft.r) AS b FROM src JOIN soft ON src.y = soft.y)""")


def _tensor_sql() -> str:
    s = Stencil(clamped)
    s.ctes.append("l AS (SELECT y, list_transform(r, lambda v: sqrt(abs(v) / (1 + abs(v)))) AS r FROM src)")
    s.stage("gx", f"0.5::DOUBLE * ({s.at('l', 1)} - {s.at('l', -1)})")
    s.stage("gy", f"0.5::DOUBLE * ({s.at('l', 0, 1)} - {s.at('l', 0, -1)})")
    return s.sql("""SELECT y, x, round(gx * gx, 6) AS xx, round(gy * gy, 6) AS yy, round(gx * gy, 6) AS xy
FROM (SELECT a.y AS y, unnest(range(0, 64)) AS x, unnest(a.r) AS gx, unnest(b.r) AS gy FROM gx a JOIN gy b ON a.y = b.y)""")


def _unsharp_sql() -> str:
    s = Stencil(clamped)
    k3 = {-1: 0.25, 0: 0.5, 1: 0.25}
    mean = " + ".join(f"{k3[dx] * k3[dy]}::DOUBLE * {s.at('src', dx, dy)}" for dx in k3 for dy in k3)
    s.stage("o", f"{s.at('src')} + {AMOUNT}::DOUBLE * ({s.at('src')} - ({mean}))")
    return s.sql(pixels("o"))


def _lanczos_sql() -> str:
    s = Stencil(clamped)
    lanczos = lambda q: float(np.sinc(q) * np.sinc(q / 3)) if abs(q) < 3 else 0.0
    wx = {d: lanczos(d - 0.3) for d in range(-2, 4)}
    wy = {d: lanczos(d + 0.2) for d in range(-3, 3)}
    norm = sum(wx.values()) * sum(wy.values())
    total = " + ".join(f"{wx[dx] * wy[dy] / norm!r}::DOUBLE * {s.at('src', dx, dy)}" for dx in wx for dy in wy)
    around = ", ".join(s.at("src", dx, dy) for dx in (0, 1) for dy in (-1, 0))
    s.stage("o", f"least(greatest({total}, least({around})), greatest({around}))")
    return s.sql(pixels("o"))


BILINEAR_SQL = f"""WITH {RASTER},
n AS (SELECT count(*) AS n FROM src),
q AS (SELECT y, x, x * 0.9::DOUBLE + y * 0.05::DOUBLE - 2.3::DOUBLE AS px, y * 0.95::DOUBLE - x * 0.04::DOUBLE + 1.7::DOUBLE AS py FROM px),
f AS (SELECT *, floor(px)::BIGINT AS x0, floor(py)::BIGINT AS y0 FROM q),
c AS (SELECT f.y, x, px - x0 AS tx, py - y0 AS ty, least(greatest(x0, 0), 63) + 1 AS xa, least(greatest(x0 + 1, 0), 63) + 1 AS xb,
  least(greatest(y0, 0), n - 1) AS ya, least(greatest(y0 + 1, 0), n - 1) AS yb FROM f, n)
SELECT c.y, x, round((1 - ty) * ((1 - tx) * a.r[xa] + tx * a.r[xb]) + ty * ((1 - tx) * b.r[xa] + tx * b.r[xb]), 6) AS v
FROM c JOIN src a ON a.y = ya JOIN src b ON b.y = yb"""

HALF_SQL = f"""WITH {RASTER}, {_UNIT},
p AS (SELECT u.y, x, u.r[x + 1] AS v, (u.y % 2) * 2 + x % 2 AS site FROM u JOIN px ON px.y = u.y),
c AS (SELECT y // 2 AS cy, x // 2 AS cx, avg(v) FILTER (site = 0) AS r, avg(v) FILTER (site IN (1, 2)) AS g, avg(v) FILTER (site = 3) AS b FROM p GROUP BY ALL)
SELECT p.y, p.x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM p JOIN c ON cy = y // 2 AND cx = x // 2"""

VIGNETTE_SQL = f"""WITH {RASTER}, {_UNIT},
p AS (SELECT u.y, x, u.r[x + 1] AS e, pow((x + 0.5::DOUBLE - 32) / 252, 2) + pow((u.y + 0.5::DOUBLE - 250) / 252, 2) AS q FROM u JOIN px ON px.y = u.y),
l AS (SELECT y, x, CASE WHEN e < 0.081 THEN e / 4.5 ELSE pow((e + 0.099) / 1.099, 1 / 0.45) END
  * least(greatest(1 + 0.30::DOUBLE * q + 0.12::DOUBLE * q * q - 0.05::DOUBLE * q * q * q + 0.02::DOUBLE * q * q * q * q, 0.5), 8) AS v FROM p)
SELECT y, x, round(CASE WHEN v < 0.018 THEN 4.5 * v ELSE 1.099 * pow(v, 0.45) - 0.099 END, 6) AS v FROM l"""

SQL = {
    "hot_pixels": _hot_sql(),
    "row_phase_cubic": _row_phase_sql(),
    "vh_discrimination": _stencil(_vh, pixels("vh")),
    "pq_discrimination": _stencil(_pq, pixels("pq")),
    "lowpass_rb": _stencil(_low, pixels("lp")),
    "green_at_rb": _stencil(_green, pixels("g")),
    "rb_diag": _stencil(_diag, _two("red0", "blue0")),
    "rb_green": _rb_green_sql(),
    "half_bin": HALF_SQL,
    "structure_tensor": _tensor_sql(),
    "blur9": _blur_sql(),
    "unsharp": _unsharp_sql(),
    "bilinear_sample": BILINEAR_SQL,
    "lanczos_sample": _lanczos_sql(),
    "vignette_remove": VIGNETTE_SQL,
    "picture_diff": _diff_sql(),
    "max_gain": f"WITH {RASTER} SELECT CAST(y // 10 AS BIGINT) AS map, round(greatest(1, max(list_max(r))), 6) AS brightness FROM src GROUP BY 1",
    "flip_rows": f"WITH {RASTER} SELECT (SELECT max(y) FROM src) - src.y AS y, x, CAST(round(least(greatest(r[x + 1], 0), 1) * 65535) AS BIGINT) AS v FROM src JOIN px ON px.y = src.y",
}
