"""A developed picture: mosaic, geometry in one resampling, and the colour chain.

The geometry goes from an output pixel back to where it was recorded: host
transform, placement, stabilising warp, lens. What leaves the picture on the
way is black. A picture that is already in colour can go through the geometry
alone, with its vignette taken out where it was recorded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions import dezigzag, geometry, kernels, tone
from kinegrain.operators import raster

PEDESTAL = 0.1


@dataclass(frozen=True)
class Look:
    """Settings of a development; neutral ones leave their stage out of the plan."""

    black: tuple[float, ...] = (0.0,) * 4
    white: float = 1.0
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    mosaic: tuple[int, int, int, int] = kernels.RGGB
    half: bool = False
    hot_pixels: bool = True
    row_phase: float = 0.0
    sharpen: float = 0.0
    recover: bool = False
    matrix: list[float] = field(default_factory=lambda: [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0])
    luminance: tuple[float, float, float] = (0.2126, 0.7152, 0.0722)
    exposure: float = 0.0
    contrast: float = 1.0
    midtones: float = 0.0
    highlights: float = 0.0
    shadows: float = 0.0
    saturation: float = 1.0
    boost: float = 0.0
    gamut: bool = False
    shoulder: bool = False
    curve: str = "rec709"
    lift: float = 0.0
    gain: float = 1.0
    soft_clip: bool = False
    edges: float = 0.0  # strength of edge smoothing, 0 to 1


@dataclass(frozen=True)
class Geometry:
    """From output pixels to recorded ones. ``crop`` is (x, y, width, height) of the recorded picture.

    ``warp`` reads a table of frame warps (img, on, inv_zoom, knots), ``lens`` is
    (centre x, y, radius, 7 coefficients).
    """

    width: int
    height: int
    place: geometry.Placement
    crop: tuple[int, int, int, int]
    transform: list[float] | None = None
    warp: geometry.Warp | None = None
    lens: tuple[float, float, float, list[float]] | None = None
    resampler: str = "bilinear"  # or catmull, lanczos2, lanczos3


def planes(mosaics: DataFrame, look: Look) -> DataFrame:
    """White-balanced red, green and blue rows of mosaics (img, y, r): img, y, r0, r1, r2, above a pedestal."""
    top = max(look.gains)
    scale = np.array([look.gains[c] / top for c in look.mosaic]) / (look.white - np.array(look.black))

    def kernel(raw: np.ndarray) -> tuple:
        a = kernels.hot_pixels(raw, look.white, look.black) if look.hot_pixels else raw
        a = kernels.row_phase(a, look.row_phase, look.black, tuple(scale), PEDESTAL)
        out = tuple(kernels.half_size(a, look.mosaic)) if look.half else kernels.demosaic(a, look.mosaic)
        return tuple(dezigzag.smooth_edges(*out, strength=look.edges)) if look.edges else out

    return raster.apply_kernel(mosaics, kernel, kernels.HALO["demosaic"] + (kernels.HALO["dezigzag"] if look.edges else 0), 3)


def positions(images: DataFrame, width: int, height: int, place: geometry.Placement, crop: tuple[int, int, int, int], transform: list[float] | None = None) -> DataFrame:
    """Where every output pixel of each image is read: img, oy, ox, px, py (pixel indices), null where it is black."""
    return recorded(images, Geometry(width, height, place, crop, transform))


def backwards(x: np.ndarray, y: np.ndarray, g: Geometry, knots: np.ndarray | None, inv_zoom: float) -> tuple[np.ndarray, np.ndarray]:
    """Output positions (from the corner) taken back to the recorded ones; NaN outside the picture.

    ``knots`` is None for an image that is not warped.
    """
    cx, cy, w, h = g.crop

    def held(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (x >= cx) & (y >= cy) & (x < cx + w) & (y < cy + h)
        return np.where(ok, x, np.nan), np.where(ok, y, np.nan)

    with np.errstate(invalid="ignore", divide="ignore"):
        if g.transform is not None:
            x, y = geometry.transform_points(x, y, g.transform, float(g.width), float(g.height))
        x, y = held((x - g.place.off_x) / g.place.scale_x + cx, (y - g.place.off_y) / g.place.scale_y + cy)
        if g.warp is not None and knots is not None:
            x, y = held(*geometry.warp_points(x, y, g.warp, knots, inv_zoom))
        if g.lens is not None:
            x, y = held(*geometry.lens_points(x, y, *g.lens))
    return x, y


def with_warps(rows: DataFrame, g: Geometry, warps: DataFrame | None) -> DataFrame:
    """Columns ``zoom`` and ``knots`` of each row's image: 33 x 9 numbers, null where it is not warped."""
    if g.warp is None:
        return rows.withColumns({"zoom": F.lit(1.0), "knots": F.lit(None).cast("array<double>")})
    on = warps.where("on").select("img", F.col("inv_zoom").alias("zoom"), F.flatten("knots").alias("knots"))
    return rows.join(on, "img", "left").withColumn("zoom", F.coalesce("zoom", F.lit(1.0)))


def recorded(images: DataFrame, g: Geometry, warps: DataFrame | None = None) -> DataFrame:
    """Where every output pixel of each image was recorded: img, oy, ox, px, py (pixel indices), null where it is black.

    ``warps`` holds (img, on, inv_zoom, knots); an image without one, or with
    ``on`` false, is not warped. A task works on output rows, whole ones.
    """
    rows = images.select(F.col("img").cast("bigint").alias("img")).distinct()
    rows = with_warps(rows, g, warps).select("img", "zoom", "knots", F.explode(F.sequence(F.lit(0), F.lit(g.height - 1))).alias("oy"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ox = np.arange(g.width, dtype=np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                knots = np.array(batch.column(2)[i].as_py(), float).reshape(-1, 9) if batch.column(2)[i].is_valid else None
                oy = batch.column(3)[i].as_py()
                x, y = backwards(ox + 0.5, np.full(g.width, oy + 0.5), g, knots, batch.column(1)[i].as_py())
                black = np.isnan(x) | np.isnan(y)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(g.width, batch.column(0)[i].as_py())), pa.array(np.full(g.width, oy, np.int32)), pa.array(ox), pa.array(x - 0.5, mask=black), pa.array(y - 0.5, mask=black)],
                    names=["img", "oy", "ox", "px", "py"])

    return rows.mapInArrow(run, "img bigint, oy int, ox int, px double, py double")


def widening(images: DataFrame, g: Geometry, warps: DataFrame | None = None) -> tuple[float, float]:
    """How far the kernel is widened: recorded pixels for one output pixel at the frame's centre, one pair for all images.

    The zoom differs little between a clip's frames; the largest one counts.
    """
    if g.resampler == "bilinear":
        return 1.0, 1.0
    frames = with_warps(images.select(F.col("img").cast("bigint").alias("img")).distinct(), g, warps)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                knots = np.array(batch.column(2)[i].as_py(), float).reshape(-1, 9) if batch.column(2)[i].is_valid else None
                x, y = backwards(0.5 * g.width + np.array([0.0, 1, 0]), 0.5 * g.height + np.array([0.0, 0, 1]), g, knots, batch.column(1)[i].as_py())
                # Beside the centre and below it: how far the recorded position moves.
                moved = [float(np.hypot(v[1] - v[0], v[2] - v[0])) for v in (x, y)]
                k = [min(m, 16.0) if np.isfinite(m) and m > 1.001 else 1.0 for m in moved]
                yield pa.RecordBatch.from_arrays([pa.array([k[0]]), pa.array([k[1]])], names=["kx", "ky"])

    top = frames.select("img", "zoom", "knots").mapInArrow(run, "kx double, ky double").agg(F.max("kx").alias("kx"), F.max("ky").alias("ky")).first()  # one row
    return top.kx or 1.0, top.ky or 1.0


def colour_chain(pixels: DataFrame, look: Look) -> DataFrame:
    """The colour chain on columns r, g, b, from planes above the pedestal to code values.

    Every stage is a projection of its own: a stage uses its inputs several
    times, and one expression for all would multiply.
    """
    def stage(df: DataFrame, values: tone.RGB, **more) -> DataFrame:
        return df.withColumns({**dict(zip("rgb", values)), **more})

    rgb = F.col("r"), F.col("g"), F.col("b")
    top = max(look.gains)
    df = stage(pixels, tone.remove_pedestal(rgb, PEDESTAL, top))
    df = stage(df, tone.recover_highlights(rgb, look.gains) if look.recover else tone.clip_highlights(rgb, min(look.gains)))
    df = stage(df, tone.apply_matrix(rgb, look.matrix, 2.0**look.exposure))
    df = df.withColumn("__y", tone.luminance(rgb, look.luminance))
    toned, y = tone.tone(rgb, F.col("__y"), look.contrast, look.midtones, look.highlights, look.shadows)
    df = stage(df, toned, __y=y)
    df = stage(df, tone.saturate(rgb, F.col("__y"), look.saturation, look.boost)).drop("__y")
    if look.gamut:
        df = stage(df, tone.compress_gamut(rgb))
    if look.shoulder:
        df = stage(df, tone.shoulder(rgb))
    return stage(df, tone.finish(rgb, look.curve, look.lift, look.gain, look.soft_clip))


def sample(three: DataFrame, seen: DataFrame, g: Geometry, scale: tuple[float, float]) -> DataFrame:
    """Columns r, g, b of the planes r0, r1, r2 at ``seen`` positions, by the geometry's kernel."""
    plain = g.resampler == "bilinear" or g.place.nearest
    found = raster.sample_kernel(three, seen, ["r0", "r1", "r2"], "bilinear" if plain else g.resampler, *scale, area=None if plain else g.crop)
    return found.select("img", "oy", "ox", "px", "py", *[F.col(f"r{k}").alias(c) for k, c in enumerate("rgb")])


def framed(at: DataFrame, done: DataFrame) -> DataFrame:
    """All output pixels, black where nothing was seen: img, y, x, r, g, b."""
    out = at.select("img", "oy", "ox").join(done.select("img", "oy", "ox", "r", "g", "b"), ["img", "oy", "ox"], "left")
    return out.select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"])


def develop_with(mosaics: DataFrame, look: Look, g: Geometry, warps: DataFrame | None = None) -> DataFrame:
    """Output pixels of every image: img, y, x, r, g, b; black outside the picture.

    Geometry is composed into one position for each output pixel, and the
    picture is sampled once there. Sharpening compares the sample with a blur of
    the recorded picture at the same place.
    """
    three = planes(mosaics, look)
    at = recorded(three, g, warps)
    seen = at.where("px IS NOT NULL")
    done = sample(three, seen, g, widening(three, g, warps))
    if look.sharpen:
        soft = None
        for k in range(3):
            one = raster.apply_kernel(three.select("img", "y", F.col(f"r{k}").alias("r")), lambda a: 2 * a - kernels.unsharp(a, 1.0), "unsharp").withColumnRenamed("r0", f"s{k}")
            soft = one if soft is None else soft.join(one, ["img", "y"])
        near = sample(soft.select("img", "y", *[F.col(f"s{k}").alias(f"r{k}") for k in range(3)]), seen, replace(g, resampler="bilinear"), (1.0, 1.0))
        near = near.select("img", "oy", "ox", *[F.col(c).alias(f"soft_{c}") for c in "rgb"])
        done = done.join(near, ["img", "oy", "ox"])
        done = done.withColumns({c: F.col(c) + look.sharpen * (F.col(c) - F.col(f"soft_{c}")) for c in "rgb"}).drop(*[f"soft_{c}" for c in "rgb"])
    return framed(at, colour_chain(done.drop("px", "py"), look))


def develop(mosaics: DataFrame, look: Look, width: int, height: int, place: geometry.Placement, crop: tuple[int, int, int, int], transform: list[float] | None = None) -> DataFrame:
    """`develop_with` for a placement and a transform alone, sampled bilinearly."""
    return develop_with(mosaics, look, Geometry(width, height, place, crop, transform))


def pass_through(pictures: DataFrame, g: Geometry, warps: DataFrame | None = None, vignette: tuple[float, float, float, tuple[float, float, float, float]] | None = None, curve: str = "rec709") -> DataFrame:
    """A picture in colour (img, y, r0, r1, r2) through the geometry alone: img, y, x, r, g, b.

    ``vignette`` is (centre x, y, 1 / radius, four coefficients); its gain acts
    in linear light where a pixel was recorded, and ``curve`` says how code
    values are to be decoded.
    """
    at = recorded(pictures, g, warps)
    done = sample(pictures, at.where("px IS NOT NULL"), g, widening(pictures, g, warps))
    if vignette is not None:
        gain = tone.vignette_gain(F.col("px") + 0.5, F.col("py") + 0.5, *vignette)
        done = done.withColumn("__gain", gain)
        done = done.withColumns({c: tone.remove_vignette(F.col(c), F.col("__gain"), curve) for c in "rgb"})
    return framed(at, done)
