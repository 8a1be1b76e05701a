"""Pictures as relations, and kernels over bands of rows.

A picture is a relation of rows ``(img, y, r array<double>)``. A kernel runs on
bands: each row is sent to the bands that need it, a band being an even number
of rows with the kernel's halo around it, so tasks share no picture and a frame
of any size is dealt over many of them. Bands at a picture's edge end there and
the kernel mirrors or repeats; elsewhere the halo makes edges invisible.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.functions import kernels
from kinegrain.functions.kernels import HALO

#: Rows of a band without its halo; even, so that the mosaic's phase is kept.
BAND_ROWS = 128


def bands(rows: DataFrame, halo: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows with the band they belong to or border on; the halo is rounded up to even."""
    halo += halo % 2
    band = F.explode(F.sequence(F.floor(F.greatest(F.col("y") - halo, F.lit(0)) / band_rows), F.floor((F.col("y") + halo) / band_rows)))
    return rows.select("img", "y", "r", band.alias("band"))


def apply_kernel(rows: DataFrame, kernel: Callable[..., np.ndarray | tuple], halo: int | str, planes: int = 1, band_rows: int = BAND_ROWS) -> DataFrame:
    """Run ``kernel(picture)`` and give ``(img, y, r0, r1, ..)`` rows, one array for each plane.

    A picture's rows must have one length. Bands beyond the last row make no
    rows. An empty relation gives none.
    """
    reach = HALO[halo] if isinstance(halo, str) else halo
    names = [f"r{k}" for k in range(planes)]

    def run(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        img = group.column("img")[0]
        order = np.argsort(group.column("y").to_numpy(), kind="stable")
        y = group.column("y").to_numpy()[order]
        picture = np.stack([group.column("r")[int(i)].values.to_numpy() for i in order])
        out = kernel(picture)
        out = out if isinstance(out, tuple) else (out,)
        keep = np.flatnonzero((y >= band * band_rows) & (y < (band + 1) * band_rows))
        arrays = [pa.array([p[i] for i in keep], pa.list_(pa.float64())) for p in out]
        return pa.table([pa.array([img.as_py()] * len(keep), pa.int64()), pa.array(y[keep]), *arrays], names=["img", "y", *names])

    schema = "img bigint, y bigint, " + ", ".join(f"{n} array<double>" for n in names)
    return bands(rows, reach, band_rows).groupBy("img", "band").applyInArrow(run, schema)


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Vectors as the rows of one picture."""
    return embeddings.select(
        F.lit(0).cast("bigint").alias("img"), F.col("vec_id").cast("bigint").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("r"))


def pixels(rows: DataFrame, plane: str = "r0", name: str = "v") -> DataFrame:
    """A row per pixel: img, y, x, value."""
    return rows.select("img", "y", F.posexplode(plane).alias("x", name))


def neighbours(rows: DataFrame, above: int, below: int) -> DataFrame:
    """Rows with ``near``: the arrays of the rows around, and ``at``: the own place among them.

    The picture is one ordered partition of rows; a kernel over it is then a
    projection, for pictures small enough that a clip's rows fit a task.
    """
    w = Window.partitionBy("img").orderBy("y").rowsBetween(-above, below)
    return rows.withColumn("near", F.collect_list("r").over(w)).withColumn(
        "at", F.least(F.row_number().over(Window.partitionBy("img").orderBy("y")) - 1, F.lit(above)))


def sample_points(rows: DataFrame, points: DataFrame, plane: str = "r") -> DataFrame:
    """Bilinear values ``v`` of (img, px, py) pixel-index positions, edges repeated.

    Each point meets its two rows in an equi-join; the columns are array
    elements. Points keep all their columns.
    """
    size = rows.groupBy("img").agg(F.max("y").alias("last_y"), F.max(F.size(plane)).alias("w"))
    p = points.join(size, "img")
    y0, x0 = F.floor("py"), F.floor("px")
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    p = p.select(
        *points.columns, (F.col("py") - y0).alias("ty"), (F.col("px") - x0).alias("tx"),
        hold(y0, F.col("last_y")).alias("ya"), hold(y0 + 1, F.col("last_y")).alias("yb"),
        (hold(x0, F.col("w") - 1) + 1).cast("int").alias("xa"), (hold(x0 + 1, F.col("w") - 1) + 1).cast("int").alias("xb"))
    a = rows.select("img", F.col("y").alias("ya"), F.col(plane).alias("ra"))
    b = rows.select("img", F.col("y").alias("yb"), F.col(plane).alias("rb"))
    p = p.join(a, ["img", "ya"]).join(b, ["img", "yb"])
    mix = lambda r: F.element_at(r, F.col("xa")) * (1 - F.col("tx")) + F.element_at(r, F.col("xb")) * F.col("tx")
    return p.select(*points.columns, (mix("ra") * (1 - F.col("ty")) + mix("rb") * F.col("ty")).alias("v"))


def sample_kernel(rows: DataFrame, points: DataFrame, planes: list[str], kind: str, kx: float = 1.0, ky: float = 1.0, area: tuple[int, int, int, int] | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """Values of several planes at (img, px, py) pixel-index positions by a windowed kernel or ``bilinear``, as columns named like the planes.

    ``area`` (x, y, width, height) is the part of the picture that is read; its
    edge repeats beyond it. Points meet the rows their taps need band by band,
    so a task holds one band and its halo. Points keep all their columns.
    """
    reach = min(int(np.ceil((3 if kind == "lanczos3" else 2) * max(ky, 1.0))), 32) + 1
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    out_schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in points.schema] + [(p, pa.float64()) for p in planes])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        y = right.column("y").to_numpy()
        order = np.argsort(y, kind="stable")
        px, py = left.column("px").to_numpy(), left.column("py").to_numpy()
        found = []
        for p in planes:
            column = right.column(p)
            picture = np.stack([column[int(i)].values.to_numpy() for i in order])
            x0 = 0
            if area:
                x0, picture = area[0], picture[:, area[0]: area[0] + area[2]]
            y0 = float(y.min())
            values = kernels.bilinear(picture, px - x0, py - y0) if kind == "bilinear" else kernels.resample(picture, px + 0.5 - x0, py + 0.5 - y0, kind, kx, ky)
            found.append(pa.array(values))
        keep = [left.column(n) for n in out_schema.names[: len(out_schema.names) - len(planes)]]
        return pa.table([*keep, *found], schema=out_schema)

    if area:
        rows = rows.where((F.col("y") >= area[1]) & (F.col("y") < area[1] + area[3]))
    size = rows.groupBy("img").agg(F.min("y").alias("__first"), F.max("y").alias("__last"))
    # Beyond the picture the taps repeat its edge, which lies in the first or last band.
    place = points.join(size, "img").withColumn("__band", F.floor(F.least(F.greatest(F.floor("py"), F.col("__first")), F.col("__last")) / band_rows))
    near = rows.withColumn("__band", F.explode(F.sequence(F.floor((F.col("y") - reach) / band_rows), F.floor((F.col("y") + reach) / band_rows))))
    left = place.select(*points.columns, F.col("img").alias("__img"), "__band").groupBy("__img", "__band")
    right = near.select(F.col("img").alias("__img"), "__band", "y", *planes).groupBy("__img", "__band")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema] + [f"{p} double" for p in planes])
    return left.cogroup(right).applyInArrow(run, ddl)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest and mean absolute difference of two pixel relations, and their non-finite values."""
    both = a.select("img", "y", "x", F.col("v").alias("va")).join(b.select("img", "y", "x", F.col("v").alias("vb")), ["img", "y", "x"])
    d = F.abs(F.col("va") - F.col("vb"))
    bad = F.isnan("va") | F.isnan("vb") | F.col("va").isNull() | F.col("vb").isNull()
    return both.agg(F.max(d).alias("largest"), F.avg(d).alias("mean"), F.count_if(bad).alias("not_finite"))
