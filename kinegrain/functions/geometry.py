"""Maps between output, fitted frame, stabilised and recorded positions, as columns.

A map takes and gives a pair of columns; maps compose into one projection, so
a picture is sampled once at the end of the chain. Outside a map's domain the
result is null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
#: Rotations along a frame's readout.
KNOTS = 33


@dataclass(frozen=True)
class Transform:
    """Host controls; angles in degrees, positions in pixels, y up."""

    zoom_x: float = 1.0
    zoom_y: float = 1.0
    pos_x: float = 0.0
    pos_y: float = 0.0
    rotation: float = 0.0
    anchor_x: float = 0.0
    anchor_y: float = 0.0
    pitch: float = 0.0
    yaw: float = 0.0
    flip_h: bool = False
    flip_v: bool = False


@dataclass(frozen=True)
class Placement:
    """Scale and offset of a frame in the output, and whether it lands on pixel centres exactly."""

    scale_x: float
    scale_y: float
    off_x: float
    off_y: float
    nearest: bool


def place(crop_w: int, crop_h: int, out_w: int, out_h: int, fit: str = "fit", comp_w: int = 0, comp_h: int = 0, render: tuple[float, float] = (1.0, 1.0)) -> Placement:
    """How a frame fits an output: ``fit``, ``fill``, ``stretch``, ``native``, ``width`` or ``height``."""
    x, y = out_w / crop_w, out_h / crop_h
    scale = {
        "fill": (max(x, y),) * 2, "stretch": (x, y), "native": render, "width": ((comp_w or out_w) / crop_w,) * 2,
        "height": ((comp_h or out_h) / crop_h,) * 2}.get(fit, (min(x, y),) * 2)
    off = (out_w - crop_w * scale[0]) / 2, (out_h - crop_h * scale[1]) / 2
    whole = all(abs(o - round(o)) < 1e-4 for o in off)
    return Placement(*scale, *off, all(abs(s - 1) < 1e-6 for s in scale) and whole)


def multiply(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def inverse(m: list[float]) -> list[float] | None:
    """Inverse of a 3 x 3 matrix, or None where there is none."""
    minor = lambda r, c: m[3 * ((r + 1) % 3) + (c + 1) % 3] * m[3 * ((r + 2) % 3) + (c + 2) % 3] - m[3 * ((r + 1) % 3) + (c + 2) % 3] * m[3 * ((r + 2) % 3) + (c + 1) % 3]
    det = sum(m[c] * minor(0, c) for c in range(3))
    if abs(det) < 1e-12:
        return None
    return [minor(c, r) / det for r in range(3) for c in range(3)]


def transform_matrix(t: Transform, width: float, render: tuple[float, float] = (1.0, 1.0)) -> list[float] | None:
    """Output to fitted frame, both centred with y up; None for the neutral transform.

    Forward: flips, then about the anchor zoom, rotation and a perspective seen
    from one frame width away, then the position.
    """
    if t == Transform():
        return None
    ax, ay = t.anchor_x * render[0], t.anchor_y * render[1]
    c, s = math.cos(math.radians(t.rotation)), math.sin(math.radians(t.rotation))
    cp, sp = math.cos(math.radians(t.pitch)), math.sin(math.radians(t.pitch))
    cy, sy = math.cos(math.radians(t.yaw)), math.sin(math.radians(t.yaw))
    chain = [
        [-1.0 if t.flip_h else 1.0, 0, 0, 0, -1.0 if t.flip_v else 1.0, 0, 0, 0, 1],
        [1, 0, -ax, 0, 1, -ay, 0, 0, 1],
        [t.zoom_x, 0, 0, 0, t.zoom_y, 0, 0, 0, 1],
        [c, -s, 0, s, c, 0, 0, 0, 1]]
    if t.pitch or t.yaw:
        chain.append([width * cy, -width * sy * sp, 0, 0, width * cp, 0, sy, cy * sp, width])
    chain.append([1, 0, ax + t.pos_x * render[0], 0, 1, ay + t.pos_y * render[1], 0, 0, 1])
    m = chain[0]
    for step in chain[1:]:
        m = multiply(step, m)
    back = inverse(m)
    if back is None:
        return [0, 0, 1e9, 0, 0, 1e9, 0, 0, 1]
    return [-v for v in back] if back[8] < 0 else back


def through_transform(p: Point, m: list[float], width: float, height: float) -> Point:
    """Output position (y down) to the fitted frame; null behind the viewer."""
    u, v = p[0] - 0.5 * width, 0.5 * height - p[1]
    row = lambda i: u * m[3 * i] + v * m[3 * i + 1] + m[3 * i + 2]
    w = F.when(row(2) > 1e-6, row(2))
    return row(0) / w + 0.5 * width, 0.5 * height - row(1) / w


def through_placement(p: Point, q: Placement, crop_x: float = 0.0, crop_y: float = 0.0) -> Point:
    return (p[0] - q.off_x) / q.scale_x + crop_x, (p[1] - q.off_y) / q.scale_y + crop_y


def through_lens(p: Point, cx: float, cy: float, radius: float, c: list[float]) -> Point:
    """Corrected position to the recorded one by a radial polynomial of degree 6."""
    dx, dy = (p[0] - cx) / radius, (p[1] - cy) / radius
    r = F.sqrt(dx * dx + dy * dy)
    f: Column = F.lit(c[6])
    for k in reversed(c[:6]):
        f = f * r + k
    return dx * f * radius + cx, dy * f * radius + cy


@dataclass(frozen=True)
class Warp:
    """Stabilising warp of a frame: focal length and centre in pixels, rows of the readout, zoom."""

    focal: float
    cx: float
    cy: float
    rows: float
    zoom: float = 1.0
    row0: float = 0.0
    rounds: int = field(default=3)


def through_warp(p: Point, w: Warp, knots: Column) -> Point:
    """Stabilised position to the recorded one; null behind the camera.

    ``knots`` is an array of 33 arrays of 9: the rotation at points of the
    readout. The row a point was read at is found in three rounds.
    """
    px, py = (p[0] - w.cx) / w.zoom, (p[1] - w.cy) / w.zoom
    start = F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))

    def one(acc: Column, _: Column) -> Column:
        row = F.least(F.greatest((acc["y"] - w.row0) / w.rows * (KNOTS - 1), F.lit(0.0)), F.lit(float(KNOTS - 1)))

        def project(at: Column) -> Column:
            k = F.least(F.floor(at), F.lit(KNOTS - 2)).cast("int")
            turn = F.zip_with(F.get(knots, k), F.get(knots, k + 1), lambda a, b: a + (at - k) * (b - a))

            def ray(m: Column) -> Column:
                q = [F.get(m, F.lit(3 * i)) * px + F.get(m, F.lit(3 * i + 1)) * py + F.get(m, F.lit(3 * i + 2)) * w.focal for i in range(3)]
                depth = F.when(q[2] >= 1e-3 * w.focal, q[2])
                return F.struct((q[0] / depth * w.focal + w.cx).alias("x"), (q[1] / depth * w.focal + w.cy).alias("y"))

            return F.get(F.transform(F.array(turn), ray), F.lit(0))

        # A one-element array gives a value a name, so that a round does not multiply the expression.
        return F.get(F.transform(F.array(row), project), F.lit(0))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(w.rounds)), start, one)
    return out["x"], out["y"]


def transform_points(x: np.ndarray, y: np.ndarray, m: list[float], width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """`through_transform` for arrays; NaN behind the viewer."""
    h = np.array(m, float).reshape(3, 3) @ np.stack((x - 0.5 * width, 0.5 * height - y, np.ones_like(x)))
    w = np.where(h[2] > 1e-6, h[2], np.nan)
    return h[0] / w + 0.5 * width, 0.5 * height - h[1] / w


def lens_points(x: np.ndarray, y: np.ndarray, cx: float, cy: float, radius: float, c: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """`through_lens` for arrays."""
    dx, dy = (x - cx) / radius, (y - cy) / radius
    f = np.polynomial.polynomial.polyval(np.hypot(dx, dy), c)
    return dx * f * radius + cx, dy * f * radius + cy


def warp_points(x: np.ndarray, y: np.ndarray, w: Warp, knots: np.ndarray, inv_zoom: float) -> tuple[np.ndarray, np.ndarray]:
    """`through_warp` for arrays of one frame; NaN behind the camera."""
    ray = np.stack(((x - w.cx) * inv_zoom, (y - w.cy) * inv_zoom, np.full_like(x, w.focal)), axis=-1)
    turns = np.asarray(knots, float).reshape(KNOTS, 3, 3)
    for _ in range(w.rounds):
        at = np.clip(np.nan_to_num((y - w.row0) / w.rows * (KNOTS - 1)), 0, KNOTS - 1)
        k = np.minimum(at.astype(np.int64), KNOTS - 2)
        turn = turns[k] + (at - k)[:, None, None] * (turns[k + 1] - turns[k])
        q = np.einsum("nij,nj->ni", turn, ray)
        depth = np.where(q[:, 2] >= 1e-3 * w.focal, q[:, 2], np.nan)
        x, y = q[:, 0] / depth * w.focal + w.cx, q[:, 1] / depth * w.focal + w.cy
    return x, y


def inside(p: Point, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a position lies in [x0, x1) x [y0, y1); a null position does not."""
    return F.coalesce((p[0] >= x0) & (p[1] >= y0) & (p[0] < x1) & (p[1] < y1), F.lit(False))


def widening(a: Point, right: Point, below: Point) -> tuple[Column, Column]:
    """Source pixels for one output pixel, from a position and its neighbours; 1 within 0.1 %, at most 16."""
    def one(k: int) -> Column:
        d = F.sqrt((right[k] - a[k]) * (right[k] - a[k]) + (below[k] - a[k]) * (below[k] - a[k]))
        return F.when(d > 1.001, F.least(d, F.lit(16.0))).otherwise(F.lit(1.0))

    return one(0), one(1)
