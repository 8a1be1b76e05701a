"""Virtual camera and automatic zoom of a clip.

Everything here follows from one clip's frames in order, so a clip is one
group; over the frames of a clip the arithmetic is vectorised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.functions.geometry import KNOTS
from kinegrain.operators.motion import product, rolling, unit

#: Largest automatic zoom.
CEILING = 4.0
#: Frames smoothed together.
BLOCK = 64
#: Border points on each side of the picture.
PER_SIDE = 8


@dataclass(frozen=True)
class Lens:
    """Raster, active area and focal length in pixels."""

    raster_w: float
    raster_h: float
    x: float
    y: float
    w: float
    h: float
    focal: float


@dataclass(frozen=True)
class Settings:
    """The library's defaults; the plug-in's differ and are passed by its callers."""

    smoothness: float = 0.5
    rolling_shutter: float = 1.0
    auto_zoom: bool = True
    max_zoom: float = 1.3
    dynamic: bool = False
    zoom_smooth: float = 4.0
    readout_s: float = 0.0
    fps: float = 25.0
    first: int = 0
    last: int = -1
    ends_early: bool = False


def conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1, -1, -1])


def blend(a: np.ndarray, b: np.ndarray, share) -> np.ndarray:
    """Normalised mix of orientations, along the shorter way."""
    b = np.where(((a * b).sum(axis=-1) < 0)[..., None], -b, b)
    return unit(a + np.asarray(share)[..., None] * (b - a))


def matrices(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of unit quaternions, (..., 3, 3)."""
    w, x, y, z = np.moveaxis(q, -1, 0)
    return np.stack((
        np.stack((1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)), -1),
        np.stack((2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)), -1),
        np.stack((2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)), -1)), -2)


def orientation_at(samples: np.ndarray, rate: float, t: np.ndarray) -> np.ndarray:
    """Orientation at any time: the two samples around it mixed, held at the ends."""
    s = np.clip(np.asarray(t) * rate, 0, len(samples) - 1)
    i = np.minimum(s.astype(np.int64), len(samples) - 2)
    return blend(samples[i], samples[i + 1], s - i)


def smooth_path(t: np.ndarray, q: np.ndarray, sigma: float, first: int, last: int, past_start: bool = False, past_end: bool = False) -> np.ndarray:
    """Gaussian mean of orientations within three sigma, inside each piece of the clip.

    Frame times must rise. The used range may look past its ends.
    """
    n = len(t)
    if not sigma > 1e-6:
        return q.copy()
    out = np.empty_like(q)
    pieces = [(0, first - 1), (first, last), (last + 1, n - 1)]
    for k, (a, b) in enumerate(pieces):
        if a > b:
            continue
        lo = 0 if k == 1 and past_start else a
        hi = n - 1 if k == 1 and past_end else b
        left = np.maximum(np.searchsorted(t, t[a: b + 1] - 3 * sigma, side="left"), lo)
        right = np.minimum(np.searchsorted(t, t[a: b + 1] + 3 * sigma, side="right"), hi + 1)
        for i in range(a, b + 1, BLOCK):
            j = min(i + BLOCK, b + 1)
            x, y = left[i - a], right[j - 1 - a]
            at = np.arange(x, y)
            w = np.exp(-0.5 * ((t[x:y] - t[i:j, None]) / sigma) ** 2)
            w *= np.where(q[i:j] @ q[x:y].T < 0, -1.0, 1.0)
            w *= (at >= left[i - a: j - a, None]) & (at < right[i - a: j - a, None])
            out[i:j] = w @ q[x:y]
    return unit(out)


class Clip:
    """A clip's frames: times, orientations, which have data, and how they map."""

    def __init__(self, samples: np.ndarray, rate: float, t: np.ndarray, valid: np.ndarray, lens: Lens, s: Settings) -> None:
        self.samples, self.rate, self.t, self.valid, self.lens, self.s = samples, rate, np.asarray(t, float), np.asarray(valid, bool), lens, s
        self.n = len(self.t)
        last = self.n - 1
        a, b = (min(max(v, 0), last) for v in (s.first, s.last if s.last >= 0 else last))
        self.first, self.last = (a, b) if a <= b and s.last >= 0 else (0, last)
        self.actual = orientation_at(samples, rate, self.t)
        u = np.arange(PER_SIDE) / PER_SIDE
        x0, y0, x1, y1 = lens.x, lens.y, lens.x + lens.w, lens.y + lens.h
        self.border = np.concatenate([np.stack(p, axis=1) for p in (
            (x0 + u * (x1 - x0), np.full(PER_SIDE, y0)), (np.full(PER_SIDE, x1), y0 + u * (y1 - y0)),
            (x1 - u * (x1 - x0), np.full(PER_SIDE, y1)), (np.full(PER_SIDE, x0), y1 - u * (y1 - y0)))])

    def rotations(self, i: np.ndarray, rs: np.ndarray, virtual: np.ndarray) -> np.ndarray:
        """33 rotations of each frame along its readout: real camera at that time from the virtual one."""
        k = np.arange(KNOTS) / (KNOTS - 1) - 0.5
        real = orientation_at(self.samples, self.rate, self.t[i][:, None] + (np.asarray(rs) * self.s.readout_s)[:, None] * k[None, :])
        return matrices(unit(product(conj(real), virtual[:, None, :])))

    def fits(self, rot: np.ndarray, zoom: np.ndarray) -> np.ndarray:
        """Whether all border points of the picture are recorded, for each frame."""
        g = self.lens
        cx, cy = g.raster_w / 2, g.raster_h / 2
        p = (self.border[None] - [cx, cy]) / np.asarray(zoom)[:, None, None]
        ray = np.concatenate((p, np.full(p.shape[:2] + (1,), g.focal)), axis=-1)
        y = np.broadcast_to(self.border[None, :, 1], p.shape[:2]).copy()
        x = np.zeros_like(y)
        front = np.ones(y.shape, bool)
        for _ in range(3):
            at = np.clip(y / g.raster_h * (KNOTS - 1), 0, KNOTS - 1)
            k = np.minimum(at.astype(int), KNOTS - 2)
            frame = np.arange(len(rot))[:, None]
            m = rot[frame, k] + (at - k)[..., None, None] * (rot[frame, k + 1] - rot[frame, k])
            q = np.einsum("fpij,fpj->fpi", m, ray)
            front &= q[..., 2] >= 1e-3 * g.focal
            depth = np.where(front, q[..., 2], 1)
            x, y = cx + g.focal * q[..., 0] / depth, cy + g.focal * q[..., 1] / depth
        held = front & (x >= g.x) & (y >= g.y) & (x <= g.x + g.w) & (y <= g.y + g.h)
        return held.all(axis=1)

    def need(self, i: np.ndarray, rs: np.ndarray, virtual: np.ndarray, limit: float, halvings: int) -> tuple[np.ndarray, np.ndarray]:
        """(smallest zoom that hides the borders, whether even ``limit`` does not) of frames."""
        rot = self.rotations(i, rs, virtual)
        zoom, over = np.ones(len(i)), np.zeros(len(i), bool)
        # Only frames whose borders show at all, and can be hidden, are searched.
        todo = np.flatnonzero(~self.fits(rot, zoom))
        if len(todo):
            hidden = self.fits(rot[todo], np.full(len(todo), limit))
            over[todo], zoom[todo] = ~hidden, limit
            todo = todo[hidden]
        if len(todo):
            rot = rot[todo]
            low, high = np.ones(len(todo)), np.full(len(todo), limit)
            for _ in range(halvings):
                mid = 0.5 * (low + high)
                good = self.fits(rot, mid)
                high, low = np.where(good, mid, high), np.where(good, low, mid)
            zoom[todo] = high
        return zoom, over

    def share(self, i: np.ndarray, good, halvings: int = 10, top: float | np.ndarray = 1.0) -> np.ndarray:
        """Largest share up to ``top`` for which ``good(frames, share)`` holds, by halving."""
        low, high = np.zeros(len(i)), np.broadcast_to(np.asarray(top, float), (len(i),)).copy()
        for _ in range(halvings):
            mid = 0.5 * (low + high)
            ok = good(i, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid)
        return low

    def choose_path(self, limit: float) -> tuple[np.ndarray, bool, bool]:
        """The smoothing at the ends of the range that needs the least zoom, the first of equals."""
        s, best = self.s, None
        if self.first == 0 and self.last == self.n - 1:
            # The range has no ends inside the clip, so there is nothing to choose.
            return smooth_path(self.t, self.actual, s.smoothness, self.first, self.last), False, False
        inside = np.flatnonzero(self.valid & (np.arange(self.n) >= self.first) & (np.arange(self.n) <= self.last))
        for end in (False, True):
            for start in (False, True):
                if (start and self.first == 0) or (end and self.last == self.n - 1):
                    continue
                path = smooth_path(self.t, self.actual, s.smoothness, self.first, self.last, start, end)
                zoom, over = self.need(inside, np.full(len(inside), s.rolling_shutter), path[inside], limit, 10) if len(inside) else (np.ones(1), np.zeros(1, bool))
                top = zoom[~over].max(initial=1.0)
                cost = int(over.sum()) * 1_000_000 + int(np.floor((top - 1) * 10_000 + 0.5))
                if best is None or cost < best[0]:
                    best = (cost, path, start, end)
        return best[1], best[2], best[3]

    def solve(self) -> dict[str, np.ndarray | float]:
        """Virtual orientation, zoom and rolling-shutter share of every frame, and the zoom's statistics."""
        s, n = self.s, self.n
        limit, rs = float(np.clip(s.max_zoom, 1, CEILING)), float(np.clip(s.rolling_shutter, -1, 1))
        path, past_start, past_end = self.choose_path(limit)
        frames = np.arange(n)
        inside = (frames >= self.first) & (frames <= self.last)
        zoom, amount, virtual = np.ones(n), np.full(n, rs), path.copy()
        limited, high, low, mean = 0, 1.0, 1.0, 1.0
        if s.auto_zoom and self.lens.focal > 0:
            used = np.flatnonzero(inside & self.valid)
            reduce = np.zeros(n, bool)
            need = np.ones(n)
            if len(used):
                need[used], reduce[used] = self.need(used, amount[used], path[used], limit, 12 if s.dynamic else 14)
            if s.dynamic:
                w = max(1, int(np.floor(np.clip(s.zoom_smooth, 0.1, 60) * s.fps + 0.5)))
                part = need[self.first: self.last + 1]
                top = np.maximum(1, rolling(part, w, np.nanmax))
                g = np.exp(-0.5 * (np.arange(-w, w + 1) / (0.5 * w)) ** 2)
                num, den = np.convolve(top, g), np.convolve(np.ones(len(top)), g)
                zoom[self.first: self.last + 1] = (num / den)[w: w + len(top)]
                zoom[: self.first], zoom[self.last + 1:] = zoom[self.first], zoom[self.last]
            else:
                zoom[:] = limit if reduce.any() else need[used].max(initial=1.0)
            span = zoom[self.first: self.last + 1]
            high, low, mean = max(1.0, float(span.max())), min(CEILING, float(span.min())), float(span.mean())
            outside = np.flatnonzero(~inside & self.valid)
            if len(outside):
                reduce[outside] = ~self.fits(self.rotations(outside, amount[outside], path[outside]), zoom[outside])
            todo = np.flatnonzero(reduce)
            if len(todo):
                share, part_rs = np.ones(n), np.ones(n)
                share[todo] = self.share(todo, lambda i, a: self.fits(self.rotations(i, amount[i], blend(self.actual[i], path[i], a)), zoom[i]))
                stuck = todo[share[todo] <= 0]
                if len(stuck):
                    part_rs[stuck] = self.share(stuck, lambda i, a: self.fits(self.rotations(i, rs * a, self.actual[i]), zoom[i]))
                k = max(1, int(np.floor(0.4 * s.fps + 0.5)))
                for a, b in ((0, self.first), (self.first, self.last + 1), (self.last + 1, n)):
                    if a < b:
                        share[a:b], part_rs[a:b] = (rolling(rolling(v[a:b], k, np.nanmin), k, np.nanmean) for v in (share, part_rs))
                amount = rs * part_rs
                less = share < 1
                virtual[less] = blend(self.actual[less], path[less], share[less])
                limited = int((less & inside).sum())
        if (s.ends_early or not self.valid.all()) and n > 1:
            virtual, zoom, amount = self.fade(virtual, zoom, amount)
        return {"virtual": virtual, "zoom": zoom, "shutter": amount, "limited": limited, "low": low, "mean": mean, "high": high, "past_start": past_start, "past_end": past_end}

    def warps(self, solved: dict, manual: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether on, 1 / zoom, 33 rotations as rows of 9) of every frame, for `geometry.through_warp`.

        A frame without data keeps its picture, with the manual zoom alone.
        """
        manual = float(np.clip(manual, 0.1, 10.0))
        every = np.arange(self.n)
        knots = self.rotations(every, solved["shutter"], solved["virtual"]).reshape(self.n, KNOTS, 9)
        knots[~self.valid] = np.eye(3).ravel()
        zoom = np.where(self.valid, solved["zoom"] * manual, manual)
        on = (self.valid | (manual != 1.0)) & (self.lens.focal > 0)
        return on, 1 / zoom, knots

    def fade(self, virtual: np.ndarray, zoom: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bring zoom and correction to none over the second beside frames without data."""
        n, s = self.n, self.s
        length = min(n - 1, max(1, int(np.floor((s.fps if s.fps > 1 else 25) + 0.5))))
        bad = np.flatnonzero(~self.valid)
        if s.ends_early:
            bad = np.append(bad, n)
        frames = np.arange(n)
        at = np.searchsorted(bad, frames)
        after = np.where(at < len(bad), bad[np.minimum(at, len(bad) - 1)] - frames, n + length)
        before = np.where(at > 0, frames - np.append(bad, 0)[at - 1], n + length)
        before[~self.valid] = after[~self.valid] = 0
        distance = np.minimum(np.minimum(after, before), n + length)
        i = np.flatnonzero(distance <= length)
        u = np.maximum(distance[i] - 1, 0) / length
        g = u * u * (3 - 2 * u)
        z = 1 + (zoom[i] - 1) * g
        if s.auto_zoom and self.lens.focal > 0 and len(i):
            good = lambda j, a, zz: self.fits(self.rotations(j, amount[j] * a, blend(self.actual[j], virtual[j], a)), zz)
            tight = np.flatnonzero((g > 0) & ~good(i, g, z))
            if len(tight):
                g[tight] = self.share(i[tight], lambda j, a: good(j, a, z[tight]), top=g[tight])
        virtual, zoom, amount = virtual.copy(), zoom.copy(), amount.copy()
        virtual[i], zoom[i], amount[i] = blend(self.actual[i], virtual[i], g), z, amount[i] * g
        return virtual, zoom, amount


def _per_clip(clips: DataFrame, samples: DataFrame, rate: float, lens: Lens, settings: Settings, rows, schema: str) -> DataFrame:
    """Solve each clip and give ``rows(clip, solution)``, a dict of columns, beside its clip and frame numbers."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        f, q = left.to_pandas().sort_values("frame"), right.to_pandas().sort_values("i")
        if len(q) < 2 or not len(f):
            return empty
        clip = Clip(q[list("wxyz")].to_numpy(), rate, f["t"].to_numpy(), f["valid"].to_numpy(), lens, settings)
        out = {"clip": pa.array(f["clip"].to_numpy()), "frame": pa.array(f["frame"].to_numpy()), **rows(clip, clip.solve())}
        return pa.table([out[n] for n in empty.column_names], schema=empty.schema)

    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    empty = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]).empty_table()
    a = clips.select(F.col("clip").cast("bigint"), F.col("frame").cast("bigint"), F.col("t").cast("double"), F.col("valid").cast("boolean"))
    b = samples.select(F.col("clip").cast("bigint"), F.col("i").cast("bigint"), *[F.col(c).cast("double") for c in "wxyz"])
    return a.groupBy("clip").cogroup(b.groupBy("clip")).applyInArrow(run, schema)


def stabilise(clips: DataFrame, samples: DataFrame, rate: float, lens: Lens, settings: Settings) -> DataFrame:
    """Virtual camera of every frame: clip, frame, w, x, y, z, zoom, shutter, low, mean, high, limited.

    ``clips`` holds (clip, frame, t, valid), ``samples`` the orientations
    (clip, i, w, x, y, z) at a constant rate. A clip is one group, which holds
    its samples (about nine million in an hour).
    """
    def rows(clip: Clip, got: dict) -> dict:
        return {
            **{c: pa.array(np.ascontiguousarray(got["virtual"][:, k])) for k, c in enumerate("wxyz")}, "zoom": pa.array(got["zoom"]), "shutter": pa.array(got["shutter"]),
            **{c: pa.array([float(got[c])] * clip.n) for c in ("low", "mean", "high")}, "limited": pa.array([int(got["limited"])] * clip.n, pa.int64())}

    names = "clip bigint, frame bigint, w double, x double, y double, z double, zoom double, shutter double, low double, mean double, high double, limited bigint"
    return _per_clip(clips, samples, rate, lens, settings, rows, names)


def frame_warps(clips: DataFrame, samples: DataFrame, rate: float, lens: Lens, settings: Settings, manual: float = 1.0) -> DataFrame:
    """The warp of every frame: clip, frame, on, inv_zoom and knots, 33 rotations of 9 numbers, for `develop`."""
    def rows(clip: Clip, got: dict) -> dict:
        on, inv_zoom, knots = clip.warps(got, manual)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(knots).ravel()), 9)
        lists = pa.FixedSizeListArray.from_arrays(flat.cast(pa.list_(pa.float64())), KNOTS)
        return {"on": pa.array(on), "inv_zoom": pa.array(inv_zoom), "knots": lists.cast(pa.list_(pa.list_(pa.float64())))}

    return _per_clip(clips, samples, rate, lens, settings, rows, "clip bigint, frame bigint, on boolean, inv_zoom double, knots array<array<double>>")
