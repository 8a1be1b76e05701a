"""Picture kernels on whole arrays.

Each works on a picture or on a band of rows with enough rows around it; the
number of rows and columns it looks at on every side is in ``HALO``. Arithmetic
is in the arrays' own precision: float32 for production, float64 in checks.
"""

from __future__ import annotations

import numpy as np

EPS, EPS_SQUARED = 1e-5, 1e-10
#: Rows and columns around a pixel that each kernel looks at.
HALO = {
    "hot": 2, "row_phase": 4, "vh": 4, "lowpass": 1, "green": 5, "pq": 4, "rb_diag": 7, "rb_green": 10,
    "half": 0, "tensor": 1, "blur": 4, "dezigzag": 48, "unsharp": 1, "demosaic": 16}
#: Default mosaic: red, green, green, blue.
RGGB = (0, 1, 1, 2)


def shifted(a: np.ndarray, reach: int, mode: str = "reflect"):
    """A function of (dx, dy) giving the picture moved so that a neighbour lies at each pixel."""
    h, w = a.shape
    wide = np.pad(a, reach, mode=mode)
    return lambda dx, dy: wide[reach + dy: reach + dy + h, reach + dx: reach + dx + w]


def colours(shape: tuple[int, int], cfa=RGGB) -> np.ndarray:
    """Colour number of every pixel of a picture that begins on an even row and column."""
    return np.tile(np.array(cfa).reshape(2, 2), (shape[0] // 2 + 1, shape[1] // 2 + 1))[: shape[0], : shape[1]]


def hot_pixels(raw: np.ndarray, white: float, black=(0.0, 0.0, 0.0, 0.0)) -> np.ndarray:
    """Samples far above their eight neighbours of one colour take the largest of these; borders stay."""
    out = raw.astype(np.float64)
    h, w = raw.shape
    if h < 5 or w < 5:
        return out
    around = np.stack([out[2 + dy: h - 2 + dy, 2 + dx: w - 2 + dx] for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dx or dy])
    top, mean = around.max(axis=0), around.mean(axis=0)
    spread = np.sqrt(np.maximum((around**2).mean(axis=0) - mean**2, 0))
    floor = 0.012 * (white - np.asarray(black)[colours(raw.shape, (0, 1, 2, 3))[2:-2, 2:-2]])
    inner = out[2:-2, 2:-2]
    out[2:-2, 2:-2] = np.where(inner > top + np.maximum(4 * spread, floor), top, inner)
    return out


def cubic_weights(t: float) -> np.ndarray:
    """Keys weights (a = -0.5) of the four samples around a position ``t`` after the second."""
    d = np.abs(np.array([t + 1, t, 1 - t, 2 - t]))
    near = 1.5 * d**3 - 2.5 * d**2 + 1
    far = -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.where(d < 1, near, far)


def row_phase(raw: np.ndarray, phase: float, black=(0.0,) * 4, scale=(1.0,) * 4, pedestal: float = 0.0) -> np.ndarray:
    """Even rows move by ``phase`` of their plane's pitch and odd rows by ``-phase``, then levels are set."""
    out = raw.astype(np.float64)
    if phase:
        for parity in (0, 1):
            plane = raw[parity::2].astype(np.float64)
            n = len(plane)
            if not n:
                continue
            offset = -phase if parity else phase
            base = int(np.floor(offset))
            w = cubic_weights(offset - base)
            rows = np.arange(n)[:, None] + base + np.arange(-1, 3)[None, :]
            out[parity::2] = np.einsum("k,jkx->jx", w, plane[np.clip(rows, 0, n - 1)])
    site = colours(raw.shape, (0, 1, 2, 3))
    return (out - np.asarray(black)[site]) * np.asarray(scale)[site] + pedestal


def _high_pass(a: np.ndarray, sx: int, sy: int) -> np.ndarray:
    """Squared high-pass along the direction (sx, sy)."""
    n = shifted(a, 3)
    at = lambda k: n(k * sx, k * sy)
    return ((at(-3) - at(-1) - at(1) + at(3)) - 3 * (at(-2) + at(2)) + 6 * a) ** 2


def _directional(a: np.ndarray, sx: int, sy: int) -> np.ndarray:
    wide = np.pad(a, 4, mode="reflect")
    hp = _high_pass(wide, sx, sy)
    h, w = a.shape
    cut = lambda k: hp[4 + k * sy: 4 + k * sy + h, 4 + k * sx: 4 + k * sx + w]
    return np.maximum(EPS_SQUARED, cut(-1) + cut(0) + cut(1))


def vh_direction(cfa: np.ndarray) -> np.ndarray:
    """Share of the vertical in the directional activity."""
    v, h = _directional(cfa, 0, 1), _directional(cfa, 1, 0)
    return v / (v + h)


def pq_direction(cfa: np.ndarray, mosaic=RGGB) -> np.ndarray:
    """Share of the falling diagonal at red and blue sites; a half at green ones."""
    p, q = _directional(cfa, 1, 1), _directional(cfa, -1, 1)
    return np.where(colours(cfa.shape, mosaic) == 1, 0.5, p / (p + q))


def low_pass(cfa: np.ndarray, mosaic=RGGB) -> np.ndarray:
    """Binomial 3 x 3 sum at red and blue sites, 0 at green ones."""
    n = shifted(cfa, 1)
    total = cfa + 0.5 * (n(0, -1) + n(0, 1) + n(-1, 0) + n(1, 0)) + 0.25 * (n(-1, -1) + n(1, -1) + n(-1, 1) + n(1, 1))
    return np.where(colours(cfa.shape, mosaic) == 1, 0.0, total)


def _refined(direction: np.ndarray) -> np.ndarray:
    """The own or the diagonal neighbours' mean direction, whichever is more decided."""
    n = shifted(direction, 1)
    around = 0.25 * (n(-1, -1) + n(1, -1) + n(-1, 1) + n(1, 1))
    return np.where(np.abs(0.5 - direction) < np.abs(0.5 - around), around, direction)


def green(cfa: np.ndarray, vh: np.ndarray, lpf: np.ndarray, mosaic=RGGB) -> np.ndarray:
    """Green at red and blue sites from four estimates weighted by their gradients."""
    c, low = shifted(cfa, 4), shifted(np.maximum(lpf, 0), 2)
    own = np.maximum(lpf, 0)
    gradient, estimate = {}, {}
    for name, (sx, sy) in {"n": (0, -1), "s": (0, 1), "w": (-1, 0), "e": (1, 0)}.items():
        at = lambda k: c(k * sx, k * sy)  # noqa: B023, E731
        gradient[name] = EPS + np.abs(at(1) - at(-1)) + np.abs(cfa - at(2)) + np.abs(at(1) - at(3)) + np.abs(at(2) - at(4))
        far = low(2 * sx, 2 * sy)
        estimate[name] = at(1) * (1 + (own - far) / (EPS + own + far))
    vertical = (gradient["s"] * estimate["n"] + gradient["n"] * estimate["s"]) / (gradient["n"] + gradient["s"])
    horizontal = (gradient["w"] * estimate["e"] + gradient["e"] * estimate["w"]) / (gradient["e"] + gradient["w"])
    d = _refined(vh)
    return np.where(colours(cfa.shape, mosaic) == 1, cfa, np.clip(d * horizontal + (1 - d) * vertical, 0, 2))


def rb_diagonal(cfa: np.ndarray, g: np.ndarray, pq: np.ndarray, mosaic=RGGB) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue planes at red and blue sites; 0 at green ones."""
    c, n = shifted(cfa, 3), shifted(g, 2)
    gradient, estimate = {}, {}
    for name, (sx, sy) in {"nw": (-1, -1), "ne": (1, -1), "sw": (-1, 1), "se": (1, 1)}.items():
        gradient[name] = EPS + np.abs(c(sx, sy) - c(-sx, -sy)) + np.abs(c(sx, sy) - c(3 * sx, 3 * sy)) + np.abs(g - n(2 * sx, 2 * sy))
        estimate[name] = c(sx, sy) - n(sx, sy)
    p = (gradient["nw"] * estimate["se"] + gradient["se"] * estimate["nw"]) / (gradient["nw"] + gradient["se"])
    q = (gradient["ne"] * estimate["sw"] + gradient["sw"] * estimate["ne"]) / (gradient["ne"] + gradient["sw"])
    d = _refined(pq)
    other = np.clip(g + (1 - d) * p + d * q, 0, 2)
    site = colours(cfa.shape, mosaic)
    zero = np.zeros_like(other)
    return np.where(site == 0, cfa, np.where(site == 2, other, zero)), np.where(site == 2, cfa, np.where(site == 0, other, zero))


def rb_at_green(g: np.ndarray, vh: np.ndarray, red: np.ndarray, blue: np.ndarray, mosaic=RGGB) -> tuple[np.ndarray, np.ndarray]:
    """Complete red and blue at the green sites from the four direct neighbours."""
    d, n = _refined(vh), shifted(g, 2)
    out = []
    for plane in (red, blue):
        c = shifted(plane, 3)
        gradient, estimate = {}, {}
        for name, (sx, sy) in {"n": (0, -1), "s": (0, 1), "w": (-1, 0), "e": (1, 0)}.items():
            gradient[name] = EPS + np.abs(g - n(2 * sx, 2 * sy)) + np.abs(c(sx, sy) - c(-sx, -sy)) + np.abs(c(sx, sy) - c(3 * sx, 3 * sy))
            estimate[name] = c(sx, sy) - n(sx, sy)
        vertical = (gradient["n"] * estimate["s"] + gradient["s"] * estimate["n"]) / (gradient["n"] + gradient["s"])
        horizontal = (gradient["e"] * estimate["w"] + gradient["w"] * estimate["e"]) / (gradient["e"] + gradient["w"])
        new = np.clip(g + (1 - d) * vertical + d * horizontal, 0, 2)
        out.append(np.where(colours(g.shape, mosaic) == 1, new, plane))
    return out[0], out[1]


def demosaic(cfa: np.ndarray, mosaic=RGGB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red, green and blue of a mosaic."""
    vh = vh_direction(cfa)
    g = green(cfa, vh, low_pass(cfa, mosaic), mosaic)
    red, blue = rb_diagonal(cfa, g, pq_direction(cfa, mosaic), mosaic)
    red, blue = rb_at_green(g, vh, red, blue, mosaic)
    return red, g, blue


def half_size(cfa: np.ndarray, mosaic=RGGB) -> np.ndarray:
    """Mean of each colour in every 2 x 2 cell, written to all of its pixels; (3, h, w)."""
    h, w = cfa.shape[0] // 2 * 2, cfa.shape[1] // 2 * 2
    cells = cfa[:h, :w].reshape(h // 2, 2, w // 2, 2)
    out = np.zeros((3, h, w), cfa.dtype)
    for k in range(3):
        sites = [(i // 2, i % 2) for i, c in enumerate(mosaic) if c == k]
        if sites:
            out[k] = (sum(cells[:, y, :, x] for y, x in sites) / len(sites)).repeat(2, axis=0).repeat(2, axis=1)
    return out


def tensor(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the central differences of the square root of luma."""
    n = shifted(np.sqrt(np.maximum(0.25 * r + 0.5 * g + 0.25 * b, 0)), 1, "edge")
    gx, gy = 0.5 * (n(1, 0) - n(-1, 0)), 0.5 * (n(0, 1) - n(0, -1))
    return gx * gx, gy * gy, gx * gy


def blur(a: np.ndarray) -> np.ndarray:
    """Separable Gaussian of nine taps (sigma 1.5), edges repeated."""
    w = np.exp(-np.arange(-4, 5) ** 2 / 4.5)
    w /= w.sum()
    n = shifted(a, 4, "edge")
    across = sum(k * n(d, 0) for k, d in zip(w, range(-4, 5)))
    n = shifted(across, 4, "edge")
    return sum(k * n(0, d) for k, d in zip(w, range(-4, 5)))


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at pixel-index positions, edges repeated."""
    h, w = a.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    tx, ty = x - x0, y - y0
    xa, xb = np.clip(x0, 0, w - 1), np.clip(x0 + 1, 0, w - 1)
    ya, yb = np.clip(y0, 0, h - 1), np.clip(y0 + 1, 0, h - 1)
    top = a[ya, xa] * (1 - tx) + a[ya, xb] * tx
    return top * (1 - ty) + (a[yb, xa] * (1 - tx) + a[yb, xb] * tx) * ty


def kernel_weight(x: np.ndarray, kind: str) -> np.ndarray:
    """Weights of the resampling kernels: ``catmull``, ``lanczos2``, ``lanczos3``."""
    x = np.abs(x)
    if kind == "catmull":
        near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))
    a = 3.0 if kind == "lanczos3" else 2.0
    return np.where(x >= a, 0.0, np.sinc(x) * np.sinc(x / a))


def resample(a: np.ndarray, x: np.ndarray, y: np.ndarray, kind: str = "lanczos3", kx: float = 1.0, ky: float = 1.0) -> np.ndarray:
    """Separable windowed samples at pixel-centre positions, widened by (kx, ky) when shrinking.

    Taps beyond the picture repeat its edge. At 1:1 or when enlarging, a sample
    stays within the four pixels around it, and a pixel centre gives its pixel.
    """
    h, w = a.shape
    fx, fy = np.asarray(x, float) - 0.5, np.asarray(y, float) - 0.5
    reach = 3 if kind == "lanczos3" else 2

    def taps(f: np.ndarray, k: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        span = min(int(np.ceil(reach * k)), 32)
        at = np.floor(f).astype(int)[:, None] + np.arange(-span + 1, span + 1)[None, :]
        exact = (k <= 1) & (f == np.floor(f))
        weight = kernel_weight((at - f[:, None]) / k, kind)
        weight[exact] = (at[exact] == f[exact, None]).astype(float)
        return np.clip(at, 0, n - 1), weight / weight.sum(axis=1, keepdims=True), exact

    xs, wx, ex = taps(fx, kx, w)
    ys, wy, ey = taps(fy, ky, h)
    out = np.einsum("ni,nj,nij->n", wy, wx, a[ys[:, :, None], xs[:, None, :]])
    if kx <= 1 and ky <= 1:
        x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
        xa, xb = np.clip(x0, 0, w - 1), np.clip(x0 + 1, 0, w - 1)
        ya, yb = np.clip(y0, 0, h - 1), np.clip(y0 + 1, 0, h - 1)
        around = np.stack((a[ya, xa], a[ya, xb], a[yb, xa], a[yb, xb]))
        out = np.where(ex & ey, out, np.clip(out, around.min(axis=0), around.max(axis=0)))
    return out


def unsharp(a: np.ndarray, amount: float) -> np.ndarray:
    """Add the difference from a 3 x 3 binomial mean, edges repeated."""
    n = shifted(a, 1, "edge")
    k = (0.25, 0.5, 0.25)
    mean = sum(k[dx + 1] * k[dy + 1] * n(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return a + amount * (a - mean)
