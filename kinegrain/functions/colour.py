"""White points, colour spaces and camera matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Isotherms in reciprocal megakelvin, u, v and slope.
ISOTHERMS = [
    (0, 0.18006, 0.26352, -0.24341), (10, 0.18066, 0.26589, -0.25479), (20, 0.18133, 0.26846, -0.26876), (30, 0.18208, 0.27119, -0.28539),
    (40, 0.18293, 0.27407, -0.30470), (50, 0.18388, 0.27709, -0.32675), (60, 0.18494, 0.28021, -0.35156), (70, 0.18611, 0.28342, -0.37915),
    (80, 0.18740, 0.28668, -0.40955), (90, 0.18880, 0.28997, -0.44278), (100, 0.19032, 0.29326, -0.47888), (125, 0.19462, 0.30141, -0.58204),
    (150, 0.19962, 0.30921, -0.70471), (175, 0.20525, 0.31647, -0.84901), (200, 0.21142, 0.32312, -1.0182), (225, 0.21807, 0.32909, -1.2168),
    (250, 0.22511, 0.33439, -1.4512), (275, 0.23247, 0.33904, -1.7298), (300, 0.24010, 0.34308, -2.0637), (325, 0.24792, 0.34655, -2.4681),
    (350, 0.25591, 0.34951, -2.9641), (375, 0.26400, 0.35200, -3.5814), (400, 0.27218, 0.35407, -4.3633), (425, 0.28039, 0.35577, -5.3762),
    (450, 0.28863, 0.35714, -6.7262), (475, 0.29685, 0.35823, -8.5955), (500, 0.30505, 0.35907, -11.324), (525, 0.31320, 0.35968, -15.628),
    (550, 0.32129, 0.36011, -23.325), (575, 0.32931, 0.36038, -40.770), (600, 0.33724, 0.36051, -116.45)]
TINT_SCALE = -3000.0
#: Primaries (red, green, blue) and white of the output spaces.
D65, ACES_WHITE, D50 = (0.3127, 0.3290), (0.32168, 0.33767), (0.3457, 0.3585)
SPACES = {
    "rec709": ((0.640, 0.330, 0.300, 0.600, 0.150, 0.060), D65),
    "p3d65": ((0.680, 0.320, 0.265, 0.690, 0.150, 0.060), D65),
    "rec2020": ((0.708, 0.292, 0.170, 0.797, 0.131, 0.046), D65),
    "wide": ((0.8000, 0.3130, 0.1682, 0.9877, 0.0790, -0.1155), D65),
    "ap0": ((0.7347, 0.2653, 0.0000, 1.0000, 0.0001, -0.0770), ACES_WHITE),
    "ap1": ((0.713, 0.293, 0.165, 0.830, 0.128, 0.044), ACES_WHITE),
    "awg3": ((0.6840, 0.3130, 0.2210, 0.8480, 0.0861, -0.1020), D65),
}
#: Kelvin of the calibration illuminants that have one.
ILLUMINANTS = {
    1: 5500, 2: 4150, 3: 2850, 4: 5500, 9: 5500, 10: 6500, 11: 7500, 12: 6430, 13: 5000, 14: 4150, 15: 3450, 17: 2856, 18: 4874, 19: 6774,
    20: 5503, 21: 6504, 22: 7504, 23: 5003, 24: 3200}
#: White balance presets.
PRESETS = {"daylight": (5500, 10), "cloudy": (6500, 10), "shade": (7500, 10), "tungsten": (2850, 0), "fluorescent": (3800, 21), "flash": (5500, 0)}
CONE = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


_T = np.array(ISOTHERMS, float)
#: Unit vectors along the isotherms.
_ALONG = np.stack((np.ones(len(_T)), _T[:, 3]), axis=1) / np.sqrt(1 + _T[:, 3:] ** 2)


def _pick(values: np.ndarray, k: Column) -> Column:
    """The k-th of constants; a folded array, so that it costs one load."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), k)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; keeps composed expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(conditions: list[Column], last: int, start: int) -> Column:
    """Number of the first condition that holds, counted from ``start``."""
    out = F.when(conditions[0], start)
    for k, c in enumerate(conditions[1:], start + 1):
        out = out.when(c, k)
    return out.otherwise(last)


def temperature_tint(x: Column, y: Column) -> tuple[Column, Column]:
    """Correlated temperature and tint of a chromaticity.

    The first isotherm that the point is not above bounds its interval; the
    last one bounds what lies beyond. On which side of an isotherm a point lies
    is linear in its coordinates, so the search is a chain of comparisons.
    """
    d = 1.5 - x + 6.0 * y
    offset = _T[:, 2] * _ALONG[:, 0] - _T[:, 1] * _ALONG[:, 1]

    def search(p: Column) -> Column:
        u, v = p["u"], p["v"]
        return _first([v * float(_ALONG[i, 0]) - u * float(_ALONG[i, 1]) <= float(offset[i]) for i in range(1, 30)], 30, 1)

    def solve(p: Column, k: Column) -> Column:
        u, v = p["u"], p["v"]
        side = lambda at: v * _pick(_ALONG[:, 0], at) - u * _pick(_ALONG[:, 1], at) - _pick(offset, at)
        over = F.greatest(-side(k), F.lit(0.0))

        def mix(f: Column) -> Column:
            mixed = lambda c: _pick(_T[:, c], k - 1) * f + _pick(_T[:, c], k) * (1.0 - f)
            # Nothing has been passed before the first interval, so its lower direction counts as none.
            du, dv = (_pick(_ALONG[:, c], k) * (1.0 - f) + F.when(k == 1, 0.0).otherwise(_pick(_ALONG[:, c], k - 1)) * f for c in (0, 1))
            tint = ((u - mixed(1)) * du + (v - mixed(2)) * dv) / F.sqrt(du * du + dv * dv) * TINT_SCALE
            return F.struct((1.0e6 / mixed(0)).alias("t"), tint.alias("tint"))

        return let(F.when(k == 1, 0.0).otherwise(over / (side(k - 1) + over)), mix)

    out = let(F.struct((2.0 * x / d).alias("u"), (3.0 * y / d).alias("v")), lambda p: let(search(p), lambda k: solve(p, k)))
    return out["t"], out["tint"]


def chromaticity(temperature: Column, tint: Column) -> tuple[Column, Column]:
    """Inverse of `temperature_tint`."""
    def search(p: Column) -> Column:
        return _first([p["r"] < float(_T[i + 1, 0]) for i in range(29)], 29, 0)

    def solve(p: Column, k: Column) -> Column:
        f = (_pick(_T[:, 0], k + 1) - p["r"]) / (_pick(_T[:, 0], k + 1) - _pick(_T[:, 0], k))
        mixed = lambda a, c: _pick(a[:, c], k) * f + _pick(a[:, c], k + 1) * (1.0 - f)
        n = F.sqrt(mixed(_ALONG, 0) * mixed(_ALONG, 0) + mixed(_ALONG, 1) * mixed(_ALONG, 1))
        u, v = (mixed(_T, c + 1) + mixed(_ALONG, c) / n * p["o"] for c in (0, 1))
        d = u - 4.0 * v + 2.0
        return F.struct((1.5 * u / d).alias("x"), (v / d).alias("y"))

    start = F.struct((1.0e6 / temperature).alias("r"), (tint / TINT_SCALE).alias("o"))
    out = let(start, lambda p: let(search(p), lambda k: solve(p, k)))
    return out["x"], out["y"]


def illuminant_kelvin(code: Column) -> Column:
    """Kelvin of an illuminant code, null where it has none."""
    pairs = [F.lit(v) for k, t in ILLUMINANTS.items() for v in (k, t)]
    return F.create_map(*pairs)[code]


# Small matrices of a clip: numpy, one row at a time.


def xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def invert(m: np.ndarray) -> np.ndarray:
    """Inverse, or the identity where there is none."""
    return np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-30 else np.eye(3)


def adapt(a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """Chromatic adaptation from white ``a`` to white ``b`` in cone space."""
    return np.linalg.inv(CONE) @ np.diag((CONE @ xyz(*b)) / (CONE @ xyz(*a))) @ CONE


def to_xyz(space: str) -> np.ndarray:
    """RGB of a space to XYZ; its white has Y = 1."""
    p, white = SPACES[space]
    m = np.stack([xyz(p[2 * k], p[2 * k + 1]) for k in range(3)], axis=1)
    return m * (np.linalg.inv(m) @ xyz(*white))


def kelvin_of(x: float, y: float) -> float:
    """Temperature of a chromaticity, as `temperature_tint` has it."""
    d = 1.5 - x + 6 * y
    u, v = 2 * x / d, 3 * y / d
    t = np.array(ISOTHERMS)
    n = np.sqrt(1 + t[:, 3] ** 2)
    side = (v - t[:, 2]) / n - (u - t[:, 1]) * t[:, 3] / n
    passed = np.flatnonzero(side[1:] <= 0)
    k = int(passed[0]) + 1 if len(passed) else 30
    over = max(-side[k], 0.0)
    f = 0.0 if k == 1 else over / (side[k - 1] + over)
    return 1e6 / (t[k - 1, 0] * f + t[k, 0] * (1 - f))


def camera_matrix(cm1: np.ndarray, cm2: np.ndarray | None, code1: int, code2: int, analog: np.ndarray, white: tuple[float, float]) -> np.ndarray:
    """XYZ to camera for a white: the calibrations mixed by reciprocal temperature."""
    t1, t2 = ILLUMINANTS.get(code1, 0), ILLUMINANTS.get(code2, 0)
    m = cm1
    if cm2 is not None and t1 and t2 and t1 != t2:
        warm, cold = (cm1, cm2) if t1 < t2 else (cm2, cm1)
        lo, hi = sorted((t1, t2))
        share = np.clip((1 / kelvin_of(*white) - 1 / hi) / (1 / lo - 1 / hi), 0, 1)
        m = share * warm + (1 - share) * cold
    return np.diag(analog) @ m


def chart_fitted(cm1: np.ndarray, cm2: np.ndarray | None, code1: int, code2: int, fitted: dict[int, np.ndarray], whites: dict[int, tuple[float, float]]):
    """Calibrations with the colour of ``fitted`` and the camera neutrals of the recorded ones; applying it twice changes nothing."""
    out = {}
    for code, white in whites.items():
        own = cm1 if code1 == code else cm2 if cm2 is not None and code2 == code else camera_matrix(cm1, cm2, code1, code2, np.ones(3), white)
        neutral = own @ xyz(*white)
        if not (neutral > 0).all():
            return cm1, cm2, code1, code2
        out[code] = np.diag(neutral) @ (fitted[code] / (fitted[code] @ xyz(*white))[:, None])
    (a, m1), (b, m2) = out.items()
    return m1, m2, a, b


def colour_setup(cm1, cm2, code1: int, code2: int, analog, neutral=None, temp: float = 5500.0, tint: float = 0.0, space: str = "rec709") -> dict:
    """Gains, camera-to-output matrix and luminance weights of a clip.

    With ``neutral`` the white is found from the camera's neutral by fixed
    point; otherwise it is the given temperature and tint. The matrix maps
    white-balanced (1, 1, 1) to Y = 1.
    """
    cm1 = np.asarray(cm1, float).reshape(3, 3)
    cm2 = None if cm2 is None else np.asarray(cm2, float).reshape(3, 3)
    analog = np.asarray(analog, float)
    white = D50
    if neutral is not None:
        neutral = np.maximum(1e-6, np.asarray(neutral, float))
        for _ in range(30):
            v = invert(camera_matrix(cm1, cm2, code1, code2, analog, white)) @ neutral
            new = (v[0] / v.sum(), v[1] / v.sum()) if v.sum() > 0 else D50
            moved = max(abs(new[0] - white[0]), abs(new[1] - white[1]))
            white = new
            if moved < 1e-7:
                break
    else:
        white = chromaticity_of(float(np.clip(temp, 1500, 50000)), float(np.clip(tint, -150, 150)))
        neutral = np.maximum(1e-6, camera_matrix(cm1, cm2, code1, code2, analog, white) @ xyz(*white))
    neutral = neutral / neutral[1]
    to_camera = camera_matrix(cm1, cm2, code1, code2, analog, white) @ adapt(D50, white)
    to_camera = to_camera / (to_camera @ xyz(*D50)).max()
    balanced = invert(to_camera) @ np.diag(neutral)
    balanced = balanced / balanced.sum(axis=1)[1]
    out_white = SPACES[space][1]
    return {
        "gains": 1 / neutral, "matrix": np.linalg.inv(to_xyz(space)) @ adapt(D50, out_white) @ balanced,
        "luminance": to_xyz(space)[1], "kelvin": kelvin_of(*white), "white": white}


def chromaticity_of(temp: float, tint: float) -> tuple[float, float]:
    """Chromaticity of a temperature and tint, as `chromaticity` has it."""
    t = np.array(ISOTHERMS)
    r = 1e6 / temp
    k = min(int(np.searchsorted(t[1:, 0], r, side="right")), 29)
    f = (t[k + 1, 0] - r) / (t[k + 1, 0] - t[k, 0])
    d = np.stack([np.array([1, s]) / np.sqrt(1 + s * s) for s in t[k: k + 2, 3]])
    mean = d[0] * f + d[1] * (1 - f)
    u, v = t[k, 1:3] * f + t[k + 1, 1:3] * (1 - f) + mean / np.sqrt((mean**2).sum()) * tint / TINT_SCALE
    return 1.5 * u / (u - 4 * v + 2), v / (u - 4 * v + 2)
