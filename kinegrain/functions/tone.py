"""The pointwise colour chain of a developed picture, stage by stage.

Every stage takes and gives a tuple of three columns, so a chain of stages is
one projection and stays inside generated code. A stage that its settings make
neutral is left out of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinegrain.functions import curves

RGB = tuple[Column, Column, Column]


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = clamp((v - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - t * 2.0)


def each(rgb: RGB, f) -> RGB:
    return tuple(f(c) for c in rgb)  # type: ignore[return-value]


def remove_pedestal(rgb: RGB, pedestal: float, norm: float) -> RGB:
    return each(rgb, lambda c: (c - pedestal) * norm)


def clip_highlights(rgb: RGB, clip: float) -> RGB:
    return each(rgb, lambda c: F.least(c, F.lit(clip)))


def recover_highlights(rgb: RGB, channel_clip: tuple[float, float, float]) -> RGB:
    """Blend towards the brightest channel as one comes within 15 % of its clip."""
    brightest = F.greatest(*rgb)
    t = smoothstep(0.85, 1.0, F.greatest(*[c / k for c, k in zip(rgb, channel_clip)]))
    return each(rgb, lambda c: c + t * (brightest - c))


def apply_matrix(rgb: RGB, m: list[float], gain: float = 1.0) -> RGB:
    r, g, b = rgb
    return tuple((r * m[3 * i] + g * m[3 * i + 1] + b * m[3 * i + 2]) * gain for i in range(3))  # type: ignore[return-value]


def luminance(rgb: RGB, weights: tuple[float, float, float]) -> Column:
    return rgb[0] * weights[0] + rgb[1] * weights[1] + rgb[2] * weights[2]


def tone(rgb: RGB, y: Column, contrast: float = 1.0, midtones: float = 0.0, highlights: float = 0.0, shadows: float = 0.0) -> tuple[RGB, Column]:
    """Contrast and zones in stops about 0.18; hue is kept by scaling all channels. Dark (1e-6) stays."""
    if (contrast, midtones, highlights, shadows) == (1.0, 0.0, 0.0, 0.0):
        return rgb, y
    stops = F.log2(y / 0.18)
    moved = stops * contrast + F.exp(-(stops / 2.5) * (stops / 2.5)) * midtones
    moved = moved + smoothstep(0.0, 4.0, stops) * (2.0 * highlights) + smoothstep(0.0, 5.0, -stops) * (2.0 * shadows)
    ratio = F.when(y > 1e-6, F.pow(F.lit(2.0), moved - stops)).otherwise(F.lit(1.0))
    return each(rgb, lambda c: c * ratio), y * ratio


def saturate(rgb: RGB, y: Column, saturation: float = 1.0, boost: float = 0.0) -> RGB:
    """Move from or to the luminance; the boost acts on unsaturated colours."""
    if boost == 0.0 and saturation == 1.0:
        return rgb
    high, low = F.greatest(*rgb), F.least(*rgb)
    sat = F.when(high > 1e-6, clamp((high - low) / high, 0.0, 1.0)).otherwise(F.lit(0.0))
    factor = ((1.0 - sat) * boost + 1.0) * saturation
    return each(rgb, lambda c: y + (c - y) * factor)


def compress_gamut(rgb: RGB, threshold: float = 0.8, limit: float = 1.2) -> RGB:
    """Distances from the achromatic axis beyond ``threshold`` approach ``limit``."""
    axis = F.greatest(*rgb)
    room = limit - threshold

    def one(c: Column) -> Column:
        d = (axis - c) / axis
        x = (d - threshold) / room
        near = x * room / (x + 1.0) + threshold
        return F.when((axis > 0) & (d > threshold), axis - near * axis).otherwise(c)

    return each(rgb, one)


def shoulder(rgb: RGB, knee: float = 0.6) -> RGB:
    """Exponential shoulder above the knee; negative signals become 0."""
    room = 1.0 - knee

    def one(c: Column) -> Column:
        v = F.greatest(c, F.lit(0.0))
        return F.when(v < knee, v).otherwise((1.0 - F.exp(-(v - knee) / room)) * room + knee)

    return each(rgb, one)


def finish(rgb: RGB, curve: str, lift: float = 0.0, gain: float = 1.0, soft_clip: bool = False) -> RGB:
    """Output encoding with lift, gain and soft clip on the code value; linear output passes through 2.4."""
    linear = curve == "linear"
    adjusts = lift != 0.0 or gain != 1.0 or soft_clip
    if linear and not adjusts:
        return rgb

    def one(c: Column) -> Column:
        e = curves.encode(c, "gamma24" if linear else curve)
        if lift != 0.0 or gain != 1.0:
            e = e * gain + (1.0 - clamp(e, 0.0, 1.0)) * lift
        if soft_clip:
            e = F.when(e > 0.8, F.tanh((e - 0.8) / 0.2) * 0.2 + 0.8).otherwise(e)
        return curves.decode(e, "gamma24") if linear else e

    return each(rgb, one)


def vignette_gain(x: Column, y: Column, cx: float, cy: float, inv_radius: float, a: tuple[float, float, float, float]) -> Column:
    """Radial gain 1 + a0 r^2 + .. + a3 r^8, held to 0.5 .. 8."""
    dx, dy = (x - cx) * inv_radius, (y - cy) * inv_radius
    r2 = dx * dx + dy * dy
    return clamp((((r2 * a[3] + a[2]) * r2 + a[1]) * r2 + a[0]) * r2 + 1.0, 0.5, 8.0)


def remove_vignette(v: Column, gain: Column, curve: str) -> Column:
    """The gain acts in linear light; the code value comes back in the same curve."""
    return curves.encode(curves.decode(v, curve) * gain, curve)
