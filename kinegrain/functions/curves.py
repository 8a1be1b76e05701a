"""Transfer curves between linear light and code values, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curve names by their number in the three lists of curves.
OUTPUT_CURVES = ["linear", "gamma22", "gamma24", "rec709", "srgb", "intermediate", "acescct"]
HOST_CURVES = ["linear", "gamma22", "gamma24", "gamma26", "rec709", "srgb", "film", "film4k", "film46k", "intermediate", "acescct"]
POWERS = {"gamma22": 2.2, "gamma24": 2.4, "gamma26": 2.6}


@dataclass(frozen=True)
class LogCurve:
    """code = a ln(linear + b) + c from ``cut`` (a code value) on, its tangent below."""

    a: float
    b: float
    c: float
    cut: float


#: The three film curves, and the constants of the two log2 curves.
FILM = {
    "film": LogCurve(0.18644097, 0.03251850, 0.67230670, 0.060236),
    "film4k": LogCurve(0.29529631, 0.07974455, 0.78163686, 0.052812),
    "film46k": LogCurve(0.15753964, 0.02359390, 0.66140084, 0.096414),
}
DI_A, DI_B, DI_C, DI_M, DI_CUT = 0.0075, 7.0, 0.07329248, 10.44426855, 0.00262409
CCT_SLOPE, CCT_BASE, CCT_LINEAR_CUT, CCT_CODE_CUT = 10.5402377416545, 0.0729055341958355, 0.0078125, 0.155251141552511


def _film_cut(k: LogCurve) -> Column:
    return F.exp(F.lit((k.cut - k.c) / k.a)) - k.b


def encode(v: Column, curve: str) -> Column:
    """Code value of a linear signal. Powers leave zero and negative signals as they are."""
    if curve in POWERS:
        return F.when(v > 0, F.pow(v, F.lit(1 / POWERS[curve]))).otherwise(v)
    if curve == "rec709":
        return F.when(v < 0.018, v * 4.5).otherwise(F.pow(v, F.lit(0.45)) * 1.099 - 0.099)
    if curve == "srgb":
        return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
    if curve == "intermediate":
        return F.when(v <= DI_CUT, v * DI_M).otherwise((F.log2(v + DI_A) + DI_B) * DI_C)
    if curve == "acescct":
        return F.when(v <= CCT_LINEAR_CUT, v * CCT_SLOPE + CCT_BASE).otherwise((F.log2(v) + 9.72) / 17.52)
    if curve in FILM:
        k = FILM[curve]
        low = _film_cut(k)
        return F.when(v >= low, F.log(v + k.b) * k.a + k.c).otherwise((v - low) * k.a / (low + k.b) + k.cut)
    return v


def decode(e: Column, curve: str) -> Column:
    """Linear signal of a code value; inverse of `encode`."""
    if curve in POWERS:
        return F.when(e > 0, F.pow(e, F.lit(POWERS[curve]))).otherwise(e)
    if curve == "rec709":
        return F.when(e < 0.081, e / 4.5).otherwise(F.pow((e + 0.099) / 1.099, F.lit(1 / 0.45)))
    if curve == "srgb":
        return F.when(e <= 0.04045, e / 12.92).otherwise(F.pow((e + 0.055) / 1.055, F.lit(2.4)))
    if curve == "intermediate":
        return F.when(e <= DI_CUT * DI_M, e / DI_M).otherwise(F.pow(F.lit(2.0), e / DI_C - DI_B) - DI_A)
    if curve == "acescct":
        return F.when(e <= CCT_CODE_CUT, (e - CCT_BASE) / CCT_SLOPE).otherwise(F.pow(F.lit(2.0), e * 17.52 - 9.72))
    if curve in FILM:
        k = FILM[curve]
        low = _film_cut(k)
        return F.when(e >= k.cut, F.exp((e - k.c) / k.a) - k.b).otherwise((e - k.cut) * (low + k.b) / k.a + low)
    return e
