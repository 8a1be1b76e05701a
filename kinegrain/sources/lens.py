"""Lens profiles: calibration points of two XML formats, one row each."""

from __future__ import annotations

import math
import re

#: Half diagonal of the full frame, and the format's namespace prefix.
FULL_FRAME = (36.0, 24.0)
NS = "stCamera:"


def value(text: str, name: str) -> str | None:
    """An attribute or element by name, wherever it stands first."""
    n = re.escape(name)
    m = re.search(rf'(?<![\w:]){n}\s*=\s*"([^"]*)"|<{n}>([^<]*)</{n}>', text)
    return None if m is None else (m[1] if m[1] is not None else m[2]).strip()


def number(text: str, name: str, default: float = 0.0) -> float:
    got = value(text, name)
    m = re.match(r"\s*[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", got or "")
    return float(m[0]) if m else default


def point(kind: str, lens: str | None, factor: float, **fields) -> dict:
    known = lambda v: v if v and v > 0 else None
    out = {"kind": kind, "lens": lens, "format_factor": factor, "focal": None, "aperture": None, "distance": None, "c": None, "warp_radius_mm": None, "v": None, "vignette_radius_mm": None}
    for k, x in fields.items():
        out[k] = known(x) if k in ("focal", "aperture", "distance", "warp_radius_mm", "vignette_radius_mm") else x
    return out


def read_adobe(text: str) -> list[dict]:
    """Points of a perspective model profile; apertures come as APEX values, radii as shares of the longer side."""
    name = value(text, NS + "LensPrettyName") or value(text, NS + "Lens")
    whole = number(text, NS + "SensorFormatFactor", 1.0)
    out, before = [], 0
    for m in re.finditer(rf"<{NS}PerspectiveModel(.*?)(?:</{NS}PerspectiveModel>|\Z)", text, re.S):
        own, body = text[before: m.start()], m[0]
        before = m.end()
        nested = re.search(rf"<{NS}(?:VignetteModel|ChromaticRedGreenModel|ChromaticGreenModel|ChromaticBlueGreenModel)", body)
        model = body[: nested.start()] if nested else body
        vignette = re.search(rf"<{NS}VignetteModel\b(.*?)(?:<{NS}VignetteModelPiecewiseParam|</{NS}VignetteModel>|\Z)", body, re.S)
        factor = max(0.1, number(own, NS + "SensorFormatFactor", whole))
        side, focal = FULL_FRAME[0] / factor, number(own, NS + "FocalLength")

        def radius(scope: str, side: float = side, focal: float = focal, factor: float = factor) -> float:
            fx = number(scope, NS + "FocalLengthX", -1.0)
            return fx * side if fx > 0 else focal * factor / 35 * side

        apex = value(own, NS + "ApertureValue")
        p = point("adobe", name, factor, focal=focal, aperture=2 ** (0.5 * float(apex)) if apex else None, distance=number(own, NS + "FocusDistance"))
        if value(model, NS + "RadialDistortParam1") is not None:
            a, b, c = (number(model, f"{NS}RadialDistortParam{k}") for k in (1, 2, 3))
            p["c"], p["warp_radius_mm"] = [1.0, 0.0, a, 0.0, b, 0.0, c], radius(model) or None
        if vignette and value(vignette[0], NS + "VignetteModelParam1") is not None:
            p["v"] = [number(vignette[0], f"{NS}VignetteModelParam{k}") for k in (1, 2, 3)]
            p["vignette_radius_mm"] = radius(vignette[0]) or radius(model) or None
        if p["warp_radius_mm"] or p["vignette_radius_mm"]:
            out.append(p)
    return out


def read_lensfun(text: str) -> list[dict]:
    """Distortion and vignetting points of every lens; radii are half the shorter side and half the diagonal."""
    out = []
    for m in re.finditer(r"<lens>(.*?)(?:</lens>|\Z)", text, re.S):
        body = m[1]
        plain = re.search(r"<model>([^<]*)</model>", body)
        crop = max(0.1, number(body, "cropfactor", 1.0))
        ratio = [float(v) for v in re.findall(r"[0-9.]+", value(body, "aspect-ratio") or "")] or [1.5]
        a, b = ratio[0], ratio[1] if len(ratio) > 1 else 1.0
        aspect = max(a, b) / min(a, b) if a > 0 and b > 0 else 1.5
        diagonal = 0.5 * math.hypot(*FULL_FRAME) / crop
        for tag in re.finditer(r"<(distortion|vignetting)\s([^>]*)>", body):
            n = lambda k, t=tag[2]: number(t, k)
            kind = value(tag[2], "model")
            p = point("lensfun", plain[1].strip() if plain else None, crop, focal=n("focal"))
            if tag[1] == "distortion":
                ptlens = [1 - n("a") - n("b") - n("c"), n("c"), n("b"), n("a"), 0.0, 0.0, 0.0]
                p["c"] = {"ptlens": ptlens, "poly3": [1 - n("k1"), 0.0, n("k1"), 0, 0, 0, 0], "poly5": [1.0, 0.0, n("k1"), 0.0, n("k2"), 0, 0]}.get(kind)
                p["warp_radius_mm"] = diagonal / math.sqrt(1 + aspect * aspect)
            elif kind == "pa":
                p["aperture"], p["distance"] = n("aperture") or None, n("distance") or None
                p["v"], p["vignette_radius_mm"] = [n("k1"), n("k2"), n("k3")], diagonal
            if p["c"] or p["v"]:
                out.append(p)
    return out


def read_profile(data: bytes) -> tuple[list[dict], str | None]:
    """(points, error) of a profile of either format."""
    text = data.decode("utf-8", "replace")
    if NS in text:
        got = read_adobe(text)
        return got, None if got else ("fisheye profiles are not supported" if f"<{NS}FisheyeModel" in text else "no lens model found")
    if "<lensdatabase" in text or "<lens>" in text:
        got = read_lensfun(text)
        return got, None if got else "no lens calibration found"
    return [], "not a lens profile"
