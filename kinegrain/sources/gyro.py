"""Gyro files: a sidecar for a clip, and blocks inside frames. All little-endian."""

from __future__ import annotations

import math
import struct

import numpy as np

SIDECAR_MAGIC, BLOCK_MAGIC = b"FPGY", b"FPG2"
#: Fixed values of the block's layout.
BLOCK_HEADER, MAX_SAMPLES, REGION, FAST_OFFSET, WINDOW_AT = 48, 500, 3072, 0x10D56, 3056


def _axes(v: tuple[int, int, int]) -> list[int] | None:
    """A signed permutation of 1, 2, 3, or None."""
    return list(v) if sorted(abs(a) for a in v) == [1, 2, 3] else None


def read_sidecar(data: bytes) -> dict:
    """Header, ``marks`` (samples at each frame) and ``samples`` (n x 3), or an ``error``. Unknown is None."""
    if len(data) < 128 or data[:4] != SIDECAR_MAGIC:
        return {"error": "not a sidecar file"}
    version, header, frames, samples, rate = struct.unpack_from("<HHIII", data, 4)
    if version != 1:
        return {"error": f"unsupported version {version}"}
    if not 128 <= header <= len(data):
        return {"error": "bad header size"}
    scale, *raster = struct.unpack_from("<f6H", data, 20)
    num, den, readout, exposure, focal, delay = struct.unpack_from("<5Ii", data, 36)
    axis, flags = _axes(struct.unpack_from("<3b", data, 60)), data[63]
    preroll, pitch, resolution, crop, depth, mode = struct.unpack_from("<6I", data, 64)
    if header + 4 * frames + 6 * samples > len(data):
        return {"error": "file is truncated"}
    if frames < 1 or samples < 2:
        return {"error": "no frames or samples"}
    if not rate > 1000 or not math.isfinite(scale) or not scale > 0:
        return {"error": "bad sample rate or scale"}
    w, h, ax, ay, aw, ah = raster
    if w < 16 or h < 16:
        return {"error": "bad raster size"}
    if axis is None:
        return {"error": "bad axis map"}
    if aw <= 0 or ah <= 0 or ax + aw > w or ay + ah > h:
        ax, ay, aw, ah = 0, 0, w, h
    marks = np.frombuffer(data, "<u4", frames, header).astype(np.int64)
    if (np.diff(marks) < 0).any() or (marks > samples).any():
        return {"error": "bad frame table"}
    known = lambda v: v if v else None
    return {
        "error": None, "rate_hz": rate / 1000, "lsb": scale, "raster_w": w, "raster_h": h, "active_x": ax, "active_y": ay, "active_w": aw, "active_h": ah,
        "fps": num / den if den else None, "readout_s": known(readout * 1e-6), "exposure_s": known(exposure * 1e-6), "focal_mm": known(focal * 1e-3), "mark_delay_s": delay * 1e-6,
        "axis": axis, "flags": flags, "preroll": preroll, "pitch_nm": known(pitch), "resolution": resolution, "dc_crop": crop, "bit_depth": depth, "sensor_mode": mode,
        "marks": marks, "samples": np.frombuffer(data, "<i2", 3 * samples, header + 4 * frames).reshape(-1, 3)}


def read_block(data: bytes) -> dict:
    """Fields and ``samples`` of one block, or an ``error``."""
    if len(data) < BLOCK_HEADER or data[:4] != BLOCK_MAGIC:
        return {"error": "no block"}
    version, header = struct.unpack_from("<HH", data, 4)
    frame, clock, n, ring, flags, lost, take, readout = struct.unpack_from("<IIHHHHII", data, 8)
    if version != 1:
        return {"error": "unsupported version"}
    if not BLOCK_HEADER <= header <= len(data):
        return {"error": "bad header size"}
    if n > MAX_SAMPLES or header + 6 * n > len(data):
        return {"error": "bad sample count"}
    delay, mode, resolution, crop, depth = struct.unpack_from("<iHBBB", data, 32)
    window = struct.unpack_from("<4H", data, WINDOW_AT) if len(data) >= WINDOW_AT + 8 else (0, 0, 0, 0)
    return {
        "error": None, "frame": frame, "clock_us": clock, "n": n, "ring_index": ring, "flags": flags, "lost": lost if flags & 2 else 0, "take": take, "readout_us": readout or None,
        "mark_delay_us": delay or None, "sensor_mode": mode, "resolution": resolution, "dc_crop": crop, "bit_depth": depth, "axis": _axes(struct.unpack_from("<3b", data, 42)),
        "lsb": struct.unpack_from("<H", data, 46)[0] or 131, **dict(zip(("window_w", "window_h", "recorded_w", "recorded_h"), (v or None for v in window))),
        "samples": np.frombuffer(data, "<i2", 3 * n, header).reshape(-1, 3)}


def find_block(data: bytes) -> dict:
    """The block of a frame file: at its usual place, else at the end of the maker note."""
    from kinegrain.sources import tiff

    got = read_block(data[FAST_OFFSET: FAST_OFFSET + REGION]) if len(data) >= FAST_OFFSET + REGION else {"error": "no block"}
    if got["error"] is None:
        return got
    try:
        place = tiff.maker_note(data)
    except ValueError:
        place = None
    if place is None:
        return {"error": "no maker note"}
    at, size = place
    if size < 4096:
        return {"error": "maker note too short"}
    return read_block(data[at + size - REGION: at + size])
