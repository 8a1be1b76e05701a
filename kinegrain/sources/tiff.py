"""TIFF structure and raw frame headers.

A value that cannot be read is null, a file that cannot be used is a row with
an error; nothing is thrown for a bad file.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: TIFF field types with their size and format; ASCII is read apart.
TYPES = {1: (1, "B"), 2: (1, ""), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 13: (4, "I")}
#: Tags of a raw frame.
TAGS = {
    "subfile": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_at": 273, "strip_size": 279, "subifds": 330,
    "tile_w": 322, "tile_h": 323, "tile_at": 324, "tile_size": 325, "cfa": 33422, "exif": 34665, "black_repeat": 50713, "black": 50714, "white": 50717,
    "crop_origin": 50719, "crop_size": 50720, "matrix1": 50721, "matrix2": 50722, "analog": 50727, "neutral": 50728, "baseline": 50730, "model": 50708,
    "illuminant1": 50778, "illuminant2": 50779, "active": 50829, "fps": 51044, "opcodes2": 51009, "opcodes3": 51022}
EXIF = {"exposure": 33434, "f_number": 33437, "iso": 34855, "distance": 37382, "focal": 37386, "maker_note": 37500, "lens": 42036}
RAW_PHOTOMETRIC = 32803
MOSAIC_COMPRESSIONS = (1, 7)


class Tiff:
    """Directories of a TIFF file held in memory, of either byte order."""

    def __init__(self, data: bytes) -> None:
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or len(data) < 16 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        self.data, self.order = data, order
        self.root = self.directory(struct.unpack_from(order + "I", data, 4)[0])

    def directory(self, at: int) -> dict[int, tuple[int, int, int]]:
        """tag -> (type, count, position of the values); unknown types and values outside the file are left out."""
        out: dict[int, tuple[int, int, int]] = {}
        if at + 2 > len(self.data):
            return out
        for k in range(struct.unpack_from(self.order + "H", self.data, at)[0]):
            e = at + 2 + 12 * k
            if e + 12 > len(self.data):
                break
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, e)
            if kind not in TYPES:
                continue
            size = TYPES[kind][0] * count
            place = e + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.data, e + 8)[0]
            if place + size <= len(self.data):
                out[tag] = (kind, count, place)
        return out

    def values(self, directory: dict, tag: int) -> list[float] | None:
        """Numbers of a tag; a rational with denominator 0 is 0."""
        if tag not in directory:
            return None
        kind, count, at = directory[tag]
        size, form = TYPES[kind]
        if not form:
            return None
        flat = struct.unpack_from(self.order + form[0] * (count * len(form)), self.data, at)
        if len(form) == 2:
            return [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2])]
        return [float(v) for v in flat]

    def text(self, directory: dict, tag: int) -> str | None:
        if tag not in directory or directory[tag][0] != 2:
            return None
        _, count, at = directory[tag]
        return bytes(self.data[at: at + count]).split(b"\0")[0].decode("utf-8", "replace").rstrip(" ")


@dataclass
class Frame:
    """Header of a raw frame; None where the file does not say."""

    width: int = 0
    height: int = 0
    bits: int = 0
    compression: int = 1
    cfa: list[int] = field(default_factory=lambda: [0, 1, 1, 2])
    black: list[float] = field(default_factory=lambda: [0.0] * 4)
    white: float = 0.0
    active_top: int = 0
    active_left: int = 0
    crop_x: int = 0
    crop_y: int = 0
    crop_w: int = 0
    crop_h: int = 0
    cm1: list[float] | None = None
    cm2: list[float] | None = None
    illum1: int | None = None
    illum2: int | None = None
    neutral: list[float] | None = None
    analog: list[float] | None = None
    baseline_exposure: float = 0.0
    iso: int | None = None
    fps: float | None = None
    model: str | None = None
    focal_mm: float | None = None
    f_number: float | None = None
    focus_m: float | None = None
    exposure_s: float | None = None
    lens_model: str | None = None
    tile_w: int = 0
    tile_h: int = 0
    offsets: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    warp: list[float] | None = None
    gain_rows: int | None = None
    gain_cols: int | None = None
    gain_planes: int | None = None
    gain: list[float] | None = None
    error: str | None = None


def opcodes(data: bytes) -> list[tuple[int, bytes]]:
    """(id, payload) of an opcode list, which is big-endian in any file."""
    out, at = [], 4
    if len(data) < 4:
        return out
    for _ in range(struct.unpack_from(">I", data)[0]):
        if at + 16 > len(data):
            break
        kind, _, _, size = struct.unpack_from(">4I", data, at)
        if at + 16 + size > len(data):
            break
        out.append((kind, data[at + 16: at + 16 + size]))
        at += 16 + size
    return out


def read_warp(body: bytes) -> list[float] | None:
    """Seven radial coefficients and the centre of a rectilinear warp; of three planes the green one."""
    planes = struct.unpack_from(">I", body)[0] if len(body) >= 4 else 0
    if planes not in (1, 3) or len(body) < 4 + 48 * planes + 16:
        return None
    even = struct.unpack_from(">4d", body, 4 + 48 * (planes // 2))
    cx, cy = struct.unpack_from(">2d", body, 4 + 48 * planes)
    sane = 0.5 < even[0] < 2 and 0.2 < cx < 0.8 and 0.2 < cy < 0.8 and all(abs(v) < 2 for v in even[1:])
    return [even[0], 0.0, even[1], 0.0, even[2], 0.0, even[3], cx, cy] if sane else None


def read_gain(body: bytes) -> tuple[int, int, int, list[float]] | None:
    """(rows, columns, planes, gains) of a map over every pixel with gains between 0.05 and 20."""
    if len(body) < 76:
        return None
    v = struct.unpack_from(">10I", body)
    rows, cols, planes = v[8], v[9], struct.unpack_from(">I", body, 72)[0]
    n = rows * cols * planes
    if v[6:8] != (1, 1) or not (2 <= rows <= 512 and 2 <= cols <= 512 and planes in (1, 3)) or len(body) < 76 + 4 * n:
        return None
    gains = np.frombuffer(body, ">f4", n, 76).astype(float)
    return (rows, cols, planes, gains.tolist()) if ((gains > 0.05) & (gains < 20)).all() else None


def read_frame(data: bytes, whole: bool = True) -> Frame:
    """The header of a raw frame. With ``whole`` unset, image data may lie beyond what was read."""
    f = Frame()
    try:
        t = Tiff(data)
    except ValueError as e:
        f.error = str(e)
        return f
    raw = t.root
    for at in t.values(t.root, TAGS["subifds"]) or []:
        sub = t.directory(int(at))
        kind, photo = t.values(sub, TAGS["subfile"]), t.values(sub, TAGS["photometric"])
        if (kind or [0])[0] == 0 and photo and photo[0] == RAW_PHOTOMETRIC:
            raw = sub
            break
    exif = t.directory(int((t.values(t.root, TAGS["exif"]) or [len(data)])[0]))
    own = lambda name, default=None: t.values(raw, TAGS[name]) or default
    either = lambda name, default=None: t.values(raw, TAGS[name]) or t.values(t.root, TAGS[name]) or default
    root = lambda name, default=None: t.values(t.root, TAGS[name]) or default
    side = lambda name: (t.values(exif, EXIF[name]) or [None])[0]
    positive = lambda v: v if v else None
    f.width, f.height, f.bits, f.compression = (int(own(n, [d])[0]) for n, d in (("width", 0), ("height", 0), ("bits", 0), ("compression", 1)))
    if own("photometric", [0])[0] != RAW_PHOTOMETRIC:
        f.error = "not a mosaic frame"
        return f
    if not (0 < f.width <= 16384 and 0 < f.height <= 16384 and 8 <= f.bits <= 16):
        f.error = "unsupported raw dimensions"
        return f
    tiled = own("tile_at") and own("tile_size")
    at, size = (own("tile_at"), own("tile_size")) if tiled else (own("strip_at"), own("strip_size"))
    if tiled:
        f.tile_w, f.tile_h = int(own("tile_w", [0])[0]), int(own("tile_h", [0])[0])
    if not at or not size or len(at) != len(size):
        f.error = "missing raw data offsets"
        return f
    f.offsets, f.counts = [int(v) for v in at], [int(v) for v in size]
    if whole and any(a + n > len(data) for a, n in zip(f.offsets, f.counts)):
        f.error = "raw data outside file"
        return f
    if len(own("cfa", [])) == 4:
        f.cfa = [int(v) for v in own("cfa")]
    if any(not 0 <= c <= 2 for c in f.cfa):
        f.error = "unsupported mosaic"
        return f
    repeat = [max(1, int(v)) for v in either("black_repeat", [1, 1])]
    black = own("black")
    if black:
        place = [(y % repeat[0]) * repeat[1] + x % repeat[1] for y in (0, 1) for x in (0, 1)]
        f.black = [black[i] if i < len(black) else black[0] for i in place]
    f.white = either("white", [float((1 << f.bits) - 1)])[0]
    active = either("active", [0, 0])
    f.active_top, f.active_left = int(active[0]), int(active[1])
    (f.crop_x, f.crop_y), (f.crop_w, f.crop_h) = ([int(v) for v in either(n, d)[:2]] for n, d in (("crop_origin", [0, 0]), ("crop_size", [f.width, f.height])))
    fits = f.crop_x >= 0 and f.crop_y >= 0 and f.crop_w > 0 and f.crop_h > 0
    if not fits or f.active_left + f.crop_x + f.crop_w > f.width or f.active_top + f.crop_y + f.crop_h > f.height:
        f.crop_x = f.crop_y = f.active_left = f.active_top = 0
        f.crop_w, f.crop_h = f.width, f.height
    three = lambda v, n: v if v and len(v) == n else None
    f.cm1, f.cm2 = three(root("matrix1"), 9), three(root("matrix2"), 9)
    f.neutral, f.analog = three(root("neutral"), 3), three(root("analog"), 3)
    f.illum1, f.illum2 = (positive(int(root(n, [0])[0])) for n in ("illuminant1", "illuminant2"))
    f.baseline_exposure = root("baseline", [0.0])[0]
    f.fps = positive(root("fps", [0])[0])
    f.model = t.text(t.root, TAGS["model"])
    f.focal_mm, f.f_number, f.focus_m = (positive(side(n)) for n in ("focal", "f_number", "distance"))
    exposure = side("exposure")
    f.exposure_s = exposure if exposure and 0 < exposure < 10 else None
    iso = side("iso") or (t.values(t.root, EXIF["iso"]) or [None])[0]
    f.iso = int(iso) if iso else None
    f.lens_model = t.text(exif, EXIF["lens"]) or None
    for name in ("opcodes3", "opcodes2"):
        entry = raw.get(TAGS[name]) or t.root.get(TAGS[name])
        for kind, body in opcodes(bytes(data[entry[2]: entry[2] + entry[1]])) if entry else []:
            if kind == 1 and f.warp is None:
                f.warp = read_warp(body)
            elif kind == 9 and f.gain is None and (got := read_gain(body)):
                f.gain_rows, f.gain_cols, f.gain_planes, f.gain = got
    if f.cm1 is None:
        f.error = "no first colour matrix"
    elif f.compression not in MOSAIC_COMPRESSIONS:
        f.error = "unsupported compression"
    return f


def maker_note(data: bytes) -> tuple[int, int] | None:
    """(position, size) of the maker note of a little-endian file."""
    if data[:2] != b"II":
        return None
    t = Tiff(data)
    exif = t.directory(int((t.values(t.root, TAGS["exif"]) or [len(data)])[0]))
    entry = exif.get(EXIF["maker_note"])
    return (entry[2], entry[1]) if entry else None


def unpack(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Samples packed from the most significant bit on; 16-bit ones are big-endian.

    Rows of 12 bits take whole bytes each, and an odd width's last sample stays 0.
    """
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[: 2 * width * height].view(">u2").reshape(height, width).astype(np.uint16)
    if bits == 12:
        row = width * 3 // 2
        three = raw[: row * height].reshape(height, row)[:, : width // 2 * 3].reshape(height, width // 2, 3).astype(np.uint16)
        out = np.zeros((height, width), np.uint16)
        out[:, 0: width // 2 * 2: 2] = three[..., 0] << 4 | three[..., 1] >> 4
        out[:, 1: width // 2 * 2: 2] = (three[..., 1] & 15) << 8 | three[..., 2]
        return out
    flat = np.unpackbits(raw)[: width * height * bits].reshape(height, width, bits)
    return (flat @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint16)


def decode_raw(data: bytes, f: Frame) -> np.ndarray:
    """The mosaic of a frame; any bad tile fails the frame."""
    from kinegrain.sources import lossless

    if f.compression == 1:
        if f.tile_w or any(a + n != b for a, n, b in zip(f.offsets, f.counts, f.offsets[1:])):
            raise ValueError("strips are not contiguous")
        need = f.height * (f.width * 3 // 2) if f.bits == 12 else -(-f.width * f.height * f.bits // 8)
        if sum(f.counts) < need:
            raise ValueError("raw data is short")
        return unpack(data[f.offsets[0]: f.offsets[0] + sum(f.counts)], f.width, f.height, f.bits)
    w, h = f.tile_w or f.width, f.tile_h or f.height
    across, down = -(-f.width // w), -(-f.height // h)
    if len(f.offsets) != across * down:
        raise ValueError("wrong number of tiles")
    out = np.zeros((down * h, across * w), np.uint16)
    for k, (at, n) in enumerate(zip(f.offsets, f.counts)):
        y, x = divmod(k, across)
        out[y * h: (y + 1) * h, x * w: (x + 1) * w] = lossless.decode(data[at: at + n], w, h)
    return out[: f.height, : f.width]


def write_rgb16(rgb: np.ndarray) -> bytes:
    """An uncompressed 16-bit RGB TIFF of a (h, w, 3) picture with values 0 .. 1, top row first."""
    h, w = rgb.shape[:2]
    body = np.floor(np.clip(rgb, 0, 1) * 65535 + 0.5).astype("<u2").tobytes()
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, 0), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 0), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(body))]
    extra = 8 + 2 + 12 * len(entries) + 4
    out = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(entries)))
    for tag, kind, count, v in entries:
        v = extra if tag == 258 else extra + 6 if tag == 273 else v
        out += struct.pack("<HHII", tag, kind, count, v)
    return bytes(out + struct.pack("<I3H", 0, 16, 16, 16) + body)
