"""Readers and writers on files made here, byte by byte."""

import math
import struct

import numpy as np
import pytest

from kinegrain.sources import gyro, lens, lossless, readers, tiff


def sidecar(frames=20, samples=200, axis=(2, -1, 3), version=1, table=None, cut=0):
    head = bytearray(128)
    struct.pack_into("<4sHHIIIf6H", head, 0, b"FPGY", version, 128, frames, samples, 2_500_000, 131.0, 3264, 2170, 12, 5, 3240, 2160)
    struct.pack_into("<5Ii", head, 36, 25000, 1000, 24800, 0, 28000, 17000)
    struct.pack_into("<3bB6I", head, 60, *axis, 0, 60, 10000, 4, 0, 12, 0)
    marks = table if table is not None else np.arange(frames) * 10
    data = bytes(head) + np.asarray(marks, "<u4").tobytes() + np.arange(3 * samples, dtype="<i2").tobytes()
    return data[: len(data) - cut]


def block(frame=1, clock=5, n=4, take=3, lost=0):
    out = bytearray(3072)
    struct.pack_into("<4sHHIIHHHHII", out, 0, b"FPG2", 1, 48, frame, clock, n, 0, 2 if lost else 0, lost, take, 24800)
    struct.pack_into("<iHBBBx3bxH", out, 32, 0, 98, 1, 0, 12, 1, 2, -3, 0)
    struct.pack_into(f"<{3 * n}h", out, 48, *range(-3, 3 * n - 3))
    struct.pack_into("<4H", out, 3056, 4608, 3072, 3000, 2000)
    return bytes(out)


def dng(picture, order=">", bits=16, note=b"", opcodes=b"", **tags):
    h, w = picture.shape
    body = picture.astype(">u2").tobytes()
    short, long, rational = (lambda v: ("H", 3, v)), (lambda v: ("I", 4, v)), (lambda v: ("i", 10, [x for q in v for x in (round(q * 10000), 10000)]))
    entries = {254: long([0]), 256: long([w]), 257: long([h]), 258: short([bits]), 259: short([1]), 262: short([32803]), 273: long([0]), 279: long([len(body)]), 33422: ("B", 1, [0, 1, 1, 2]),
               50714: short([256]), 50717: long([4095]), 50721: rational(tags.get("cm1", [1, 0, 0, 0, 1, 0, 0, 0, 1])), 50728: rational([0.5, 1, 0.7]), 50778: short([21])}
    if opcodes:
        entries[51022] = ("B", 7, list(opcodes))
    exif = {37386: ("I", 5, [28, 1]), 42036: ("B", 2, list(b"A lens 28mm \0"))}
    if note:
        exif[37500] = ("B", 7, list(note))
    drop = tags.get("drop", ())
    entries = {k: v for k, v in entries.items() if k not in drop}

    def directory(items, at):
        size, extra, out = 2 + 12 * len(items) + 4, b"", struct.pack(order + "H", len(items))
        for tag, (form, kind, values) in sorted(items.items()):
            raw = struct.pack(order + form * len(values), *values)
            count = len(values) // (2 if kind in (5, 10) else 1)
            if len(raw) <= 4:
                out += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                out += struct.pack(order + "HHII", tag, kind, count, at + size + len(extra))
                extra += raw
        return out + struct.pack(order + "I", 0) + extra

    entries[34665] = long([0])
    base = len(directory(entries, 8))
    entries[34665] = long([8 + base])
    side = directory(exif, 8 + base)
    entries[273] = long([8 + base + len(side)])
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + directory(entries, 8) + side + body


def test_sidecar():
    got = gyro.read_sidecar(sidecar())
    assert got["error"] is None and got["rate_hz"] == 2500 and got["axis"] == [2, -1, 3] and got["exposure_s"] is None and got["fps"] == 25
    assert got["samples"].shape == (200, 3) and got["samples"][1].tolist() == [3, 4, 5]


@pytest.mark.parametrize("bad", [sidecar(cut=1), b"XPGY" + sidecar()[4:], sidecar(version=2), sidecar()[:64], sidecar(axis=(1, 1, 3)), sidecar(table=np.arange(20)[::-1]), b""])
def test_bad_sidecars(bad):
    assert gyro.read_sidecar(bad)["error"]


def test_block_places():
    assert gyro.read_block(block())["samples"].tolist()[0] == [-3, -2, -1]
    assert gyro.read_block(block(lost=7))["lost"] == 7 and gyro.read_block(block())["lsb"] == 131
    picture = np.zeros((8, 8), int)
    noted = dng(picture, "<", note=bytes(1500) + bytes(1024) + block(frame=9))
    assert gyro.find_block(noted)["frame"] == 9
    fast = bytearray(gyro.FAST_OFFSET + gyro.REGION)
    fast[gyro.FAST_OFFSET:] = block(frame=4)
    assert gyro.find_block(bytes(fast))["frame"] == 4
    assert gyro.find_block(dng(picture, "<"))["error"] and gyro.find_block(b"")["error"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_frame_header_and_samples(order):
    picture = np.random.default_rng(1).integers(0, 4095, (10, 12))
    data = dng(picture, order)
    f = tiff.read_frame(data)
    assert f.error is None and (f.width, f.height) == (12, 10) and f.black == [256.0] * 4 and f.lens_model == "A lens 28mm" and f.focal_mm == 28
    assert f.neutral == pytest.approx([0.5, 1, 0.7]) and f.iso is None
    assert (tiff.decode_raw(data, f) == picture).all()
    assert tiff.read_frame(data[:-5]).error and tiff.read_frame(b"junk").error and tiff.read_frame(dng(picture, order, drop=(50721,))).error


def test_opcodes():
    warp = struct.pack(">I6d2d", 1, 1.01, -0.02, 0.003, 0.0, 0, 0, 0.5, 0.5)
    gain = struct.pack(">10I", 0, 0, 100, 150, 0, 1, 1, 1, 2, 3) + bytes(32) + struct.pack(">I6f", 1, 1, 1.1, 1.2, 1.3, 1.2, 1.1)
    listed = struct.pack(">I", 2) + b"".join(struct.pack(">4I", k, 0, 0, len(b)) + b for k, b in ((1, warp), (9, gain)))
    f = tiff.read_frame(dng(np.zeros((4, 4), int), opcodes=listed))
    assert f.warp[:3] == [1.01, 0.0, -0.02] and (f.gain_rows, f.gain_cols) == (2, 3) and max(f.gain) == pytest.approx(1.3)


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16])
def test_unpack(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, (6, 8))
    flat = "".join(format(int(x), f"0{bits}b") for x in v.ravel())
    assert (tiff.unpack(bytes(int(flat[i: i + 8], 2) for i in range(0, len(flat), 8)), 8, 6, bits) == v).all()


def lossless_tile(picture, kind=1, precision=12, parts=1):
    h, w = picture.shape
    cols = w // parts
    samples = picture.reshape(h, cols, parts)
    # Seventeen codes of five bits each.
    head = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 2 + 17 + 17, 0) + bytes([0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17))
    head += b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * parts, precision, h, cols, parts) + b"".join(bytes([k, 0x11, 0]) for k in range(parts))
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * parts, parts) + b"".join(bytes([k, 0]) for k in range(parts)) + bytes([kind, 0, 0])
    bits = ""
    for y in range(h):
        for x in range(cols):
            for c in range(parts):
                at = lambda j, i: int(samples[j, i, c])  # noqa: B023, E731
                p = 1 << (precision - 1) if not x and not y else at(y, x - 1) if not y else at(y - 1, x) if not x else lossless.predict(kind, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1))
                d = at(y, x) - p
                s = abs(d).bit_length()
                bits += format(s, "05b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i: i + 8], 2) for i in range(0, len(bits), 8))
    return head + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


@pytest.mark.parametrize("kind", range(1, 8))
@pytest.mark.parametrize("parts", [1, 2])
def test_lossless(kind, parts):
    picture = np.random.default_rng(kind).integers(0, 4096, (7, 10))
    data = lossless_tile(picture, kind, parts=parts)
    assert (lossless.decode(data, 10, 7) == picture).all()
    with pytest.raises(ValueError):
        lossless.decode(b"\x00" + data, 10, 7)


LENSFUN = '<lensdatabase><lens><model>A 28mm f/2</model><cropfactor>1.5</cropfactor><distortion model="poly3" focal="28" k1="-0.04"/><vignetting model="pa" focal="28" aperture="2" distance="10" k1="-0.45" k2="0.12" k3="-0.03"/></lens></lensdatabase>'
ADOBE = """<x stCamera:LensPrettyName="B 35mm"><rdf stCamera:FocalLength="35" stCamera:ApertureValue="2" stCamera:FocusDistance="5">
<stCamera:PerspectiveModel stCamera:FocalLengthX="0.97" stCamera:RadialDistortParam1="-0.1" stCamera:RadialDistortParam2="0.02"><stCamera:VignetteModel stCamera:VignetteModelParam1="-0.5"/></stCamera:PerspectiveModel></rdf></x>"""


def test_profiles():
    points, error = lens.read_profile(LENSFUN.encode())
    assert error is None and points[0]["c"][0] == pytest.approx(1.04) and points[1]["v"] == [-0.45, 0.12, -0.03]
    assert points[1]["vignette_radius_mm"] == pytest.approx(0.5 * math.hypot(36, 24) / 1.5)
    (p,), error = lens.read_profile(ADOBE.encode())
    assert p["aperture"] == pytest.approx(2) and p["c"][2] == -0.1 and p["warp_radius_mm"] == pytest.approx(0.97 * 36) and p["v"][0] == -0.5
    assert lens.read_profile(b"hello")[1] and lens.read_profile(b"<stCamera:FisheyeModel/>")[1].startswith("fisheye")


def test_readers(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k in range(3):
        (tmp_path / f"A001_{k + 1:04d}.dng").write_bytes(dng(rng.integers(0, 4095, (6, 8)), "<", note=bytes(2000) + block(frame=k, clock=k * 40000)))
    (tmp_path / "A001_0004.DNG").write_bytes(b"broken")
    (tmp_path / "a.fpg").write_bytes(sidecar())
    (tmp_path / "lens.xml").write_text(LENSFUN)
    all_files = readers.files(spark, f"file://{tmp_path}")
    raw = readers.files(spark, f"file://{tmp_path}", "*.{dng,DNG}")
    assert readers.listing(all_files, "a001", ".dng").count() == 4
    assert sorted(r.error is None for r in readers.frames(raw).collect()) == [False, True, True, True]
    assert readers.mosaics(raw).count() == 18
    got = readers.blocks(raw).where("error IS NULL").orderBy("frame").collect()
    assert [r.clock_us for r in got] == [0, 40000, 80000] and got[0].samples[0].x == -3
    clip = readers.sidecars(readers.files(spark, f"file://{tmp_path}", "*.fpg")).first()
    assert clip.error is None and len(clip.marks) == 20 and clip.samples[1].z == 5
    assert readers.profiles(readers.files(spark, f"file://{tmp_path}", "*.xml")).count() == 2
    assert readers.probe(raw, "path", 2).count() == 2


def test_writers(spark, tmp_path):
    rows = [("c", f, y, [0.1 * y, 2.0], [0.5, 0.25], [-1.0, 1.0]) for f in (1, 2) for y in range(3)]
    out = readers.write_pictures(spark.createDataFrame(rows, "clip string, frame int, y int, r array<double>, g array<double>, b array<double>"), f"file://{tmp_path}/out").collect()
    assert sorted(r.name for r in out) == ["c-00000001.tif", "c-00000002.tif"]
    data = (tmp_path / "out" / "c-00000001.tif").read_bytes()
    t = tiff.Tiff(data)
    at = int(t.values(t.root, 273)[0])
    assert np.frombuffer(data, "<u2", 18, at).reshape(3, 2, 3)[2, 0].tolist() == [13107, 32768, 0] and (t.values(t.root, 256), t.values(t.root, 258)) == ([2.0], [16.0] * 3)
    assert readers.report(spark.createDataFrame([(1, None)], "a int, b int")).first()[0] == '{"a":1}'
    tracks = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 2)], "clip string, signature string, v int")
    readers.save_tracks(tracks, f"file://{tmp_path}/t")
    readers.save_tracks(tracks.where("clip = 'a'").selectExpr("clip", "'s2' AS signature", "v"), f"file://{tmp_path}/t")
    wanted = spark.createDataFrame([("a", "s1"), ("b", "s1")], "clip string, signature string")
    assert [r.clip for r in readers.load_tracks(spark, f"file://{tmp_path}/t", wanted).collect()] == ["b"]
