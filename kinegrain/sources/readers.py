"""Files of a folder as relations. Spark lists and reads them, so any store will do."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from kinegrain.sources import gyro, lens, tiff

FRAME_SCHEMA = """path string, width int, height int, bits int, compression int, cfa array<int>, black array<double>, white double, active_top int, active_left int,
 crop_x int, crop_y int, crop_w int, crop_h int, cm1 array<double>, cm2 array<double>, illum1 int, illum2 int, neutral array<double>, analog array<double>, baseline_exposure double,
 iso int, fps double, model string, focal_mm double, f_number double, focus_m double, exposure_s double, lens_model string, tile_w int, tile_h int, offsets array<bigint>, counts array<bigint>,
 warp array<double>, gain_rows int, gain_cols int, gain_planes int, gain array<double>, error string"""
_FRAME_FIELDS = [c.split()[0] for c in FRAME_SCHEMA.replace("\n", " ").split(", ")]
BLOCK_SCHEMA = """path string, frame bigint, clock_us bigint, n int, ring_index int, flags int, lost int, take bigint, readout_us bigint, mark_delay_us bigint, sensor_mode int, resolution int,
 dc_crop int, bit_depth int, axis array<int>, lsb int, window_w int, window_h int, recorded_w int, recorded_h int, samples array<struct<x smallint, y smallint, z smallint>>, error string"""
_BLOCK_FIELDS = [c.split()[0] for c in BLOCK_SCHEMA.split("samples")[0].replace("\n", " ").split(", ") if c.strip()]
CLIP_SCHEMA = """path string, rate_hz double, lsb double, raster_w int, raster_h int, active_x int, active_y int, active_w int, active_h int, fps double, readout_s double, exposure_s double,
 focal_mm double, mark_delay_s double, axis array<int>, flags int, preroll bigint, pitch_nm bigint, resolution int, dc_crop int, bit_depth int, sensor_mode int, marks array<bigint>, samples array<struct<x smallint, y smallint, z smallint>>, error string"""
_CLIP_FIELDS = [c.split()[0] for c in CLIP_SCHEMA.split("marks array")[0].replace("\n", " ").split(", ") if c.strip()]
POINT_SCHEMA = """path string, kind string, lens string, format_factor double, focal double, aperture double, distance double, c array<double>, warp_radius_mm double, v array<double>, vignette_radius_mm double, error string"""
_POINT_FIELDS = [c.split()[0] for c in POINT_SCHEMA.split(", ")]


def files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content; unused columns are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(folder)


def listing(files_: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Names that begin and end as given, ASCII case aside, without reading contents."""
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    return files_.select("path", name.alias("name"), "length", "modificationTime").where(low.startswith(prefix.lower()) & low.endswith(suffix.lower()))


def _rows(files_: DataFrame, parse, schema: str, fields: list[str]) -> DataFrame:
    kinds = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = parse(path, content.as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.field(n).type) for n in fields], names=fields)

    return files_.select("path", "content").mapInArrow(run, schema)


def frames(files_: DataFrame) -> DataFrame:
    """Headers of raw frames; a bad file is a row with an error."""
    def parse(path: str, content: bytes) -> list[dict]:
        return [{"path": path, **vars(tiff.read_frame(content))}]

    return _rows(files_, parse, FRAME_SCHEMA, _FRAME_FIELDS)


def mosaics(files_: DataFrame) -> DataFrame:
    """Decoded samples of frames as rows: path, y, r array<int>; undecodable frames give none."""
    def parse(path: str, content: bytes) -> list[dict]:
        f = tiff.read_frame(content)
        if f.error:
            return []
        try:
            picture = tiff.decode_raw(content, f)
        except (ValueError, IndexError, KeyError):
            return []
        return [{"path": path, "y": y, "r": row.astype("int32")} for y, row in enumerate(picture)]

    return _rows(files_, parse, "path string, y int, r array<int>", ["path", "y", "r"])


def _samples(a) -> list[dict]:
    return [{"x": int(x), "y": int(y), "z": int(z)} for x, y, z in a]


def blocks(files_: DataFrame) -> DataFrame:
    """The gyro block of every frame file."""
    def parse(path: str, content: bytes) -> list[dict]:
        got = gyro.find_block(content)
        return [{**got, "path": path, "samples": _samples(got["samples"]) if got["error"] is None else None}]

    return _rows(files_, parse, BLOCK_SCHEMA, [*_BLOCK_FIELDS, "samples", "error"])


def sidecars(files_: DataFrame) -> DataFrame:
    """Sidecar gyro files with their marks and samples."""
    def parse(path: str, content: bytes) -> list[dict]:
        got = gyro.read_sidecar(content)
        good = got["error"] is None
        return [{**got, "path": path, "samples": _samples(got["samples"]) if good else None, "marks": got["marks"].tolist() if good else None}]

    return _rows(files_, parse, CLIP_SCHEMA, [*_CLIP_FIELDS, "marks", "samples", "error"])


def profiles(files_: DataFrame) -> DataFrame:
    """Calibration points of lens profiles; a file without any is a row with an error."""
    def parse(path: str, content: bytes) -> list[dict]:
        points, error = lens.read_profile(content)
        return [{"path": path, **p, "error": None} for p in points] or [{"path": path, "error": error}]

    return _rows(files_, parse, POINT_SCHEMA, _POINT_FIELDS)


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """A 16-bit TIFF for each (clip, frame) of rows (clip, frame, y, r, g, b arrays); gives the files' names and sizes.

    ``folder`` is a URI that the executors share; a file appears when whole.
    """
    import numpy as np

    def run(group: pa.Table) -> pa.Table:
        from pyarrow import fs
        from pyspark import TaskContext

        order = np.argsort(group.column("y").to_numpy())
        rgb = np.stack([np.stack([group.column(c)[int(i)].values.to_numpy() for i in order]) for c in "rgb"], axis=-1)
        clip, frame = group.column("clip")[0].as_py(), group.column("frame")[0].as_py()
        data = tiff.write_rgb16(rgb)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{clip}-{frame:08d}.tif"
        context = TaskContext.get()
        part = f"{root}/_{name}.{context.taskAttemptId() if context else os.getpid()}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{root}/{name}")
        return pa.table({"clip": [clip], "frame": [frame], "name": [name], "size": [len(data)]})

    rows = pictures.select(F.col("clip").cast("string"), F.col("frame").cast("bigint"), F.col("y").cast("bigint"), "r", "g", "b")
    return rows.groupBy("clip", "frame").applyInArrow(run, "clip string, frame bigint, name string, size bigint")


def report(rows: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON text, unknown fields left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias(name))


def save_tracks(tracks: DataFrame, folder: str) -> None:
    """Keep tracks by clip with their signature; only the clips written are replaced."""
    tracks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clip").parquet(folder)


def load_tracks(spark: SparkSession, folder: str, signatures: DataFrame) -> DataFrame:
    """Saved tracks of the clips whose (clip, signature) still holds."""
    return spark.read.parquet(folder).join(signatures, ["clip", "signature"], "left_semi")


def probe(files_: DataFrame, order: str, count: int = 48) -> DataFrame:
    """About ``count`` evenly spaced files, to look at before a whole scan."""
    n = files_.count()
    step = max(1, n // count)
    return files_.withColumn("__k", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("__k") % step == 0).drop("__k")
