"""`.npy` volumes as a Spark data source.

``spark.read.format("npy_volume").option("root", dir).load()`` reads every
sample folder under ``root``, in any store that Arrow's file systems reach
(``file:``, ``s3:``, ``gs:``, ``hdfs:``) or that option ``filesystem`` names as
``module:function``, a function that takes the root and returns such a file system
and the path in it.  A file is split into slabs along its slowest axis and a task
reads its slab as one range of bytes, so one large image is read by many tasks and
nobody needs the file on a local disk.  Both label files of a sample are read
together, which avoids joining them voxel by voxel.
"""

from __future__ import annotations

import importlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLAB_VOXELS = 2_000_000
BATCH_VOXELS = 200_000


def open_store(root: str, factory: str | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if factory:
        module, name = factory.split(":")
        return getattr(importlib.import_module(module), name)(root)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    root = re.sub("^s3[an]://", "s3://", root)  # Hadoop's names of the store
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


@dataclass(frozen=True)
class Layout:
    """Where an array lies in its file."""
    path: str
    offset: int
    dtype: str
    shape: tuple[int, ...]
    fortran: bool


def layout(store: fs.FileSystem, path: str) -> Layout:
    """Reads the header only."""
    with store.open_input_file(path) as file:
        version = npy.read_magic(file)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path}: .npy version {version} is not supported")
        shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
        if dtype.hasobject:
            raise ValueError(f"{path}: holds objects")
        return Layout(path, file.tell(), dtype.str, shape, fortran and len(shape) > 1)


def read_slab(store: fs.FileSystem, at: Layout, axis: int, start: int, stop: int) -> np.ndarray:
    """Planes ``start`` to ``stop`` along ``axis`` (0 or 2).

    One range of bytes where the axis is the slowest of the file's order; else the
    planes of the slowest axis are read one after another and cut.
    """
    dtype, (nx, ny, nz) = np.dtype(at.dtype), at.shape
    slow = 2 if at.fortran else 0
    plane = dtype.itemsize * ny * (nx if at.fortran else nz)

    def planes(file, first: int, last: int) -> np.ndarray:
        data = file.read_at((last - first) * plane, at.offset + first * plane)
        if len(data) != (last - first) * plane:
            raise ValueError(f"{at.path}: shorter than its header says")
        flat = np.frombuffer(data, dtype)
        return flat.reshape((nx, ny, last - first), order="F") if at.fortran else flat.reshape(last - first, ny, nz)

    with store.open_input_file(at.path) as file:
        if axis == slow:
            return planes(file, start, stop)
        cut = [slice(None)] * 3
        cut[axis] = slice(start, stop)
        return np.concatenate([planes(file, k, k + 1)[tuple(cut)] for k in range(at.shape[slow])], axis=slow)


class Slab(InputPartition):
    def __init__(self, ms_id: str, files: dict[str, Layout], axis: int, start: int, stop: int):
        self.ms_id, self.files, self.axis, self.start, self.stop = ms_id, files, axis, start, stop


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.factory = options["root"], options.get("filesystem")
        self.names = {"phase": options.get("segmented_file", "segmented.npy"),
                      "body": options.get("body_file", "body_array.npy")}
        self.slab = int(options.get("slab_voxels", SLAB_VOXELS))

    def partitions(self):
        store, root = open_store(self.root, self.factory)
        out = []
        for folder in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if folder.type != fs.FileType.Directory:
                continue
            paths = {k: f"{folder.path}/{name}" for k, name in self.names.items()}
            found = {info.path for info in store.get_file_info(list(paths.values())) if info.type == fs.FileType.File}
            files = {k: layout(store, p) for k, p in paths.items() if p in found}
            if not files:
                continue
            shapes = {f.shape for f in files.values()}
            if len(shapes) != 1 or len(next(iter(shapes))) != 3:
                raise ValueError(f"{folder.path}: expected 3-D volumes of one shape, got {sorted(shapes)}")
            shape = shapes.pop()
            axis = 2 if all(f.fortran for f in files.values()) else 0
            step = max(1, self.slab // max(1, int(np.prod(shape)) // max(1, shape[axis])))
            out += [Slab(folder.base_name, files, axis, a, min(shape[axis], a + step)) for a in range(0, shape[axis], step)]
        return out

    def read(self, part):
        store, _ = open_store(self.root, self.factory)
        shape = list(next(iter(part.files.values())).shape)
        shape[part.axis] = 1
        planes = max(1, BATCH_VOXELS // max(1, int(np.prod(shape))))
        volumes = {k: read_slab(store, f, part.axis, part.start, part.stop) for k, f in part.files.items()}
        for a in range(part.start, part.stop, planes):
            b = min(part.stop, a + planes)
            ranges = [np.arange(n, dtype="int32") for n in next(iter(part.files.values())).shape]
            ranges[part.axis] = np.arange(a, b, dtype="int32")
            x, y, z = np.meshgrid(*ranges, indexing="ij")
            inner = [slice(None)] * 3
            inner[part.axis] = slice(a - part.start, b - part.start)
            cols = [pa.array([part.ms_id] * x.size), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(z.ravel())]
            for k, kind in (("phase", "int32"), ("body", "int64")):
                cols.append(pa.array(volumes[k][tuple(inner)].astype(kind).ravel()) if k in volumes
                            else pa.nulls(x.size, pa.type_for_alias(kind)))
            yield pa.RecordBatch.from_arrays(cols, names=["ms_id", "x", "y", "z", "phase", "body"])


class NpyVolume(DataSource):
    @classmethod
    def name(cls):
        return "npy_volume"

    def schema(self):
        return "ms_id string, x int, y int, z int, phase int, body bigint"

    def reader(self, schema):
        return NpyReader(self.options)


def read_volumes(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(NpyVolume)
    reader = spark.read.format("npy_volume").option("root", root)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()
