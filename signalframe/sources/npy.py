"""A data source for ``.npy`` files that are cut into byte ranges.

Planning only lists files and their sizes.  Each task reads the header of its file and then its own range, so one large
array is shared by many tasks and no row holds more than ``CHUNK_VALUES`` values.  Paths are opened through Arrow's file
systems (local and shared folders, HDFS, object stores).  An array in column-major order, whose file order is not that of its
rows, is read by one task.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK_VALUES = 65_536


class NpyRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def open_path(path: str):
    """(Arrow file system, path in it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def npy_header(stream) -> tuple:
    """(dtype, shape, column-major, first data byte) of an open .npy file."""
    import numpy as np

    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(stream)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return kind, shape, fortran and len(shape) > 1, stream.tell()


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, chunk: int):
        self.path, self.range_bytes, self.chunk = path, range_bytes, chunk

    def partitions(self) -> list[NpyRange]:
        from pyarrow import fs

        system, root = open_path(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        files = sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".npy")), key=lambda f: f.path)
        scheme = self.path.split(root)[0] if ":/" in self.path and root in self.path else ""
        out = [NpyRange(scheme + f.path, a, min(a + self.range_bytes, f.size)) for f in files for a in range(0, f.size, self.range_bytes)]
        if not out:
            raise ValueError(f"no .npy file in {self.path}")
        return out

    def read(self, part: NpyRange) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, path = open_path(part.path)
        with system.open_input_file(path) as stream:
            kind, shape, whole, data = npy_header(stream)
            size = int(np.prod(shape, dtype=np.int64))
            if whole:
                first, last = (0, size) if part.start == 0 else (0, 0)
            else:
                first, last = (min(size, max(0, -(-(edge - data) // kind.itemsize))) for edge in (part.start, part.stop))
            name = posixpath.basename(path)
            held = None
            if whole and last:
                stream.seek(data)
                held = np.frombuffer(stream.read(size * kind.itemsize), kind).reshape(shape, order="F").ravel().astype(float)
            # an array without values still has one row
            starts = range(first, last, self.chunk) if size else [0] if part.start == 0 else []
            for a in starts:
                b = min(a + self.chunk, last)
                if held is None:
                    stream.seek(data + a * kind.itemsize)
                    values = np.frombuffer(stream.read((b - a) * kind.itemsize), kind).astype(float)
                else:
                    values = held[a:b]
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([a], pa.int64()), lists],
                                                 schema=pa.schema([("sample_id", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("values", pa.list_(pa.float64()))]))


class NpySource(DataSource):
    """Options ``range_bytes`` and ``chunk_values``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "sample_id string, size bigint, offset bigint, values array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("chunk_values", CHUNK_VALUES)))


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """(sample_id, size, offset, values): pieces of the flattened arrays of a folder or file; ``offset`` is the place of a piece's first value."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("range_bytes", range_bytes).option("chunk_values", chunk_values).load(path)


def own_label(sample_id: Column | str) -> Column:
    """The part of a file name before the first underscore."""
    name = F.regexp_replace(F.col(sample_id) if isinstance(sample_id, str) else sample_id, r"\.npy$", "")
    return F.split(name, "_")[0]


def with_labels(pieces: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pieces`` with ``label``: that of ``labels`` (file, label) where the file is listed, else from its name."""
    if labels is None:
        return pieces.withColumn("label", own_label("sample_id"))
    known = labels.select(F.col("file").alias("sample_id"), F.col("label").cast("string").alias("_sf_listed"))
    return pieces.join(known, "sample_id", "left").withColumn("label", F.coalesce("_sf_listed", own_label("sample_id"))).drop("_sf_listed")


def write_files(rows: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Write every row's binary ``content`` as the file ``name`` (folders allowed) below ``path``; returns (name, bytes).

    A file is written under another name and then moved, so a task that runs again leaves whole files.
    """
    from ..session import cut_lineage

    def write(batches):
        import posixpath
        import uuid

        import pyarrow as pa

        system, root = open_path(path)
        for batch in batches:
            names = batch["name"].to_pylist()
            for file, data in zip(names, batch["content"].to_pylist()):
                folder, last = posixpath.split(f"{root}/{file}")
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(b) for b in batch["content"].to_pylist()], pa.int64())], names=["name", "bytes"])

    return cut_lineage(rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(write, "name string, bytes bigint"))


def write_npy(rows: DataFrame, path: str, name: str = "sample_id", values: str = "features", width: int | None = None) -> DataFrame:
    """Write every row's array as a .npy file of ``path`` (``width``: as a matrix of such rows); returns (name, bytes)."""
    def encode_all(arrays):
        import io

        import numpy as np
        import pyarrow as pa

        def one(a):
            buffer = io.BytesIO()
            x = np.asarray(a, dtype=float)
            np.save(buffer, x.reshape(-1, width) if width else x)
            return buffer.getvalue()

        return pa.array([one(a.as_py()) for a in arrays], pa.binary())

    encode = F.arrow_udf(encode_all, "binary", F.ArrowUDFType.SCALAR)
    return write_files(rows.select(F.col(name).alias("name"), encode(values).alias("content")), path, "name", "content")
