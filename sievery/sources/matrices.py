"""Matrices of NumPy (.npy, .npz) and safetensors files as a Python data source, read by ranges of rows.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").option("member", "vectors").load(path)

gives (row long, vector array<float or double>). A file is cut into ranges of rows; each task seeks to its own range and
reads no other byte, except in compressed .npz members, which are streams: there a task reads up to its range. `columns`
(as 0:64,128) keeps some columns, rows are read in blocks of BLOCK bytes. A folder is all files in it with one of the
suffixes, in the order of their names, rows numbered on.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, SUFFIXES = 4 << 20, (".npy", ".npz", ".safetensors")
#: The kinds of numbers that safetensors names, as NumPy calls them.
TENSOR_KINDS = {"F16": "<f2", "F32": "<f4", "F64": "<f8", "I8": "i1", "U8": "u1", "I16": "<i2", "I32": "<i4", "I64": "<i8", "BOOL": "?"}


@dataclass
class Matrix:
    """Where a matrix lies: rows x width numbers from `at` on, in the file itself or in a member of an archive."""

    path: str
    member: str | None
    at: int
    kind: str
    rows: int
    width: int
    columnwise: bool = False
    packed: bool = False


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as pyarrow knows it, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def shaped(shape: tuple[int, ...], path: str) -> tuple[int, int]:
    if len(shape) not in (1, 2):
        raise ValueError(f"a matrix has one or two dimensions, {path} has {len(shape)}")
    return (shape[0], 1) if len(shape) == 1 else shape


def npy_header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    major, _ = npy.read_magic(stream)
    shape, columnwise, kind = npy.read_array_header_1_0(stream) if major == 1 else npy.read_array_header_2_0(stream)
    if kind.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, columnwise, kind


def found(path: str, member: str | None) -> Matrix:
    """The matrix in a file; its header alone is read. member: the array of an archive, the first one by name if None."""
    files, inner = opened(path)
    with files.open_input_file(inner) as f:
        if path.endswith(".npz"):
            with zipfile.ZipFile(f) as archive:
                names = sorted(n for n in archive.namelist() if n.endswith(".npy"))
                name = f"{member}.npy" if member else (names or [""])[0]
                if name not in names:
                    raise ValueError(f"{path} has no array {member or ''}")
                info = archive.getinfo(name)
                with archive.open(name) as stream:
                    shape, columnwise, kind = npy_header(stream)
                    skip = stream.tell()
            f.seek(info.header_offset + 26)  # the member's own header may be longer than the directory says
            lengths = struct.unpack("<HH", f.read(4))
            packed = info.compress_type != zipfile.ZIP_STORED
            at = skip if packed else info.header_offset + 30 + sum(lengths) + skip
            return Matrix(path, name, at, kind.str, *shaped(shape, path), columnwise and len(shape) == 2, packed)
        if path.endswith(".safetensors"):
            (size,) = struct.unpack("<Q", f.read(8))
            header = json.loads(f.read(size))
            names = sorted(n for n in header if n != "__metadata__")
            name = member or (names or [""])[0]
            if name not in names or header[name]["dtype"] not in TENSOR_KINDS:
                raise ValueError(f"{path} has no tensor {name} of a known kind")
            entry = header[name]
            return Matrix(path, name, 8 + size + entry["data_offsets"][0], TENSOR_KINDS[entry["dtype"]], *shaped(tuple(entry["shape"]), path))
        shape, columnwise, kind = npy_header(f)
        return Matrix(path, None, f.tell(), kind.str, *shaped(shape, path), columnwise and len(shape) == 2)


def rows_of(matrix: Matrix, first: int, last: int, columns: np.ndarray | None) -> Iterator[np.ndarray]:
    """The rows from first to last, exclusive, in blocks."""
    kind = np.dtype(matrix.kind)
    files, inner = opened(matrix.path)
    step = max(1, BLOCK // max(1, kind.itemsize * matrix.width))
    with files.open_input_file(inner) as f:
        archive = zipfile.ZipFile(f).open(matrix.member) if matrix.packed else None
        place = 0

        def read(at: int, size: int) -> bytes:
            nonlocal place
            if archive is None:
                f.seek(at)
                return f.read(size)
            while place < at:  # a compressed member has no seek
                place += len(archive.read(min(BLOCK, at - place))) or at
            place += size
            return archive.read(size)

        if matrix.columnwise and matrix.packed:
            raise ValueError(f"{matrix.path}: a compressed matrix must be stored by rows")
        for start in range(first, last, step):
            n = min(step, last - start)
            if matrix.columnwise:
                wanted = range(matrix.width) if columns is None else columns
                parts = [np.frombuffer(read(matrix.at + (c * matrix.rows + start) * kind.itemsize, n * kind.itemsize), kind) for c in wanted]
                yield np.stack(parts, axis=1) if parts else np.zeros((n, 0), kind)
            else:
                block = np.frombuffer(read(matrix.at + start * matrix.width * kind.itemsize, n * matrix.width * kind.itemsize), kind).reshape(n, matrix.width)
                yield block if columns is None else block[:, columns]


@dataclass
class Rows(InputPartition):
    matrix: Matrix
    first: int
    last: int
    base: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict, wide: bool):
        self.options, self.wide = options, wide

    def files(self) -> list[str]:
        path = self.options["path"]
        files, inner = opened(path)
        if files.get_file_info(inner).type != pafs.FileType.Directory:
            return [path]
        names = sorted(x.base_name for x in files.get_file_info(pafs.FileSelector(inner)) if x.is_file and x.base_name.endswith(SUFFIXES))
        return [f"{path.rstrip('/')}/{n}" for n in names]

    def partitions(self) -> list[InputPartition]:
        """Ranges of about `rows` rows (by default 64 MB of numbers)."""
        parts, base = [], 0
        for path in self.files():
            m = found(path, self.options.get("member"))
            step = int(self.options.get("rows") or max(1, (64 << 20) // max(1, np.dtype(m.kind).itemsize * m.width)))
            parts += [Rows(m, a, min(a + step, m.rows), base + a) for a in range(0, m.rows, step)]
            base += m.rows
        return parts or [Rows(Matrix("", None, 0, "<f4", 0, 0), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        columns, at = self.columns(partition.matrix.width), partition.base
        number = pa.float64() if self.wide else pa.float32()
        if partition.first == partition.last:
            return
        for block in rows_of(partition.matrix, partition.first, partition.last, columns):
            flat = pa.array(np.ascontiguousarray(block, np.float64 if self.wide else np.float32).reshape(-1), number)
            ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(block))), pa.ListArray.from_arrays(ends, flat)], ["row", "vector"])
            at += len(block)

    def columns(self, width: int) -> np.ndarray | None:
        text = self.options.get("columns")
        if not text:
            return None
        ranges = [(int(a), int(b or int(a) + 1)) for a, _, b in (p.partition(":") for p in text.split(","))]
        if any(not 0 <= a <= b <= width for a, b in ranges):
            raise ValueError(f"columns {text} of a matrix of {width}")
        return np.concatenate([np.arange(a, b) for a, b in ranges])


class MatrixSource(DataSource):
    """Options: path, member, rows (of a task), columns, double (true: array<double>)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return f"row long, vector array<{'double' if self.wide() else 'float'}>"

    def wide(self) -> bool:
        return str(self.options.get("double", "false")).lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(dict(self.options), self.wide())
