"""Binary vector and graph files as Spark data sources.

Register with ``register(spark)``; then ``spark.read.format(...).load(path)`` and
``df.write.format(...).mode("overwrite").save(path)``. Formats:

``vecbin``         .fbin, .u8bin, .ibin: u32 rows, u32 dim, values; columns vec_id, embedding
``vecs``           .fvecs, .bvecs, .ivecs: per row u32 dim, values
``npy``            a two-dimensional NumPy file in C order; columns vec_id, embedding (read only)
``idmap``          u32 rows, u32 values; columns local_id, vec_id
``groundtruth``    u32 queries, u32 k, i32 ids; columns query_id, rank, neighbor_id
``fixedgraph``     fixed-degree graph with NumPy headers; columns src, pos, dst
``variablegraph``  variable-degree graph; columns src, pos, dst
``layeredgraph``   hierarchical graph; columns layer, src, pos, dst

Readers split files into byte ranges of whole rows, one task each. Files may be
in any store that pyarrow's file systems know. Writers sort by id first; each
task writes its own part beside the target, and the commit appends the parts in
order in a streaming copy, so no task or driver holds a file.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Element types by the last part of a file's name.
BIN_TYPES = {"fbin": "<f4", "u8bin": "u1", "ibin": "<u4"}
VECS_TYPES = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<u4"}
SPARK_TYPES = {"<f4": "float", "u1": "short", "<u4": "long"}
ARROW_TYPES = {"<f4": pa.float32(), "u1": pa.int16(), "<u4": pa.int64()}
#: Fixed values of the fixed-degree format: version, bytes of a NumPy header, where the neighbours start.
GRAPH_VERSION, HEADER, GRAPH_START = 4, 128, 790
ROWS = 65_536


def element_type(path: str, known: dict[str, str]) -> str:
    """The element type that a path's suffix names; an error for any other suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in known:
        raise ValueError(f"{path}: the suffix must be one of {', '.join(known)}")
    return known[suffix]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def read_at(path: str, start: int, size: int) -> bytes:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        data = f.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"{path}: {size} bytes expected at {start}, {len(data)} found")
    return data


def size_of(path: str) -> int:
    fs, name = opened(path)
    return fs.get_file_info(name).size


def numpy_header(kind: str, shape: tuple[int, ...]) -> bytes:
    """A version 1.0 NumPy header, padded to 128 bytes."""
    said = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({', '.join(map(str, shape))}{',' if len(shape) == 1 else ''})}}"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", HEADER - 10) + said.ljust(HEADER - 11).encode() + b"\n"


@dataclass
class Span(InputPartition):
    """Rows [first, last) of a file."""

    first: int
    last: int


def spans(rows: int, per: int = ROWS) -> list[Span]:
    return [Span(k, min(k + per, rows)) for k in range(0, rows, per)] or [Span(0, 0)]


def vectors_batch(first: int, values: np.ndarray, kind: str) -> pa.RecordBatch:
    n, dim = values.shape
    flat = pa.array(np.ascontiguousarray(values).ravel().astype({"<f4": np.float32, "u1": np.int16, "<u4": np.int64}[kind]), ARROW_TYPES[kind])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n, dtype=np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim or 1, dtype=np.int32)[: n + 1]), flat)], ["vec_id", "embedding"])


def edges_batch(src: np.ndarray, pos: np.ndarray, dst: np.ndarray, layer: int | None = None) -> pa.RecordBatch:
    columns = [pa.array(src, pa.int64()), pa.array(pos, pa.int32()), pa.array(dst, pa.int64())]
    names = ["src", "pos", "dst"]
    if layer is not None:
        columns, names = [pa.array(np.full(len(src), layer, np.int32)), *columns], ["layer", *names]
    return pa.RecordBatch.from_arrays(columns, names)


def fixed_edges(first: int, matrix: np.ndarray, layer: int | None = None) -> pa.RecordBatch:
    n, degree = matrix.shape
    return edges_batch(np.repeat(np.arange(first, first + n), degree), np.tile(np.arange(1, degree + 1), n), matrix.ravel().astype(np.int64), layer)


class BinReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.kind = path, np.dtype(element_type(path, BIN_TYPES))
        self.rows, self.dim = struct.unpack("<II", read_at(path, 0, 8))
        if size_of(path) < 8 + self.rows * self.dim * self.kind.itemsize:
            raise ValueError(f"{path} is shorter than its header says")

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        row = self.dim * self.kind.itemsize
        data = read_at(self.path, 8 + partition.first * row, (partition.last - partition.first) * row)
        if data:
            yield vectors_batch(partition.first, np.frombuffer(data, self.kind).reshape(-1, self.dim), element_type(self.path, BIN_TYPES))


class VecsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.kind = path, np.dtype(element_type(path, VECS_TYPES))
        size = size_of(path)
        self.dim = struct.unpack("<I", read_at(path, 0, 4))[0] if size else 0
        self.row = 4 + self.dim * self.kind.itemsize
        if size % self.row:
            raise ValueError(f"{path} doesn't hold whole rows of dimension {self.dim}")
        self.rows = size // self.row

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows if self.dim else 0)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        data = read_at(self.path, partition.first * self.row, (partition.last - partition.first) * self.row)
        if data:
            rows = np.frombuffer(data, np.uint8).reshape(-1, self.row)
            if (np.ascontiguousarray(rows[:, :4]).view("<u4") != self.dim).any():
                raise ValueError(f"{self.path}: rows of different dimensions")
            yield vectors_batch(partition.first, np.ascontiguousarray(rows[:, 4:]).view(self.kind), element_type(self.path, VECS_TYPES))


class NpyReader(DataSourceReader):
    """A C-ordered matrix; its values come out as floats."""

    def __init__(self, path: str) -> None:
        from numpy.lib import format as npy

        head = io.BytesIO(read_at(path, 0, min(size_of(path), 4096)))
        version = npy.read_magic(head)
        shape, fortran, self.kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(head)
        if len(shape) != 2 or fortran:
            raise ValueError(f"{path} isn't a C-ordered matrix")
        self.path, self.start, (self.rows, self.dim) = path, head.tell(), shape

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        row = self.dim * self.kind.itemsize
        data = read_at(self.path, self.start + partition.first * row, (partition.last - partition.first) * row)
        if data:
            yield vectors_batch(partition.first, np.frombuffer(data, self.kind).reshape(-1, self.dim), "<f4")


class IdMapReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        (self.rows,) = struct.unpack("<I", read_at(path, 0, 4))
        if size_of(path) != 4 + 4 * self.rows:
            raise ValueError(f"{path}: {self.rows} ids don't make {size_of(path)} bytes")

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(read_at(self.path, 4 + 4 * partition.first, 4 * (partition.last - partition.first)), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last, dtype=np.int64)), pa.array(ids.astype(np.int64))], ["local_id", "vec_id"])


class GroundTruthReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.rows, self.k = struct.unpack("<II", read_at(path, 0, 8))

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        ids = np.frombuffer(read_at(self.path, 8 + 4 * self.k * partition.first, 4 * self.k * n), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(partition.first, partition.last), self.k)), pa.array(np.tile(np.arange(1, self.k + 1, dtype=np.int32), n)), pa.array(ids)], ["query_id", "rank", "neighbor_id"])


class FixedGraphReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        head = read_at(path, 0, GRAPH_START)
        scalar = lambda k, code: struct.unpack_from(code, head, 4 + HEADER * (k + 1) + 4 * k)[0]
        self.version, self.rows, self.dim, self.degree = scalar(0, "<i"), scalar(1, "<I"), scalar(2, "<I"), scalar(3, "<I")
        if self.version != GRAPH_VERSION:
            raise ValueError(f"{path}: version {self.version}, not {GRAPH_VERSION}")

    def partitions(self) -> Sequence[Span]:
        return spans(self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        data = read_at(self.path, GRAPH_START + 4 * self.degree * partition.first, 4 * self.degree * (partition.last - partition.first))
        if data:
            yield fixed_edges(partition.first, np.frombuffer(data, "<u4").reshape(-1, self.degree))


class VariableGraphReader(DataSourceReader):
    """Lists of unknown lengths follow each other, so a file is one task that streams it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[Span]:
        return [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, name = opened(self.path)
        with fs.open_input_stream(name, buffer_size=1 << 20) as f:
            size, _, _, _ = struct.unpack("<QIIQ", f.read(24))
            left, node = size - 24, 0
            src, pos, dst = [], [], []
            held = 0
            while left > 0:
                (n,) = struct.unpack("<I", f.read(4))
                src.append(np.full(n, node))
                pos.append(np.arange(1, n + 1))
                dst.append(np.frombuffer(f.read(4 * n), "<u4"))
                left, node, held = left - 4 - 4 * n, node + 1, held + n
                if held >= ROWS:
                    yield edges_batch(np.concatenate(src), np.concatenate(pos), np.concatenate(dst))
                    src, pos, dst, held = [], [], [], 0
        if held:
            yield edges_batch(np.concatenate(src), np.concatenate(pos), np.concatenate(dst))


class LayeredGraphReader(DataSourceReader):
    """Options: rows, layers, segment, degree, which give the layers' sizes; ids come out as bottom ids."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        from velora.functions.planning import layer_plan, layered_index_size

        self.path, self.degree = path, int(options["degree"])
        self.plan = layer_plan(int(options["rows"]), int(options["layers"]), int(options["segment"]), self.degree)
        if size_of(path) != layered_index_size(self.plan, self.degree):
            raise ValueError(f"{path}: {size_of(path)} bytes, {layered_index_size(self.plan, self.degree)} planned")

    def partitions(self) -> Sequence[Span]:
        return [Span(k, k + 1) for k in range(len(self.plan.sizes))]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        from velora.functions.planning import align8

        layer, n = partition.first, self.plan.sizes[partition.first]
        bottom = None
        if layer:
            start = align8(4 * self.plan.rows * self.degree) + 4 * self.plan.translation_offsets[layer]
            bottom = np.frombuffer(read_at(self.path, start, 4 * n), "<u4").astype(np.int64)
        for k in range(0, n, ROWS):
            m = min(ROWS, n - k)
            data = read_at(self.path, 4 * self.degree * (self.plan.offsets[layer] + k), 4 * self.degree * m)
            local = np.frombuffer(data, "<u4").reshape(m, self.degree).astype(np.int64)
            if bottom is None:
                yield fixed_edges(k, local, layer)
            else:
                yield edges_batch(np.repeat(bottom[k : k + m], self.degree), np.tile(np.arange(1, self.degree + 1), m), bottom[local].ravel(), layer)


@dataclass
class Part(WriterCommitMessage):
    first: int
    rows: int
    width: int
    name: str


class OrderedWriter(DataSourceWriter):
    """Tasks write parts of ascending ids; the commit appends them under a header."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def encode(self, rows: list) -> tuple[int, int, int, bytes]:
        """(first id, rows, width, bytes) of a task's rows."""
        raise NotImplementedError

    def header(self, rows: int, width: int, size: int) -> bytes:
        return b""

    def trailer(self) -> bytes:
        return b""

    def write(self, iterator: Iterator) -> Part:
        import uuid

        rows = list(iterator)
        if not rows:
            return Part(0, 0, 0, "")
        first, n, width, data = self.encode(rows)
        fs, name = opened(self.path)
        part = f"{name}.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(data)
        return Part(first, n, width, part)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        fs, name = opened(self.path)
        if not self.overwrite and fs.get_file_info(name).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} exists")
        if len({p.width for p in parts if p.width}) > 1:
            self.abort(messages)
            raise ValueError("rows of different widths")
        size = sum(fs.get_file_info(p.name).size for p in parts)
        with fs.open_output_stream(name) as out:
            out.write(self.header(sum(p.rows for p in parts), max((p.width for p in parts), default=0), size))
            for p in parts:
                with fs.open_input_stream(p.name) as f:
                    while block := f.read(8 << 20):
                        out.write(block)
            out.write(self.trailer())
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                fs.delete_file(m.name)


class BinWriter(OrderedWriter):
    def encode(self, rows: list) -> tuple[int, int, int, bytes]:
        if len({len(r["embedding"]) for r in rows}) > 1:
            raise ValueError("rows of different dimensions")
        return rows[0]["vec_id"], len(rows), len(rows[0]["embedding"]), np.array([r["embedding"] for r in rows]).astype(element_type(self.path, BIN_TYPES)).tobytes()

    def header(self, rows: int, width: int, size: int) -> bytes:
        return struct.pack("<II", rows, width)


class VecsWriter(OrderedWriter):
    def encode(self, rows: list) -> tuple[int, int, int, bytes]:
        if len({len(r["embedding"]) for r in rows}) > 1:
            raise ValueError("rows of different dimensions")
        kind, out = element_type(self.path, VECS_TYPES), io.BytesIO()
        for r in rows:
            out.write(struct.pack("<I", len(r["embedding"])) + np.array(r["embedding"]).astype(kind).tobytes())
        return rows[0]["vec_id"], len(rows), len(rows[0]["embedding"]), out.getvalue()


class IdMapWriter(OrderedWriter):
    def encode(self, rows: list) -> tuple[int, int, int, bytes]:
        return rows[0]["local_id"], len(rows), 1, np.array([r["vec_id"] for r in rows], "<u4").tobytes()

    def header(self, rows: int, width: int, size: int) -> bytes:
        return struct.pack("<I", rows)


class GraphWriter(OrderedWriter):
    """Rows come grouped by src, in order of pos."""

    variable = False

    def lists(self, rows: list) -> list[tuple[int, list[int]]]:
        out: list[tuple[int, list[int]]] = []
        for r in rows:
            if not out or out[-1][0] != r["src"]:
                out.append((r["src"], []))
            out[-1][1].append(r["dst"])
        return out

    def encode(self, rows: list) -> tuple[int, int, int, bytes]:
        lists = self.lists(rows)
        if self.variable:
            return lists[0][0], len(lists), 0, b"".join(struct.pack("<I", len(x)) + np.array(x, "<u4").tobytes() for _, x in lists)
        if len({len(x) for _, x in lists}) > 1:
            raise ValueError("nodes of different degrees")
        return lists[0][0], len(lists), len(lists[0][1]), np.array([x for _, x in lists], "<u4").tobytes()


class FixedGraphWriter(GraphWriter):
    def __init__(self, path: str, overwrite: bool, dim: int) -> None:
        super().__init__(path, overwrite)
        self.dim = dim

    def header(self, rows: int, width: int, size: int) -> bytes:
        scalars = (("<i4", "<i", GRAPH_VERSION), ("<u4", "<I", rows), ("<u4", "<I", self.dim), ("<u4", "<I", width), ("<u2", "<H", 0))
        return b"<f4\0" + b"".join(numpy_header(kind, ()) + struct.pack(code, x) for kind, code, x in scalars) + numpy_header("<u4", (rows, width))

    def trailer(self) -> bytes:
        return numpy_header("|u1", ()) + b"\0"


class VariableGraphWriter(GraphWriter):
    variable = True

    def __init__(self, path: str, overwrite: bool, width: int, medoid: int) -> None:
        super().__init__(path, overwrite)
        self.width, self.medoid = width, medoid

    def header(self, rows: int, width: int, size: int) -> bytes:
        return struct.pack("<QIIQ", 24 + size, self.width, self.medoid, 0)


class _Source(DataSource):
    kind, columns = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str | StructType:
        return self.columns


class VecBin(_Source):
    kind = "vecbin"

    def schema(self) -> str:
        return f"vec_id long, embedding array<{SPARK_TYPES[element_type(self.options['path'], BIN_TYPES)]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BinWriter(self.options["path"], overwrite)


class Vecs(_Source):
    kind = "vecs"

    def schema(self) -> str:
        return f"vec_id long, embedding array<{SPARK_TYPES[element_type(self.options['path'], VECS_TYPES)]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VecsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VecsWriter(self.options["path"], overwrite)


class Npy(_Source):
    kind, columns = "npy", "vec_id long, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"])


class IdMap(_Source):
    kind, columns = "idmap", "local_id long, vec_id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return IdMapReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return IdMapWriter(self.options["path"], overwrite)


class GroundTruth(_Source):
    kind, columns = "groundtruth", "query_id long, rank int, neighbor_id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GroundTruthReader(self.options["path"])


class FixedGraph(_Source):
    kind, columns = "fixedgraph", "src long, pos int, dst long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedGraphReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FixedGraphWriter(self.options["path"], overwrite, int(self.options.get("dim", 0)))


class VariableGraph(_Source):
    kind, columns = "variablegraph", "src long, pos int, dst long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VariableGraphReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VariableGraphWriter(self.options["path"], overwrite, int(self.options.get("width", 0)), int(self.options.get("medoid", 0)))


class LayeredGraph(_Source):
    kind, columns = "layeredgraph", "layer int, src long, pos int, dst long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LayeredGraphReader(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Make all formats known to a session."""
    for source in (VecBin, Vecs, Npy, IdMap, GroundTruth, FixedGraph, VariableGraph, LayeredGraph):
        spark.dataSource.register(source)


def save(df: DataFrame, format: str, path: str, **options: str | int) -> None:
    """Write a table in id order, range by range, in one of the formats."""
    key, within = {"idmap": ("local_id", ["local_id"]), "fixedgraph": ("src", ["src", "pos"]), "variablegraph": ("src", ["src", "pos"])}.get(format, ("vec_id", ["vec_id"]))
    df.repartitionByRange(key).sortWithinPartitions(*within).write.format(format).options(**options).mode("overwrite").save(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding of a file in any vector format, by its suffix, or of a Parquet table."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in BIN_TYPES or suffix in VECS_TYPES or suffix == "npy":
        register(spark)
        return spark.read.format("vecbin" if suffix in BIN_TYPES else "npy" if suffix == "npy" else "vecs").load(path)
    return spark.read.parquet(path)


def save_vectors(df: DataFrame, path: str) -> None:
    """The inverse of load_vectors(); converts between formats without holding a file."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in BIN_TYPES or suffix in VECS_TYPES:
        register(df.sparkSession)
        save(df, "vecbin" if suffix in BIN_TYPES else "vecs", path)
    else:
        df.write.mode("overwrite").parquet(path)
