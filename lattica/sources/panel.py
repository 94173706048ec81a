"""The compact binary panel format: columns one after the other, little-endian.

    int64 N, int32 K, [int32 L,] int32 n_fe, int32 has_cluster, int32 has_weights, [int32 precision: 0 double, 1 float]
    y[N], K regressors, L instruments, n_fe int32 id columns, int32 cluster, weights
    "META" int32 1, then the names: y, x list, z list, fe list, cluster, weights (int32 lengths and counts)

The older layout has no L.  Which layout a file has follows from its exact size;
with names after the data the newer one is assumed.

``register(spark)`` makes ``spark.read.format("panel").load(path)`` available;
each partition reads a range of rows of the columns that it needs by seeking.
"""

from __future__ import annotations

import json
import struct
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.operators.prepare import dense_ids, drop_missing, reject_missing
from lattica.plans.spec import ModelSpec
from lattica.shipping import ship

#: Rows per partition, if the reader is given no number of partitions.
ROWS_EACH = 4_000_000


@dataclass(frozen=True)
class Layout:
    """Where every column of a file is: name, numpy type, byte offset."""

    n: int
    columns: tuple[tuple[str, str, int], ...]
    spec: ModelSpec
    precision: int


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(inner)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def text(self) -> str:
        size = self.take("<i")
        if size < 0 or self.at + size > len(self.data):
            raise ValueError("damaged names in a panel file")
        self.at += size
        return self.data[self.at - size : self.at].decode()

    def texts(self) -> list[str]:
        return [self.text() for _ in range(self.take("<i"))]


def read_layout(path: str) -> Layout:
    """Header, layout and names of a file; raises ``ValueError`` if it is too short for what its header says."""
    with _open(path) as file:
        size = file.size()
        head = file.read(min(size, 40))
        if len(head) < 24:
            raise ValueError(f"{path} is too short for a panel header")
        n = struct.unpack_from("<q", head)[0]
        counts = {True: struct.unpack_from("<5i", head.ljust(40, b"\0"), 8), False: (struct.unpack_from("<i", head, 8)[0], 0, *struct.unpack_from("<3i", head, 12))}

        def length(new: bool, width: int, flag: bool) -> int:
            k, z, fe, cluster, weights = counts[new]
            values = 1 + k + z + bool(weights)
            return 8 + 4 * (5 if new else 4) + 4 * flag + n * (width * values + 4 * (fe + bool(cluster)))

        exact = [(new, w, flag) for new in (True, False) for flag in (True, False) for w in (8, 4) if length(new, w, flag) == size]
        new, width, flag = exact[0] if exact else (True, 0, True)
        at = 8 + 4 * (5 if new else 4)
        if flag:
            # with the flag, its value counts: both widths can't fit one size unless there are no rows
            width = 4 if struct.unpack_from("<i", head.ljust(40, b"\0"), at)[0] == 1 else 8
            at += 4
        k, z, fe, cluster, weights = counts[new]
        if min(n, k, z, fe) < 0 or length(new, width, flag) > size:
            raise ValueError(f"{path} is no panel file, or is cut off")
        names = None
        file.seek(length(new, width, flag))
        rest = file.read()
        if rest[:4] == b"META":
            cursor = _Cursor(rest)
            cursor.at = 4
            if cursor.take("<i") == 1:
                names = (cursor.text(), cursor.texts(), cursor.texts(), cursor.texts(), cursor.text(), cursor.text())
    fallback = ("y", [f"x{i + 1}" for i in range(k)], [f"z{i + 1}" for i in range(z)], [f"fe{i + 1}" for i in range(fe)], "cluster", "weights")
    y, xs, zs, fes, c, w = names or fallback
    pad = lambda given, plain: tuple(given[i] if i < len(given) and given[i] else p for i, p in enumerate(plain))
    spec = ModelSpec(y or "y", pad(xs, fallback[1]), pad(zs, fallback[2]), pad(fes, fallback[3]), (c or "cluster") if cluster else None, (w or "weights") if weights else None)
    value = f"<f{width}"
    roles = [(spec.y, value), *[(x, value) for x in spec.x], *[(x, value) for x in spec.z], *[(f, "<i4") for f in spec.fe]]
    roles += [(spec.cluster, "<i4")] * bool(cluster) + [(spec.weights, value)] * bool(weights)
    columns, seen = [], set()
    for name, kind in roles:
        while name.lower() in seen:  # one variable may have two roles
            name += "_"
        seen.add(name.lower())
        columns.append((name, kind, at))
        at += n * np.dtype(kind).itemsize
    return Layout(n, tuple(columns), spec, 1 if width == 4 else 0)


@dataclass
class _Rows(InputPartition):
    start: int
    stop: int


class _PanelReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, schema: T.StructType, count: int):
        self.path, self.layout, self.count = path, layout, count
        self.wanted = [f.name for f in schema.fields]

    def partitions(self) -> list[_Rows]:
        cuts = [self.layout.n * i // self.count for i in range(self.count + 1)]
        return [_Rows(a, b) for a, b in zip(cuts, cuts[1:]) if b > a] or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        by_name = {name: (kind, at) for name, kind, at in self.layout.columns}
        step = 1 << 18
        with _open(self.path) as file:
            for start in range(part.start, part.stop, step):
                stop, arrays = min(start + step, part.stop), []
                for name in self.wanted:
                    kind, at = by_name[name]
                    width = np.dtype(kind).itemsize
                    file.seek(at + start * width)
                    values = np.frombuffer(file.read((stop - start) * width), kind)
                    arrays.append(pa.array(values.astype(np.float64 if kind[1] == "f" else np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, names=self.wanted)


class PanelSource(DataSource):
    """``spark.read.format("panel").option("partitions", 8).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "panel"

    def schema(self) -> T.StructType:
        layout = read_layout(self.options["path"])
        return T.StructType([T.StructField(n, T.DoubleType() if kind[1] == "f" else T.IntegerType()) for n, kind, _ in layout.columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        layout = read_layout(self.options["path"])
        count = int(self.options.get("partitions", 0)) or max(1, -(-layout.n // ROWS_EACH))
        return _PanelReader(self.options["path"], layout, schema, count)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PanelSource)


def read_panel(spark: SparkSession, path: str, partitions: int | None = None, columns=None) -> tuple[DataFrame, ModelSpec]:
    """The frame of a panel file, and the roles of its columns.  With ``columns`` no bytes of the others are read."""
    register(spark)
    reader = spark.read.format("panel")
    if partitions:
        reader = reader.option("partitions", partitions)
    layout = read_layout(path)
    if columns:
        kinds = {name: T.DoubleType() if kind[1] == "f" else T.IntegerType() for name, kind, _ in layout.columns}
        reader = reader.schema(T.StructType([T.StructField(c, kinds[c]) for c in columns]))
    return reader.load(path), layout.spec


def prepare_panel(df: DataFrame, spec: ModelSpec, drop: bool = False) -> DataFrame:
    """The columns of a panel: numbers as doubles, fixed effects and the cluster as dense ids from 1."""
    used = df.select(*spec.columns())
    if drop:
        used = drop_missing(used)
    reject_missing(used)
    keys = [*spec.fe, *([spec.cluster] if spec.cluster else [])]
    for i, key in enumerate(dict.fromkeys(keys)):
        used = used.join(dense_ids(used, key, f"_id{i}"), key)
    place = {k: f"_id{i}" for i, k in enumerate(dict.fromkeys(keys))}
    numbers = [spec.y, *spec.x, *spec.z]
    out = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)] + [F.col(place[c]).cast("int").alias(f"k{i}") for i, c in enumerate(keys)]
    return used.select(*out, *([F.col(spec.weights).cast("double").alias("w0")] if spec.weights else []))


def write_panel(df: DataFrame, path: str, spec: ModelSpec, precision: str = "float64", drop_missing_rows: bool = False) -> dict:
    """Write a panel file and return its summary.

    The format is one file with whole columns in a row.  Executors pack batches
    into bytes per column; the driver appends those to one temporary file per
    column, a partition at a time, and joins the files: its memory holds a
    partition's packed batches, its disk the file twice.
    """
    ship(df.sparkSession)
    ready = prepare_panel(df, spec, drop_missing_rows)
    names = ready.columns
    kinds = ["<i4" if c.startswith("k") else ("<f4" if precision == "float32" else "<f8") for c in names]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [pa.array([c.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for c, k in zip(batch.columns, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *cells], names=["rows", *names])

    packed = ready.mapInArrow(pack, "rows long, " + ", ".join(f"{c} binary" for c in names))
    n = 0
    with ExitStack() as stack:
        parts = [stack.enter_context(tempfile.TemporaryFile()) for _ in names]
        for row in packed.toLocalIterator():
            n += row["rows"]
            for part, c in zip(parts, names):
                part.write(row[c])
        with open(path, "wb") as out:
            counts = (len(spec.x), len(spec.z), len(spec.fe), int(bool(spec.cluster)), int(bool(spec.weights)))
            out.write(struct.pack("<q6i", n, *counts, 1 if precision == "float32" else 0))
            for part in parts:
                part.seek(0)
                while block := part.read(1 << 22):
                    out.write(block)
            text = lambda s: struct.pack("<i", len(s.encode())) + s.encode()
            texts = lambda ss: struct.pack("<i", len(ss)) + b"".join(map(text, ss))
            out.write(b"META" + struct.pack("<i", 1) + text(spec.y) + texts(spec.x) + texts(spec.z) + texts(spec.fe) + text(spec.cluster or "") + text(spec.weights or ""))
    return {
        "n_obs": n, "n_regressors": len(spec.x), "n_fe_dims": len(spec.fe), "n_instruments": len(spec.z),
        "clustered": spec.cluster is not None, "weights": spec.weights is not None, "precision": precision,
    }


def summary_json(info: dict) -> str:
    return json.dumps(info, indent=2)
