"""A data source for a device's headerless little-endian arrays: format("device"), options layout and path.

Writing. Rows are sorted by ranges of their key, so the tasks' rows follow each other in the order of partitions. Each task writes its rows to
parts of at most PART_BYTES, under names of its own in a folder that readers pass over; the commit step, on the driver, renames the parts of the
tasks that won, numbered through in the order of partitions, and an abort deletes them. A task that runs twice leaves no trace but in that folder.

Reading. A row's id is its position, so parts follow each other in the order of their names, where digits count as numbers: VEC.2 comes before
VEC.10. The driver looks at names and sizes only; a task reads one range of whole rows, of RANGE_BYTES at most, and yields Arrow batches made
from the bytes as they are.

Files are reached through Arrow's file systems: local and mounted paths, hdfs, s3, gs and abfs. Lists of another length than the layout's width,
nulls in them, and numbers that its type can't hold are errors. An empty table has no part, and reads as no row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from beamlake.config import DEGREE, DIM


@dataclass(frozen=True)
class Layout:
    """dtype and elements of a row; id and value columns and the Spark type of an element."""

    dtype: str
    width: int
    key: str
    value: str
    kind: str


#: Element types and row widths of the input files.
LAYOUTS = {
    "MEAN": Layout("<i2", DIM, "row", "mean", "int"),
    "VEC": Layout("<i2", DIM, "vec_id", "vec", "int"),
    "QUERY": Layout("<i2", DIM, "query_id", "vec", "int"),
    "NEIGHBOR": Layout("<u4", DEGREE, "vec_id", "neighbors", "bigint"),
    "PQCODE": Layout("u1", 16, "vec_id", "pq16", "smallint"),
    "LONG": Layout("u1", 32, "vec_id", "pq32", "smallint"),
    "GT": Layout("<u4", 10, "query_id", "dists", "bigint"),
    "CODEBOOK": Layout("<i2", 4, "cell", "c", "int"),
    "LONGBOOK": Layout("<i2", 2, "cell", "c", "int"),
}


#: Bytes of a range that one task reads, of a part that one task writes, and of a batch.
RANGE_BYTES, PART_BYTES, BATCH_BYTES = 64 << 20, 128 << 20, 4 << 20
#: Readers pass over names that begin so.
PENDING = "_pending"

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)


def row_bytes(lay: Layout) -> int:
    return np.dtype(lay.dtype).itemsize * lay.width


def parts(path: str, lay: Layout) -> list[tuple[str, int]]:
    """Files of a path, a file or a folder of parts, in their order, with their rows."""
    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))]
    natural = lambda f: [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", f.base_name)]
    size = row_bytes(lay)
    for f in found:
        if f.size % size:
            raise ValueError(f"{f.path} does not hold whole rows of {size} bytes")
    return [(f.path, f.size // size) for f in sorted(found, key=natural)]


@dataclass
class Range(InputPartition):
    """Rows of a file from one on, and the id of the first."""

    path: str
    row: int
    rows: int
    first: int


class DeviceReader(DataSourceReader):
    def __init__(self, path: str, lay: Layout, range_bytes: int):
        self.path, self.lay, self.step = path, lay, max(1, range_bytes // row_bytes(lay))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        first = 0
        for path, rows in parts(self.path, self.lay):
            out += [Range(path, at, min(self.step, rows - at), first + at) for at in range(0, rows, self.step)]
            first += rows
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, or none with rows
            return
        lay, size = self.lay, row_bytes(self.lay)
        system, _ = _system(self.path)
        step = max(1, BATCH_BYTES // size)
        with system.open_input_file(partition.path) as f:
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                data = f.read_at(n * size, (partition.row + at) * size)
                flat = pa.array(np.frombuffer(data, dtype=lay.dtype).astype(np.int64)).cast(_ARROW[lay.kind])
                ids = np.arange(partition.first + at, partition.first + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * lay.width + 1, lay.width), pa.int32()), flat)], names=[lay.key, lay.value])


@dataclass
class Written(WriterCommitMessage):
    """A task's partition and its parts, in order."""

    partition: int
    names: list[str]


def packed(values: pa.Array, lay: Layout) -> bytes:
    """A column of lists as the bytes of a file."""
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = lists.flatten()
    lengths = np.diff(lists.offsets.to_numpy())
    if lists.null_count or flat.null_count or (lengths != lay.width).any():
        raise ValueError(f"every row must have {lay.width} numbers")
    x, kind = flat.to_numpy(zero_copy_only=False), np.iinfo(np.dtype(lay.dtype))
    if len(x) and (x.min() < kind.min or x.max() > kind.max):
        raise ValueError(f"a number does not fit {lay.dtype}")
    return x.astype(lay.dtype).tobytes()


class DeviceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, part_bytes: int):
        self.path, self.name, self.lay, self.part_bytes = path.rstrip("/"), name, LAYOUTS[name], part_bytes
        self.job = uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{_system(self.path)[1]}/{PENDING}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _ = _system(self.path)
        task, names, out, size = uuid.uuid4().hex, [], None, 0
        most = max(1, self.part_bytes // row_bytes(self.lay)) * row_bytes(self.lay)
        try:
            for b in iterator:
                data = memoryview(packed(b.column(self.lay.value), self.lay))
                while len(data):
                    if out is None:
                        system.create_dir(self.pending)
                        names.append(f"{task}-{len(names)}")
                        out, size = system.open_output_stream(f"{self.pending}/{names[-1]}"), 0
                    piece = data[: most - size]
                    out.write(piece)
                    size, data = size + len(piece), data[len(piece) :]
                    if size == most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(TaskContext.get().partitionId(), names)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        system.create_dir(at)
        for k, name in enumerate(n for m in done for n in m.names):
            system.move(f"{self.pending}/{name}", f"{at}/{self.name}.{k:05d}.BIN")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, _ = _system(self.path)
        if system.get_file_info(self.pending).type == pafs.FileType.Directory:
            system.delete_dir(self.pending)


class DeviceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "device"

    @property
    def layout(self) -> Layout:
        return LAYOUTS[self.options["layout"]]

    def schema(self) -> str:
        return f"{self.layout.key} bigint, {self.layout.value} array<{self.layout.kind}>"

    def reader(self, schema: object) -> DataSourceReader:
        return DeviceReader(self.options["path"], self.layout, int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: object, overwrite: bool) -> DeviceWriter:
        return DeviceWriter(self.options["path"], self.options["layout"], int(self.options.get("part_bytes", PART_BYTES)))


def read(spark: SparkSession, path: str, name: str, range_bytes: int | None = None) -> DataFrame:
    """Rows of a file, or of a folder of parts, with their positions as ids."""
    spark.dataSource.register(DeviceFiles)
    parts(path, LAYOUTS[name])  # what can't be read is an error here, not in a job
    return spark.read.format("device").option("layout", name).option("range_bytes", str(range_bytes or RANGE_BYTES)).load(path)


def write(df: DataFrame, name: str, path: str, part_bytes: int | None = None) -> None:
    """Rows in the order of their key, in parts under `path`, which must be new or empty of parts."""
    lay = LAYOUTS[name]
    df.sparkSession.dataSource.register(DeviceFiles)
    system, at = _system(path)
    if system.get_file_info(at).type != pafs.FileType.NotFound and parts(path, lay):
        raise FileExistsError(path)
    rows = df.select(F.col(lay.key).cast("bigint").alias(lay.key), F.col(lay.value).cast(f"array<{lay.kind}>").alias(lay.value)).orderBy(lay.key)
    rows.write.format("device").mode("append").option("layout", name).option("part_bytes", str(part_bytes or PART_BYTES)).save(path)
