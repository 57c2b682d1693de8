"""Binary arrays (`.npy`) as a Spark source and sink: tasks read ranges of rows, never a file as a whole."""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads, and that a batch or a written file holds.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
MANIFEST = "_arrays.json"


def _opened(path: str):
    """The file system of a path or URI, local or remote, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Header:
    shape: tuple[int, int]
    fortran: bool
    dtype: np.dtype
    start: int


def header(files, path: str) -> Header:
    """What the first bytes of a `.npy` file say; an array of one dimension has rows of one component."""
    with files.open_input_file(path) as f:
        raw = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = npy.read_magic(raw)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(raw)
    if dtype.kind not in "fiub" or len(shape) not in (1, 2):
        raise ValueError(f"{path}: an array of {dtype} and {len(shape)} dimensions; numbers in one or two are read")
    return Header((shape[0], 1 if len(shape) == 1 else shape[1]), fortran and len(shape) == 2, dtype, raw.tell())


@dataclass
class Rows(InputPartition):
    path: str
    head: Header
    first: int
    count: int
    before: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, whole: bool):
        self.path, self.whole = options["path"], whole
        self.picked = [int(i) for i in options["components"].split(",")] if options.get("components") else None
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Rows]:
        files, path = _opened(self.path)
        out, before = [], 0
        for name in names_of(files, path):
            head = header(files, name)
            if self.whole and head.dtype.kind == "f":
                raise ValueError(f"{name} has {head.dtype}, other files whole numbers")
            n = max(1, self.task_bytes // max(1, head.shape[1] * head.dtype.itemsize))
            out += [Rows(name, head, at, min(n, head.shape[0] - at), before) for at in range(0, head.shape[0], n)]
            before += head.shape[0]
        return out

    def read(self, partition: Rows | None):
        if not isinstance(partition, Rows):  # Spark asks once where there are none
            return
        files, head = _opened(self.path)[0], partition.head
        (n, width), size = head.shape, head.dtype.itemsize
        picked = list(range(width)) if self.picked is None else self.picked
        step = max(1, BATCH_BYTES // max(1, size * width))
        kind = pa.int64() if self.whole else pa.float64()
        with files.open_input_file(partition.path) as f:
            for at in range(partition.first, partition.first + partition.count, step):
                m = min(step, partition.first + partition.count - at)
                if head.fortran:  # a component lies in one piece: others are not read
                    cells = [np.frombuffer(f.read_at(m * size, head.start + (c * n + at) * size), head.dtype) for c in picked]
                    block = np.stack(cells, axis=1) if cells else np.empty((m, 0))
                else:
                    block = np.frombuffer(f.read_at(m * width * size, head.start + at * width * size), head.dtype).reshape(m, width)[:, picked]
                flat = pa.array(np.ascontiguousarray(block, "<i8" if self.whole else "<f8").ravel(), kind)
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * len(picked))
                rows = pa.array(np.arange(m, dtype=np.int64) + at + partition.before)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(ends, flat)], ["row", "vec"])


def names_of(files, path: str) -> list[str]:
    """The `.npy` files of a path in their order: itself, those its manifest names, or all in the folder by name."""
    from pyarrow import fs

    if files.get_file_info(path).type == fs.FileType.File:
        return [path]
    if files.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
        with files.open_input_stream(f"{path}/{MANIFEST}") as f:
            return [f"{path}/{x}" for x in json.loads(f.read())]
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.endswith(".npy"))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes files of about BATCH_BYTES under names of its own; the manifest, written once all have ended, names
    those of the tasks that count, so files of a task that was lost or ran twice are never read."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, np.dtype(dtype)

    def write(self, batches) -> Written:
        files, path = _opened(self.path)
        files.create_dir(path, recursive=True)
        part, names, held, size, width = TaskContext.get().partitionId(), [], [], 0, None

        def flush() -> None:
            name = f"part-{part:05d}-{len(names):05d}-{uuid.uuid4().hex}.npy"
            raw = io.BytesIO()
            np.save(raw, np.concatenate(held))
            with files.open_output_stream(f"{path}/{name}") as f:
                f.write(raw.getbuffer())
            names.append(name)
            held.clear()

        for b in batches:
            vec = b.column("vec")
            if not b.num_rows:
                continue
            lengths = set(vec.value_lengths().to_pylist()) | ({width} if width is not None else set())
            if len(lengths) != 1 or None in lengths or vec.flatten().null_count:
                raise ValueError("arrays are written of vectors of one length without nulls")
            width = lengths.pop()
            step = max(1, BATCH_BYTES // max(1, width * self.dtype.itemsize))
            block = vec.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(b.num_rows, width)
            for at in range(0, len(block), step):
                held.append(block[at : at + step])
                size += len(held[-1])
                if size >= step:
                    flush()
                    size = 0
        if held:
            flush()
        return Written(part, names)

    def commit(self, messages) -> None:
        files, path = _opened(self.path)
        files.create_dir(path, recursive=True)
        names = [n for m in sorted((m for m in messages if m), key=lambda m: m.partition) for n in m.names]
        with files.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())


class ArraySource(DataSource):
    """`(row, vec)`: rows numbered from 0 through all files, vec of bigint if the first file has whole numbers, else of double.

    Options: `components`, numbers of those to keep, in that order; `taskBytes`; `dtype` to write, `<f8` by default."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        files, path = _opened(self.options["path"])
        names = names_of(files, path)
        whole = bool(names) and header(files, names[0]).dtype.kind != "f"
        return f"row bigint, vec array<{'bigint' if whole else 'double'}>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options, schema["vec"].dataType.elementType.typeName() == "long")

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], self.options.get("dtype", "<f8"))


def read_arrays(spark: SparkSession, path: str, components: list[int] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """`(row, vec)` of a `.npy` file or a folder of them; of Fortran-ordered files only `components` are read."""
    spark.dataSource.register(ArraySource)
    chosen = {"components": ",".join(map(str, components))} if components else {}
    return spark.read.format("npy").options(taskBytes=task_bytes, **chosen).load(path)


def write_arrays(rows: DataFrame, path: str, order: str, vec: str = "vec", dtype: str = "<f8") -> None:
    """The vectors of `rows` in ascending `order`, dealt by ranges, as `.npy` files and a manifest in the folder `path`, a new
    one or one whose earlier files are then no longer named. Vectors of other lengths or with nulls are an error."""
    rows.sparkSession.dataSource.register(ArraySource)
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.col(vec).alias("vec"))
    dealt.write.format("npy").option("dtype", dtype).mode("append").save(path)
