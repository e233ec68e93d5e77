"""Binary N-body snapshots in the Gadget-2 layout (format 1), one file or several.

A file is a row of Fortran records: a header of 256 bytes with the number of particles of six
types, then positions, velocities, ids and masses, each for all types one after the other.
Numbers may have 4 or 8 bytes. Nothing is read but what is asked for: a partition is a
stretch of one type's particles in one file, and of each wanted block it reads the bytes of
that stretch. Files are opened by their URI, so they may be on any file system that Arrow knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship
from ..snapshot import Snapshot

# Fixed values of the layout: header fields by offset, families of the six types, and the block and place of each column.
HEADER = "<6i6d2d2i6i2i4d"
FAMILIES = ("gas", "dm", "dm", "dm", "star", "dm")
TYPE_OF = {"gas": 0, "dm": 1, "star": 4}
COLUMNS = {"x": ("pos", 0), "y": ("pos", 1), "z": ("pos", 2), "vx": ("vel", 0), "vy": ("vel", 1), "vz": ("vel", 2), "pid": ("id", 0), "mass": ("mass", 0)}
WIDTH = {"pos": 3, "vel": 3, "id": 1, "mass": 1}
BLOCKS = ("pos", "vel", "id", "mass")
SCHEMA = "pid bigint, family string, x double, y double, z double, vx double, vy double, vz double, mass double"
BATCH = 100_000


@dataclass(frozen=True)
class Header:
    counts: tuple[int, ...]
    masses: tuple[float, ...]
    time: float
    redshift: float
    totals: tuple[int, ...]
    files: int
    boxsize: float

    @classmethod
    def read(cls, data: bytes) -> Header:
        v = struct.unpack(HEADER, data[: struct.calcsize(HEADER)])
        return cls(v[:6], v[6:12], v[12], v[13], v[16:22], v[23], v[24])

    def pack(self) -> bytes:
        return struct.pack(HEADER, *self.counts, *self.masses, self.time, self.redshift, 0, 0, *self.totals, 0, self.files, self.boxsize, 0.0, 0.0, 0.0).ljust(256, b"\0")


@dataclass(frozen=True)
class Layout:
    """Where the blocks of one file are: offset and bytes of a number."""

    path: str
    header: Header
    blocks: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, path: str) -> Layout:
        """From the header and the sizes in front of the records."""
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            (size,) = struct.unpack("<i", f.read_at(4, 0))
            if size != 256:
                raise ValueError(f"{path} is no snapshot of this layout: its first record has {size} bytes")
            header = Header.read(f.read_at(256, 4))
            n, massive = sum(header.counts), sum(c for c, m in zip(header.counts, header.masses, strict=True) if m == 0)
            offset, blocks = 264, {}
            for name in BLOCKS:
                rows = massive if name == "mass" else n
                if not rows:
                    continue
                (size,) = struct.unpack("<I", f.read_at(4, offset))
                each = size // (rows * WIDTH[name])
                if each not in (4, 8) or each * rows * WIDTH[name] != size:
                    raise ValueError(f"{path}: {name} has {size} bytes for {rows} particles")
                blocks[name] = offset + 4, each
                offset += 8 + size
        return cls(path, header, blocks)

    def before(self, kind: int, block: str) -> int:
        """Rows of a block in front of those of a type."""
        return sum(c for c, m in list(zip(self.header.counts, self.header.masses, strict=True))[:kind] if block != "mass" or m == 0)


@dataclass
class Stretch(InputPartition):
    """Particles ``first`` to ``first + count`` of a type, and the byte ranges (block, offset, bytes, bytes of a number) to read for them."""

    path: str
    family: str
    mass: float
    count: int
    ranges: tuple[tuple[str, int, int, int], ...]


def plan(layout: Layout, columns: list[str], families: set[str] | None, chunk: int) -> list[Stretch]:
    out, wanted = [], list(dict.fromkeys(COLUMNS[c][0] for c in columns if c in COLUMNS))
    for kind, n in enumerate(layout.header.counts):
        if not n or families is not None and FAMILIES[kind] not in families:
            continue
        mass = layout.header.masses[kind]
        parts = -(-n // chunk)
        for i in range(parts):
            first, last = n * i // parts, n * (i + 1) // parts
            ranges = []
            for b in wanted:
                if b == "mass" and mass != 0:
                    continue
                offset, each = layout.blocks[b]
                width = WIDTH[b] * each
                ranges.append((b, offset + (layout.before(kind, b) + first) * width, (last - first) * width, each))
            out.append(Stretch(layout.path, FAMILIES[kind], mass, last - first, tuple(ranges)))
    return out


class GadgetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path = schema.names, options["path"]
        self.chunk = int(options.get("chunk", 1_000_000))
        self.families = set(options["families"].split(",")) if options.get("families") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """A family that is asked for limits the files' stretches; all else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("family",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.families = asked if self.families is None else self.families & asked
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        return [s for path in files_of(self.path) for s in plan(Layout.of(path), self.columns, self.families, self.chunk)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        system, at = fs.FileSystem.from_uri(part.path)
        with system.open_input_file(at) as f:
            for lo in range(0, part.count, BATCH):
                n = min(BATCH, part.count - lo)
                held = {}
                for block, offset, size, each in part.ranges:
                    width = size // part.count
                    kind = ("<u" if block == "id" else "<f") + str(each)
                    held[block] = np.frombuffer(f.read_at(n * width, offset + lo * width), kind).reshape(n, WIDTH[block])
                made = {"family": pa.array([part.family] * n), "mass": pa.array(np.full(n, part.mass))}
                for c, (block, place) in COLUMNS.items():
                    if block in held:
                        made[c] = pa.array(held[block][:, place].astype(np.int64 if block == "id" else float))
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], names=self.columns)


class GadgetWriter(DataSourceArrowWriter):
    """A file for each partition, renamed into place when all are written."""

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.totals = tuple(int(v) for v in options["totals"].split(","))
        self.files, self.boxsize = int(options["files"]), float(options.get("boxsize", 0.0))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        i = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0)
        kind = np.array([TYPE_OF[f] for f in column("family")], int)
        by = np.argsort(kind, kind="stable")
        get = lambda c: column(c)[by]
        header = Header(tuple(int((kind == k).sum()) for k in range(6)), (0.0,) * 6, 0.0, 0.0, self.totals, self.files, self.boxsize)
        records = [header.pack(), *[np.stack([get(c) for c in cs], 1).astype("<f8").tobytes() for cs in (("x", "y", "z"), ("vx", "vy", "vz"))], get("pid").astype("<u8").tobytes(), get("mass").astype("<f8").tobytes()]
        system, at = fs.FileSystem.from_uri(self.path)
        system.create_dir(at)
        name = f"{at}/_{self.job}.{i}.{uuid.uuid4().hex}"
        with system.open_output_stream(name) as f:
            for r in records:
                if len(r) >= 2**32:
                    raise ValueError("a record of 4 GB or more: write more files")
                f.write(struct.pack("<I", len(r)) + r + struct.pack("<I", len(r)))
        return Written(name, f"{at}/snapshot.{i}")

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.move(m.written, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.written)


@dataclass
class Written(WriterCommitMessage):
    written: str
    final: str


class Gadget(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gadget"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> GadgetReader:
        return GadgetReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> GadgetWriter:
        return GadgetWriter(self.options)


def files_of(path: str) -> list[str]:
    """The file, or those of a folder whose names do not begin with ``_`` or ``.``."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name[0] not in "_."]
    return [f"{path.rstrip('/')}/{name}" for name in sorted(found)]


def read_gadget(spark: SparkSession, path: str, *, columns: list[str] | None = None, units: dict[str, str] | None = None, chunk: int = 1_000_000, families: list[str] | None = None) -> Snapshot:
    """A snapshot from a file or a folder of them (an absolute path or URI that all executors reach). ``columns``: those to read; blocks of no wanted column are not touched."""
    ship(spark)
    spark.dataSource.register(Gadget)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    names = list(kinds) if columns is None else list(dict.fromkeys(["family", *columns]))
    reader = spark.read.format("gadget").schema(", ".join(f"{c} {kinds[c]}" for c in names)).option("chunk", str(chunk))
    if families is not None:
        reader = reader.option("families", ",".join(families))
    files = files_of(path)
    if not files:
        raise ValueError(f"no files in {path}")
    box = Layout.of(files[0]).header.boxsize
    return Snapshot(reader.load(path), units or {}, {"boxsize": box} if box else {})


def write_gadget(snap: Snapshot, path: str, files: int | None = None) -> None:
    """Files ``snapshot.0`` and on in a folder, with 8 bytes a number; a task holds one file's rows. ``files``: by default the frame's partitions."""
    df = snap.df.select(*[F.col(c).cast(t).alias(c) for c, t in (part.split() for part in SCHEMA.split(", "))])
    df = df if files is None else df.repartition(files)
    held = {r["family"]: r["count"] for r in df.groupBy("family").count().collect()}
    totals = ["0"] * 6
    for family, n in held.items():
        totals[TYPE_OF[family]] = str(n)
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(Gadget)
    n = df.rdd.getNumPartitions() if files is None else files
    df.write.format("gadget").mode("append").option("totals", ",".join(totals)).option("files", str(n)).option("boxsize", str(snap.properties.get("boxsize", 0.0))).save(path)


def frame_bytes(parts: list[Stretch]) -> int:
    """What a plan reads."""
    return sum(size for p in parts for _, _, size, _ in p.ranges)
