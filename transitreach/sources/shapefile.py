"""Polygon files: a Spark data source for folders of shapefiles.

``spark.read.format("shapefile").load(path)`` after ``register(spark)``.  ``path``
is one ``.shp`` file or a folder of them, each with its ``.shx`` index and ``.dbf``
table.  The index and the table have records of fixed length, so a task reads a
range of records of a file (about ``splitbytes`` of shapes) by its place and nothing
else.  Columns are pruned by the schema the reader is given:
``.schema("geoid string")`` reads the table alone and decodes no shape.

``geometry`` is polygon -> ring -> vertex ``struct<x, y>`` for every part of an area:
outer ring first, then its holes.  A hole belongs to the smallest outer ring that
holds its first vertex.  On writing, outer rings turn clockwise and holes
counterclockwise, so a ring may come back reversed.

Edge cases: a NULL geometry is a null shape and comes back as NULL, as does an area
without polygons.  Blank text in the table is NULL, so an empty string comes back as
NULL.  Deleted table rows are skipped.  An empty folder gives no rows, but then the
schema must be given; writing an empty table writes one file without records.  Longer
texts than the table can hold (254 bytes) and names beyond ten bytes are an error, not
cut.  Coordinates must be geographic: a projected reference system is an error.

Files are opened with ``pyarrow.fs``, in Python workers, so the path's scheme must be
one that it knows; tasks write under a staging folder and the driver moves the files
of the tasks that were committed.
"""

from __future__ import annotations

import datetime
import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# ---- Fixed values: the file format ----
FILE_CODE, VERSION = 9994, 1000
NULL_SHAPE, POLYGON = 0, 5
POLYGONS = (5, 15, 25)              # flat, with heights, with measures: all begin alike
HEADER, INDEX_ENTRY = 100, 8
TEXT_BYTES, NAME_BYTES = 254, 10
WGS84 = ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],'
         'PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]')
PARTS = (".shp", ".shx", ".dbf", ".cpg", ".prj")

GEOMETRY = "geometry"
VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))
SPLIT_BYTES = 32 << 20              # shapes per reading task
BATCH_BYTES = 4 << 20               # shapes per Arrow batch
FILE_BYTES = 64 << 20               # shapes per written file, held by its task


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _bytes_at(fs: pafs.FileSystem, path: str, start: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(size, start)


# ---------------------------------------------------------------- the attribute table

@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    width: int
    decimals: int = 0

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.width <= 20 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding).strip(" \0")
        if not text or (self.kind in "NF" and set(text) == {"*"}):
            return None
        if self.kind in "NF":
            return int(text) if isinstance(self.type, T.LongType) else float(text)
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        return datetime.datetime.strptime(text, "%Y%m%d").date() if self.kind == "D" else text

    def raw(self, value) -> bytes:
        if value is None:
            return b" " * self.width
        if self.kind == "D":
            return value.strftime("%Y%m%d").encode()
        if self.kind == "L":
            return b"T" if value else b"F"
        out = (repr(value) if self.kind in "NF" else value).encode("utf-8")
        if len(out) > self.width:
            raise ValueError(f"{self.name}: {len(out)} bytes, the table holds {self.width}")
        return out.rjust(self.width) if self.kind in "NF" else out.ljust(self.width)


@dataclass(frozen=True)
class Table:
    fields: tuple[Field, ...]
    header: int
    record: int

    @staticmethod
    def of(fs: pafs.FileSystem, path: str) -> Table:
        _, _, header, record = struct.unpack("<4sIHH", _bytes_at(fs, path, 0, 12))
        rows = _bytes_at(fs, path, 32, header - 32)
        found = []
        for at in range(0, len(rows) - 31, 32):
            if rows[at] == 0x0D:
                break
            name, kind, width, decimals = struct.unpack("<11sc4xBB", rows[at:at + 18])
            found.append(Field(name.split(b"\0")[0].decode("latin-1"), kind.decode(), width, decimals))
        return Table(tuple(found), header, record)

    def rows(self, fs: pafs.FileSystem, path: str, first: int, last: int) -> np.ndarray:
        """Raw records ``first`` to ``last`` (without it), one named byte field per column."""
        names, places, at = ["_gone"], [0], 1
        for f in self.fields:
            names.append(f.name)
            places.append(at)
            at += f.width
        layout = np.dtype({"names": names, "offsets": places, "itemsize": self.record,
                           "formats": ["S1", *[f"S{f.width}" for f in self.fields]]})
        return np.frombuffer(_bytes_at(fs, path, self.header + first * self.record, (last - first) * self.record), layout)


def _field_of(name: str, kind: T.DataType) -> Field:
    if len(name.encode()) > NAME_BYTES:
        raise ValueError(f"{name}: column names have at most {NAME_BYTES} bytes")
    if isinstance(kind, T.StringType):
        return Field(name, "C", TEXT_BYTES)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return Field(name, "N", 20)
    if isinstance(kind, T.DoubleType):
        return Field(name, "F", 24, 15)
    if isinstance(kind, T.BooleanType):
        return Field(name, "L", 1)
    if isinstance(kind, T.DateType):
        return Field(name, "D", 8)
    raise ValueError(f"{name}: {kind.simpleString()} has no column type in the table")


# ---------------------------------------------------------------- shapes

def _twice_area(ring: np.ndarray) -> float:
    """Positive for a counterclockwise ring; relative to its first vertex, for precision."""
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    (x, y), a, b = point, ring[:-1], ring[1:]
    crossing = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[crossing], b[crossing]
    return bool(np.sum(x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) % 2)


def polygons_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as they stand in a shape -> polygons, each with its holes after the outer ring.

    Without any clockwise ring the rings are taken as outer ones, and a hole that no outer
    ring holds stands as a polygon, so no ring is lost.
    """
    rings = [r for r in rings if len(r)]
    areas = [_twice_area(r) for r in rings]
    outer = [i for i, a in enumerate(areas) if a <= 0] or list(range(len(rings)))
    made = {i: [rings[i]] for i in outer}
    for i in range(len(rings)):
        if i not in made:
            around = outer if len(outer) == 1 else [o for o in outer if _holds(rings[o], rings[i][0])]
            if around:
                made[min(around, key=lambda o: abs(areas[o]))].append(rings[i])
            else:
                made[i] = [rings[i]]
    return list(made.values())


def shape_polygons(content: bytes) -> list[list[np.ndarray]] | None:
    kind = struct.unpack_from("<i", content)[0]
    if kind == NULL_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shapes of type {kind} are no polygons")
    n_rings, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_rings, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_rings).reshape(-1, 2)
    return polygons_of(np.split(points, starts[1:]) if n_rings else []) or None


def _turned(ring: np.ndarray, clockwise: bool) -> np.ndarray:
    return ring[::-1] if (_twice_area(ring) < 0) != clockwise else ring


def polygon_shape(polygons) -> tuple[bytes, np.ndarray]:
    """The content of a shape record and its box; the box of a null shape is empty."""
    rings = [_turned(np.array([(v["x"], v["y"]) for v in ring], dtype="<f8"), k == 0)
             for polygon in polygons or () for k, ring in enumerate(polygon) if ring]
    if not rings:
        return struct.pack("<i", NULL_SHAPE), np.empty((0, 2))
    points = np.concatenate(rings)
    box = np.array([points.min(0), points.max(0)])
    starts = np.cumsum([0, *[len(r) for r in rings[:-1]]]).astype("<i4")
    return (struct.pack("<i4dii", POLYGON, *box.ravel(), len(rings), len(points)) + starts.tobytes()
            + points.astype("<f8").tobytes(), box)


def _geometry_array(shapes: list) -> pa.Array:
    """Nested Arrow lists over one flat array of vertices."""
    def bounds(sizes):
        return np.cumsum([0, *sizes]).astype(np.int32)

    polygons = [p for s in shapes for p in s or ()]
    rings = [r for p in polygons for r in p]
    points = np.concatenate(rings) if rings else np.empty((0, 2))
    vertices = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    by_ring = pa.ListArray.from_arrays(pa.array(bounds(map(len, rings))), vertices)
    by_polygon = pa.ListArray.from_arrays(pa.array(bounds(map(len, polygons))), by_ring)
    return pa.ListArray.from_arrays(pa.array(bounds(len(s or ()) for s in shapes)), by_polygon,
                                    mask=pa.array([s is None for s in shapes], type=pa.bool_()))


# ---------------------------------------------------------------- the data source

@dataclass
class Records(InputPartition):
    stem: str
    first: int
    last: int


class ShapefileSource(DataSource):
    """``path`` (a file or a folder); ``splitbytes``: shapes per reading task; ``filebytes``: per written file."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        fs, stems = _stems(self.options["path"])
        if not stems:
            raise ValueError(f"no .shp file in {self.options['path']}: give the schema")
        fields = Table.of(fs, stems[0][0] + ".dbf").fields
        return T.StructType([*[T.StructField(f.name, f.type) for f in fields], T.StructField(GEOMETRY, MULTIPOLYGON)])

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(self.options, schema, overwrite)


def _stems(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    """Each file's path without its ending and the bytes of its shapes, by name."""
    fs, path = _opened(path)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path))
    return fs, sorted((f.path[:-4], f.size) for f in files if f.is_file and f.path.lower().endswith(".shp"))


def _side_text(fs: pafs.FileSystem, path: str, otherwise: str) -> str:
    info = fs.get_file_info(path)
    return _bytes_at(fs, path, 0, info.size).decode("latin-1").strip() if info.is_file else otherwise


class ShapeReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Records]:
        fs, stems = _stems(self.path)
        out = []
        for stem, size in stems:
            n = (fs.get_file_info(stem + ".shx").size - HEADER) // INDEX_ENTRY
            step = max(1, -(-n // max(1, -(-size // self.split))))
            out += [Records(stem, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records):
        if part.first == part.last:
            return
        fs, _ = _opened(self.path)
        crs = _side_text(fs, part.stem + ".prj", WGS84)
        if re.match(r"PROJ(CS|CRS)", crs):
            raise ValueError(f"{part.stem}.prj: projected coordinates ({crs[:60]})")
        encoding = _side_text(fs, part.stem + ".cpg", "latin-1")
        table = Table.of(fs, part.stem + ".dbf")
        fields = {f.name: f for f in table.fields}
        index = np.frombuffer(_bytes_at(fs, part.stem + ".shx", HEADER + part.first * INDEX_ENTRY,
                                        (part.last - part.first) * INDEX_ENTRY), ">i4").reshape(-1, 2).astype(np.int64) * 2
        group = np.cumsum(index[:, 1]) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(index)]
        with fs.open_input_file(part.stem + ".shp") as shp:
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = table.rows(fs, part.stem + ".dbf", part.first + int(a), part.first + int(b))
                kept = np.flatnonzero(rows["_gone"] != b"*")
                columns = []
                for wanted in self.schema.fields:
                    if wanted.name == GEOMETRY:
                        columns.append(_geometry_array(self._shapes(shp, index[a:b][kept])))
                    elif wanted.name in fields:
                        values = [fields[wanted.name].value(v, encoding) for v in rows[wanted.name][kept].tolist()]
                        columns.append(_arrow(values, wanted.dataType))
                    else:                                        # a column that this file lacks
                        columns.append(_arrow([None] * len(kept), wanted.dataType))
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)

    @staticmethod
    def _shapes(shp, entries: np.ndarray) -> list:
        if not len(entries):
            return []
        low, high = int(entries[:, 0].min()), int((entries[:, 0] + 8 + entries[:, 1]).max())
        if high - low <= 2 * int((entries[:, 1] + 8).sum()):     # one read for records that lie together
            data = shp.read_at(high - low, low)
            return [shape_polygons(data[o - low + 8:o - low + 8 + n]) for o, n in entries.tolist()]
        return [shape_polygons(shp.read_at(n, o + 8)) for o, n in entries.tolist()]


def _arrow(values: list, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type
    if isinstance(kind, T.StringType):
        values = [None if v is None else str(v) for v in values]
    return pa.array(values, type=to_arrow_type(kind))


@dataclass
class Written(WriterCommitMessage):
    stems: list[str]


class ShapeWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.names = options["path"].rstrip("/"), overwrite, schema.names
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.fields = [_field_of(f.name, f.dataType) for f in schema.fields if f.name != GEOMETRY]
        if GEOMETRY not in schema.names or schema[GEOMETRY].dataType.simpleString() != MULTIPOLYGON.simpleString():
            raise ValueError(f"a column {GEOMETRY} of type {MULTIPOLYGON.simpleString()} is needed")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        task, stems, rows, size = uuid.uuid4().hex, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                content, box = polygon_shape(row[GEOMETRY])
                rows.append((content, box, b" " + b"".join(f.raw(row[f.name]) for f in self.fields)))
                size += len(content)
                if size >= self.most:
                    stems.append(self._file(fs, root, f"part-{task}-{len(stems):05d}", rows))
                    rows, size = [], 0
        if rows or not stems:
            stems.append(self._file(fs, root, f"part-{task}-{len(stems):05d}", rows))
        return Written(stems)

    def _file(self, fs, root: str, stem: str, rows: list) -> str:
        boxes = [box for _, box, _ in rows if len(box)]
        points = np.concatenate(boxes) if boxes else np.zeros((1, 2))
        box = struct.pack("<4d", *points.min(0), *points.max(0)) + b"\0" * 32

        def head(size: int) -> bytes:
            return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", VERSION, POLYGON) + box

        sizes = np.array([len(c) for c, _, _ in rows], dtype=np.int64)
        places = HEADER + np.concatenate(([0], np.cumsum(sizes + 8)))
        shapes = b"".join(struct.pack(">2i", i + 1, len(c) // 2) + c for i, (c, _, _) in enumerate(rows))
        index = np.column_stack((places[:-1], sizes)) // 2
        record = 1 + sum(f.width for f in self.fields)
        table = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(self.fields), record)
        for f in self.fields:
            table += struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.width, f.decimals)
        parts = {".shp": head(HEADER + len(shapes)) + shapes, ".shx": head(HEADER + 8 * len(rows)) + index.astype(">i4").tobytes(),
                 ".dbf": table + b"\r" + b"".join(r for _, _, r in rows) + b"\x1a", ".cpg": b"UTF-8", ".prj": WGS84.encode()}
        for end, data in parts.items():
            with fs.open_output_stream(f"{root}/{self.staging}/{stem}{end}") as out:
                out.write(data)
        return stem

    def commit(self, messages) -> None:
        fs, root = _opened(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.path.endswith(PARTS):
                    fs.delete_file(f.path)
        for stem in [s for m in messages if m for s in m.stems]:
            for end in (*PARTS[1:], PARTS[0]):                   # the shapes last: readers list them
                fs.move(f"{root}/{self.staging}/{stem}{end}", f"{root}/{stem}{end}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages) -> None:
        fs, root = _opened(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")
