"""Shapefiles as a Spark data source: ``spark.read.format("shapefile")`` and ``df.write.format("shapefile")``.

Reading: ``.shx`` tells where each record stands, so ranges of ``RECORDS`` records are read by separate tasks, each with the
matching rows of ``.dbf``. Columns: ``record_no`` (from 0), ``kind`` (Point, LineString, MultiLineString; null for a null
shape), ``x, y`` for points or ``parts`` for lines, and the attributes. Filters on ``kind`` are applied before rows leave the
reader. ``.cpg`` names the attributes' encoding; the projection text is available from :func:`read_crs`.

Writing: tasks write pieces beside the target, and the commit joins them into one set of files; only offsets are held in
memory. The path has to be on a file system that the driver and all executors share.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from roadloom.functions.crs import Crs, parse, to_wkt
from roadloom.session import ship

RECORDS = 50_000
POINT, LINE = 1, 3
RESERVED = ("record_no", "kind", "x", "y", "parts")
VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _stem(path: str) -> str:
    return path[:-4] if path.lower().endswith(".shp") else path


def read_crs(path: str) -> Crs | None:
    """The coordinate reference system of a shapefile; None without ``.prj``."""
    name = f"{_stem(path)}.prj"
    if not os.path.exists(name):
        return None
    with open(name, encoding="utf-8") as f:
        return parse(f.read())


def _encoding(path: str) -> str:
    name = f"{_stem(path)}.cpg"
    if not os.path.exists(name):
        return "iso-8859-1"
    with open(name, encoding="ascii") as f:
        return f.read().strip() or "iso-8859-1"


@dataclass
class Field:
    name: str
    kind: str
    width: int
    decimals: int

    def spark_type(self) -> T.DataType:
        if self.kind in "NF":
            return T.DoubleType() if self.decimals or self.kind == "F" or self.width > 18 else T.LongType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())


def _dbf_head(path: str) -> tuple[int, int, int, list[Field]]:
    """Rows, bytes before the first row, bytes of a row, and fields of the attribute table."""
    with open(f"{_stem(path)}.dbf", "rb") as f:
        rows, head, width = struct.unpack("<4xIHH", f.read(12))
        f.seek(32)
        fields = []
        while (first := f.read(1)) not in (b"\r", b""):
            raw = first + f.read(31)
            fields.append(Field(raw[:11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[11]), raw[16], raw[17]))
    return rows, head, width, fields


def _value(field: Field, raw: bytes, encoding: str):
    from datetime import date

    text = raw.decode(encoding, "replace").rstrip(" \0")
    if field.kind in "NF":
        text = text.strip()
        try:
            return (float if isinstance(field.spark_type(), T.DoubleType) else int)(text) if text and text[0] != "*" else None
        except ValueError:
            return None
    if field.kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text.strip().lower())
    if field.kind == "D":
        text = text.strip()
        return date(int(text[:4]), int(text[4:6]), int(text[6:8])) if len(text) == 8 and text.isdigit() else None
    return text if text else None


def _shape_kind(path: str) -> int:
    with open(f"{_stem(path)}.shp", "rb") as f:
        code, kind = struct.unpack(">I28xI", f.read(36))
    kind = struct.unpack("<I", struct.pack(">I", kind))[0]
    if code != 9994:
        raise ValueError(f"{path} is not a shapefile")
    if kind not in (POINT, LINE):
        raise ValueError(f"shape kind {kind} is not supported")
    return kind


@dataclass
class Records(InputPartition):
    first: int
    end: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.kinds = path, schema, None

    def pushFilters(self, filters: list) -> Iterator:
        """Equality and membership tests of ``kind`` are taken over."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} if self.kinds is None else self.kinds & {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = set(f.value) if self.kinds is None else self.kinds & set(f.value)
            else:
                yield f

    def partitions(self) -> list[Records]:
        n = (os.path.getsize(f"{_stem(self.path)}.shx") - 100) // 8
        return [Records(a, min(a + RECORDS, n)) for a in range(0, n, RECORDS)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        stem, encoding = _stem(self.path), _encoding(self.path)
        _, head, width, fields = _dbf_head(self.path)
        points = "x" in self.schema.names
        n = partition.end - partition.first
        if not n:
            return
        with open(f"{stem}.shx", "rb") as f:
            f.seek(100 + 8 * partition.first)
            where = struct.unpack(f">{2 * n}I", f.read(8 * n))
        with open(f"{stem}.shp", "rb") as shapes, open(f"{stem}.dbf", "rb") as rows:
            rows.seek(head + width * partition.first)
            for k in range(n):
                row = rows.read(width)
                shapes.seek(2 * where[2 * k])
                body = shapes.read(8 + 2 * where[2 * k + 1])[8:]
                kind, shape = _shape(body, points)
                if self.kinds is not None and kind not in self.kinds:
                    continue
                at, values = 1, []
                for f in fields:
                    values.append(_value(f, row[at : at + f.width], encoding))
                    at += f.width
                yield (partition.first + k, kind, *shape, *values)


def _shape(body: bytes, points: bool) -> tuple[str | None, tuple]:
    (kind,) = struct.unpack_from("<I", body)
    if kind == POINT and points:
        return "Point", struct.unpack_from("<dd", body, 4)
    if kind == LINE and not points:
        parts, vertices = struct.unpack_from("<II", body, 36)
        starts = [*struct.unpack_from(f"<{parts}I", body, 44), vertices]
        flat = struct.unpack_from(f"<{2 * vertices}d", body, 44 + 4 * parts)
        lines = [[{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:])]
        return "LineString" if parts == 1 else "MultiLineString", (lines,)
    return None, (None, None) if points else (None,)


class ShapefileWriter(DataSourceWriter):
    """``record_no`` orders the records, if there; other reserved columns are the shape, the rest attributes."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, crs: str | None):
        self.path, self.schema, self.crs = path, schema, crs
        self.points = "x" in schema.names and "y" in schema.names
        if not self.points and "parts" not in schema.names:
            raise ValueError("a layer has x and y, or parts")
        if os.path.exists(f"{_stem(path)}.shp") and not overwrite:
            raise FileExistsError(path)
        self.fields = [self._field(f) for f in schema.fields if f.name not in RESERVED]
        short = [f.name for f in self.fields]
        if len(set(short)) < len(short):
            raise ValueError("attribute names must differ in their first ten characters")
        os.makedirs(self._work(), exist_ok=True)

    def _work(self) -> str:
        return f"{_stem(self.path)}.pieces"

    def _field(self, f: T.StructField) -> Field:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return Field(f.name[:10], "N", 32, 15)
        if isinstance(f.dataType, T.IntegralType):
            return Field(f.name[:10], "N", 18, 0)
        if isinstance(f.dataType, T.BooleanType):
            return Field(f.name[:10], "L", 1, 0)
        if isinstance(f.dataType, T.DateType):
            return Field(f.name[:10], "D", 8, 0)
        return Field(f.name[:10], "C", 254, 0)

    def _cell(self, field: Field, value) -> bytes:
        if value is None:
            return b" " * field.width
        if field.kind == "N":
            text = str(int(value)) if not field.decimals else repr(float(value))
            return text[: field.width].rjust(field.width).encode("ascii")
        if field.kind == "L":
            return b"T" if value else b"F"
        if field.kind == "D":
            return value.strftime("%Y%m%d").encode("ascii")
        raw = str(value).encode("utf-8")[: field.width]
        return raw.decode("utf-8", "ignore").encode("utf-8").ljust(field.width)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """A piece: length of the shape, shape, attribute row, again and again, in order."""
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(self._work(), f"{context.partitionId():06d}-{context.taskAttemptId()}")
        names = [f.name for f in self.schema.fields if f.name not in RESERVED]
        with open(name, "wb") as out:
            for row in iterator:
                shape = self._body(row)
                out.write(struct.pack("<I", len(shape)) + shape + b" " + b"".join(self._cell(f, row[n]) for f, n in zip(self.fields, names)))
        return Piece(name)

    def _body(self, row) -> bytes:
        if self.points:
            return struct.pack("<I", 0) if row["x"] is None or row["y"] is None else struct.pack("<Idd", POINT, row["x"], row["y"])
        parts = row["parts"]
        if not parts:
            return struct.pack("<I", 0)
        flat = [(v["x"], v["y"]) for p in parts for v in p]
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += len(p)
        xs, ys = [x for x, _ in flat], [y for _, y in flat]
        head = struct.pack("<I4dII", LINE, min(xs, default=0), min(ys, default=0), max(xs, default=0), max(ys, default=0), len(parts), len(flat))
        return head + struct.pack(f"<{len(parts)}I", *starts) + struct.pack(f"<{2 * len(flat)}d", *(c for v in flat for c in v))

    def commit(self, messages: list) -> None:
        stem, width = _stem(self.path), 1 + sum(f.width for f in self.fields)
        low, high, n = [float("inf")] * 2, [float("-inf")] * 2, 0
        with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
            shp.write(b"\0" * 100)
            shx.write(b"\0" * 100)
            fields = b"".join(struct.pack("<11sc4xBB14x", f.name.encode("utf-8")[:10], f.kind.encode("ascii"), f.width, f.decimals) for f in self.fields)
            dbf.write(b"\0" * 32 + fields + b"\r")
            for piece in sorted(m.name for m in messages if m):
                with open(piece, "rb") as f:
                    while size := f.read(4):
                        shape = f.read(struct.unpack("<I", size)[0])
                        shx.write(struct.pack(">II", shp.tell() // 2, len(shape) // 2))
                        shp.write(struct.pack(">II", n + 1, len(shape) // 2) + shape)
                        dbf.write(f.read(width))
                        n += 1
                        if len(shape) > 4:
                            box = struct.unpack_from("<4d", shape, 4) if not self.points else struct.unpack_from("<dd", shape, 4) * 2
                            low, high = [min(low[0], box[0]), min(low[1], box[1])], [max(high[0], box[2]), max(high[1], box[3])]
            dbf.write(b"\x1a")
            box = [*low, *high] if n and low[0] <= high[0] else [0.0] * 4
            for f in (shp, shx):
                length = f.tell() // 2
                f.seek(0)
                f.write(struct.pack(">I20xI", 9994, length) + struct.pack("<II8d", 1000, POINT if self.points else LINE, *box, 0, 0, 0, 0))
            dbf.seek(0)
            dbf.write(struct.pack("<BBBBIHH", 3, 95, 1, 1, n, 33 + len(fields), width))
        for ending, text in ((".cpg", "UTF-8"), (".prj", self.crs)):
            if text:
                with open(f"{stem}{ending}", "w", encoding="utf-8") as f:
                    f.write(text)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self._work()):
            os.remove(os.path.join(self._work(), name))
        os.rmdir(self._work())


@dataclass
class Piece(WriterCommitMessage):
    name: str


class ShapefileSource(DataSource):
    """Options: ``path``, and ``crs`` (well-known text or ``EPSG:n``) when writing."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _path(self) -> str:
        path = self.options.get("path")
        if not isinstance(path, str):
            raise TypeError("a path is needed")
        return path

    def schema(self) -> T.StructType:
        path = self._path()
        if not os.path.exists(f"{_stem(path)}.shp"):
            raise FileNotFoundError(path)
        head = [T.StructField("record_no", T.LongType()), T.StructField("kind", T.StringType())]
        shape = [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())] if _shape_kind(path) == POINT else [T.StructField("parts", T.ArrayType(T.ArrayType(VERTEX)))]
        return T.StructType([*head, *shape, *(T.StructField(f.name, f.spark_type()) for f in _dbf_head(path)[3])])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self._path(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        crs = self.options.get("crs")
        return ShapefileWriter(self._path(), schema, overwrite, to_wkt(parse(crs)) if crs else None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session. Pushing filters into Python sources is switched on."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileSource)
