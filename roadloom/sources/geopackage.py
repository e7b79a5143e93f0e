"""GeoPackage layers as a Spark data source: ``format("geopackage")``.

A GeoPackage is one SQLite file. Tasks write their rows as pieces beside the target; the commit streams them into the
file in batches. Reading splits a layer by ranges of its row numbers. Geometry is points (``x, y``), lines (``parts``) or
polygons (``ring``); for large results, write Parquet with :func:`roadloom.functions.geometry.with_wkb` instead.
"""

from __future__ import annotations

import os
import pickle
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from roadloom.functions.crs import WGS84, from_srid, parse, to_wkt
from roadloom.functions.geometry import line_wkb, parse_wkb, point_wkb, polygon_wkb
from roadloom.session import ship

BATCH, ROWS = 10_000, 50_000
SHAPES = {"x": "POINT", "parts": "MULTILINESTRING", "ring": "POLYGON"}


def _blob(wkb: bytes | None, srid: int) -> bytes | None:
    return None if wkb is None else b"GP\0\x01" + struct.pack("<i", srid) + wkb


def _vertices(rows) -> list[tuple[float, float]]:
    return [(v["x"], v["y"]) for v in rows]


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


@dataclass
class Piece(WriterCommitMessage):
    name: str


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class GeoPackageWriter(DataSourceWriter):
    def __init__(self, path: str, layer: str, schema: T.StructType, overwrite: bool, srid: int):
        self.path, self.layer, self.schema, self.overwrite, self.srid = path, layer, schema, overwrite, srid
        self.shape = next((c for c in SHAPES if c in schema.names), None)
        if self.shape is None:
            raise ValueError("a layer has x and y, parts, or ring")
        if '"' in layer or any('"' in n for n in schema.names):
            raise ValueError("names must not hold quotes")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.columns = [f for f in schema.fields if f.name not in ("x", "y", "parts", "ring")]
        os.makedirs(self._work(), exist_ok=True)

    def _work(self) -> str:
        return f"{self.path}.pieces"

    def _wkb(self, row) -> bytes | None:
        if self.shape == "x":
            return None if row["x"] is None or row["y"] is None else point_wkb(row["x"], row["y"])
        if not row[self.shape]:
            return None
        return polygon_wkb(_vertices(row["ring"])) if self.shape == "ring" else line_wkb([_vertices(p) for p in row["parts"]])

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(self._work(), f"{context.partitionId():06d}-{context.taskAttemptId()}")
        with open(name, "wb") as out:
            batch = []
            for row in iterator:
                batch.append((_blob(self._wkb(row), self.srid), *(_plain(row[f.name]) for f in self.columns)))
                if len(batch) == BATCH:
                    pickle.dump(batch, out)
                    batch = []
            if batch:
                pickle.dump(batch, out)
        return Piece(name)

    def commit(self, messages: list) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)
        kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.BooleanType: "BOOLEAN", T.DecimalType: "DOUBLE", T.DateType: "DATE", T.TimestampType: "DATETIME", T.BinaryType: "BLOB"}
        columns = "".join(f', "{f.name}" {kinds.get(type(f.dataType), "TEXT")}' for f in self.columns)
        db = sqlite3.connect(self.path)
        try:
            db.executescript(f"""
                PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
                CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
                CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '2000-01-01T00:00:00.000Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
                CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
                CREATE TABLE "{self.layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{columns});""")
            known = {-1: ("Undefined cartesian", "NONE", "undefined"), 0: ("Undefined geographic", "NONE", "undefined"), 4326: ("WGS 84", "EPSG", to_wkt(WGS84))}
            if self.srid not in known:
                known[self.srid] = (f"EPSG:{self.srid}", "EPSG", to_wkt(from_srid(self.srid)))
            db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [(name, k, org, k, text) for k, (name, org, text) in known.items()])
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (self.layer, self.layer, self.srid))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (self.layer, "GEOMETRY" if self.shape == "parts" else SHAPES[self.shape], self.srid))
            names = ", ".join(["geom", *(f'"{f.name}"' for f in self.columns)])
            into = f'INSERT INTO "{self.layer}" ({names}) VALUES ({", ".join("?" * (1 + len(self.columns)))})'
            for piece in sorted(m.name for m in messages if m):
                with open(piece, "rb") as f:
                    while True:
                        try:
                            db.executemany(into, pickle.load(f))
                        except EOFError:
                            break
            db.commit()
        finally:
            db.close()
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self._work()):
            os.remove(os.path.join(self._work(), name))
        os.rmdir(self._work())


class GeoPackageReader(DataSourceReader):
    """Rows with ``kind``, ``parts`` (a point is one part of one vertex) and the attributes."""

    def __init__(self, path: str, layer: str, names: list[str]):
        self.path, self.layer, self.names = path, layer, names

    def partitions(self) -> list[Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT coalesce(min(fid), 0), coalesce(max(fid), -1) FROM "{self.layer}"').fetchone()
        return [Rows(a, min(a + ROWS, high + 1)) for a in range(low, high + 1, ROWS)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(f'"{n}"' for n in ["fid", "geom", *self.names])
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for fid, geom, *values in db.execute(f'SELECT {columns} FROM "{self.layer}" WHERE fid >= ? AND fid < ? ORDER BY fid', (partition.first, partition.end)):
                kind, parts = (None, None) if geom is None else parse_wkb(geom[8:])
                if parts is not None:
                    parts = [[{"x": x, "y": y} for x, y in (p if isinstance(p, list) else [p])] for p in parts]
                yield (fid, kind, parts, *values)


class GeoPackageSource(DataSource):
    """Options: ``path``, ``layer`` (by default the file's name) and, when writing, ``crs`` (``EPSG:n``)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _where(self) -> tuple[str, str]:
        path = self.options.get("path")
        if not isinstance(path, str):
            raise TypeError("a path is needed")
        return path, self.options.get("layer") or os.path.splitext(os.path.basename(path))[0]

    def _attributes(self) -> list[tuple[str, str]]:
        path, layer = self._where()
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return [(r[1], r[2]) for r in db.execute(f'PRAGMA table_info("{layer}")') if r[1] not in ("fid", "geom")]

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.LongType(), "BLOB": T.BinaryType()}
        vertex = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
        head = [T.StructField("fid", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(vertex)))]
        return T.StructType([*head, *(T.StructField(n, kinds.get(k, T.StringType())) for n, k in self._attributes())])

    def reader(self, schema: T.StructType) -> GeoPackageReader:
        return GeoPackageReader(*self._where(), [n for n, _ in self._attributes()])

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoPackageWriter:
        crs = self.options.get("crs")
        return GeoPackageWriter(*self._where(), schema, overwrite, parse(crs).srid if crs else -1)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(GeoPackageSource)
