"""Coordinate reference systems, and transverse Mercator projection as column expressions.

A :class:`Crs` is a small driver-side value carried beside a DataFrame. Projections are Krüger series of order six in
the third flattening, built from built-in functions only, so they run inside generated code.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Crs:
    """A geographic system, or a transverse Mercator projection of it."""

    projected: bool
    central_meridian: float = 0.0
    scale: float = 1.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    unit: str = "degree"

    @property
    def axes(self) -> tuple[str, str]:
        return ("E", "N") if self.projected else ("Lon", "Lat")

    @property
    def srid(self) -> int:
        """The EPSG code of WGS 84 and its UTM zones; 0 for others."""
        if self == WGS84:
            return 4326
        zone = (self.central_meridian + 183) / 6
        if self.projected and zone == int(zone) and 1 <= zone <= 60:
            for base, north in ((32600, True), (32700, False)):
                if self == utm(int(zone), north):
                    return base + int(zone)
        return 0


WGS84 = Crs(projected=False)


def utm(zone: int, north: bool = True) -> Crs:
    """A WGS 84 UTM zone."""
    if not 1 <= zone <= 60:
        raise ValueError("UTM zones are 1 to 60")
    return Crs(True, 6.0 * zone - 183.0, 0.9996, 500_000.0, 0.0 if north else 10_000_000.0, unit="metre")


def from_srid(srid: int) -> Crs:
    """From an EPSG code: 4326, 326zz or 327zz."""
    if srid == 4326:
        return WGS84
    if srid // 100 in (326, 327):
        return utm(srid % 100, srid // 100 == 326)
    raise ValueError(f"unknown EPSG code {srid}")


def parse(name: str) -> Crs:
    """From ``EPSG:n`` or well-known text."""
    if m := re.fullmatch(r"\s*EPSG:(\d+)\s*", name, re.IGNORECASE):
        return from_srid(int(m[1]))
    spheroid = re.search(r'SPHEROID\["[^"]*",\s*([\d.]+),\s*([\d.]+)', name)
    if not spheroid:
        raise ValueError("not a coordinate reference system")
    a, inverse = float(spheroid[1]), float(spheroid[2])
    if not name.lstrip().startswith("PROJCS"):
        return Crs(False, semi_major=a, inverse_flattening=inverse)
    if not re.search(r'PROJECTION\["Transverse_Mercator"', name, re.IGNORECASE):
        raise ValueError("only transverse Mercator projections are supported")
    held = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*(-?[\d.eE+-]+)', name)}
    if held.get("latitude_of_origin", 0.0) != 0.0:
        raise ValueError("only the equator is supported as latitude of origin")
    units = re.findall(r'UNIT\["([^"]+)",\s*([\d.eE+-]+)', name)
    if units and float(units[-1][1]) != 1.0:
        raise ValueError("only metres are supported as projected unit")
    return Crs(True, held.get("central_meridian", 0.0), held.get("scale_factor", 1.0), held.get("false_easting", 0.0), held.get("false_northing", 0.0), a, inverse, "metre")


def to_wkt(crs: Crs) -> str:
    """Well-known text in the form that shapefiles carry."""
    geographic = f'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",{crs.semi_major!r},{crs.inverse_flattening!r}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    if not crs.projected:
        return geographic
    values = {"False_Easting": crs.false_easting, "False_Northing": crs.false_northing, "Central_Meridian": crs.central_meridian, "Scale_Factor": crs.scale, "Latitude_Of_Origin": 0.0}
    name = f"EPSG_{crs.srid}" if crs.srid else "Transverse_Mercator"
    return f'PROJCS["{name}",{geographic},PROJECTION["Transverse_Mercator"],' + ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in values.items()) + ',UNIT["Meter",1.0]]'


# Coefficients of the series in the third flattening n, from n^j upwards, for j = 1 to 6.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
INVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def _constants(crs: Crs) -> tuple[float, float, float, list[float], list[float]]:
    f = 1 / crs.inverse_flattening
    n = f / (2 - f)
    radius = crs.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    series = lambda table: [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]
    return math.sqrt(f * (2 - f)), crs.scale * radius, n, series(FORWARD), series(INVERSE)


Step = Callable[[Column, Column], tuple[Column, Column]]


def _forward_steps(crs: Crs) -> list[Step]:
    e, radius, _, alpha, _ = _constants(crs)

    def to_sphere(lon: Column, lat: Column) -> tuple[Column, Column]:
        sine, turn = F.sin(F.radians(lat)), F.radians(lon - crs.central_meridian)
        return F.atanh(sine) - e * F.atanh(e * sine), turn

    def to_plane(level: Column, turn: Column) -> tuple[Column, Column]:
        t = F.sinh(level)
        return F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))

    def with_series(xi: Column, eta: Column) -> tuple[Column, Column]:
        north, east = xi, eta
        for j, a in enumerate(alpha, 1):
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return crs.false_easting + radius * east, crs.false_northing + radius * north

    return [to_sphere, to_plane, with_series]


def _backward_steps(crs: Crs) -> list[Step]:
    e, radius, _, _, beta = _constants(crs)

    def without_series(x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - crs.false_northing) / radius, (x - crs.false_easting) / radius
        xi0, eta0 = xi, eta
        for j, b in enumerate(beta, 1):
            xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return xi0, eta0

    def to_sphere(xi: Column, eta: Column) -> tuple[Column, Column]:
        tangent = F.sinh(eta)
        return F.atan2(tangent, F.cos(xi)), F.asinh(F.sin(xi) / F.sqrt(tangent * tangent + F.cos(xi) * F.cos(xi)))

    def to_degrees(turn: Column, level: Column) -> tuple[Column, Column]:
        sine = F.tanh(level)
        for _ in range(7):  # each turn gains over two digits
            sine = F.tanh(level + e * F.atanh(e * sine))
        return crs.central_meridian + F.degrees(turn), F.degrees(F.atan(F.sinh(level + e * F.atanh(e * sine))))

    return [without_series, to_sphere, to_degrees]


def _steps(source: Crs, target: Crs) -> list[Step]:
    if source == target:
        return []
    if (source.semi_major, source.inverse_flattening) != (target.semi_major, target.inverse_flattening):
        raise ValueError("datum shifts are not supported")
    return (_backward_steps(source) if source.projected else []) + (_forward_steps(target) if target.projected else [])


def transform(x: Column, y: Column, source: Crs, target: Crs) -> tuple[Column, Column]:
    """Coordinates of ``source`` in ``target``; unchanged where they are equal."""
    for step in _steps(source, target):
        x, y = step(x, y)
    return x, y


def project(lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    """Easting and northing of degrees."""
    return transform(lon, lat, replace(crs, projected=False), crs)


def unproject(x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    return transform(x, y, crs, replace(crs, projected=False))


def transform_vertices(vertices: Column, source: Crs, target: Crs) -> Column:
    """An array of vertices moved to ``target``. Every step is a pass of its own, so no expression is repeated."""

    def applied(step: Step) -> Callable[[Column], Column]:
        def one(v: Column) -> Column:
            x, y = step(v["x"], v["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return one

    for step in _steps(source, target):
        vertices = F.transform(vertices, applied(step))
    return vertices


def with_transformed(df: DataFrame, source: Crs, target: Crs, out_x: str, out_y: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``out_x`` and ``out_y``, the point moved to ``target``. Every step is a projection of its own, which stays small."""
    if out_x not in (x, y) or out_y not in (x, y):
        df = df.withColumns({out_x: F.col(x), out_y: F.col(y)})
    for step in _steps(source, target):
        moved = step(F.col(out_x), F.col(out_y))
        df = df.withColumns({out_x: moved[0], out_y: moved[1]})
    return df


def reproject_points(df: DataFrame, source: Crs, target: Crs, x: str = "x", y: str = "y") -> DataFrame:
    """Points with ``x`` and ``y`` moved to ``target``; other columns are kept."""
    return with_transformed(df, source, target, x, y, x, y)


def reproject_lines(df: DataFrame, source: Crs, target: Crs, parts: str = "parts") -> DataFrame:
    """Lines with every vertex of ``parts`` moved to ``target``; other columns are kept."""
    if source == target:
        return df

    return df.withColumn(parts, F.transform(parts, lambda part: transform_vertices(part, source, target)))
