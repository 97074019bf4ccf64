"""Transverse Mercator as column functions, and grids resampled from one projection to another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the constants of the UTM grid.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger's series in the third flattening, to its fourth power; the rest is below a thousandth of a millimetre
# in a zone.
_TO_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_FROM_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def zone_of(lon: float, lat: float) -> int:
    """EPSG number of the UTM zone of a place."""
    return (32600 if lat >= 0 else 32700) + int((lon + 180) // 6) % 60 + 1


def _zone(epsg: int) -> tuple[float, float]:
    """Middle meridian in degrees and false northing."""
    south, zone = divmod(epsg - 32600, 100)
    if south not in (0, 1) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is no UTM zone")
    return zone * 6 - 183.0, NORTH * south


def _series(terms: tuple[float, ...], a: Column, b: Column, sign: int) -> tuple[Column, Column]:
    """(a, b) with the series' sines and cosines added or taken off."""
    x = [(t * F.sin(2 * k * a) * F.cosh(2 * k * b), t * F.cos(2 * k * a) * F.sinh(2 * k * b)) for k, t in enumerate(terms, 1)]
    return sum((sign * u for u, _ in x), a), sum((sign * v for _, v in x), b)


def to_utm(df: DataFrame, lon: str, lat: str, epsg: int, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with plane coordinates of longitude and latitude in degrees; null stays null."""
    middle, false = _zone(epsg)
    phi, lam = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double") - middle)
    conformal = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    df = df.withColumns({"_t": conformal, "_l": lam})
    df = df.withColumns({"_a": F.atan2(F.col("_t"), F.cos("_l")), "_b": F.asinh(F.sin("_l") / F.sqrt(F.col("_t") * F.col("_t") + F.cos("_l") * F.cos("_l")))})
    a, b = _series(_TO_PLANE, F.col("_a"), F.col("_b"), 1)
    df = df.withColumns({"_x": EAST + SCALE * _RADIUS * b, "_y": false + SCALE * _RADIUS * a}).drop("_t", "_l", "_a", "_b", *{x, y} & set(df.columns))
    return df.withColumnsRenamed({"_x": x, "_y": y})


def from_utm(df: DataFrame, x: str, y: str, epsg: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with longitude and latitude in degrees of plane coordinates; null stays null."""
    middle, false = _zone(epsg)
    df = df.withColumns({"_a": (F.col(y).cast("double") - false) / (SCALE * _RADIUS), "_b": (F.col(x).cast("double") - EAST) / (SCALE * _RADIUS)})
    a, b = _series(_FROM_PLANE, F.col("_a"), F.col("_b"), -1)
    df = df.withColumns({"_p": a, "_q": b})
    df = df.withColumns({"_s": F.sin("_p") / F.sqrt(F.sinh("_q") * F.sinh("_q") + F.cos("_p") * F.cos("_p")), "_l": F.atan2(F.sinh("_q"), F.cos("_p"))}).withColumn("_g", F.col("_s"))
    # The conformal latitude's tangent back to the geodetic one: Newton steps, each squares the error.
    for _ in range(3):
        t, e2 = F.col("_g"), _E * _E
        root = F.sqrt(1 + t * t)
        sigma = F.sinh(_E * F.atanh(_E * t / root))
        now = t * F.sqrt(1 + sigma * sigma) - sigma * root
        step = (F.col("_s") - now) / F.sqrt(1 + now * now) * (1 + (1 - e2) * t * t) / ((1 - e2) * root)
        df = df.withColumn("_g2", t + step).drop("_g").withColumnRenamed("_g2", "_g")
    df = df.withColumns({"_lon": F.degrees("_l") + middle, "_lat": F.degrees(F.atan("_g"))}).drop("_a", "_b", "_p", "_q", "_s", "_l", "_g", *{lon, lat} & set(df.columns))
    return df.withColumnsRenamed({"_lon": lon, "_lat": lat})


def grid_cells(df: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """``df(r, c, ...)`` with the cells' middles x and y."""
    return df.withColumns({"x": left + (F.col("c") + 0.5) * size, "y": top - (F.col("r") + 0.5) * size})


def resample(source: DataFrame, targets: DataFrame, left: float, top: float, width: float, height: float, method: str) -> DataFrame:
    """``targets(lon, lat, ...)`` with ``v`` of a grid ``source(r, c, v)`` whose cells are ``width`` by ``height`` from
    ``left`` and ``top``: of the cell they lie in (``nearest``) or the four around, by their distance (``bilinear``).

    Missing cells have no row or a null; the rest of the four then shares their weight, and a target without any is null.
    Each target meets four cells by their numbers, so neither grid is held in one place.
    """
    known = source.filter("v is not null").select("r", "c", F.col("v").cast("double").alias("v"))
    at = {"_c": (F.col("lon") - left) / width, "_r": (F.lit(top) - F.col("lat")) / height}
    x = targets.drop("v").withColumn("_id", F.monotonically_increasing_id()).withColumns(at)
    if method == "nearest":
        return x.withColumns({"r_": F.floor("_r"), "c_": F.floor("_c")}).join(known.toDF("r_", "c_", "v"), ["r_", "c_"], "left").drop("r_", "c_", "_r", "_c", "_id")
    if method != "bilinear":
        raise ValueError(method)
    x = x.withColumns({"_r": F.col("_r") - 0.5, "_c": F.col("_c") - 0.5})
    fr, fc = F.col("_r") - F.floor("_r"), F.col("_c") - F.floor("_c")
    four = [F.struct((F.floor("_r") + i).alias("r_"), (F.floor("_c") + j).alias("c_"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)]
    near = x.select(F.struct(*[c for c in x.columns if c not in ("_r", "_c")]).alias("row"), F.inline(F.array(*four)))
    met = near.join(known.toDF("r_", "c_", "v"), ["r_", "c_"], "left")
    weight = F.when(F.col("v").isNotNull(), F.col("w"))
    out = met.groupBy("row").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(weight)).alias("v"))
    return out.select("row.*", "v").drop("_id")
