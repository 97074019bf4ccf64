"""Harmonic analysis of sea level: astronomical arguments, nodal corrections, choice of constituents, fit, prediction.

Arguments and corrections are columns of the time, so a fit is one pass that sums a normal matrix of fixed size, and a
prediction is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mean longitudes in degrees at 1899-12-31 12:00 UT, degrees a day, and per (10,000 days)^2 and ^3:
# moon, sun, lunar perigee, negative lunar node, solar perigee.
LONGITUDES = {
    "s": (270.434164, 13.1763965268, -0.0000850, 0.000000039),
    "h": (279.696678, 0.9856473354, 0.00002267, 0.0),
    "p": (334.329556, 0.1114040803, -0.0007739, -0.00000026),
    "n": (-259.183275, 0.0529539222, -0.0001557, -0.000000050),
    "q": (281.220844, 0.0000470684, 0.0000339, 0.000000070),
}
#: 1970-01-01 in days after the epoch of the longitudes.
UNIX_EPOCH = 25567.5

# Nodal corrections by the longitude N of the lunar node; f = c0 + c1 cos N + c2 cos 2N + c3 cos 3N,
# u = s1 sin N + s2 sin 2N + s3 sin 3N in degrees.
NODAL = {
    "Mm": ((1.0000, -0.1300, 0.0013, 0.0), (0.0, 0.0, 0.0)),
    "Mf": ((1.0429, 0.4135, -0.0040, 0.0), (-23.74, 2.68, -0.38)),
    "O1": ((1.0089, 0.1871, -0.0147, 0.0014), (10.80, -1.34, 0.19)),
    "K1": ((1.0060, 0.1150, -0.0088, 0.0006), (-8.86, 0.68, -0.07)),
    "J1": ((1.0129, 0.1676, -0.0170, 0.0016), (-12.94, 1.34, -0.19)),
    "OO1": ((1.1027, 0.6504, 0.0317, -0.0014), (-36.68, 4.02, -0.57)),
    "M2": ((1.0004, -0.0373, 0.0002, 0.0), (-2.14, 0.0, 0.0)),
    "K2": ((1.0241, 0.2863, 0.0083, -0.0015), (-17.74, 0.68, -0.04)),
}


@dataclass(frozen=True)
class Constituent:
    """Multiples of lunar time, s, h, p, n and q, a phase in cycles, and the nodal corrections it takes (name: power)."""

    name: str
    numbers: tuple[int, ...]
    phase: float
    nodal: tuple[tuple[str, float], ...] = ()

    @property
    def frequency(self) -> float:
        """Cycles an hour."""
        s, h, p, n, q = (v[1] / 360 for v in LONGITUDES.values())
        return sum(k * r for k, r in zip(self.numbers, (1 + h - s, s, h, p, n, q), strict=True)) / 24


def _c(name: str, numbers: str, phase: float, **nodal: float) -> Constituent:
    return Constituent(name, tuple(map(int, numbers.split())), phase, tuple(nodal.items()))


#: Constituents, those that matter most first.
CONSTITUENTS = [
    _c("M2", "2 0 0 0 0 0", 0.0, M2=1), _c("K1", "1 1 0 0 0 0", -0.75, K1=1), _c("S2", "2 2 -2 0 0 0", 0.0),
    _c("O1", "1 -1 0 0 0 0", -0.25, O1=1), _c("P1", "1 1 -2 0 0 0", -0.25), _c("N2", "2 -1 0 1 0 0", 0.0, M2=1),
    _c("Mf", "0 2 0 0 0 0", 0.0, Mf=1), _c("K2", "2 2 0 0 0 0", 0.0, K2=1), _c("Mm", "0 1 0 -1 0 0", 0.0, Mm=1),
    _c("Ssa", "0 0 2 0 0 0", 0.0), _c("Q1", "1 -2 0 1 0 0", -0.25, O1=1), _c("NU2", "2 -1 2 -1 0 0", 0.0, M2=1),
    _c("J1", "1 2 0 -1 0 0", -0.75, J1=1), _c("NO1", "1 0 0 1 0 0", -0.75, O1=1), _c("MU2", "2 -2 2 0 0 0", 0.0, M2=1),
    _c("L2", "2 1 0 -1 0 0", -0.5, M2=1), _c("T2", "2 2 -3 0 0 1", 0.0), _c("2N2", "2 -2 0 2 0 0", 0.0, M2=1),
    _c("OO1", "1 3 0 0 0 0", -0.75, OO1=1), _c("Sa", "0 0 1 0 0 -1", 0.0), _c("RHO1", "1 -2 2 -1 0 0", -0.25, O1=1),
    _c("2Q1", "1 -3 0 2 0 0", -0.25, O1=1), _c("SIG1", "1 -3 2 0 0 0", -0.25, O1=1), _c("LDA2", "2 1 -2 1 0 0", -0.5, M2=1),
    _c("MSF", "0 2 -2 0 0 0", 0.0, M2=1), _c("S1", "1 1 -1 0 0 1", -0.75), _c("PI1", "1 1 -3 0 0 1", -0.25),
    _c("M4", "4 0 0 0 0 0", 0.0, M2=2), _c("MS4", "4 2 -2 0 0 0", 0.0, M2=1), _c("MN4", "4 -1 0 1 0 0", 0.0, M2=2),
    _c("M3", "3 0 0 0 0 0", -0.5, M2=1.5), _c("MO3", "3 -1 0 0 0 0", -0.25, M2=1, O1=1), _c("MK3", "3 1 0 0 0 0", -0.75, M2=1, K1=1),
    _c("SK3", "3 3 -2 0 0 0", -0.75, K1=1), _c("MK4", "4 2 0 0 0 0", 0.0, M2=1, K2=1), _c("S4", "4 4 -4 0 0 0", 0.0),
    _c("M6", "6 0 0 0 0 0", 0.0, M2=3), _c("2MS6", "6 2 -2 0 0 0", 0.0, M2=2), _c("2SM6", "6 4 -4 0 0 0", 0.0, M2=1), _c("M8", "8 0 0 0 0 0", 0.0, M2=4),
]


def chosen(hours: float, rayleigh: float = 1.0) -> list[Constituent]:
    """Constituents that a record of so many hours tells apart: each, by importance, that is ``rayleigh`` cycles over the
    record away from the mean and from all chosen before."""
    found: list[Constituent] = []
    for c in CONSTITUENTS:
        if all(abs(c.frequency - f) * hours >= rayleigh for f in (0.0, *(k.frequency for k in found))):
            found.append(c)
    return found


def _angles(df: DataFrame, time: str) -> DataFrame:
    """``df`` with cycles of lunar time and the five longitudes, and f and u of every nodal correction."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    df = df.withColumn("_d", seconds / 86400.0 + UNIX_EPOCH)
    e = F.col("_d") / 10000.0
    df = df.withColumns({f"_{k}": (a + b * F.col("_d") + c * e * e + g * e * e * e) / 360.0 for k, (a, b, c, g) in LONGITUDES.items()})
    df = df.withColumn("_t", F.pmod(seconds / 86400.0, F.lit(1.0)) + F.col("_h") - F.col("_s")).withColumn("_node", -2 * math.pi * F.col("_n"))
    turn = lambda k, f: f(k * F.col("_node"))
    df = df.withColumns({f"_f{k}": sum((w * turn(i + 1, F.cos) for i, w in enumerate(f[1:])), F.lit(f[0])) for k, (f, _) in NODAL.items()})
    return df.withColumns({f"_u{k}": sum((w / 360.0 * turn(i + 1, F.sin) for i, w in enumerate(u)), F.lit(0.0)) for k, (_, u) in NODAL.items()})


def factor(c: Constituent) -> Column:
    out = F.lit(1.0)
    for k, power in c.nodal:
        out = out * (F.col(f"_f{k}") if power == 1 else F.pow(F.col(f"_f{k}"), F.lit(float(power))))
    return out


def angle(c: Constituent) -> Column:
    """Argument with its nodal part, in cycles."""
    parts = [k * F.col(f"_{n}") for k, n in zip(c.numbers, "tshpnq", strict=True) if k]
    return sum(parts + [power * F.col(f"_u{k}") for k, power in c.nodal], F.lit(c.phase))


def arguments(df: DataFrame, time: str, which: list[Constituent]) -> DataFrame:
    """``df`` with ``f_NAME`` and ``v_NAME``: nodal factor, and argument in radians, at the UTC ``time``."""
    x = _angles(df, time)
    wave = {f"f_{c.name}": factor(c) for c in which} | {f"v_{c.name}": 2 * math.pi * angle(c) for c in which}
    return x.select(*df.columns, *[v.alias(k) for k, v in wave.items()])


def _design(df: DataFrame, time: str, which: list[Constituent], *keep: str) -> DataFrame:
    x = arguments(df.select(time, *keep), time, which)
    waves = [w for c in which for w in (F.col(f"f_{c.name}") * F.cos(f"v_{c.name}"), F.col(f"f_{c.name}") * F.sin(f"v_{c.name}"))]
    return x.select(*keep, F.array(F.lit(1.0), *waves).alias("x"))


def _sums(wide: int):
    """Normal matrix of (y, x) rows with y as the last column, row by row; one matrix a task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide + 1, wide + 1))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack((b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), wide), y))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return go


@dataclass
class Tide:
    """A fit: the mean level and, of each constituent, the cosine's and the sine's amount."""

    which: list[Constituent]
    mean: float
    cos: list[float]
    sin: list[float]

    def heights(self, df: DataFrame, time: str, out: str) -> DataFrame:
        """``df`` with the predicted level."""
        x = arguments(df, time, self.which)
        z = F.lit(self.mean)
        for c, a, b in zip(self.which, self.cos, self.sin, strict=True):
            z = z + F.col(f"f_{c.name}") * (a * F.cos(f"v_{c.name}") + b * F.sin(f"v_{c.name}"))
        return x.withColumn(out, z).select(*df.columns, out)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, amplitude, phase): phase lags in degrees behind the argument at Greenwich."""
        rows = [(c.name, math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360) for c, a, b in zip(self.which, self.cos, self.sin, strict=True)]
        return spark.createDataFrame(rows, "name string, amplitude double, phase double")


def fit(df: DataFrame, time: str, level: str, rayleigh: float = 1.0, which: list[Constituent] | None = None) -> Tide:
    """Least squares over all rows with time and level; constituents by the length of the record unless given."""
    known = df.filter(F.col(time).isNotNull() & F.col(level).isNotNull() & ~F.isnan(F.col(level).cast("double")))
    known = known.select(F.col(time), F.col(level).cast("double").alias(level))
    if which is None:
        at = F.unix_micros(F.col(time).cast("timestamp"))
        hours = known.agg((F.max(at) - F.min(at)) / F.lit(3.6e9)).first()[0]
        which = chosen(hours or 0.0, rayleigh)
    wide = 1 + 2 * len(which)
    parts = _design(known, time, which, level).mapInArrow(_sums(wide), "i int, row array<double>")
    each = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    a = np.zeros((wide + 1, wide + 1))
    for r in each.collect():  # a matrix as wide as the constituents
        a[r["i"], r["j"]] = r["v"]
    w = np.linalg.lstsq(a[:wide, :wide], a[:wide, wide], rcond=None)[0]
    return Tide(which, float(w[0]), [float(v) for v in w[1::2]], [float(v) for v in w[2::2]])


def hours_of(spark: SparkSession, start: str, end: str, zone: str) -> DataFrame:
    """(time, date): every hour of the days start .. end of a time zone, as UTC, and its local day."""
    days = spark.sql(f"select explode(sequence(date '{start}', date '{end}')) as date")
    local = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))
    x = days.repartition("date").select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")).select("date", local.alias("t"))
    return x.select(F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("t")).alias("time"), "date")


def daily(hourly: DataFrame, observed: DataFrame) -> DataFrame:
    """``hourly(date, astro_m)`` and ``observed(date, level)`` to a day's highest and lowest tide, the highest of three days
    (none before all three are there), the highest observed level, and the tide less it."""
    day = hourly.groupBy("date").agg(F.max("astro_m").alias("astro_daily_max_m"), F.min("astro_m").alias("astro_daily_min_m"))
    later = day.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "date", "astro_daily_max_m").select(F.date_add("date", F.col("k")).alias("date"), "astro_daily_max_m")
    three = later.groupBy("date").agg(F.when(F.count(F.lit(1)) == 3, F.max("astro_daily_max_m")).alias("astro_max_3d_m"))
    top = observed.filter("level is not null").groupBy("date").agg(F.max("level").alias("observed_daily_max_m"))
    out = day.join(three, "date", "left").join(top, "date", "left")
    return out.withColumn("astro_vs_observed_residual_m", F.col("astro_daily_max_m") - F.col("observed_daily_max_m"))
