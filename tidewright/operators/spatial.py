"""Distance joins by grid buckets: a cell is as wide as the radius, so partners lie in the nine cells around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import staged
from . import graph


def distance_join(left: DataFrame, right: DataFrame, radius: float, how: Column | None = None) -> DataFrame:
    """Pairs of left(id, x, y) and right(rid, rx, ry) at most ``radius`` apart, with ``dist``."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    near = F.explode(F.array(*[F.struct((cell("rx") + i).alias("gx"), (cell("ry") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = right.withColumn("_g", near).select(*right.columns, F.col("_g.gx").alias("gx"), F.col("_g.gy").alias("gy"))
    pairs = left.withColumn("gx", cell("x")).withColumn("gy", cell("y")).join(spread.hint("merge"), ["gx", "gy"])  # nine times what Spark takes it for
    dist = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)
    pairs = pairs.withColumn("dist", dist).filter(F.col("dist") <= radius)
    return (pairs.filter(how) if how is not None else pairs).drop("gx", "gy")


def _dist(x: str, y: str, rx: str, ry: str) -> Column:
    return F.sqrt((F.col(x) - F.col(rx)) ** 2 + (F.col(y) - F.col(ry)) ** 2)


def _finite(df: DataFrame) -> DataFrame:
    """Rows with an id and a place; a null, NaN or infinite coordinate is near nothing."""
    real = lambda c: F.abs(F.col(c)) < float("inf")
    return df.filter(F.col("id").isNotNull() & real("x") & real("y"))


#: Most places in a cell of the first search, and the most halvings of the radius for it.
CROWD, HALVINGS = 16, 20


def nearest(points: DataFrame, kind: str, radius: float) -> DataFrame:
    """(id, rid, dist) of points(id, x, y, kind): the nearest point of the same kind and another id at most ``radius``
    away, ties by rid; ids without one have no row.

    The search begins at a radius whose cells hold few places, and doubles it for those that found none.  Such points lie
    apart by the radius before, so a cell has few of them and its rows are met a bounded number of times: no list of all
    pairs.  Copies are one place with its two least ids, as one of them may be the point's own.
    """
    key = ["x", "y", kind]
    rows = staged(_finite(points).filter(F.col(kind).isNotNull()).select("id", *[(F.col(c) + 0.0).alias(c) for c in "xy"], kind), "points")
    least = rows.groupBy(*key).agg(F.min("id").alias("rid"), F.max("id").alias("_most"))
    second = rows.join(least.filter("rid < _most").hint("merge"), key).filter("id > rid").groupBy(*key).agg(F.min("id").alias("other"))
    places = staged(least.drop("_most").join(second.hint("merge"), key, "left").withColumnsRenamed({"x": "rx", "y": "ry"}), "places")
    width = lambda k: radius / 2**k * (1 + 1e-9)  # noqa: E731  a margin over rounding
    cell = lambda c, k: F.floor(F.col(c) / F.lit(width(k)))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), cell("rx", k).alias("gx"), cell("ry", k).alias("gy")) for k in range(HALVINGS + 1)])).alias("c")
    crowd = places.select(kind, level).groupBy(kind, "c").agg(F.count(F.lit(1)).alias("n")).groupBy("c.k").agg(F.max("n").alias("n"))
    first = crowd.filter(F.col("n") <= CROWD).agg(F.min("k")).first()[0]
    found, left = None, rows
    for k in range(HALVINGS if first is None else first, -1, -1):
        around = F.explode(F.array(*[F.struct((cell("x", k) + i).alias("gx"), (cell("y", k) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
        asked = left.select("*", around).select("id", *key, "c.gx", "c.gy")
        near = asked.join(places.withColumn("gx", cell("rx", k)).withColumn("gy", cell("ry", k)).hint("merge"), [kind, "gx", "gy"])
        near = near.withColumn("rid", F.when(F.col("rid") != F.col("id"), F.col("rid")).otherwise(F.col("other"))).withColumn("dist", _dist("x", "y", "rx", "ry"))
        best = near.filter(F.col("rid").isNotNull() & (F.col("dist") <= radius / 2**k)).groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("m"))
        best = staged(best.select("id", "m.rid", "m.dist"), "nearest")
        found = best if found is None else found.unionByName(best)
        if k:
            left = staged(left.join(best.hint("merge"), "id", "left_anti"), "alone")
            if left.isEmpty():
                break
    return found


def match_kinds(points: DataFrame, kind: str, radius: float, far: float) -> DataFrame:
    """Per row of points(id, x, y, kind) what ``best_match`` tells of pairs up to ``radius`` apart, where points of one
    kind are similar: the nearest of the same kind, else the nearest within ``far``, else unmatched."""
    same = staged(nearest(points, kind, radius), "same")
    alone = points.join(same.hint("merge"), "id", "left_anti")
    # Those of one kind lie further apart than the radius, so a cell has few of them.
    pairs = distance_join(_finite(alone).select("id", "x", "y"), _finite(points).select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), min(radius, far), F.col("id") != F.col("rid"))
    other = pairs.groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("m"))
    both = same.withColumn("match_type", F.lit("name+distance")).unionByName(other.select("id", "m.rid", "m.dist", F.lit("distance").alias("match_type")))
    out = points.select("id").join(both.hint("merge"), "id", "left")
    return out.select("id", "rid", F.coalesce("match_type", F.lit("unmatched")).alias("match_type"), "dist")


def best_match(records: DataFrame, pairs: DataFrame, similar: float = 0.55, far: float = 40.0) -> DataFrame:
    """Per record(id): the nearest similar partner, else the nearest within ``far``, else unmatched; ties by rid."""
    rank = F.when(F.col("similarity") >= similar, 0).when(F.col("dist") <= far, 1)
    best = pairs.withColumn("_r", rank).filter("_r is not null").groupBy("id").agg(F.min(F.struct("_r", "dist", "rid")).alias("m"))
    kind = F.when(F.col("m._r") == 0, "name+distance").when(F.col("m._r") == 1, "distance").otherwise("unmatched")
    return records.join(best, "id", "left").select("id", F.col("m.rid").alias("rid"), kind.alias("match_type"), F.col("m.dist").alias("dist"))


def groups_within(points: DataFrame, radius: float) -> DataFrame:
    """points(id, x, y) to (id, comp): groups of points linked where at most ``radius`` apart, named by their least id.

    All points of a cell lie within the radius and follow its least id.  Two cells are linked at once where points at
    their far sides are near; only cells that these links leave in different groups, and whose bounds come near, are
    joined point by point.  Coordinates count up to 1e15 radii.
    """
    width = radius / 1.5
    at = [F.floor(F.col(c) / F.lit(width)).alias(g) for c, g in (("x", "gx"), ("y", "gy"))]
    rows = staged(_finite(points).select("id", *[(F.col(c) + 0.0).alias(c) for c in "xy"]).select("*", *at), "points")
    far = lambda a, b: F.struct((F.col("x") * a + F.col("y") * b).alias("o"), "x", "y")
    ways = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    ends = F.array(*[F.max(far(*w)) for w in ways]).alias("ends")
    bounds = [f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))]
    cells = staged(rows.groupBy("gx", "gy").agg(F.min("id").alias("least"), ends, *bounds), "cells")
    beside = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])).alias("c")
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns], beside).select("*", "c.gx", "c.gy").drop("c")
    pairs = a.join(cells.hint("merge"), ["gx", "gy"])
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"a_{c}1"))
    pairs = pairs.filter(gap("x") ** 2 + gap("y") ** 2 <= radius**2 * (1 + 1e-9))
    near = lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) <= radius
    sure = F.exists("a_ends", lambda p: F.exists("ends", lambda q: near(p, q)))
    pairs = staged(pairs.withColumn("sure", sure).drop("ends", "a_ends"), "pairs")
    links = pairs.filter("sure").select(F.col("a_least").alias("a"), F.col("least").alias("b"))
    comp = graph.components(cells.select(F.col("least").alias("id")), links)
    of = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp")).hint("merge")
    open_ = pairs.filter("not sure").join(of("a_least"), "a_least").join(of("least"), "least").filter("a_least_comp <> least_comp")
    open_ = staged(open_.drop("sure", "a_least_comp", "least_comp"), "open")
    margin = radius * (1 + 1e-9)
    within = lambda p: (F.col("x") >= F.col(f"{p}x0") - margin) & (F.col("x") <= F.col(f"{p}x1") + margin) & (F.col("y") >= F.col(f"{p}y0") - margin) & (F.col("y") <= F.col(f"{p}y1") + margin)
    left = rows.join(open_.drop("gx", "gy").withColumnsRenamed({"a_gx": "gx", "a_gy": "gy"}).hint("merge"), ["gx", "gy"]).filter(within(""))
    right = rows.join(open_.hint("merge"), ["gx", "gy"]).filter(within("a_"))
    key = ["a_least", "least"]
    left, right = left.select(*key, "x", "y").distinct(), right.select(*key, F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    exact = left.join(right.hint("merge"), key).filter(_dist("x", "y", "rx", "ry") <= radius).select(*key).distinct().toDF("a", "b")
    star = rows.join(cells.select("gx", "gy", "least").hint("merge"), ["gx", "gy"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
    return graph.components(points, star.unionByName(links).unionByName(exact))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


#: Search radius in metres, the wider one for named streets and areas, nearest without a name, similarity.
RADIUS, NAMED_RADIUS, NEAR, SIMILAR = 150.0, 500.0, 40.0, 0.55


def match_records(records: DataFrame, routes: DataFrame, similarity: Callable[[Column, Column], Column] = text.name_similarity) -> DataFrame:
    """``records(record_id, raw, location_precision, x, y)`` to ``routes(route_id, name_norm, named, line)``: record_id,
    route_id, match_type, dist.  ``similarity`` compares two normalised names.

    A segment is put into every cell that it crosses, with a margin of the wider radius, so a record meets its cell only.
    """
    ends = routes.select("route_id", "name_norm", "named", F.explode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))).alias("s"))
    ends = ends.select("route_id", "name_norm", "named", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - NAMED_RADIUS) / NAMED_RADIUS), F.floor((F.greatest(a, b) + NAMED_RADIUS) / NAMED_RADIUS))
    ends = ends.withColumn("gx", F.explode(span("ax", "bx"))).withColumn("gy", F.explode(span("ay", "by")))
    name = text.normalize_name(text.road_name(F.coalesce("raw", F.lit(""))))
    wide = F.col("location_precision").isin("street", "area") & (F.col("norm") != "")
    rec = records.withColumn("norm", name).withColumn("radius", F.when(wide, NAMED_RADIUS).otherwise(RADIUS))
    rec = rec.withColumn("gx", F.floor(F.col("x") / NAMED_RADIUS)).withColumn("gy", F.floor(F.col("y") / NAMED_RADIUS))
    dist = point_segment(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    near = rec.join(ends, ["gx", "gy"]).withColumn("dist", dist).filter("dist <= radius")
    near = near.groupBy("record_id", "norm", "route_id", "name_norm", "named").agg(F.min("dist").alias("dist"))
    alike = F.when(F.col("named"), similarity(F.col("norm"), F.col("name_norm"))).otherwise(F.lit(0.0))
    pairs = near.select(F.col("record_id").alias("id"), F.col("route_id").alias("rid"), "dist", alike.alias("similarity"))
    found = best_match(records.select(F.col("record_id").alias("id")), pairs, SIMILAR, NEAR)
    return found.select(F.col("id").alias("record_id"), F.col("rid").alias("route_id"), "match_type", "dist")
