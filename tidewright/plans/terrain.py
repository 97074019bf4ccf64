"""Catalogue, sixth part: terrain grids, focal statistics, sampling of grids by routes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import kernels, raster
from ..sources import tables as t
from .catalog import query, r6

_DEM = "select (l_partkey % 2)::bigint as grid, (l_partkey % 30)::bigint as r, (l_suppkey % 30)::bigint as c, round(avg(l_quantity), 3) as v from lineitem where l_suppkey % 31 <> 7 group by 1, 2, 3"


def dem(s, d):
    """Two grids of 30 x 30 cells with holes."""
    x = t.table(s, d, "lineitem").filter("l_suppkey % 31 <> 7")
    return x.groupBy((F.col("l_partkey") % 2).alias("grid"), (F.col("l_partkey") % 30).alias("r"), (F.col("l_suppkey") % 30).alias("c")).agg(F.round(F.avg("l_quantity"), 3).alias("v"))


_NEAR = "a.grid = b.grid and abs(a.r - b.r) <= {n} and abs(a.c - b.c) <= {n}"


@query(f"""with g as ({_DEM}) select a.grid, a.r, a.c, round(avg(b.v), 6) as focal_mean, round(min(b.v), 6) as focal_min, round(any_value(a.v) - avg(b.v), 6) as relative from g a join g b on {_NEAR.format(n=3)} group by 1, 2, 3""")
def q_focal_stats(s, d):
    """Mean and least value of the square around each cell, and the height over that mean: a pass down, then across."""
    return raster.focal(dem(s, d), 3).select("grid", "r", "c", r6("mean").alias("focal_mean"), r6("least").alias("focal_min"), r6(F.col("v") - F.col("mean")).alias("relative"))


@query(f"""with g as ({_DEM}), lim as (select grid, min(v) as lo, max(v) as hi from g group by 1), b as (select g.*, lo, hi, least(63, floor((v - lo) / (hi - lo) * 64)) as bin from g join lim using (grid)),
 k as (select *, lo + (bin + 1) * (hi - lo) / 64 as cut from b) select a.grid, a.r, a.c, round(avg((b.v <= a.cut)::int), 6) as local_percentile from k a join g b on {_NEAR.format(n=5)} group by 1, 2, 3""")
def q_local_percentile(s, d):
    """Share of the cells around that lie no higher than a cell's own bin: levels counted down, then across."""
    return raster.local_share(dem(s, d), 5, 64).select("grid", "r", "c", r6("share").alias("local_percentile"))


@query(f"""with g as ({_DEM}), w as (select * from g where v < 22), p as (select a.grid, a.r, a.c, a.v, b.v as wv, b.r as br, b.c as bc, (a.r - b.r) ** 2 + (a.c - b.c) ** 2 as d2 from g a join w b on a.grid = b.grid),
 m as (select grid, r, c, min(struct_pack(d2 := d2, br := br, bc := bc)) as m, any_value(v) as v from p group by 1, 2, 3)
 select m.grid, m.r, m.c, round(sqrt(m.m.d2) * 30, 6) as dist, round(m.v - w.v, 6) as hand from m join w on w.grid = m.grid and w.r = m.m.br and w.c = m.m.bc""")
def q_above_water(s, d):
    """Distance to the nearest water cell and the height above it."""
    x = kernels.above_nearest(dem(s, d).withColumn("water", (F.col("v") < 22).cast("int")))
    return x.select("grid", "r", "c", r6("dist").alias("dist"), r6("hand").alias("hand"))


_SOLID = "select 0::bigint as grid, (l_partkey % 20)::bigint as r, (l_suppkey % 20)::bigint as c, round(avg(l_extendedprice), 3) as v from lineitem where l_partkey % 20 < 20 group by 1, 2, 3"


@query(f"""with g as ({_SOLID}), e as (select *, min(r) over () as r0, max(r) over () as r1, min(c) over () as c0, max(c) over () as c1 from g),
 n as (select *, lag(v) over rr as up, lead(v) over rr as down, lag(v) over cc as lf, lead(v) over cc as rt from e window rr as (partition by grid, c order by r), cc as (partition by grid, r order by c))
 select grid, r, c, round(sqrt(((coalesce(rt, v) - coalesce(lf, v)) / (30 * ((rt is not null)::int + (lf is not null)::int))) ** 2 + ((coalesce(down, v) - coalesce(up, v)) / (30 * ((down is not null)::int + (up is not null)::int))) ** 2), 6) as slope from n""")
def q_slope(s, d):
    """Slope by neighbours only: lags along rows and columns, no Python.  Needs a grid without holes."""
    x = t.table(s, d, "lineitem").groupBy(F.lit(0).cast("long").alias("grid"), (F.col("l_partkey") % 20).alias("r"), (F.col("l_suppkey") % 20).alias("c")).agg(F.round(F.avg("l_extendedprice"), 3).alias("v"))
    return raster.neighbour_slope(x, 30.0).select("grid", "r", "c", r6("slope").alias("slope"))


@query()
def q_fill_depth(s, d):
    """How deep water would stand in each cell before it runs off."""
    return kernels.apply(dem(s, d), "fill_depth").select("grid", "r", "c", r6("fill_depth").alias("fill_depth"))


@query()
def q_flow_wetness(s, d):
    """Logarithm of the drained cells, and the wetness index."""
    x = kernels.apply(dem(s, d), "flow_log", "twi")
    return x.select("grid", "r", "c", r6("flow_log").alias("flow_log"), r6("twi").alias("twi"))


@query(f"""with g as ({_DEM}), b as (select 0 as r0, 29 as r1, 0 as c0, 29 as c1), hit as (select grid, r, c, (v >= 25)::int as h from g)
 select p_partkey, round(sum(h)::double / ((least(p_partkey % 30 + 4, 29) - greatest(p_partkey % 30 - 4, 0) + 1) * (least(p_size % 30 + 4, 29) - greatest(p_size % 30 - 4, 0) + 1)), 6) as share from part
 left join hit on grid = 0 and r between p_partkey % 30 - 4 and p_partkey % 30 + 4 and c between p_size % 30 - 4 and p_size % 30 + 4 group by p_partkey, p_size""")
def q_window_share(s, d):
    """Share of a class in the square around each point, from an integral image: four look-ups a point."""
    hit = dem(s, d).filter("grid = 0").select("r", "c", (F.col("v") >= 25).cast("long").alias("h"))
    table = raster.integral(hit, "h", 30, 30)
    p = t.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 30).alias("r"), (F.col("p_size") % 30).cast("long").alias("c"))
    return raster.window_share(p, table, 4, 30, 30).select("p_partkey", r6("share").alias("share"))


@query(f"""with g as ({_DEM}), p as (select vec_id, unnest(range(1, 9)) as i, embedding from embeddings), q as (select vec_id, floor(15 + embedding[i]::double * 40)::bigint as c, floor(15 - embedding[i + 8]::double * 40)::bigint as r from p)
 select vec_id, count(v) as n, round(min(v), 6) as v_min, round(quantile_cont(v, 0.1), 6) as v_p10, round(avg(v), 6) as v_mean, round(max(v), 6) as v_max, round(max(v) - min(v), 6) as v_range, round(avg((v > 25)::int), 6) as share_above from q left join g on grid = 0 and g.r = q.r and g.c = q.c group by 1""")
def q_route_grid_stats(s, d):
    """Points to cells, cells outside or missing left out; then a route's statistics over its points."""
    i = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    x = t.table(s, d, "embeddings").select("vec_id", "embedding", i)
    x = x.select("vec_id", (F.col("embedding")[F.col("i")].cast("double") * 40).alias("x"), (F.col("embedding")[F.col("i") + 8].cast("double") * 40).alias("y"))
    return raster.sample(x, dem(s, d).filter("grid = 0"), -15.0, 15.0, 1.0).groupBy("vec_id").agg(
        F.count("v").alias("n"), r6(F.min("v")).alias("v_min"), r6(F.percentile("v", 0.1)).alias("v_p10"), r6(F.avg("v")).alias("v_mean"), r6(F.max("v")).alias("v_max"), r6(F.max("v") - F.min("v")).alias("v_range"), r6(F.avg((F.col("v") > 25).cast("int"))).alias("share_above")
    )


_CROSS = "list_transform(range(ceil(least({a}, {b}) / 30)::bigint, floor(greatest({a}, {b}) / 30)::bigint + 1), lambda k: (k * 30.0::double - {a}) / nullif({b} - {a}, 0))"


@query(f"""with s as (select vec_id, unnest(range(0, 31)) as i, embedding::double[] as e from embeddings), l as (select vec_id, i, e[2 * i + 1] * 100 as ax, e[2 * i + 2] * 100 as ay, e[2 * i + 3] * 100 as bx, e[2 * i + 4] * 100 as by_ from s),
 c as (select *, list_sort(list_distinct(list_filter(list_concat([0.0::double, 1.0::double], {_CROSS.format(a="ax", b="bx")}, {_CROSS.format(a="ay", b="by_")}), lambda u: u >= 0 and u <= 1))) as us from l),
 m as (select *, unnest(list_transform(range(1, len(us)), lambda j: (us[j] + us[j + 1]) / 2)) as u from c)
 select distinct vec_id, floor((ay + u * (by_ - ay)) / 30)::bigint as r, floor((ax + u * (bx - ax)) / 30)::bigint as c from m""")
def q_burned_cells(s, d):
    """Cells that a line of 32 points passes, from its exact crossings of the grid's lines."""
    e = lambda i: F.col("embedding")[i].cast("double") * 100
    parts = F.array(*[F.struct(e(2 * i).alias("ax"), e(2 * i + 1).alias("ay"), e(2 * i + 2).alias("bx"), e(2 * i + 3).alias("by")) for i in range(31)])
    x = t.table(s, d, "embeddings").select("vec_id", F.explode(parts).alias("p")).select("vec_id", "p.*")
    return raster.burn(x, 30.0).select("vec_id", "r", "c").distinct()


@query("""with x as (select l_partkey, l_linenumber, l_extendedprice, row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber, l_suppkey) as rn, count(*) over (partition by l_partkey) as n, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) * 15.0::double as along from lineitem),
 k as (select l_partkey, along, case when along - lag(along) over (partition by l_partkey order by along) > 30.01 then 1 else 0 end as gap from x where rn <= greatest(1, ceil(n * 0.2::double))),
 r as (select l_partkey, along, sum(gap) over (partition by l_partkey order by along rows unbounded preceding) as run from k)
 select l_partkey, run::bigint as run, min(along) as from_m, max(along) as to_m, count(*) as points from r group by 1, 2""")
def q_low_stretches(s, d):
    """The lowest fifth of a route's points, joined to stretches where they lie within 30 m."""
    w = Window.partitionBy("l_partkey")
    place = ["l_orderkey", "l_linenumber", "l_suppkey"]
    x = t.table(s, d, "lineitem").select("l_partkey", F.row_number().over(w.orderBy("l_extendedprice", *place)).alias("rn"), F.count(F.lit(1)).over(w).alias("n"), (F.row_number().over(w.orderBy(*place, "l_extendedprice")) * F.lit(15.0)).alias("along"))
    low = x.filter(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.2))))
    gap = (F.col("along") - F.lag("along").over(w.orderBy("along"))) > 30.01
    low = low.withColumn("g", F.coalesce(gap, F.lit(False)).cast("long"))
    low = low.withColumn("run", F.sum("g").over(w.orderBy("along").rowsBetween(Window.unboundedPreceding, 0)))
    return low.groupBy("l_partkey", "run").agg(F.min("along").alias("from_m"), F.max("along").alias("to_m"), F.count(F.lit(1)).alias("points"))
