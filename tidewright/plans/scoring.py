"""Catalogue, second part: levels by day, rank bins, resampled intervals, fitted models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import raster
from ..sources import tables as t
from .catalog import _DAYS, _SCORED, _SUSC, banded, day_states, query, r6, scored, susceptibility

# Degrees an hour of the tidal constituents M2, S2, N2, K1, O1.
SPEEDS = (28.9841042, 30.0, 28.4397295, 15.0410686, 13.9430356)
# Cumulative Poisson(1) probabilities.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
REPLICATES = 100

_LEVELS = f"""{_DAYS}, {_SUSC}, b as (select *, row_number() over (order by s_rain desc, s_model desc, route_id) as rn, count(*) over () as n from susc),
 c as (select case when rn <= greatest(1, ceil(n * 0.05::double)) then 2 when rn <= greatest(1, ceil(n * 0.20::double)) then 1 else 0 end as band, count(*) as k from b group by 1),
 x as (select date, k, case state when 2 then band when 1 then greatest(0, band - 1) else 0 end as level from st, c)"""


def day_levels(s, d):
    """(date, state, level, k): routes by level and day, from three band counts rather than from routes."""
    b = banded(susceptibility(s, d), "s_rain", "s_model", "route_id").groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    x = day_states(s, d).crossJoin(F.broadcast(b))  # three rows
    level = F.when(F.col("state") == 2, F.col("band")).when(F.col("state") == 1, F.greatest(F.lit(0), F.col("band") - 1)).otherwise(0)
    return x.select("date", "state", level.cast("int").alias("level"), "k")


@query(f"with {_LEVELS} select date, level::integer as level, sum(k)::bigint as n from x group by 1, 2")
def q_level_matrix(s, d):
    return day_levels(s, d).groupBy("date", "level").agg(F.sum("k").alias("n"))


@query(f"""with {_LEVELS}, kind as (select ts::date as date, sum((event_type = 'purchase')::int) as official, sum((event_type = 'error')::int) as dry from events group by 1),
 y as (select x.date, sum(k) as n, sum(case when level >= 1 then k else 0 end) as hit from x group by 1),
 z as (select y.*, case when official > dry then 'flood' when state >= 1 then 'rain_no_report' else 'dry' end as day_type from y join kind using (date) join st using (date))
 select day_type, count(*) as days, sum(hit)::bigint as hit, sum(n)::bigint as n from z group by 1""")
def q_burden(s, d):
    """Alerted routes by the type of the day: reported, rainy without reports, dry."""
    kind = t.table(s, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("official"), F.count_if(F.col("event_type") == "error").alias("dry")
    )
    hit = F.sum(F.when(F.col("level") >= 1, F.col("k")).otherwise(0))
    days = day_levels(s, d).groupBy("date", "state").agg(F.sum("k").alias("n"), hit.alias("hit")).join(kind, "date")
    day_type = F.when(F.col("official") > F.col("dry"), "flood").when(F.col("state") >= 1, "rain_no_report").otherwise("dry")
    return days.groupBy(day_type.alias("day_type")).agg(F.count(F.lit(1)).alias("days"), F.sum("hit").alias("hit"), F.sum("n").alias("n"))


@query("""with x as (select l_partkey, l_extendedprice, row_number() over (partition by l_partkey order by l_extendedprice) as rn, count(*) over (partition by l_partkey) as n from lineitem)
 select l_partkey, l_extendedprice from x where rn <= greatest(1, ceil(n * 0.2::double))""")
def q_lowest20(s, d):
    w = Window.partitionBy("l_partkey")
    x = t.table(s, d, "lineitem").select("l_partkey", "l_extendedprice", F.row_number().over(w.orderBy("l_extendedprice")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return x.filter(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.2)))).select("l_partkey", "l_extendedprice")


_BINS = f"""x as ({_SCORED}), r as (select *, row_number() over (order by score desc, doc_id) as rn, count(*) over () as n from x),
 b as (select *, greatest(0, ceil((rn - 1) * 10 / (n - 1)::double) - 1)::bigint as bin from r)"""


def deciles(s, d):
    rows = stats.row_ranks(scored(s, d), "score", F.col("doc_id"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("bin", stats.rank_bins(F.col("rn"), F.col("n"), 10).cast("long"))


@query(f"with {_BINS} select bin, count(*) as n, sum(quality)::bigint as pos from b group by 1")
def q_qcut_bins(s, d):
    return deciles(s, d).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("pos"))


@query(f"""with {_BINS}, m as (select *, row_number() over (partition by bin order by doc_id * 37 % 101 desc, doc_id) as place, count(*) over (partition by bin) as size from b)
 select bin, sum(quality)::bigint as pos, sum(case when place <= greatest(1, ceil(size * 0.1::double)) then quality else 0 end)::bigint as hits from m group by 1""")
def q_prop_recall(s, d):
    """Hits in the top tenth of each exposure decile."""
    b = deciles(s, d).withColumn("order", F.col("doc_id") * 37 % 101)
    counts = F.broadcast(b.groupBy("bin").agg(F.count(F.lit(1)).alias("size")))  # ten rows
    x = stats.row_ranks(b, "order", F.col("doc_id"), out="at", keys=("bin",)).join(counts, "bin")
    top = F.col("at") <= F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(0.1)))
    return x.groupBy("bin").agg(F.sum("quality").cast("long").alias("pos"), F.sum(F.when(top, F.col("quality")).otherwise(0)).cast("long").alias("hits"))


@query("""with g as (select l_partkey % 40 as r, l_suppkey % 40 as c, avg(case when l_discount >= 0.05 then 1.0::double else 0.0::double end) as v from lineitem group by 1, 2)
 select a.r, a.c, round(avg(b.v), 6) as fraction, count(*) as n from g a join g b on abs(a.r - b.r) <= 2 and abs(a.c - b.c) <= 2 group by 1, 2""")
def q_boxsum_fraction(s, d):
    hit = F.avg(F.when(F.col("l_discount") >= 0.05, F.lit(1.0)).otherwise(F.lit(0.0)))
    x = t.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("r"), (F.col("l_suppkey") % 40).alias("c")).agg(hit.alias("v"))
    return raster.box_mean(x, 2).select("r", "c", r6("mean").alias("fraction"), "n")


@query("""with r as (select p_partkey, (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double) / count(*) over () as a,
 (rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0::double) / count(*) over () as b from part)
 select p_partkey, round((a + b) / 2, 6) as score from r""")
def q_rank_ensemble(s, d):
    x = t.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")
    x = stats.percent_rank(stats.percent_rank(x, "p_size", "a"), "p_retailprice", "b")
    return x.select("p_partkey", r6((F.col("a") + F.col("b")) / 2).alias("score"))


_WEIGHT = " + ".join(f"(u >= {int(p * 2**32)})::int" for p in POISSON)


@query(f"""with x as (select doc_id, quality, unnest(range({REPLICATES})) as rep from labels),
 y as (select rep, quality, ('0x' || substr(md5(doc_id || '-' || rep), 1, 8))::bigint as u from x),
 z as (select rep, sum(quality * ({_WEIGHT}))::double / sum({_WEIGHT}) as share from y group by 1)
 select round(quantile_cont(share, 0.025), 6) as low, round(quantile_cont(share, 0.975), 6) as high, count(*) as replicates from z""")
def q_bootstrap_ci(s, d):
    """Poisson bootstrap: weights hash from row and replicate, so replicates need no resampled tables."""
    x = t.table(s, d, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("rep"))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", "doc_id", "rep").cast("binary")), 1, 8), 16, 10).cast("long")
    x = x.withColumn("u", u)
    w = sum((F.when(F.col("u") >= int(p * 2**32), 1).otherwise(0) for p in POISSON), F.lit(0))
    z = x.groupBy("rep").agg((F.sum(F.col("quality") * w).cast("double") / F.sum(w)).alias("share"))
    return z.agg(r6(F.percentile("share", 0.025)).alias("low"), r6(F.percentile("share", 0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


@query()
def q_lr_scores(s, d):
    """Ridge-regularised logistic regression over all vectors: is the label at least 5?"""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = t.table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), (F.col("label") >= 5).cast("double").alias("label"))
    model = LogisticRegression(regParam=0.01, maxIter=100).fit(x)
    return model.transform(x).select("vec_id", r6(vector_to_array("probability")[1]).alias("score"))


@query(f"""with x as ({_SCORED}), g as (select score, avg(quality) as y, count(*) as w from x group by 1), c as (select score, sum(y * w) over (order by score) as sy, sum(w) over (order by score) as sw, y, w from g),
 ab as (select a.score as a, b.score as b, (b.sy - a.sy + a.y * a.w) / (b.sw - a.sw + a.w) as m from c a join c b on b.score >= a.score), k as (select g.score, ab.a, min(ab.m) as m from g join ab on ab.a <= g.score and ab.b >= g.score group by 1, 2)
 select score::double as score, round(max(m), 6) as fitted from k group by 1""")
def q_isotonic(s, d):
    """Non-decreasing positive share by score; equal scores pool first, so the fit sees distinct scores only."""
    from pyspark.ml.regression import IsotonicRegression

    by = scored(s, d).groupBy(F.col("score").cast("double").alias("score")).agg(F.avg("quality").alias("share"), F.count(F.lit(1)).cast("double").alias("n"))
    model = IsotonicRegression(featuresCol="score", labelCol="share", weightCol="n").fit(by)
    return model.transform(by).select("score", r6("prediction").alias("fitted"))


def harmonic_fit(df, hour: str, value: str):
    """Least squares of ``value`` on a constant and the constituents; the sums of one aggregate (11 x 11) are solved here."""
    terms = [F.lit(1.0)]
    for v in SPEEDS:
        terms += [F.cos(F.col(hour) * math.radians(v)), F.sin(F.col(hour) * math.radians(v))]
    k = len(terms)
    x = df.filter(F.col(value).isNotNull() & F.col(hour).isNotNull()).select(F.col(value).alias("y"), *[c.alias(f"t{i}") for i, c in enumerate(terms)])
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    row = x.agg(*sums, *[F.sum(F.col(f"t{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    coef = np.linalg.lstsq(a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)[0]
    return coef, sum((c * float(w) for c, w in zip(terms[1:], coef[1:], strict=True)), F.lit(float(coef[0])))


@query()
def q_tide_fit(s, d):
    """Hourly totals and their harmonic reconstruction."""
    hours = t.hourly(s, d).groupBy("hour").agg(F.sum("mm").alias("level"))
    at = (F.unix_timestamp(F.col("hour").cast("timestamp")) - F.lit(1704067200)) / 3600.0
    x = hours.withColumn("h", at)
    return x.select("hour", r6("level").alias("level"), r6(harmonic_fit(x, "h", "level")[1]).alias("fitted"))
