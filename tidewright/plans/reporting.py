"""Catalogue, tenth part: capture by cause with intervals, day types with intervals, finer strata, route statistics of all
grids, reports matched to roads of the given tables, reports that are active."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import raster, sampling, spatial
from ..sources import tables as t
from ..sources.shared import staged
from .catalog import _AT, _SCORED, query, r6, scored
from .decisions import _DAYS_T, _FOLD, kept_reports, labelled_days
from .evaluation import _LONG, _U, _W, REPS
from .terrain import _DEM, dem

METHODS = ("model", "history", "hybrid")


def chosen_routes(s, d):
    """(route_id, fresh, model, history, hybrid): whether each method has a route in its first 5 %; a fresh route has no
    deep record before the cut-off."""
    deep = t.eligible(s, d).filter("l_quantity >= 45").groupBy(F.col("l_partkey").alias("route_id")).agg(F.count(F.lit(1)).alias("seen"))
    x = t.table(s, d, "part").select(F.col("p_partkey").alias("route_id"), F.col("p_retailprice").alias("price")).join(deep, "route_id", "left")
    x = stats.row_ranks(x.withColumn("seen", F.coalesce("seen", F.lit(0))), "price", F.col("route_id"), out="rm")
    x = stats.row_ranks(x, "seen", F.desc("price"), F.col("route_id"), out="rh")
    x = x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n_all"))))
    past = F.when(F.col("seen") > 0, 0.9 + 0.1 * F.least(F.lit(1.0), F.col("seen") / F.lit(3.0))).otherwise(F.lit(0.0))
    x = x.withColumn("hyb", F.greatest(0.9 * (F.col("n_all") - F.col("rm") + 1).cast("double") / (F.col("n_all") + 1).cast("double"), past))
    x = stats.row_ranks(x, "hyb", F.desc("price"), F.col("route_id"), out="ry")
    top = lambda c: (F.col(c) <= F.greatest(F.lit(1), F.ceil(F.col("n_all") * F.lit(0.05)))).cast("int")
    return x.select("route_id", (F.col("seen") == 0).alias("fresh"), top("rm").alias("model"), top("rh").alias("history"), top("ry").alias("hybrid"))


@query(f"""with p as (select p_partkey as route_id, p_retailprice as price, coalesce(n, 0) as seen from part left join (select l_partkey, count(*) as n from lineitem where l_shipdate < timestamp '{t.CUTOFF}' and l_quantity >= 45 group by 1) h on l_partkey = p_partkey),
 r as (select *, row_number() over (order by price desc, route_id) as rm, row_number() over (order by seen desc, price desc, route_id) as rh, count(*) over () as n_all from p),
 q as (select *, greatest(1, ceil(n_all * 0.05::double)) as b, greatest(0.9::double * (n_all - rm + 1)::double / (n_all + 1)::double, case when seen > 0 then 0.9::double + 0.1::double * least(1.0::double, seen / 3.0::double) else 0.0::double end) as hyb from r),
 m as (select route_id, seen = 0 as fresh, (rm <= b)::int as model, (rh <= b)::int as history, (row_number() over (order by hyb desc, price desc, route_id) <= b)::int as hybrid from q),
 e as (select distinct date, cause, route_id from (select l_shipdate::date as date, unnest(case l_returnflag when 'A' then ['rain'] when 'N' then ['tide'] else ['rain', 'tide'] end) as cause, l_partkey as route_id from lineitem where l_shipdate >= timestamp '{t.CUTOFF}')),
 dd as (select date, cause, {", ".join(f"avg({x}) as {x}, avg(case when fresh then {x} end) as {x}_f" for x in METHODS)} from e join m using (route_id) group by 1, 2),
 l as (select date, cause, unnest([{", ".join(f"'{x}'" for x in METHODS)}]) as method, unnest([{", ".join(METHODS)}]) as v, unnest([{", ".join(f"{x}_f" for x in METHODS)}]) as f from dd),
 y as (select *, {_U.format(key="date::varchar")} as u from (select *, unnest(range({REPS})) as rep from l)), w as (select *, {_W} as w from y),
 z as (select cause, method, rep, sum(v * w) / nullif(sum(w), 0) as v, sum(f * w) / nullif(sum(case when f is not null then w end), 0) as f from w group by 1, 2, 3),
 i as (select cause, method, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high, quantile_cont(f, 0.025) as fresh_low, quantile_cont(f, 0.975) as fresh_high from z group by 1, 2),
 o as (select cause, method, count(*) as days, avg(v) as overall, avg(f) as fresh from l group by 1, 2)
 select cause, method, days, round(overall, 6) as overall, round(low, 6) as low, round(high, 6) as high, round(fresh, 6) as fresh, round(fresh_low, 6) as fresh_low, round(fresh_high, 6) as fresh_high from o join i using (cause, method)""")
def q_cause_capture(s, d):
    """Share of a day's reported routes in the first 5 %, by cause and method, over all and over fresh routes, with
    intervals over resampled days; a combined cause counts for both.  Days are as many as the calendar has."""
    rows = t.table(s, d, "lineitem").filter(F.col("l_shipdate") >= F.lit(t.CUTOFF).cast("timestamp_ntz"))
    cause = F.when(F.col("l_returnflag") == "A", F.array(F.lit("rain"))).when(F.col("l_returnflag") == "N", F.array(F.lit("tide"))).otherwise(F.array(F.lit("rain"), F.lit("tide")))
    e = rows.select(F.col("l_shipdate").cast("date").alias("date"), F.explode(cause).alias("cause"), F.col("l_partkey").alias("route_id")).distinct()
    share = [F.struct(F.lit(x).alias("method"), F.avg(x).alias("v"), F.avg(F.when(F.col("fresh"), F.col(x))).alias("f")) for x in METHODS]
    day = e.join(chosen_routes(s, d), "route_id").groupBy("date", "cause").agg(F.array(*share).alias("m"))
    day = staged(day.select("date", "cause", F.explode("m").alias("m")).select("date", "cause", "m.*"), "day-shares")
    w = sampling.weighted(day, F.col("date").cast("string"), REPS)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum(F.when(F.col(c).isNotNull(), F.col("w"))))
    z = w.groupBy("cause", "method", "rep").agg(mean("v").alias("v"), mean("f").alias("f")).groupBy("cause", "method")
    z = z.agg(*[r6(F.percentile(c, q)).alias(n) for c, q, n in (("v", 0.025, "low"), ("v", 0.975, "high"), ("f", 0.025, "fresh_low"), ("f", 0.975, "fresh_high"))])
    return day.groupBy("cause", "method").agg(F.count(F.lit(1)).alias("days"), r6(F.avg("v")).alias("overall"), r6(F.avg("f")).alias("fresh")).join(z, ["cause", "method"])


_TYPES = f"{_DAYS_T}, k as (select date, t, pos, case when pos then 'flood' when neg then 'no_report' else 'other' end as day_type, (t >= 0.45)::int as watch, (t >= 0.5)::int as alert from lab)"


@query(f"""with {_TYPES}, y as (select *, {_U.format(key="date::varchar")} as u from (select *, unnest(range({REPS})) as rep from k)), ww as (select *, {_W} as w from y),
 z as (select day_type, rep, sum(watch * w) / nullif(sum(w), 0)::double as watch, sum(alert * w) / nullif(sum(w), 0)::double as alert from ww group by 1, 2),
 i as (select day_type, quantile_cont(watch, 0.025) as watch_low, quantile_cont(watch, 0.975) as watch_high, quantile_cont(alert, 0.025) as alert_low, quantile_cont(alert, 0.975) as alert_high from z group by 1),
 o as (select day_type, count(*) as days, avg(watch) as watch, avg(alert) as alert from k group by 1)
 select day_type, days, round(watch, 6) as watch, round(watch_low, 6) as watch_low, round(watch_high, 6) as watch_high, round(alert, 6) as alert, round(alert_low, 6) as alert_low, round(alert_high, 6) as alert_high from o join i using (day_type)""")
def q_day_type_intervals(s, d):
    """How often each type of day is in watch or above, and in alert, with intervals over resampled days."""
    kind = F.when(F.col("pos"), "flood").when(F.col("neg"), "no_report").otherwise("other")
    k = staged(labelled_days(s, d).select("date", kind.alias("day_type"), (F.col("t") >= 0.45).cast("int").alias("watch"), (F.col("t") >= 0.5).cast("int").alias("alert")), "day-types")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w").cast("double"))
    z = sampling.weighted(k, F.col("date").cast("string"), REPS).groupBy("day_type", "rep").agg(mean("watch").alias("watch"), mean("alert").alias("alert"))
    ends = [r6(F.percentile(c, q)).alias(f"{c}_{n}") for c in ("watch", "alert") for q, n in ((0.025, "low"), (0.975, "high"))]
    out = k.groupBy("day_type").agg(F.count(F.lit(1)).alias("days"), r6(F.avg("watch")).alias("watch"), r6(F.avg("alert")).alias("alert"))
    return out.join(z.groupBy("day_type").agg(*ends), "day_type")


@query(f"""with {_TYPES}, y as (select *, {_U.format(key="date::varchar")} as u from (select *, unnest(range({REPS})) as rep from k)), ww as (select rep, t, sum(case when pos then {_W} else 0 end) as p, sum(case when pos then 0 else {_W} end) as z from y group by 1, 2),
 b as (select *, sum(z) over (partition by rep order by t) - z / 2.0::double as below from ww), a as (select rep, sum(p * below) / nullif(sum(p) * sum(z), 0) as auc from b group by 1),
 w0 as (select t, sum(pos::int) as p, sum((not pos)::int) as z from k group by 1), b0 as (select *, sum(z) over (order by t) - z / 2.0::double as below from w0)
 select (select round(sum(p * below) / nullif(sum(p) * sum(z), 0), 6) from b0) as auc, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high from a""")
def q_day_auc(s, d):
    """AUC of the trigger over days, with an interval over resampled days; replicate -1 holds every day once."""
    k = staged(labelled_days(s, d).select("date", "t", F.col("pos").cast("int").alias("y")), "days")
    x = sampling.weighted(k, F.col("date").cast("string"), REPS).unionByName(k.withColumns({"rep": F.lit(-1), "w": F.lit(1)}))
    by = x.groupBy("rep", "t").agg(F.sum(F.col("y") * F.col("w")).alias("p"), F.sum((1 - F.col("y")) * F.col("w")).alias("z"))
    b = stats.running(by, "t", {"zc": "z"}, ("rep",)).withColumn("below", F.col("zc") - F.col("z") / F.lit(2.0))
    a = b.groupBy("rep").agg(F.try_divide(F.sum(F.col("p") * F.col("below")), F.sum("p") * F.sum("z")).alias("auc"))
    drawn = F.when(F.col("rep") >= 0, F.col("auc"))
    return a.agg(r6(F.max(F.when(F.col("rep") < 0, F.col("auc")))).alias("auc"), r6(F.percentile(drawn, 0.025)).alias("low"), r6(F.percentile(drawn, 0.975)).alias("high"))


_TERC = "greatest(0, ceil(({rn} - 1) * 3 / (n - 1)::double) - 1)::bigint"
_STRATA = f"x as (select s.*, d.n_chars, row_number() over (order by d.n_chars, doc_id) as rn, row_number() over (order by score, doc_id) as rs, count(*) over () as n from ({_SCORED}) s join documents d using (doc_id)), k as (select *, lang || ':' || {_TERC.format(rn='rn')} as key, lang || '|' || {_TERC.format(rn='rn')} || '|' || {_TERC.format(rn='rs')} as fine from x)"


def strata(s, d):
    """Scored rows with ``key``, the language and the third of the length, and ``fine``, with the third of the score too."""
    x = scored(s, d).join(t.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumns({"_c": -F.col("n_chars"), "_s": -F.col("score")})
    x = stats.row_ranks(stats.row_ranks(x, "_c", F.col("doc_id")), "_s", F.col("doc_id"), out="rs")
    x = x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n_all"))))
    third = lambda c: stats.rank_bins(F.col(c), F.col("n_all"), 3).cast("long").cast("string")
    return x.withColumns({"key": F.concat_ws(":", "lang", third("rn")), "fine": F.concat_ws("|", "lang", third("rn"), third("rs"))})


def _pooled(key: str, label: str, name: str) -> str:
    return f"""{name} as (select sum(hits) filter (where pos > 0 and pos < n) / greatest(1, sum(pos)) as v from (select key, any_value(pos) as pos, any_value(n) as n, sum(p * least(greatest(0.1::double * n - (seen - c), 0), c) / c) as hits from
 (select key, score, p, c, sum(c) over (partition by key order by score desc) as seen, sum(p) over (partition by key) as pos, sum(c) over (partition by key) as n from (select {key} as key, score, sum({label}) as p, count(*) as c from k group by 1, 2)) group by 1))"""


@query(f"with {_STRATA}, {_pooled('key', 'quality', 'a')}, {_pooled('lang', 'toxic', 'b')} select round(a.v, 6) as strat2_recall, round(b.v, 6) as variant_recall from a, b")
def q_strat2_recall(s, d):
    """Recall at a tenth within language and third of the length, and of the other label within languages; a stratum of
    one class has no hits but its positives count."""
    x = strata(s, d)

    def pooled(key, label, out):
        m = stats.group_metrics(x, key, "score", label)
        hits = F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("recall") * F.col("pos"))
        return m.agg(r6(F.sum(hits) / F.greatest(F.lit(1), F.sum("pos"))).alias(out))

    return pooled("key", "quality", "strat2_recall").crossJoin(F.broadcast(pooled("lang", "toxic", "variant_recall")))  # one row each


@query(f"""with {_STRATA}, m as (select fine, greatest(1, sum((quality = 0)::int)) as want from k group by 1 having sum((quality = 0)::int) > 0), c as (select doc_id, fine, row_number() over (partition by fine order by md5(doc_id::varchar || '-5'), doc_id) as place from k where quality = 1)
 select c.doc_id, c.fine from c join m using (fine) where place <= want""")
def q_matched_exposure(s, d):
    """For every stratum of class and two thirds with rare rows, as many others of it by hash."""
    x = strata(s, d).select("doc_id", "fine", (F.col("quality") == 0).alias("rare"))
    return sampling.matched(x, "doc_id", "fine", "rare", 5)


@query(f"""with g as ({_DEM}), p as (select vec_id, unnest(range(1, 33)) as i, embedding from embeddings), q as (select vec_id, floor(15 + embedding[i]::double * 40)::bigint as c, floor(15 - embedding[i + 32]::double * 40)::bigint as r from p)
 select vec_id, grid, count(*) as n, round(min(v), 6) as v_min, round(quantile_cont(v, 0.1), 6) as v_p10, round(avg(v), 9) as v_mean, round(max(v), 6) as v_max, round(max(v) - min(v), 6) as v_range, round(avg((v > 25.2)::int), 6) as share_above from q join g using (r, c) group by 1, 2""")
def q_route_all_grids(s, d):
    """A route's statistics over its 32 points in every grid, with the share of points above a limit."""
    x = t.table(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    x = x.select("vec_id", (F.col("embedding")[F.col("i")].cast("double") * 40).alias("x"), (F.col("embedding")[F.col("i") + 32].cast("double") * 40).alias("y"))
    cells = dem(s, d).groupBy("r", "c").agg(F.collect_list(F.struct("grid", "v")).alias("v"))  # one entry a grid
    x = raster.sample(x, cells, -15.0, 15.0, 1.0).select("vec_id", F.explode("v").alias("g")).select("vec_id", "g.*")
    return x.groupBy("vec_id", "grid").agg(
        F.count("v").alias("n"), r6(F.min("v")).alias("v_min"), r6(F.percentile("v", 0.1)).alias("v_p10"), F.round(F.avg("v"), 9).alias("v_mean"), r6(F.max("v")).alias("v_max"), r6(F.max("v") - F.min("v")).alias("v_range"), r6(F.avg((F.col("v") > 25.2).cast("int"))).alias("share_above")
    )


@query(f"""with f as ({_LONG}), g as (select dim, v, sum(y::int) as p, sum((not y)::int) as z from f group by 1, 2), k as (select *, sum(z) over (partition by dim order by v) - z / 2.0::double as below from g), m as (select dim, round(greatest(sum(p * below) / (sum(p) * sum(z)), 1 - sum(p * below) / (sum(p) * sum(z))), 6) as auc from k group by 1),
 o as (select *, row_number() over (order by auc desc, dim) as rank, count(*) over () as n from m) select dim, auc, rank::bigint as rank, case when rank <= 15 then 'best' else 'worst' end as part from o where rank <= 15 or rank > n - 5""")
def q_feature_ends(s, d):
    """The 15 best and the five worst features by AUC: a report of fixed length."""
    x = t.table(s, d, "embeddings").select((F.col("label") >= 5).cast("long").alias("y"), F.posexplode("embedding").alias("dim", "v"))
    a = stats.feature_audit(x.select(F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v"), "y")).select("dim", r6("auc").alias("auc"))
    a = stats.row_ranks(a, "auc", F.col("dim"), out="rank")
    a = a.crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("n")))).filter("rank <= 15 or rank > n - 5")
    return a.select("dim", "auc", F.col("rank").cast("long").alias("rank"), F.when(F.col("rank") <= 15, "best").otherwise("worst").alias("part"))


def _origin(k):
    """Where on the plane the k-th road lies: roads spread over 100 km either way."""
    return k * 7919 % 997 * 100.0, k * 104729 % 991 * 100.0


def roads(s, d):
    """Every vector as a line of 32 points around its origin, named after the part of its number; every fifth has no name."""
    x, y = _origin(F.col("vec_id"))
    point = lambda i: F.struct((x + F.col("embedding")[2 * i].cast("double") * 300).alias("x"), (y + F.col("embedding")[2 * i + 1].cast("double") * 300).alias("y"))
    names = t.table(s, d, "part").select(F.col("p_partkey").alias("vec_id"), F.lower("p_name").alias("name"))
    e = t.table(s, d, "embeddings").join(names, "vec_id", "left")
    named = F.col("name").isNotNull() & (F.col("vec_id") % 5 != 0)
    return e.select(F.col("vec_id").alias("route_id"), F.when(named, F.col("name")).alias("name_norm"), named.alias("named"), F.array(*[point(i) for i in range(32)]).alias("line"))


def road_reports(s, d):
    """Every part as a report near a road: a name with a house number and a ward, a precision, a place."""
    k = F.col("p_partkey")
    x, y = _origin((k + 3) % 4999)
    kind = F.when(F.col("p_type") == "ECONOMY", "street").when(F.col("p_type") == "SMALL", "area").otherwise("point")
    raw = F.concat((k % 90 + 1).cast("string"), F.lit(" "), F.initcap("p_name"), F.lit(", "), "p_brand")
    return t.table(s, d, "part").select(k.alias("record_id"), raw.alias("raw"), kind.alias("location_precision"), (x + (F.col("p_size") - 25) * 8).alias("x"), (y + (k * 13 % 41 - 20) * 10).alias("y"))


@query("""with l as (select vec_id as route_id, lower(p_name) as name, p_name is not null and vec_id % 5 <> 0 as named, vec_id * 7919 % 997 * 100.0::double as ox, vec_id * 104729 % 991 * 100.0::double as oy, unnest(range(0, 31)) as i, embedding::double[] as e from embeddings left join part on p_partkey = vec_id),
 st as (select route_id, name, named, ox + e[2 * i + 1] * 300 as ax, oy + e[2 * i + 2] * 300 as ay, ox + e[2 * i + 3] * 300 as bx, oy + e[2 * i + 4] * 300 as by_ from l),
 rec as (select p_partkey as record_id, lower(p_name) as norm, p_type in ('ECONOMY', 'SMALL') as wide, (p_partkey + 3) % 4999 * 7919 % 997 * 100.0::double + (p_size - 25) * 8 as x, (p_partkey + 3) % 4999 * 104729 % 991 * 100.0::double + (p_partkey * 13 % 41 - 20) * 10 as y from part),
 tt as (select rec.*, st.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) as u from rec join st on least(ax, bx) <= x + 500 and greatest(ax, bx) >= x - 500 and least(ay, by_) <= y + 500 and greatest(ay, by_) >= y - 500),
 dd as (select record_id, norm, wide, route_id, any_value(name) as name, any_value(named) as named, min(sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by_ - ay)) ** 2)) as dist from tt group by 1, 2, 3, 4),
 h as (select *, len(list_intersect(string_split(norm, ' '), string_split(name, ' '))) / len(list_distinct(list_concat(string_split(norm, ' '), string_split(name, ' '))))::double as sim from dd where dist <= case when wide then 500 else 150 end),
 k as (select record_id, route_id, dist, case when named and sim >= 0.55 then 0 when dist <= 40 then 1 end as r from h), best as (select record_id, min(struct_pack(r := r, dist := dist, route_id := route_id)) as m from k where r is not null group by 1)
 select p_partkey as record_id, m.route_id as route_id, case m.r when 0 then 'name+distance' when 1 then 'distance' else 'unmatched' end as match_type, round(m.dist, 6) as dist from part left join best on record_id = p_partkey""")
def q_road_match_words(s, d):
    """Reports to roads by distance to their segments and the words that the names share."""
    return spatial.match_records(road_reports(s, d), roads(s, d), text.token_jaccard).withColumn("dist", r6("dist"))


@query()
def q_road_match_names(s, d):
    """Reports to roads by distance to their segments and the better of shared words and the ratio of matching blocks."""
    return spatial.match_records(road_reports(s, d), roads(s, d)).withColumn("dist", r6("dist"))


@query(f"with {_FOLD} select route_id, count(*) as active_report_count from r where status = 'flooded' and ts <= timestamp '{_AT}' and ts > timestamp '{_AT}' - interval 6 hours group by 1")
def q_active_reports(s, d):
    """How many kept reports of the last six hours tell a route flooded."""
    at = F.lit(_AT).cast("timestamp_ntz")
    now = (F.col("ts") <= at) & (F.col("ts") > at - F.expr("interval 6 hours"))
    return kept_reports(s, d).filter((F.col("status") == "flooded") & now).groupBy("route_id").agg(F.count(F.lit(1)).alias("active_report_count"))
