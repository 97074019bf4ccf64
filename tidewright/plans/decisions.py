"""Catalogue, fifth part: daily drivers, triggers and their limits, live windows, hourly risk, evidence without repeats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import evidence, series, triggers
from ..sources import tables as t
from ..sources.shared import staged
from .catalog import _AT, _HOURLY, _SUSC, Q_ALERT, Q_WATCH, banded, query, r6, susceptibility

FIELDS = ("total", "max_1h", "max_3h", "max_6h", "prev_24h", "prev_72h", "prev_7d", "hours")

_CELL_DAYS = f"""h as ({_HOURLY}), w as (select *, case when hour(hour) >= 2 and count(mm) over a = 3 then sum(mm) over a end as mm3, case when hour(hour) >= 5 and count(mm) over b = 6 then sum(mm) over b end as mm6 from h
 window a as (partition by cell, hour::date order by hour rows 2 preceding), b as (partition by cell, hour::date order by hour rows 5 preceding)),
 dd as (select cell, hour::date as date, sum(mm) as total, max(mm) as max_1h, max(mm3) as max_3h, max(mm6) as max_6h, sum((mm > 0)::int)::double as hours from w group by 1, 2),
 sp as (select cell, unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day))::date as date from dd group by cell),
 x as (select * from sp left join dd using (cell, date)),
 cd as (select *, case when count(total) over a = 1 then sum(total) over a end as prev_24h, case when count(total) over b = 3 then sum(total) over b end as prev_72h, case when count(total) over c = 7 then sum(total) over c end as prev_7d from x
 window a as (partition by cell order by date rows between 1 preceding and 1 preceding), b as (partition by cell order by date rows between 3 preceding and 1 preceding), c as (partition by cell order by date rows between 7 preceding and 1 preceding))"""


def cell_days(s, d):
    """(cell, date) and the eight daily fields; a day without hours is there and empty."""
    h = series.day_confined(series.day_confined(t.hourly(s, d), 3, "mm3"), 6, "mm6")
    x = h.groupBy("cell", F.to_date("hour").alias("date")).agg(F.sum("mm").alias("total"), F.max("mm").alias("max_1h"), F.max("mm3").alias("max_3h"), F.max("mm6").alias("max_6h"), F.sum((F.col("mm") > 0).cast("double")).alias("hours"))
    x = series.spine(x, "cell", "date").join(x, ["cell", "date"], "left").withColumn("mm", F.col("total"))
    for n, name in ((1, "prev_24h"), (3, "prev_72h"), (7, "prev_7d")):
        x = series.antecedent(x, n, name)
    return x.drop("mm")


_CITY_SQL = ", ".join(f"round(max({f}), 6) as {f}_max_cells, round(avg({f}), 6) as {f}_mean_cells" for f in FIELDS)


@query(f"with {_CELL_DAYS} select date, {_CITY_SQL}, count(total) as cells_available from cd group by 1")
def q_city_day_fields(s, d):
    """Highest and mean cell of all eight fields by day."""
    both = [g(f).alias(f"{f}_{n}_cells") for f in FIELDS for g, n in ((lambda c: r6(F.max(c)), "max"), (lambda c: r6(F.avg(c)), "mean"))]
    return cell_days(s, d).groupBy("date").agg(*both, F.count("total").alias("cells_available"))


_TIDE = f"h as ({_HOURLY}), a as (select hour, sum(mm) / 1000 as level from h where cell <> 'error' group by 1), o as (select hour, max(mm) / 100 as seen from h where hour(hour) % 3 = 0 group by 1)"


@query(f"""with {_TIDE}, dd as (select hour::date as date, max(level) as hi, min(level) as lo from a group by 1), ob as (select hour::date as date, max(seen) as seen from o group by 1)
 select date, round(hi, 6) as astro_max, round(lo, 6) as astro_min, round(case when count(hi) over w = 3 then max(hi) over w end, 6) as astro_max_3d, round(seen, 6) as observed_max, round(hi - seen, 6) as residual from dd left join ob using (date)
 window w as (order by date rows 2 preceding)""")
def q_tide_daily(s, d):
    """Daily extremes of a level, the highest over three days, and what it misses of the observed maximum."""
    h = t.hourly(s, d)
    level = h.filter("cell <> 'error'").groupBy("hour").agg((F.sum("mm") / 1000).alias("level"))
    seen = h.filter(F.hour("hour") % 3 == 0).groupBy("hour").agg((F.max("mm") / 100).alias("seen"))
    day = level.groupBy(F.to_date("hour").alias("date")).agg(F.max("level").alias("hi"), F.min("level").alias("lo"))
    day = day.join(seen.groupBy(F.to_date("hour").alias("date")).agg(F.max("seen").alias("seen")), "date", "left")
    w = Window.partitionBy(F.lit("city")).orderBy("date").rowsBetween(-2, 0)  # one row a day
    return day.select("date", r6("hi").alias("astro_max"), r6("lo").alias("astro_min"), r6(series.full_window(F.max, "hi", w, 3)).alias("astro_max_3d"), r6("seen").alias("observed_max"), r6(F.col("hi") - F.col("seen")).alias("residual"))


_CITY_HOURS = "c as (select hour, max(mm) as mm from h group by 1)"
_LIVE = f"""h as ({_HOURLY}), {_CITY_HOURS}, v as (select unnest([0, 1, 2])::integer as horizon_h), tt as (select horizon_h, timestamp '{_AT}' + horizon_h * interval 1 hour as valid_time from v),
 six as (select horizon_h, valid_time, hour, mm, count(mm) over w as n3, sum(mm) over w as s3 from tt join c on hour > valid_time - interval 6 hours and hour <= valid_time window w as (partition by horizon_h order by hour rows 2 preceding)),
 live as (select horizon_h, valid_time, count(mm) as hours, max(case when n3 = 3 then s3 end) as max_3h, (select sum(mm) from c where hour > valid_time - interval 24 hours and hour <= valid_time) as total_24h from six group by 1, 2)"""


def city_hours(s, d):
    """The highest cell of every hour, staged: measurements are read once, however many windows ask."""
    return staged(t.hourly(s, d).groupBy("hour").agg(F.max("mm").alias("mm")), "city-hours")


def live_windows(s, d, city=None):
    """The trailing windows of three hours to come; fewer than six hours of rain fail the job."""
    return triggers.trailing_windows(city_hours(s, d) if city is None else city, _AT, 3)


@query(f"with {_LIVE} select horizon_h, valid_time, round(max_3h, 6) as max_3h, round(total_24h, 6) as total_24h from live")
def q_live_windows(s, d):
    return live_windows(s, d).select("horizon_h", "valid_time", r6("max_3h").alias("max_3h"), r6("total_24h").alias("total_24h"))


#: Parameters of the stored trigger: weights of both log odds and the constant.
COEF, CONSTANT = (0.31, 0.24), -1.4
_LIVE_T = f"""{_LIVE},
 ref as (select hour::date as date, max(mm) as m1, sum(mm) as tot from c where hour < timestamp '2024-01-20' group by 1), n as (select count(*) as n from ref),
 q as (select horizon_h, valid_time, max_3h, total_24h, (select count(*) from ref where m1 <= max_3h) / (select n from n)::double as q3, (select count(*) from ref where tot <= total_24h) / (select n from n)::double as qt from live),
 z as (select *, greatest(0.001::double, least(0.999::double, q3)) as a, greatest(0.001::double, least(0.999::double, qt)) as b from q),
 tr as (select horizon_h, valid_time, q3, qt, 1 / (1 + exp(-({COEF[0]}::double * ln(a / (1 - a)) + {COEF[1]}::double * ln(b / (1 - b)) + {CONSTANT}::double))) as t_rain from z)"""


def live_trigger(s, d):
    """Percentiles of the live windows in the stored reference days, and the trigger's probability."""
    city = city_hours(s, d)
    ref = city.filter(F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(F.to_date("hour").alias("date")).agg(F.max("mm").alias("m1"), F.sum("mm").alias("tot"))
    live = live_windows(s, d, city)
    below = lambda c, v: (F.count_if(F.col(c) <= F.col(v)) / F.count(F.lit(1)).cast("double"))
    x = ref.crossJoin(F.broadcast(live)).groupBy("horizon_h", "valid_time").agg(below("m1", "max_3h").alias("q3"), below("tot", "total_24h").alias("qt"))  # three live rows
    z = triggers.logit(F.col("q3")) * COEF[0] + triggers.logit(F.col("qt")) * COEF[1] + CONSTANT
    return x.select("horizon_h", "valid_time", "q3", "qt", triggers.expit(z).alias("t_rain"))


@query(f"with {_LIVE_T} select horizon_h, valid_time, round(q3, 6) as q3, round(qt, 6) as qt, round(t_rain, 6) as t_rain from tr")
def q_live_trigger(s, d):
    return live_trigger(s, d).select("horizon_h", "valid_time", *[r6(c).alias(c) for c in ("q3", "qt", "t_rain")])


_KNOTS = [0.0, 0.0, 20.0, 40.0, 80.0, 400.0]
_PCT = "case when {v} < 0 then 0.0::double when {v} >= 400 then 1.0::double when {v} >= 80 then 0.8::double + ({v} - 80) / 320 * 0.2::double when {v} >= 40 then 0.6::double + ({v} - 40) / 40 * 0.2::double when {v} >= 20 then 0.4::double + ({v} - 20) / 20 * 0.2::double else 0.2::double + {v} / 20 * 0.2::double end"


@query(f"""with x as (select event_id, event_type, case when event_type = 'error' then null else value end as v from events), m as (select 30.0::double as mean, 12.0::double as scale)
 select event_id, 0.25::double as constant, round(1 / (1 + exp(-(0.9::double * (coalesce(v, mean) - mean) / scale - 1.1::double))), 6) as logistic,
 round(1 / (1 + exp(-(0.7::double * (case when v is null then 3.1::double else ln(1 + greatest(v, 0)) end - 3.1::double) / 0.8::double - 0.4::double))), 6) as logistic_log,
 round(case when v is null then null when v < 5 then 0.1::double when v >= 60 then 0.9::double else 0.1::double + (v - 5) / 55 * 0.8::double end, 6) as isotonic,
 round(case when v is not null then 1 / (1 + exp(-(({_PCT.format(v="v")}) - 0.95::double) / 0.02::double)) end, 6) as percentile, 0.0::double as zero from x, m""")
def q_trigger_kinds(s, d):
    """Every kind of stored trigger on one series; a missing value is the training mean for the logistic ones."""
    v = F.when(F.col("event_type") != "error", F.col("value"))
    kinds = {
        "constant": {"kind": "constant", "value": 0.25},
        "logistic": {"kind": "logistic", "mean": [30.0], "scale": [12.0], "coef": [0.9], "intercept": -1.1},
        "logistic_log": {"kind": "logistic", "log": True, "mean": [3.1], "scale": [0.8], "coef": [0.7], "intercept": -0.4},
        "isotonic": {"kind": "isotonic", "x": [5.0, 60.0], "y": [0.1, 0.9]},
        "percentile": {"kind": "percentile", "knots": _KNOTS},
        "zero": {"kind": "zero"},
    }
    x = t.table(s, d, "events").withColumn("v", v)
    return x.select("event_id", *[r6(triggers.apply(p, [F.col("v")])).alias(k) for k, p in kinds.items()])


@query(f"""with h as ({_HOURLY}), dm as (select cell, hour::date as date, max(mm) as m from h group by 1, 2), q as (select unnest(range(0, 201)) as i), r as (select m, row_number() over (order by m) - 1 as k, count(*) over () as n from dm),
 e as (select i, i * (max(n) - 1) / 200.0::double as pos from q, r group by i) select i::integer as i, round(max(case when k = floor(pos) then m end) + (pos - floor(pos)) * (max(case when k = least(n - 1, floor(pos) + 1) then m end) - max(case when k = floor(pos) then m end)), 6) as q from e, r group by i, pos""")
def q_climatology(s, d):
    """The 201 quantiles of the daily maxima, from ranks rather than from one task's percentile."""
    daily = t.hourly(s, d).groupBy("cell", F.to_date("hour").alias("date")).agg(F.max("mm").alias("m"))
    return triggers.quantile_grid(daily, "m", 200).select("i", r6("q").alias("q"))


_DAYS_T = f"""{_CELL_DAYS}, city as (select date, max(total) as total from cd group by 1), tg as (select date, round(total / (total + 400), 6) as t from city where total is not null),
 kind as (select ts::date as date, sum((event_type = 'purchase')::int) as p, sum((event_type = 'error')::int) as e from events group by 1), lab as (select date, t, p > e + 4 as pos, p < e as neg from tg join kind using (date))"""


def labelled_days(s, d):
    """(date, t, pos, neg): the trigger of each day, whether it was reported, whether it was quiet."""
    city = cell_days(s, d).groupBy("date").agg(F.max("total").alias("total")).filter("total is not null")
    kind = t.table(s, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("e"))
    x = city.select("date", r6(F.col("total") / (F.col("total") + 400)).alias("t")).join(kind, "date")
    return x.select("date", "t", (F.col("p") > F.col("e") + 4).alias("pos"), (F.col("p") < F.col("e")).alias("neg"))


@query(f"""with {_DAYS_T}, rk as (select t, row_number() over (order by t) - 1 as k, count(*) over () as n from lab), q as (select unnest(range(0, 101)) as i), ps as (select i, i * (max(n) - 1) / 100.0::double as pos from q, rk group by i),
 his as (select distinct max(case when k = floor(pos) then t end) + (pos - floor(pos)) * (max(case when k = least(n - 1, floor(pos) + 1) then t end) - max(case when k = floor(pos) then t end)) as hi from ps, rk group by i, pos),
 gap as (select greatest(1e-6::double, 0.01::double * (max(t) - min(t))) as gap from lab),
 c as (select hi, (select avg((t >= hi)::int) from lab where pos) as sens, (select max(t) from lab where neg and t <= hi - gap) as top, (select count(*) from lab where neg and t < hi - gap) as below, (select count(*) from lab where neg) as n_neg from his, gap),
 b as (select hi, sens, below / n_neg::double as quiet from c), f as (select *, sens >= 0.7 and quiet >= 0.8 as ok, least(sens / 0.7::double, quiet / 0.8::double) as worst from b)
 select round(hi, 6) as t_hi, round(sens, 6) as sensitivity, round(quiet, 6) as quiet, ok as targets_met from f order by ok desc, case when ok then hi end desc nulls last, case when ok then quiet end desc nulls last, case when not ok then worst end desc nulls last, case when not ok then sens + quiet end desc nulls last, hi desc limit 1""")
def q_alert_limit(s, d):
    """The alert limit: the highest of 101 quantiles that meets both targets, else the best compromise."""
    best = triggers.choose_limits(staged(labelled_days(s, d), "labelled-days"), 100, 0.7, 0.8)
    return best.select(r6("hi").alias("t_hi"), r6("sens").alias("sensitivity"), r6("quiet").alias("quiet"), F.col("ok").alias("targets_met"))


_SCORED_DAYS = "select doc_id, (n_chars % 97)::double / 97 as t, quality = 1 as pos, quality = 0 as neg from documents join labels using (doc_id)"


@query(f"""with lab as ({_SCORED_DAYS}), rk as (select t, row_number() over (order by t) - 1 as k, count(*) over () as n from lab), q as (select unnest(range(0, 201)) as i), ps as (select i, i * (max(n) - 1) / 200.0::double as pos from q, rk group by i),
 his as (select distinct max(case when k = floor(pos) then t end) + (pos - floor(pos)) * (max(case when k = least(n - 1, floor(pos) + 1) then t end) - max(case when k = floor(pos) then t end)) as hi from ps, rk group by i, pos),
 c as (select hi, (select avg((t >= hi)::int) from lab where pos) as sens, (select avg((t < hi)::int) from lab where neg) as quiet from his),
 al as (select *, sens >= 0.6 and quiet >= 0.9 as ok from c order by ok desc, case when ok then hi end desc nulls last, least(sens / 0.6::double, quiet / 0.9::double) desc, sens + quiet desc, hi desc limit 1),
 wa as (select max(c.hi) as watch from c, al where c.sens >= 0.85 and c.hi <= al.hi)
 select round(hi, 6) as q_alert, round(coalesce(watch, least(0.0::double, hi)), 6) as q_watch, round(sens, 6) as alert_sensitivity, round(quiet, 6) as no_report_quiet from al, wa""")
def q_watch_alert(s, d):
    """Both limits from 201 quantiles: alert by its targets, watch the highest that still finds 85 %."""
    x = t.table(s, d, "documents").join(t.table(s, d, "labels"), "doc_id").select(((F.col("n_chars") % 97).cast("double") / 97).alias("t"), (F.col("quality") == 1).alias("pos"), (F.col("quality") == 0).alias("neg"))
    got = triggers.watch_and_alert(x, 200, 0.6, 0.9, 0.85)
    return got.select(r6("alert").alias("q_alert"), r6("watch").alias("q_watch"), r6("sens").alias("alert_sensitivity"), r6("quiet").alias("no_report_quiet"))


_HIST_ALL = "rec as (select l_partkey as route_id, case when l_linenumber = 7 then null else l_shipdate::date end as date, case l_returnflag when 'A' then 'rain' when 'N' then 'tide' when 'R' then 'combined' else 'unknown' end as cause from lineitem where l_quantity >= 45)"


def history_scores(s, d):
    """Per route and cause: 0.9 and up to 0.1 more for three dates; undated reports count as history without a date."""
    x = t.table(s, d, "lineitem").filter("l_quantity >= 45")
    x = x.select(F.col("l_partkey").alias("route_id"), F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date")).alias("date"), t.cause_of(F.col("l_returnflag")).alias("cause"))
    x = x.filter(F.col("date").isNull() | (F.col("date") < F.lit(t.CUTOFF).cast("date")))
    both = [(c, F.col("cause").isin(c, "combined")) for c in ("rain", "tide")]
    g = x.groupBy("route_id").agg(*[F.count_distinct(F.when(is_, F.col("date"))).alias(f"n_{c}") for c, is_ in both], *[F.coalesce(F.bool_or(is_), F.lit(False)).alias(f"seen_{c}") for c, is_ in both])
    score = lambda c: F.when(F.col(f"seen_{c}"), 0.9 + 0.1 * F.least(F.lit(1.0), F.col(f"n_{c}") / F.lit(3.0))).otherwise(F.lit(0.0))
    return g.select("route_id", "n_rain", "n_tide", "seen_rain", "seen_tide", score("rain").alias("s_rain"), score("tide").alias("s_tide"))


_HS = f"""{_HIST_ALL}, hs as (select route_id, count(distinct case when cause in ('rain', 'combined') then date end) as n_rain, count(distinct case when cause in ('tide', 'combined') then date end) as n_tide, bool_or(cause in ('rain', 'combined')) as seen_rain, bool_or(cause in ('tide', 'combined')) as seen_tide
 from rec where date is null or date < date '2000-01-01' group by 1)"""


@query(f"with {_HS} select route_id, n_rain, n_tide, round(case when seen_rain then 0.9::double + 0.1::double * least(1.0::double, n_rain / 3.0::double) else 0 end, 6) as s_rain, round(case when seen_tide then 0.9::double + 0.1::double * least(1.0::double, n_tide / 3.0::double) else 0 end, 6) as s_tide from hs")
def q_history_scores(s, d):
    return history_scores(s, d).select("route_id", "n_rain", "n_tide", r6("s_rain").alias("s_rain"), r6("s_tide").alias("s_tide"))


@query(f"""with {_SUSC}, {_HS.replace("rec as", "rec2 as").replace("from rec where", "from rec2 where")}
 select s.route_id, in_universe, round(s_model, 6) as s_model, round(greatest(s_model, case when seen_rain then 0.9::double + 0.1::double * least(1.0::double, h.n_rain / 3.0::double) else 0 end), 6) as s_hyb_rain,
 round(greatest(s_model, case when seen_tide then 0.9::double + 0.1::double * least(1.0::double, h.n_tide / 3.0::double) else 0 end), 6) as s_hyb_tide, coalesce(seen_rain, false)::integer as h_rain, coalesce(seen_tide, false)::integer as h_tide,
 (coalesce(seen_rain, false) or coalesce(seen_tide, false))::integer as h_any, coalesce(h.n_rain, 0) as n_rain, coalesce(h.n_tide, 0) as n_tide from susc s left join hs h using (route_id)""")
def q_susceptibility(s, d):
    """Model, history and hybrid scores with their flags."""
    x = susceptibility(s, d).select("route_id", "in_universe", "s_model").join(history_scores(s, d), "route_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select("route_id", "in_universe", r6("s_model").alias("s_model"), r6(F.greatest("s_model", zero("s_rain"))).alias("s_hyb_rain"), r6(F.greatest("s_model", zero("s_tide"))).alias("s_hyb_tide"), flag("seen_rain").cast("int").alias("h_rain"), flag("seen_tide").cast("int").alias("h_tide"), (flag("seen_rain") | flag("seen_tide")).cast("int").alias("h_any"), zero("n_rain").alias("n_rain"), zero("n_tide").alias("n_tide"))


_STATE = f"case when t_rain >= {Q_ALERT} then 2 when t_rain >= {Q_WATCH} then 1 else 0 end"


@query(f"""with {_LIVE_T}, {_SUSC}, b as (select *, row_number() over (order by s_rain desc, s_model desc, route_id) as rn, count(*) over () as nn from susc),
 bd as (select *, case when rn <= greatest(1, ceil(nn * 0.05::double)) then 2 when rn <= greatest(1, ceil(nn * 0.20::double)) then 1 else 0 end as band from b),
 dep as (select l_partkey as route_id, max(l_quantity) as depth from lineitem where l_quantity >= 49 and l_discount >= 0.085 and l_shipdate < timestamp '2000-01-01' group by 1), st as (select *, {_STATE} as state from tr)
 select route_id, valid_time, horizon_h, round(1 - (1 - s_rain * t_rain) * (1 - s_tide * 0.1::double), 6) as p, case when state = 2 then (['low', 'medium', 'high'])[band + 1] when state = 1 and band = 2 then 'medium' else 'low' end as level, round(s_rain, 6) as s_rain, round(s_tide, 6) as s_tide,
 round(t_rain, 6) as t_rain, 0.1::double as t_tide, (['quiet', 'watch', 'alert'])[state + 1] as day_state_rain, 'quiet' as day_state_tide, case when depth is not null then 'official_observation' else 'model_forecast' end as provenance, 0 as active_report_count, depth as max_recorded_depth_cm
 from bd left join dep using (route_id), st""")
def q_risk_hourly(s, d):
    """The hourly product: every route at three hours, with the live trigger; three rows are broadcast."""
    b = banded(staged(susceptibility(s, d), "susceptibility"), "s_rain", "s_model", "route_id")
    past = t.records(s, d).filter(F.col("date") < F.lit(t.CUTOFF).cast("date")).groupBy("route_id").agg(F.max("depth_cm").alias("depth"))
    state = F.when(F.col("t_rain") >= Q_ALERT, 2).when(F.col("t_rain") >= Q_WATCH, 1).otherwise(0)
    x = b.join(past, "route_id", "left").crossJoin(F.broadcast(live_trigger(s, d).withColumn("state", state)))
    names = lambda *v: F.array(*map(F.lit, v))
    level = F.when(F.col("state") == 2, F.col("band")).when((F.col("state") == 1) & (F.col("band") == 2), 1).otherwise(0)
    return x.select(
        "route_id", "valid_time", "horizon_h", r6(1 - (1 - F.col("s_rain") * F.col("t_rain")) * (1 - F.col("s_tide") * 0.1)).alias("p"), F.get(names("low", "medium", "high"), level.cast("int")).alias("level"), r6("s_rain").alias("s_rain"), r6("s_tide").alias("s_tide"),
        r6("t_rain").alias("t_rain"), F.lit(0.1).alias("t_tide"), F.get(names("quiet", "watch", "alert"), F.col("state")).alias("day_state_rain"), F.lit("quiet").alias("day_state_tide"), F.when(F.col("depth").isNotNull(), "official_observation").otherwise("model_forecast").alias("provenance"), F.lit(0).alias("active_report_count"), F.col("depth").alias("max_recorded_depth_cm"),
    )


_FOLD = f"""recursive r0 as (select event_id, user_id, event_id % 50 as route_id, ts, value, case when event_type in ('click', 'view', 'purchase') then 'flooded' when event_type = 'error' then 'dry' end as status, event_type = 'purchase' as official from events),
 f as (select user_id, route_id, min(ts) as ts from r0 group by 1, 2 union all select f.user_id, f.route_id, (select min(r0.ts) from r0 where r0.user_id = f.user_id and r0.route_id = f.route_id and r0.ts >= f.ts + interval 30 minutes) from f where f.ts is not null),
 r as (select r0.* from r0 join f using (user_id, route_id, ts) where event_id = (select min(event_id) from r0 o where o.user_id = r0.user_id and o.route_id = r0.route_id and o.ts = r0.ts))"""


def kept_reports(s, d):
    e = t.table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 50).alias("route_id"), "ts", "value", "event_type")
    status = F.when(F.col("event_type").isin("click", "view", "purchase"), "flooded").when(F.col("event_type") == "error", "dry")
    return evidence.kept(e.withColumn("status", status).withColumn("official", F.col("event_type") == "purchase"), "event_id")


@query(f"""with {_FOLD}, o as (select route_id, sum(ln(case when status = 'dry' then 1 / 3.0::double when official then 10.0::double else 3.0::double end) * pow(0.5::double, (epoch(timestamp '{_AT}') - epoch(ts)) / 60 / 30)) as shift, count(*) as n from r where status is not null and ts <= timestamp '{_AT}' group by 1)
 select route_id, n, round(1 / (1 + exp(-(ln(0.3::double / 0.7::double) + shift))), 6) as p from o""")
def q_evidence_kept_update(s, d):
    """The odds update over the reports that stay after the repeats of a user and route are gone."""
    o = evidence.log_odds(kept_reports(s, d), _AT)
    return o.select("route_id", "n", r6(evidence.updated(F.lit(0.3), F.col("shift"))).alias("p"))


@query(f"""with {_FOLD}, c as (select route_id, case when status = 'dry' then 0 when value is null then 2 when value < 10 then 1 when value <= 30 then 3 else 4 end as severity, count(*) as n from r where status is not null and ts <= timestamp '{_AT}' group by 1, 2)
 select route_id, (['none', 'light', 'unknown', 'moderate', 'high'])[1 + arg_max(severity, struct_pack(a := n, b := severity))] as level, max(n) as n from c group by 1""")
def q_shown_level(s, d):
    """The level most reports tell, repeats gone, none, light, unknown, moderate, high; ties go to the more severe."""
    v = F.col("value")
    deep = F.when(F.col("status") == "dry", 0).when(v.isNull(), 2).when(v < 10, 1).when(v <= 30, 3).otherwise(4)
    use = kept_reports(s, d).filter(F.col("status").isNotNull() & (F.col("ts") <= F.lit(_AT).cast("timestamp_ntz")))
    m = evidence.modal_level(use, "route_id", deep)
    names = F.array(*map(F.lit, ("none", "light", "unknown", "moderate", "high")))
    return m.select("route_id", F.get(names, F.col("severity")).alias("level"), "n")


@query("""with o as (select o_orderdate::date as date, count(*) as n_orders from orders group by 1), l as (select l_shipdate::date as date, round(sum(l_quantity), 2) as shipped from lineitem where l_quantity >= 49 group by 1)
 select date, n_orders, shipped, coalesce(shipped, 0) as filled from o left join l using (date)""")
def q_join_date_left(s, d):
    """Days of one table with what another knows of them; unknown stays null, and 0 only where a fill is asked for."""
    o = t.table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    ship = t.table(s, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    return o.join(ship, "date", "left").select("date", "n_orders", "shipped", F.coalesce("shipped", F.lit(0.0)).alias("filled"))


@query(f"""with {_DAYS_T}, chosen as (select max(date) as date from lab where pos), c as (select hour, max(mm) as mm from h group by 1)
 select c.hour, round(c.mm, 6) as mm from c, chosen where c.hour >= chosen.date::timestamp + interval 12 hours - interval 72 hours and c.hour <= chosen.date::timestamp + interval 12 hours + interval 6 hours""")
def q_replay_slice(s, d):
    """The hours around noon of the newest reported day, three days back and six hours on: one row is broadcast."""
    chosen = labelled_days(s, d).filter("pos").agg(F.max("date").cast("timestamp_ntz").alias("day"))
    city = t.hourly(s, d).groupBy("hour").agg(F.max("mm").alias("mm")).crossJoin(F.broadcast(chosen))
    noon = F.col("day") + F.expr("interval 12 hours")
    return city.filter((F.col("hour") >= noon - F.expr("interval 72 hours")) & (F.col("hour") <= noon + F.expr("interval 6 hours"))).select("hour", r6("mm").alias("mm"))


@query(f"""with {_CELL_DAYS} select cell, date, case when max_3h is not null and prev_24h is not null and prev_72h is not null then round(1 / (1 + exp(-(0.01::double * max_3h + 0.002::double * prev_24h - 0.0005::double * prev_72h - 1.5::double))), 6) end as p from cd""")
def q_score_complete(s, d):
    """Only rows with every feature known are scored; the others stay null."""
    known = F.col("max_3h").isNotNull() & F.col("prev_24h").isNotNull() & F.col("prev_72h").isNotNull()
    z = 0.01 * F.col("max_3h") + 0.002 * F.col("prev_24h") - 0.0005 * F.col("prev_72h") - 1.5
    return cell_days(s, d).select("cell", "date", F.when(known, r6(triggers.expit(z))).alias("p"))


@query(f"""with {_TIDE}, q as (select hour, least(400, greatest(0, level * 200)) as v from a) select hour, round(1 / (1 + exp(-(({_PCT.format(v="v")}) - 0.95::double) / 0.02::double)), 6) as t_tide from q""")
def q_tide_trigger_hour(s, d):
    """The trigger of each hour's level against the climatology of daily maxima, as the hourly runner has it."""
    level = t.hourly(s, d).filter("cell <> 'error'").groupBy("hour").agg((F.sum("mm") / 1000).alias("level"))
    v = F.least(F.lit(400.0), F.greatest(F.lit(0.0), F.col("level") * 200))
    return level.select("hour", r6(triggers.apply({"kind": "percentile", "knots": _KNOTS}, [v])).alias("t_tide"))


@query(f"""with {_DAYS_T}, m as (select avg(t) as mean from lab) select count(*) as days, round(avg(pos::int), 6) as rate, round(greatest(0, avg(pos::int) - 1.96::double * sqrt(avg(pos::int) * (1 - avg(pos::int)) / count(*))), 6) as low, round(least(1, avg(pos::int) + 1.96::double * sqrt(avg(pos::int) * (1 - avg(pos::int)) / count(*))), 6) as high from lab""")
def q_rate_interval(s, d):
    """A share with its binomial interval in closed form."""
    p = F.avg(F.col("pos").cast("int"))
    x = labelled_days(s, d).agg(F.count(F.lit(1)).alias("days"), p.alias("rate"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("days"))
    return x.select("days", r6("rate").alias("rate"), r6(F.greatest(F.lit(0.0), F.col("rate") - half)).alias("low"), r6(F.least(F.lit(1.0), F.col("rate") + half)).alias("high"))
