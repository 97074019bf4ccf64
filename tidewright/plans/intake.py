"""Catalogue, fourth part: reports and roads as they come in, cleaning, keys, flags, checked joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import checks, geometry, spatial
from ..sources import payloads
from ..sources import tables as t
from .catalog import query, r6


def literal(v) -> str:
    if v is None:
        return "null"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()


def rows_sql(name: str, columns: str, rows) -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def inline(s, schema: str, rows):
    return s.createDataFrame(rows, schema)


PLACES = [(1, "Street", "GPS", None), (2, "line", None, "High"), (3, None, "ward centre", ""), (4, "", "", "medium"), (5, None, None, None), (6, "Commune polygon", "road name", None), (7, "POINT", None, "low"), (8, "house", "?", "")]


@query("with " + rows_sql("p", "id, a, b, c", PLACES) + """, q as (select id, lower(trim(coalesce(a, '')) || ' ' || trim(coalesce(b, '')) || ' ' || trim(coalesce(c, ''))) as s from p)
 select id, case when contains(s, 'segment') or contains(s, 'line') then 'segment' when contains(s, 'street') or contains(s, 'road') then 'street'
 when regexp_matches(s, 'area|ward|district|commune|polygon') then 'area' when regexp_matches(s, 'point|high|medium|low') then 'point' else 'unknown' end as location_precision from q""")
def q_location_precision(s, d):
    return inline(s, "id int, a string, b string, c string", PLACES).select("id", text.location_precision(F.col("a"), F.col("b"), F.col("c")).alias("location_precision"))


CAUSES = [(1, "Heavy RAIN"), (2, "rain and tide: both"), (3, "High tide"), (4, "combined"), (5, None), (6, "burst pipe"), (7, " Rainfall; tide")]


@query("with " + rows_sql("p", "id, cause", CAUSES) + """ select id, case when regexp_matches(lower(coalesce(cause, '')), 'combined|both') then 'combined' when contains(lower(coalesce(cause, '')), 'rain') then 'rain'
 when contains(lower(coalesce(cause, '')), 'tide') then 'tide' else 'unknown' end as cause from p""")
def q_cause_words(s, d):
    return inline(s, "id int, cause string", CAUSES).select("id", text.by_keyword(F.col("cause"), text.CAUSE_WORDS).alias("cause"))


STATES = [(1, "Flooded", None), (2, " NGAP ", False), (3, "not flooded", True), (4, "Khong Ngap", None), (5, "", True), (6, None, False), (7, "perhaps", None), (8, "1", None), (9, "No", True)]


@query("with " + rows_sql("p", "id, status, flag", STATES) + f""", q as (select id, flag, replace(lower(trim(coalesce(status, ''))), ' ', '_') as s from p)
 select id, case when s in {text.FLOODED_TERMS} then 'flooded' when s in {text.DRY_TERMS} then 'not_flooded' when flag then 'flooded' when not flag then 'not_flooded' end as status from q""")
def q_status_terms(s, d):
    return inline(s, "id int, status string, flag boolean", STATES).select("id", text.status_of(F.col("status"), F.col("flag")).alias("status"))


WAYS = [(1, '"name"=>"Le Loi","lanes"=>"4","bridge"=>"yes"'), (2, ""), (3, None), (4, '"surface"=>" asphalt ","ref"=>""'), (5, "junk"), (6, '"a b"=>"c, d"')]


@query("with " + rows_sql("p", "id, s", WAYS) + """, k as (select id, unnest(regexp_extract_all(coalesce(s, ''), '"([^"]+)"=>"([^"]*)"', 1)) as key, unnest(regexp_extract_all(coalesce(s, ''), '"([^"]+)"=>"([^"]*)"', 2)) as value from p)
 select id, trim(key) as key, trim(value) as value from k""")
def q_way_tags(s, d):
    return inline(s, "id int, s string", WAYS).select("id", F.explode(text.tags(F.col("s"))).alias("key", "value"))


PORTAL = [
    ('{"status":"ok","data":[{"_id":"a1","location":{"coordinates":[108.2,16.05],"address":"12 Le Loi, Hai Chau"},"flood_time":{"start_time":1665741600},"water_level":0.4,"flood_unit":"m","flood_type":"rain","floodStatus":"flooded"},'
     '{"_id":"a2","location":{"coordinates":[108.3,16.1]},"water_level":25,"flood_unit":"cm","flood_location_details":"Nguyen Hue"}]}',),
    ('{"status":"ok","data":[{"_id":"a3"},{"_id":"a4","location":{"coordinates":[]},"water_level":"x","flood_unit":"m"}]}',),
]


@query("with " + rows_sql("p", "j", PORTAL) + """, e as (select unnest((j::json->'data')::json[]) as e from p)
 select e->>'_id' as id, (e->'location'->'coordinates'->>1)::double as lat, (e->'location'->'coordinates'->>0)::double as lon,
 to_timestamp((e->'flood_time'->>'start_time')::bigint)::timestamp + interval 7 hours as at,
 try_cast(e->>'water_level' as double) * case when e->>'flood_unit' = 'm' then 100 else 1 end as depth_cm, coalesce(e->'location'->>'address', e->>'flood_location_details') as road,
 e->>'floodStatus' as status, e->>'flood_type' as kind from e""")
def q_portal_reports(s, d):
    """Nested payloads to reports: coordinate pairs, metres to centimetres, seconds to local time."""
    return payloads.portal_reports(inline(s, "j string", PORTAL), "j")


GAUGE = [(1, "time,sea_level"), (2, "UTC,millimeters"), (3, "2024-01-01T00:00:00Z,1510"), (4, "2024-01-01T01:00:00Z,NaN"), (5, "2024-01-01T00:00:00Z,1510"), (6, "2025-01-01T00:00:00Z,1600"), (7, "2024-01-01T02:00:00Z,1490.5"), (8, "broken")]


@query("with " + rows_sql("p", "id, line", GAUGE) + """, q as (select try_cast(replace(replace(split_part(line, ',', 1), 'T', ' '), 'Z', '') as timestamp) as measured, try_cast(split_part(line, ',', 2) as double) / 1000 as level from p)
 select distinct measured, round(level, 6) as level from q where measured is not null and level is not null and not isnan(level) and measured < timestamp '2025-01-01'""")
def q_gauge_lines(s, d):
    """Comma-separated lines whose second row holds units: what does not parse goes; millimetres to metres, one row a time."""
    return payloads.gauge_readings(inline(s, "id int, line string", GAUGE), "line", "2025-01-01").select(F.col("at").alias("measured"), r6("level").alias("level"))


FORECAST = [('[{"hourly":{"time":["2024-05-01T00:00","2024-05-01T01:00"],"precipitation":[0.5,null]}},{"hourly":{"time":["2024-05-01T00:00","2024-05-01T01:00","2024-05-01T02:00"],"precipitation":[1.5,2.0,null]}}]',)]


@query("with " + rows_sql("p", "j", FORECAST) + """, e as (select unnest(j::json[]) as e from p), h as (select unnest((e->'hourly'->'time')::varchar[]) as t, unnest((e->'hourly'->'precipitation')::double[]) as mm from e)
 select replace(t, 'T', ' ')::timestamp as at, max(mm) as mm from h group by 1""")
def q_forecast_points(s, d):
    """A forecast of several points to one series: the highest value of each hour."""
    return payloads.forecast(inline(s, "j string", FORECAST), "j")


ELEMENTS = [('{"elements":[{"type":"way","id":5,"tags":{"highway":"primary","name":"A"},"geometry":[{"lat":10.0,"lon":106.0},{"lat":10.5,"lon":106.5}]},{"type":"node","id":6},{"type":"way","id":7,"tags":{"waterway":"river"},"geometry":[{"lat":1.0,"lon":2.0},{"lat":1.0,"lon":3.0},{"lat":2.0,"lon":3.0},{"lat":1.0,"lon":2.0}]}]}',)]


@query("with " + rows_sql("p", "j", ELEMENTS) + """, e as (select unnest((j::json->'elements')::json[]) as e from p)
 select (e->>'id')::bigint as id, e->'tags'->>'highway' as highway, e->'tags'->>'waterway' as waterway, json_array_length(e->'geometry')::bigint as points,
 json_extract_string(e, '$.geometry[0].lon') = json_extract_string(e, '$.geometry[#-1].lon') and json_extract_string(e, '$.geometry[0].lat') = json_extract_string(e, '$.geometry[#-1].lat') as closed from e where e->>'type' = 'way'""")
def q_map_elements(s, d):
    """Ways of a map extract with their tags; a closed one is an area."""
    w = payloads.ways(inline(s, "j string", ELEMENTS), "j")
    return w.select("id", F.col("tags")["highway"].alias("highway"), F.col("tags")["waterway"].alias("waterway"), F.size("line").cast("long").alias("points"), "closed")


@query("""select user_id, event_type, first_id, last_id from (select user_id, event_type, arg_min(event_id, struct_pack(t := ts, e := event_id)) as first_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) as last_id from events group by 1, 2)""")
def q_keep_first_last(s, d):
    """The first and the last row of each key."""
    at = F.struct("ts", "event_id")
    return t.table(s, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


_ROADS = [*text.CLASS_RANKS, "primary_link", "track"]
_ROAD_SQL = f"select p_partkey as route_id, {_ROADS}[1 + p_partkey % {len(_ROADS)}] as highway, p_size, p_retailprice from part"


def roads(s, d):
    kinds = F.array(*map(F.lit, _ROADS))
    return t.table(s, d, "part").select(F.col("p_partkey").alias("route_id"), F.get(kinds, (F.col("p_partkey") % len(_ROADS)).cast("int")).alias("highway"), "p_size", "p_retailprice")


_RANK_SQL = "case highway " + " ".join(f"when '{k}' then {v}" for k, v in text.CLASS_RANKS.items()) + " end"
_GROUP_SQL = "case " + " ".join(f"when highway in ({', '.join(map(literal, v))}) then '{g}'" for g, v in text.CLASS_GROUPS.items()) + " else 'other' end"


@query(f"with r as ({_ROAD_SQL}) select route_id, highway, ({_RANK_SQL})::integer as class_rank, {_GROUP_SQL} as class_group, highway not in ('service', 'track') and p_size >= 30 as in_universe from r")
def q_road_classes(s, d):
    """Ordinal and group of a road's class; the universe: allowed classes of 30 m or more."""
    x = roads(s, d)
    h = F.col("highway")
    inside = ~h.isin("service", "track") & (F.col("p_size") >= 30)
    return x.select("route_id", "highway", text.class_rank(h).alias("class_rank"), text.class_group(h).alias("class_group"), inside.alias("in_universe"))


@query(f"with r as ({_ROAD_SQL}) select route_id, " + ", ".join(f"(highway = '{k}')::integer as is_{k}" for k in ("primary", "residential", "track")) + ", 0 as is_alley from r")
def q_one_hot(s, d):
    """Indicator columns as the training table had them: a class it never saw has none, one missing here is 0."""
    trained = ("primary", "residential", "track", "alley")
    x = roads(s, d)
    return x.select("route_id", *[(F.col("highway") == k).cast("int").alias(f"is_{k}") for k in trained])


@query("""select event_id, case when isinf(x) or isnan(x) then null else x::float end as x, (event_type = 'click')::integer as is_click from
 (select event_id, event_type, case when event_type = 'error' then 'inf'::double when event_type = 'view' then 'nan'::double else round(value, 3) end as x from events)""")
def q_clean_numbers(s, d):
    """Infinite and undefined values become null, doubles floats, flags numbers."""
    x = F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.round("value", 3))
    e = t.table(s, d, "events").withColumn("x", x)
    clean = F.when(F.isnan("x") | (F.abs("x") == float("inf")), None).otherwise(F.col("x").cast("float"))
    return e.select("event_id", clean.alias("x"), (F.col("event_type") == "click").cast("int").alias("is_click"))


@query("""with e as (select event_id, event_type, case when event_id % 7 = 0 then null else value end as v from events), m as (select round(quantile_cont(v, 0.5), 6) as med, (select event_type from e group by 1 order by count(*) desc, event_type limit 1) as mode from e)
 select event_id, round(coalesce(v, med), 6) as median_filled, round(coalesce(v, 0), 6) as zero_filled, case when event_id % 11 = 0 then mode else event_type end as mode_filled from e, m""")
def q_fill_values(s, d):
    """Missing values by the median, by zero and by the most frequent value."""
    e = t.table(s, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    med = e.agg(r6(F.percentile("v", 0.5)).alias("med"))
    mode = e.groupBy("event_type").count().agg(F.min_by("event_type", F.struct(-F.col("count"), "event_type")).alias("mode"))
    x = e.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(mode))
    return x.select("event_id", r6(F.coalesce("v", "med")).alias("median_filled"), r6(F.coalesce("v", F.lit(0.0))).alias("zero_filled"), F.when(F.col("event_id") % 11 == 0, F.col("mode")).otherwise(F.col("event_type")).alias("mode_filled"))


_REC = "select l_partkey as route_id, l_shipdate::date as date, case l_returnflag when 'A' then 'rain' when 'N' then 'tide' when 'R' then 'combined' else 'unknown' end as cause from lineitem"


@query(f"""with r as ({_REC}), g as (select route_id, bool_or(cause in ('rain', 'combined')) as rain, min(date) as first, max(date) as last from r where date < date '1995-03-01' group by 1)
 select p_partkey as route_id, coalesce(rain, false) as ever_rain, coalesce(rain and not (first = date '1995-01-15' and last = date '1995-01-15'), false) as non_event from part left join g on route_id = p_partkey""")
def q_positive_flags(s, d):
    """Routes with a positive label, and those whose label does not hang on one date alone."""
    event = F.lit("1995-01-15").cast("date")
    r = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("route_id"), F.col("l_shipdate").cast("date").alias("date"), t.cause_of(F.col("l_returnflag")).alias("cause"))
    g = r.filter(F.col("date") < F.lit("1995-03-01").cast("date")).groupBy("route_id").agg(F.bool_or(F.col("cause").isin("rain", "combined")).alias("rain"), F.min("date").alias("first"), F.max("date").alias("last"))
    x = t.table(s, d, "part").select(F.col("p_partkey").alias("route_id")).join(g, "route_id", "left")
    once = (F.col("first") == event) & (F.col("last") == event)
    return x.select("route_id", F.coalesce("rain", F.lit(False)).alias("ever_rain"), F.coalesce(F.col("rain") & ~once, F.lit(False)).alias("non_event"))


_SEASON = f"""r as ({_REC}), days as (select distinct o_orderdate::date as date from orders), pos as (select distinct date from r where cause in ('rain', 'combined')), any_report as (select distinct date from r where cause <> 'tide' or date < date '1997-01-01')"""


def season_days(s, d):
    """Days of the season, and positive days of any month, with both flags."""
    r = t.table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), t.cause_of(F.col("l_returnflag")).alias("cause"))
    flag = lambda x, name: x.select("date").distinct().withColumn(name, F.lit(True))
    days = t.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    known = r.filter((F.col("cause") != "tide") | (F.col("date") < F.lit("1997-01-01").cast("date")))
    days = days.join(flag(r.filter(F.col("cause").isin("rain", "combined")), "p"), "date", "left").join(flag(known, "k"), "date", "left")
    days = days.select("date", F.coalesce("p", F.lit(False)).alias("positive"), F.col("k").isNull().alias("no_report"), F.month("date").between(5, 11).alias("in_season"))
    return days.filter("in_season or positive")


@query(f"with {_SEASON} select date, date in (select date from pos) as positive, date not in (select date from any_report) as no_report, month(date) between 5 and 11 as in_season from days where month(date) between 5 and 11 or date in (select date from pos)")
def q_season_days(s, d):
    return season_days(s, d)


@query(f"""with {_SEASON}, x as (select date, date in (select date from pos) as positive from days where month(date) between 5 and 11 or date in (select date from pos))
 select year(date)::integer as year, count(*) as days, sum(positive::int)::bigint as positive_days, sum((positive and month(date) between 5 and 11)::int)::bigint as positive_in_season from x group by 1""")
def q_positive_day_counts(s, d):
    return season_days(s, d).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("positive").cast("long")).alias("positive_days"), F.sum((F.col("positive") & F.col("in_season")).cast("long")).alias("positive_in_season"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_shipdate < timestamp '2000-01-01' and l_partkey in (select p_partkey from part where p_size > 45)")
def q_eligible_view(s, d):
    """Later readers see the filtered view only; an id set restricts the scan."""
    t.eligible(s, d).createOrReplaceTempView("eligible_lines")
    ids = t.table(s, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return s.table("eligible_lines").join(ids, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings) select count(*) as n, sum((x between -0.2 and 0.2 and y between -0.1 and 0.3)::int)::bigint as inside,
 sum((not (x between -0.2 and 0.2 and y between -0.1 and 0.3))::int)::bigint as outside from p""")
def q_inside_box(s, d):
    p = t.table(s, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    inside = checks.within(F.col("x"), F.col("y"), -0.2, -0.1, 0.2, 0.3)
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("inside"), F.sum((~inside).cast("long")).alias("outside"))


WATER = [(1, "river", None, "line", 0.0), (2, None, "water", "polygon", 12000.0), (3, "riverbank", None, "polygon", 900.0), (4, "ditch", None, "line", 0.0), (5, None, "coastline", "line", 0.0), (6, "Canal ", None, "line", 0.0), (7, None, "wood", "polygon", 50000.0)]


@query("with " + rows_sql("p", "id, ww, nat, kind, area", WATER) + """, q as (select id, kind = 'polygon' as poly, area, lower(trim(coalesce(ww, ''))) as w, lower(trim(coalesce(nat, ''))) as n from p),
 c as (select *, poly and (n = 'water' or w in ('riverbank', 'water')) as wp, not poly and w <> '' as wl from q)
 select id, wp or wl as any_water, (wp and area > 10000) or (wl and w in ('river', 'canal')) as major_water, n = 'coastline' and not poly as coast from c""")
def q_water_classes(s, d):
    x = inline(s, "id int, ww string, nat string, kind string, area double", WATER)
    return x.select("id", *geometry.water_classes(F.col("ww"), F.col("nat"), F.col("kind") == "polygon", F.col("area")))


@query("select l_orderkey, substr(sha1(string_agg(h, '|' order by h)), 1, 20) as signature from (select l_orderkey, hex(l_partkey::varchar || ':' || l_suppkey::varchar) as h from lineitem) group by 1")
def q_piece_signature(s, d):
    """One key for a set of pieces, whatever their order."""
    h = F.hex(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).cast("binary"))
    g = t.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(h)), "|").alias("x"))
    return g.select("l_orderkey", F.substring(F.sha1(F.col("x").cast("binary")), 1, 20).alias("signature"))


@query("select o_orderkey, c_custkey, c_nationkey, round(o_totalprice, 2) as price from orders join customer on c_custkey = o_custkey")
def q_join_checked(s, d):
    """Many to one; a customer key that repeated would fail the job."""
    o = t.table(s, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return checks.to_one(o, t.table(s, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"]).select("o_orderkey", "c_custkey", "c_nationkey", F.round("o_totalprice", 2).alias("price"))


@query("select p.p_partkey, p_size, n from part p join (select l_partkey, count(*) as n from lineitem group by 1) l on l_partkey = p_partkey")
def q_join_one_to_one(s, d):
    n = t.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return checks.one_to_one(t.table(s, d, "part").select("p_partkey", "p_size"), n, ["p_partkey"]).select("p_partkey", "p_size", "n")


@query("select count(*) as missing, count(*) = 0 as is_subset from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0))")
def q_subset_check(s, d):
    part = t.table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    return checks.is_subset(part, t.table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("select c_custkey, c_nationkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey in (0, 2))")
def q_join_anti_regions(s, d):
    n = t.table(s, d, "nation").filter(F.col("n_regionkey").isin(0, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    return t.table(s, d, "customer").join(n, "c_nationkey", "left_anti").select("c_custkey", "c_nationkey")


@query("select distinct l_partkey as k from lineitem where l_quantity > 40 except select l_partkey from lineitem where l_discount > 0.09")
def q_set_except_parts(s, d):
    x = t.table(s, d, "lineitem")
    return x.filter("l_quantity > 40").select(F.col("l_partkey").alias("k")).subtract(x.filter("l_discount > 0.09").select("l_partkey"))


STREETS = [
    ("r1", "nguyen hue", True, [(0.0, 0.0), (110.0, 0.0)]),
    ("r2", "tran hung dao", True, [(0.0, 60.0), (60.0, 60.0), (60.0, 200.0)]),
    ("r3", None, False, [(300.0, 0.0), (300.0, 100.0)]),
    ("r4", "nguyen hue dai", True, [(0.0, 300.0), (200.0, 300.0)]),
    ("r5", "nguyen hue", True, [(0.0, -20.0), (110.0, -20.0)]),
]
REPORTS = [("a", "12 Nguyễn Huệ, Quận 1", "street", 50.0, 10.0), ("b", "Trần Hưng Đạo", "street", 100.0, 400.0), ("c", None, "point", 310.0, 50.0), ("d", "Le Loi", "point", 30.0, 100.0), ("e", "Nguyen Hue", "point", 50.0, -10.0), ("f", "", "area", 2000.0, 2000.0), ("g", "Nguyen Hue", "point", 10.0, 170.0)]
_SEGMENTS = [(r, n, named, *a, *b) for r, n, named, line in STREETS for a, b in zip(line, line[1:], strict=False)]


@query("with " + rows_sql("st", "route_id, name_norm, named, ax, ay, bx, by_", _SEGMENTS) + ", " + rows_sql("rec", "record_id, raw, precision_, x, y", REPORTS) + r""",
 n as (select *, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(replace(replace(string_split(coalesce(raw, ''), ',')[1], 'Đ', 'D'), 'đ', 'd'))), '[^a-z0-9 ]', ' ', 'g')), '^[0-9]+[a-z]? +', ''), '^(duong|pho) +', '')) as norm from rec),
 t as (select n.*, st.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) as u from n, st),
 dd as (select record_id, norm, precision_, route_id, any_value(name_norm) as name_norm, any_value(named) as named, min(sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by_ - ay)) ** 2)) as dist from t group by 1, 2, 3, 4),
 h as (select *, case when norm = '' or name_norm is null then 0 else len(list_intersect(string_split(norm, ' '), string_split(name_norm, ' '))) / len(list_distinct(list_concat(string_split(norm, ' '), string_split(name_norm, ' '))))::double end as sim
  from dd where dist <= case when precision_ in ('street', 'area') and norm <> '' then 500 else 150 end),
 k as (select record_id, route_id, dist, case when named and sim >= 0.55 then 0 when dist <= 40 then 1 end as r from h),
 best as (select record_id, min(struct_pack(r := r, dist := dist, route_id := route_id)) as m from k where r is not null group by 1)
 select record_id, m.route_id as route_id, case m.r when 0 then 'name+distance' when 1 then 'distance' else 'unmatched' end as match_type, round(m.dist, 6) as dist from rec left join best using (record_id)""")
def q_record_match(s, d):
    """Reports to roads: similar name and distance, else near distance alone, else unmatched."""
    seg = "array<struct<x:double,y:double>>"
    routes = inline(s, f"route_id string, name_norm string, named boolean, line {seg}", STREETS)
    records = inline(s, "record_id string, raw string, location_precision string, x double, y double", REPORTS)
    return spatial.match_records(records, routes).withColumn("dist", r6("dist"))


@query("""with s as (select vec_id, embedding[1]::double * 10 as ax, embedding[2]::double * 10 as ay, embedding[3]::double * 10 as bx, embedding[4]::double * 10 as by_ from embeddings),
 c as (select *, list_sort(list_distinct(list_concat([0.0::double, 1.0::double], [ (k - ax) / (bx - ax) for k in range(ceil(least(ax, bx))::bigint, floor(greatest(ax, bx))::bigint + 1) if bx <> ax and (k - ax) / (bx - ax) > 0 and (k - ax) / (bx - ax) < 1],
  [ (k - ay) / (by_ - ay) for k in range(ceil(least(ay, by_))::bigint, floor(greatest(ay, by_))::bigint + 1) if by_ <> ay and (k - ay) / (by_ - ay) > 0 and (k - ay) / (by_ - ay) < 1]))) as u from s),
 p as (select *, unnest(range(1, len(u))) as i from c), q as (select *, (u[i] + u[i + 1]) / 2 as m, u[i + 1] - u[i] as w from p)
 select vec_id, floor(ax + m * (bx - ax))::bigint as gx, floor(ay + m * (by_ - ay))::bigint as gy, round(sum(w * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 6) as length from q group by 1, 2, 3 having round(sum(w * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 6) > 0""")
def q_clip_to_cells(s, d):
    """Segments cut at the lines of a grid: length by cell."""
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    x = t.table(s, d, "embeddings").select("vec_id", e(0).alias("ax"), e(1).alias("ay"), e(2).alias("bx"), e(3).alias("by"))
    pieces = geometry.clip_to_cells(x, 1.0)
    return pieces.groupBy("vec_id", "gx", "gy").agg(r6(F.sum("length")).alias("length")).filter("length > 0")


_PTS = "select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, abs(embedding[3])::double as len from embeddings"


@query(f"with p as ({_PTS}) select a.id, round(sum(b.len), 6) as length_near, count(*) - 1 as others from p a join p b on sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.05 group by 1")
def q_road_density(s, d):
    """Length of the roads around each road, and their number."""
    p = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.abs(F.col("embedding")[2].cast("double")).alias("len"))
    near = spatial.distance_join(p.drop("len"), p.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), "len"), 0.05)
    return near.groupBy("id").agg(r6(F.sum("len")).alias("length_near"), (F.count(F.lit(1)) - 1).alias("others"))


@query("""with s as (select vec_id, embedding[1]::double * 300 as ax, embedding[2]::double * 300 as ay, embedding[3]::double * 300 as bx, embedding[4]::double * 300 as by_ from embeddings), l as (select *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) as len from s where ax <> bx or ay <> by_),
 k as (select *, unnest(list_concat([ (i * 15)::double for i in range(0, ceil(len / 15)::bigint)], [len])) as along from l)
 select vec_id, round(along, 6) as along, round(ax + along / len * (bx - ax), 6) as x, round(ay + along / len * (by_ - ay), 6) as y from k""")
def q_sample_points(s, d):
    """A point every 15 m along a line, and its end."""
    e = lambda i: F.col("embedding")[i].cast("double") * 300
    x = t.table(s, d, "embeddings").select("vec_id", F.array(F.struct(e(0).alias("x"), e(1).alias("y")), F.struct(e(2).alias("x"), e(3).alias("y"))).alias("line"))
    return geometry.sample_line(x, "line", 15.0).select("vec_id", r6("at").alias("along"), r6("x").alias("x"), r6("y").alias("y"))


@query("""with b as (select * from (values ('era5', 106.436::double, 10.55::double, 107.0::double, 11.05::double)) v(model, w, s, e, n)),
 k as (select *, ceil((s - 0.125) / 0.25 - 1e-10)::bigint as y0, ceil((w - 0.125) / 0.25 - 1e-10)::bigint as x0 from b)
 select model, round((y0 + i) * 0.25, 4)::double as lat, round((x0 + j) * 0.25, 4)::double as lon from k, range(0, 20) a(i), range(0, 20) c(j) where (y0 + i) * 0.25 <= n + 0.125 + 1e-9 and (x0 + j) * 0.25 <= e + 0.125 + 1e-9""")
def q_request_grid(s, d):
    """Cell centres of a quarter-degree grid that a box touches."""
    b = inline(s, "model string, w double, s double, e double, n double", [("era5", 106.436, 10.55, 107.0, 11.05)])
    return payloads.grid_points(b, 0.25)


CALLS = [(1, "2024-01-01", "2024-01-14", 9, 3), (2, "2024-01-01", "2024-01-15", 9, 3), (3, "2024-01-01", "2024-12-31", 4, 12)]


@query("with " + rows_sql("c", "id, a, b, places, vars", CALLS) + " select id, (places * ceil((date_diff('day', a::date, b::date) + 1) / 14.0) * ceil(vars / 10.0))::bigint as cost from c")
def q_request_cost(s, d):
    c = inline(s, "id int, a string, b string, places long, vars long", CALLS)
    days = F.datediff(F.col("b").cast("date"), F.col("a").cast("date")) + 1
    return c.select("id", (F.col("places") * F.ceil(days / F.lit(14)) * F.ceil(F.col("vars") / F.lit(10))).cast("long").alias("cost"))
