"""Catalogue, seventh part: sampling, folds, rule scorers, grouped metrics, resampled comparisons, day-level capture."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import sampling, scorers
from ..sources import tables as t
from .catalog import _SCORED, query, r6, scored
from .decisions import _DAYS_T, labelled_days
from .scoring import POISSON

_CAP = 300


@query(f"""with p as (select p_partkey as id, p_size, p_type <> 'ECONOMY' as u, p_partkey in (select l_partkey from lineitem where l_quantity >= 49 and l_discount >= 0.085) as known from part),
 k as (select *, row_number() over (order by md5(id::varchar || '-7'), id) as rn from p where u and not known)
 select id, known::integer as label, case when known then 1.0::double else 0.2::double end as weight from p where u and known union all select id, 0, 0.2::double from k where rn <= {_CAP}""")
def q_capped_sample(s, d):
    """All known routes and a capped sample of the others by hash, with weights; the cap is the sampling operator's own."""
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_type") != "ECONOMY").alias("u"))
    known = t.records(s, d).select(F.col("route_id").alias("id")).distinct().withColumn("known", F.lit(True))
    x = p.join(known, "id", "left").filter("u").withColumn("known", F.coalesce("known", F.lit(False)))
    rest = sampling.hashed(x.filter("not known"), "id", 7, _CAP)
    both = x.filter("known").select("id", F.lit(1).alias("label"), F.lit(1.0).alias("weight"))
    return both.unionByName(rest.select("id", F.lit(0).alias("label"), F.lit(0.2).alias("weight")))


@query("""with p as (select vec_id, floor(embedding[1]::double * 20)::bigint as bx, floor(embedding[2]::double * 20)::bigint as by_ from embeddings), b as (select bx, by_, count(*) as n from p group by 1, 2)
 select bx, by_, n from b""")
def q_spatial_blocks(s, d):
    """Rows by block of the plane: what the folds are dealt from."""
    return sampling.blocks(t.table(s, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 20).alias("x"), (F.col("embedding")[1].cast("double") * 20).alias("y")), 1.0).groupBy("bx", "by_").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_spatial_folds(s, d):
    """Five folds of whole blocks, dealt largest first to the emptiest fold; blocks are few and dealt on the driver."""
    x = t.table(s, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 20).alias("x"), (F.col("embedding")[1].cast("double") * 20).alias("y"))
    return sampling.folds(x, 1.0, 5).select("vec_id", "fold")


@query("""with x as (select doc_id, quality, n_chars, lang, row_number() over (order by n_chars, doc_id) as rn, count(*) over () as n from documents join labels using (doc_id)),
 k as (select doc_id, quality, lang || '|' || greatest(0, ceil((rn - 1) * 3 / (n - 1)::double) - 1)::bigint as key from x), m as (select key, greatest(1, sum((quality = 0)::int)) as want from k where key in (select key from k where quality = 0) group by 1),
 c as (select doc_id, key, row_number() over (partition by key order by md5(doc_id::varchar || '-3'), doc_id) as place from k where quality = 1)
 select c.doc_id, c.key from c join m using (key) where place <= want""")
def q_matched_rows(s, d):
    """For every stratum with rare rows, as many others from the same stratum by hash."""
    x = scored(s, d).join(t.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    x = stats.row_ranks(x.withColumn("_m", -F.col("n_chars")), "_m", F.col("doc_id"))
    x = x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n_all"))))
    key = F.concat_ws("|", "lang", stats.rank_bins(F.col("rn"), F.col("n_all"), 3).cast("long").cast("string"))
    return sampling.matched(x.select("doc_id", key.alias("key"), (F.col("quality") == 0).alias("rare")), "doc_id", "key", "rare", 3)


@query("""with m as (select round(quantile_cont(p_retailprice, 0.5), 6) as price, round(quantile_cont(case when p_size > 25 then p_size end, 0.5), 6) as size from part)
 select p_partkey, round(-coalesce(p_retailprice, price), 6) as lowest, round(-coalesce(case when p_size > 25 then p_size end, size), 6)::double as nearest, coalesce(case when p_size <= 40 then p_size end, 0)::double as ranked from part, m""")
def q_rule_scores(s, d):
    """Scorers without a fit, through the registry: low is likely, near is likely, rank is likely; missing by median or 0."""
    x = t.table(s, d, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("near"), F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("rank"))
    for name, rule in (("lowest", scorers.Rule("p_retailprice", -1, "median")), ("nearest", scorers.Rule("near", -1, "median")), ("ranked", scorers.Rule("rank", 1, "zero"))):
        x = scorers.score(rule, x, x, name)
    return x.select("p_partkey", *[r6(c).alias(c) for c in ("lowest", "nearest", "ranked")])


@query("""with m as (select round(quantile_cont(value, 0.5), 6) as med, (select event_type from events where event_id % 2 = 0 group by 1 order by count(*) desc, event_type limit 1) as mode from events where event_id % 2 = 0)
 select event_id, med as value, mode as event_type from events, m where event_id % 2 = 1""")
def q_nuisance_replaced(s, d):
    """Exposure columns take the training rows' median or most frequent value before scoring."""
    e = t.table(s, d, "events").select("event_id", "event_type", "value")
    return scorers.neutral(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["value"], ["event_type"]).select("event_id", r6("value").alias("value"), "event_type")


_G = f"x as ({_SCORED}), g as (select lang, score, sum(quality) as p, count(*) - sum(quality) as z, count(*) as c from x group by 1, 2), k as (select *, sum(p) over w as tp, sum(c) over w as seen, sum(z) over (partition by lang order by score) - z / 2.0::double as below, sum(p) over (partition by lang) as pos, sum(z) over (partition by lang) as neg, sum(c) over (partition by lang) as n from g window w as (partition by lang order by score desc))"


@query(f"""with {_G}, m as (select lang, any_value(pos)::bigint as pos, any_value(n)::bigint as n, sum(p * below) / nullif(any_value(pos) * any_value(neg), 0) as auc, sum(p * tp / seen::double) / nullif(any_value(pos), 0) as ap, sum(p * least(greatest(0.1::double * n - (seen - c), 0), c) / c) / nullif(any_value(pos), 0) as recall from k group by 1)
 select lang, pos, n, round(auc, 6) as auc, round(ap, 6) as ap, round(recall, 6) as recall, round(recall / (pos / n::double), 6) as lift from m""")
def q_group_metrics(s, d):
    """AUC, average precision, recall at a tenth with shared ties, and lift, by group."""
    m = stats.group_metrics(scored(s, d), "lang", "score", "quality")
    return m.select("lang", "pos", "n", *[r6(c).alias(c) for c in ("auc", "ap", "recall", "lift")])


@query(f"""with {_G}, m as (select lang, any_value(pos) as pos, any_value(neg) as neg, sum(p * below) / nullif(any_value(pos) * any_value(neg), 0) as auc, sum(p * least(greatest(0.1::double * n - (seen - c), 0), c) / c) as hits from k group by 1)
 select round(sum(hits) / sum(pos), 6) as strat_recall, round(sum(auc * pos) filter (where neg > 0 and pos > 0) / sum(pos) filter (where neg > 0 and pos > 0), 6) as strat_auc from m""")
def q_stratified_metrics(s, d):
    """Recall and AUC within groups, pooled by positives."""
    m = stats.group_metrics(scored(s, d), "lang", "score", "quality")
    both = F.when(F.col("auc").isNotNull(), F.col("pos"))
    return m.agg(r6(F.sum(F.col("recall") * F.col("pos")) / F.sum("pos")).alias("strat_recall"), r6(F.sum(F.col("auc") * both) / F.sum(both)).alias("strat_auc"))


_LONG = "select i - 1 as dim, label >= 5 as y, embedding[i]::double as v from (select label, embedding, unnest(range(1, 65)) as i from embeddings)"


@query(f"""with f as ({_LONG}), g as (select dim, v, sum(y::int) as p, sum((not y)::int) as z, count(*) as c from f group by 1, 2), k as (select *, sum(z) over (partition by dim order by v) - z / 2.0::double as below, sum(c) over (partition by dim order by v desc) as seen_hi, sum(c) over (partition by dim order by v) as seen_lo, sum(c) over (partition by dim) as n from g),
 m as (select dim, sum(p * below) / (sum(p) * sum(z)) as auc, sum(p * least(greatest(ceil(0.1::double * n) - (seen_hi - c), 0), c) / c) / sum(p) as hi, sum(p * least(greatest(ceil(0.1::double * n) - (seen_lo - c), 0), c) / c) / sum(p) as lo from k group by 1)
 select dim, round(greatest(auc, 1 - auc), 6) as auc, case when auc >= 0.5 then 'high' else 'low' end as direction, round(case when auc >= 0.5 then hi else lo end, 6) as recall from m""")
def q_feature_audit(s, d):
    """Every feature alone: AUC in its better direction and recall at a tenth; all features in one pass of long rows."""
    x = t.table(s, d, "embeddings").select((F.col("label") >= 5).cast("long").alias("y"), F.posexplode("embedding").alias("dim", "v"))
    return stats.feature_audit(x.select(F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v"), "y")).select("dim", r6("auc").alias("auc"), "direction", r6("recall").alias("recall"))


@query(f"""with f as ({_LONG}), g as (select dim, v, sum(y::int) as p, sum((not y)::int) as z from f group by 1, 2), k as (select *, sum(z) over (partition by dim order by v) - z / 2.0::double as below from g), m as (select dim, round(greatest(sum(p * below) / (sum(p) * sum(z)), 1 - sum(p * below) / (sum(p) * sum(z))), 6) as auc from k group by 1)
 select dim, auc, rank::bigint as rank from (select *, row_number() over (order by auc desc, dim) as rank from m) where rank <= 15""")
def q_top_features(s, d):
    """The 15 best features by AUC."""
    x = t.table(s, d, "embeddings").select((F.col("label") >= 5).cast("long").alias("y"), F.posexplode("embedding").alias("dim", "v"))
    a = stats.feature_audit(x.select(F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v"), "y")).select("dim", r6("auc").alias("auc"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("auc"), "dim")  # one row a feature
    return a.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 15")


_U = "('0x' || substr(md5({key} || '-' || rep), 1, 8))::bigint"
_W = " + ".join(f"(u >= {int(p * 2**32)})::int" for p in POISSON)
REPS = 200


@query(f"""with {_DAYS_T}, rules as (select date, (t >= 0.45)::int::double as a, (t >= 0.5)::int::double as b, unnest(range({REPS})) as rep from lab), y as (select *, {_U.format(key="date::varchar")} as u from rules),
 z as (select rep, sum(a * ({_W})) / nullif(sum({_W}), 0) as ma, sum(b * ({_W})) / nullif(sum({_W}), 0) as mb from y group by 1)
 select round(avg(ma - mb), 6) as delta, round(quantile_cont(ma - mb, 0.025), 6) as low, round(quantile_cont(ma - mb, 0.975), 6) as high, round(avg((ma > mb)::int), 6) as p_better from z""")
def q_paired_days(s, d):
    """Two rules on the same days: the difference over resampled days with shared weights, and how often the first leads."""
    x = labelled_days(s, d).select("date", (F.col("t") >= 0.45).cast("double").alias("a"), (F.col("t") >= 0.5).cast("double").alias("b"))
    z = sampling.resampled(x, F.col("date").cast("string"), REPS, {"ma": "a", "mb": "b"})
    gap = F.col("ma") - F.col("mb")
    return z.agg(r6(F.avg(gap)).alias("delta"), r6(F.percentile(gap, 0.025)).alias("low"), r6(F.percentile(gap, 0.975)).alias("high"), r6(F.avg((gap > 0).cast("int"))).alias("p_better"))


@query(f"""with x as ({_SCORED}), e as (select doc_id, quality, score, unnest(range({REPS})) as rep from x), y as (select *, {_U.format(key="doc_id")} as u from e), w as (select rep, score, sum(case when quality = 1 then {_W} else 0 end) as p, sum(case when quality = 0 then {_W} else 0 end) as z from y group by 1, 2),
 k as (select *, sum(z) over (partition by rep order by score) - z / 2.0::double as below from w), a as (select rep, sum(p * below) / nullif(sum(p) * sum(z), 0) as auc from k group by 1)
 select round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high from a""")
def q_auc_interval(s, d):
    """Interval of the AUC by resampling: rows collapse to scores by replicate, running totals go by replicate and range."""
    x = sampling.weighted(scored(s, d).select("doc_id", "score", "quality"), F.col("doc_id").cast("string"), REPS)
    by = x.groupBy("rep", "score").agg(F.sum(F.col("quality") * F.col("w")).alias("p"), F.sum((1 - F.col("quality")) * F.col("w")).alias("z"))
    k = stats.running(by, "score", {"zc": "z"}, ("rep",)).withColumn("below", F.col("zc") - F.col("z") / F.lit(2.0))
    a = k.groupBy("rep").agg(F.try_divide(F.sum(F.col("p") * F.col("below")), F.sum("p") * F.sum("z")).alias("auc"))
    return a.agg(r6(F.percentile("auc", 0.025)).alias("low"), r6(F.percentile("auc", 0.975)).alias("high"))


@query(f"""with {_DAYS_T}, k as (select date, case when pos then 'flood' when t >= 0.45 then 'rainy' else 'dry' end as day_type, case when t >= 0.5 then 2 when t >= 0.45 then 1 else 0 end as state from lab)
 select day_type, count(*) as days, round(avg((state >= 1)::int), 6) as watch_share, round(avg((state = 2)::int), 6) as alert_share from k group by 1""")
def q_state_by_day_type(s, d):
    """How often each type of day is in watch or alert."""
    k = labelled_days(s, d).select(F.when(F.col("pos"), "flood").when(F.col("t") >= 0.45, "rainy").otherwise("dry").alias("day_type"), F.when(F.col("t") >= 0.5, 2).when(F.col("t") >= 0.45, 1).otherwise(0).alias("state"))
    return k.groupBy("day_type").agg(F.count(F.lit(1)).alias("days"), r6(F.avg((F.col("state") >= 1).cast("int"))).alias("watch_share"), r6(F.avg((F.col("state") == 2).cast("int"))).alias("alert_share"))


_CAPTURE = """x as (select l_shipdate::date as date, l_partkey as route_id, count(*) as n from lineitem where l_quantity >= 49 group by 1, 2), b as (select p_partkey as route_id, row_number() over (order by p_retailprice desc, p_partkey) as rn, count(*) over () as n_all from part)"""


@query(f"""with {_CAPTURE}, h as (select date, x.route_id, x.n, (rn <= greatest(1, ceil(n_all * 0.05::double)))::int as top5, (rn <= greatest(1, ceil(n_all * 0.2::double)))::int as top20 from x join b using (route_id)),
 dd as (select date, avg(top5) as d5, avg(top20) as d20, sum(n * top5) as r5, sum(n * top20) as r20, sum(n) as n from h group by 1)
 select round(avg(d5), 6) as day_hit_5, round(avg(d20), 6) as day_hit_20, round(sum(r5) / sum(n), 6) as record_capture_5, round(sum(r20) / sum(n), 6) as record_capture_20, count(*) as days from dd""")
def q_day_capture(s, d):
    """Share of reported routes inside the budget by day, then over days; and the same by records."""
    x = t.table(s, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").alias("route_id")).agg(F.count(F.lit(1)).alias("n"))
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("route_id"), "p_retailprice")
    rank = stats.row_ranks(p, "p_retailprice", F.col("route_id")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n_all"))))
    top = lambda share: (F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n_all") * F.lit(share)))).cast("int")
    h = x.join(rank.select("route_id", top(0.05).alias("top5"), top(0.2).alias("top20")), "route_id")
    day = h.groupBy("date").agg(F.avg("top5").alias("d5"), F.avg("top20").alias("d20"), F.sum(F.col("n") * F.col("top5")).alias("r5"), F.sum(F.col("n") * F.col("top20")).alias("r20"), F.sum("n").alias("n"))
    return day.agg(r6(F.avg("d5")).alias("day_hit_5"), r6(F.avg("d20")).alias("day_hit_20"), r6(F.sum("r5") / F.sum("n").cast("double")).alias("record_capture_5"), r6(F.sum("r20") / F.sum("n").cast("double")).alias("record_capture_20"), F.count(F.lit(1)).alias("days"))


@query("""with h as (select event_type as source, ts::date as date, max(value) as mx, sum(value) as tot from events group by 1, 2), lab as (select ts::date as date, sum((event_type = 'purchase')::int) > sum((event_type = 'error')::int) + 4 as pos from events group by 1),
 sp as (select s.source, l.date, l.pos from (select distinct event_type as source from events) s, lab l), x as (select source, pos, coalesce(mx, 0) as v, coalesce(tot, 0) as tot from sp left join h using (source, date)),
 g as (select source, v, sum(pos::int) as p, sum((not pos)::int) as z from x group by 1, 2), k as (select *, sum(z) over (partition by source order by v) - z / 2.0::double as below from g), a as (select source, sum(p * below) / nullif(sum(p) * sum(z), 0) as auc from k group by 1)
 select source, round(auc, 6) as auc, round((select avg((tot < 500)::int) from x where x.source = a.source and pos), 6) as low_share from a""")
def q_rain_sources(s, d):
    """Sources compared on the same calendar: AUC of the daily maximum, and the share of reported days with little rain."""
    e = t.table(s, d, "events").withColumn("date", F.col("ts").cast("date")).withColumnRenamed("event_type", "source")
    h = e.groupBy("source", "date").agg(F.max("value").alias("mx"), F.sum("value").alias("tot"))
    lab = e.groupBy("date").agg((F.count_if(F.col("source") == "purchase") > F.count_if(F.col("source") == "error") + 4).alias("pos"))
    names = e.select("source").distinct()
    spine = lab.crossJoin(F.broadcast(names))  # a handful of sources
    x = spine.join(h, ["source", "date"], "left").select("source", F.col("pos").cast("long").alias("pos"), F.coalesce("mx", F.lit(0.0)).alias("v"), F.coalesce("tot", F.lit(0.0)).alias("tot"))
    m = stats.group_metrics(x, "source", "v", "pos").select("source", "auc")
    low = x.filter("pos = 1").groupBy("source").agg(r6(F.avg((F.col("tot") < 500).cast("int"))).alias("low_share"))
    return m.join(low, "source", "left").select("source", r6("auc").alias("auc"), "low_share")


@query(f"""with {_G}, m as (select lang, sum(p * least(greatest(0.1::double * n - (seen - c), 0), c) / c) / nullif(any_value(pos), 0) as recall from k group by 1)
 select round(avg(recall), 6) as headline, round(min(recall), 6) as worst, avg(recall) >= 0.1 and min(recall) >= 0.05 as keep from m where recall is not null""")
def q_headline(s, d):
    """The mean over tasks that decides whether a scorer stays."""
    m = stats.group_metrics(scored(s, d), "lang", "score", "quality").filter("recall is not null")
    return m.agg(r6(F.avg("recall")).alias("headline"), r6(F.min("recall")).alias("worst"), ((F.avg("recall") >= 0.1) & (F.min("recall") >= 0.05)).alias("keep"))


@query(f"""with x as ({_SCORED}), a as (select doc_id, quality, lang, score as s1, doc_id % 89 as s2 from x) select lang, count(*) as n, round(avg(s1 - s2), 6) as mean_gap, sum((s1 > s2)::int)::bigint as first_leads from a group by 1""")
def q_paired_scores(s, d):
    """Two scorers on the same rows, matched by key."""
    a = scored(s, d).select("doc_id", "lang", F.col("score").alias("s1"))
    b = scored(s, d).select("doc_id", (F.col("doc_id") % 89).alias("s2"))
    x = a.join(b, "doc_id")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("s1") - F.col("s2"))).alias("mean_gap"), F.sum((F.col("s1") > F.col("s2")).cast("long")).alias("first_leads"))


@query()
def q_trigger_folds(s, d):
    """Trigger candidates on held-out days: AUC by candidate, from models that never saw the day.  One row a day is kept."""
    return scorers.left_out(labelled_days(s, d).select("date", "t", F.col("pos").cast("double").alias("label"), (F.dayofmonth("date") % 3).alias("group")).persist(), ["t"])


@query()
def q_exposure_scores(s, d):
    """Cross-fitted propensity: each row is scored by a model of the other folds; missing values by the median."""
    x = t.table(s, d, "embeddings").select("vec_id", *[F.when(F.col("vec_id") % 13 != i, F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(4)], (F.col("label") >= 5).cast("double").alias("label"))
    return scorers.cross_fitted(x, "vec_id", [f"f{i}" for i in range(4)], 5).select("vec_id", r6("score").alias("score"))


@query()
def q_spline_scores(s, d):
    """Quantile bins of each feature as indicators, then a logistic model."""
    x = t.table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(4)], (F.col("label") >= 5).cast("double").alias("label"))
    return scorers.spline(x, [f"f{i}" for i in range(4)], 5).select("vec_id", r6("score").alias("score"))


@query()
def q_forest_scores(s, d):
    """A forest over all vectors and the weight of its features."""
    x = t.table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(8)], (F.col("label") >= 5).cast("double").alias("label"))
    return scorers.forest(x, [f"f{i}" for i in range(8)]).select("vec_id", r6("score").alias("score"))
