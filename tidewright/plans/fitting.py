"""Catalogue, ninth part: pooled triggers, boosted models and what is kept of them, resampled comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, pooled, resampling, selection
from ..sources import tables as t
from ..sources.shared import staged, staged_path
from .catalog import _SCORED, query, r6, scored
from .evaluation import _W, REPS

#: Trees of the queries; the operator's own default is 160.
GROWTH = boosting.Growth(rounds=16, rate=0.2)
SETS = [["f1"], ["f1", "f2"], ["f1", "f2", "f3"]]


def shipped_days(s, d):
    """(date, year, city, f1, f2, f3, label) by day and line status: three totals and whether returns exceed a share."""
    x = t.table(s, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_linestatus").alias("city"))
    x = x.agg(F.max("l_extendedprice").alias("f1"), F.sum("l_quantity").alias("f2"), F.avg("l_discount").alias("f3"), (F.count_if(F.col("l_returnflag") == "R") * 2 > F.count(F.lit(1))).cast("int").alias("label"))
    return x.withColumn("year", F.year("date"))


def _pooled(s, d):
    days = pooled.log_odds_of_rank(shipped_days(s, d), ["f1", "f2", "f3"])
    return days, pooled.fit(days, ["f1", "f2", "f3"], SETS, "label", "year", "city")


@query()
def q_pooled_folds(s, d):
    """AUC and AP of every left-out year and feature set, all fitted together."""
    days, model = _pooled(s, d)
    x = pooled.yearly(days, model, "label", "year")
    return x.select("set", "year", "pos", "n", r6("auc").alias("auc"), r6("ap").alias("ap"))


@query()
def q_pooled_trigger(s, d):
    """The probability of every day by the feature set that is best in left-out years."""
    days, model = _pooled(s, d)
    best = pooled.chosen(pooled.yearly(days, model, "label", "year"))
    if (best, None) not in model.found:
        return days.select("date", "city", F.lit(best).alias("set"), F.lit(None).cast("double").alias("trigger"))
    return model.score(days, best, "trigger").select("date", "city", F.lit(best).alias("set"), r6("trigger").alias("trigger"))


def spread(s, d):
    """(vec_id, f0 .. f63, label): every vector's numbers as columns."""
    e = t.table(s, d, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)], (F.col("label") >= 5).cast("int").alias("label"))


FEATURES = [f"f{i}" for i in range(64)]


@query()
def q_leafwise_scores(s, d):
    """Boosted trees grown leaf by leaf over all numbers of all vectors."""
    x = spread(s, d)
    return boosting.fit(x, FEATURES, "label", "vec_id", growth=GROWTH).score(x, "score").select("vec_id", r6("score").alias("score"))


@query()
def q_monotone_scores(s, d):
    """The same with directions: the first eight numbers may only raise the score, the next eight only lower it."""
    x, p = spread(s, d), boosting.replace(GROWTH, depth=3, leaves=5, l2=12.0, l1=0.0, least_rows=20, monotone=(1,) * 8 + (-1,) * 8 + (0,) * 48)
    return boosting.fit(x, FEATURES, "label", "vec_id", growth=p).score(x, "score").select("vec_id", r6("score").alias("score"))


@query()
def q_stored_model(s, d):
    """A model of the orders before a cut-off, written, read back and scored over all orders by column functions."""
    lines = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    x = t.table(s, d, "orders").join(lines, "o_orderkey", "left").withColumn("label", (F.col("o_totalprice") > 200_000).cast("int"))
    features = ["n", "quantity", "discount"]
    x = staged(x.select("o_orderkey", "o_orderdate", "label", *features), "orders")  # fitting and scoring read it six times
    live = boosting.fit_before(x, "o_orderdate", "1998-01-01", features, "label", "o_orderkey", growth=boosting.replace(GROWTH, rounds=10, columns=1.0))
    path = staged_path(s, "model")
    live.save(s, path)
    kept = boosting.load(s, path)
    return kept.score(x, "score").select("o_orderkey", r6("score").alias("score"), F.lit(kept.about["max_training_date"]).alias("fitted_to"))


_LONG = "select vec_id, i - 1 as dim, floor(embedding[i]::double * 20)::bigint as bin, (label >= 5)::int as y from (select vec_id, label, embedding, unnest(range(1, 65)) as i from embeddings)"


@query(f"""with x as ({_LONG}), m as (select avg(y) as p, count(*) as n, sum(y) as pos from (select distinct vec_id, y from x)), b as (select dim, bin, sum(m.p - y) as g, count(*) * any_value(m.p * (1 - m.p)) as h, count(*) as n from x, m group by 1, 2),
 c as (select dim, bin, sum(g) over w as g, sum(h) over w as h, sum(n) over w as n, sum(g) over (partition by dim) as tg, sum(h) over (partition by dim) as th, sum(n) over (partition by dim) as tn from b window w as (partition by dim order by bin)),
 s as (select dim, bin, greatest(abs(g) - 1.5::double, 0) ** 2 / (h + 8) + greatest(abs(tg - g) - 1.5::double, 0) ** 2 / (th - h + 8) - greatest(abs(tg) - 1.5::double, 0) ** 2 / (th + 8) as gain from c where n >= 30 and tn - n >= 30)
 select dim, round(max(gain), 6) as gain from s group by 1 having max(gain) > 0.000001""")
def q_split_gains(s, d):
    """What the first split on each number alone would gain, values in bins of a twentieth."""
    e = t.table(s, d, "embeddings").select((F.col("label") >= 5).cast("int").alias("y"), F.posexplode("embedding").alias("dim", "v"))
    x = e.select(F.col("dim").cast("long").alias("dim"), F.floor(F.col("v").cast("double") * 20).alias("bin"), "y")
    return boosting.first_gains(x, "dim", "bin", "y").filter("gain > 0.000001").select("dim", r6("gain").alias("gain"))


_HASH = "('0x' || substr(md5({key} || '-' || {y} || '-' || rep), 1, 8))::bigint"


def _draws(name: str, score: str, label: str) -> str:
    """SQL: replicates of a score and a label, classes drawn apart."""
    n = f"{name}_"
    return f"""{n}e as (select doc_id, lang, ({score})::double as s, {label} as y, unnest(range({REPS})) as rep from x), {n}u as (select *, {_HASH.format(key="doc_id", y=label)} as u from {n}e join x using (doc_id)),
 {n}w as (select rep, {n}u.lang, s, y, {_W} as w from {n}u), {n}t as (select rep, sum(w * y) as sp, sum(w * (1 - y)) as sz, sum(y) as np, sum(1 - y) as nz from {n}w group by 1),
 {n}b as (select rep, lang, s, sum(w * y) * any_value(np / sp::double) as p, sum(w * (1 - y)) * any_value(nz / sz::double) as z from {n}w join {n}t using (rep) group by 1, 2, 3),
 {n}k as (select *, sum(p + z) over (partition by rep order by s desc) as seen, sum(p) over (partition by rep order by s desc) as tp, sum(p) over (partition by rep) as pos, sum(z) over (partition by rep) as neg, sum(z) over (partition by rep order by s) - z / 2 as below
   from (select rep, s, sum(p) as p, sum(z) as z from {n}b group by 1, 2)),
 {n}o as (select rep, sum(p * least(greatest(0.1::double * (pos + neg) - (seen - p - z), 0), p + z) / nullif(p + z, 0)) / any_value(pos) as recall, sum(p * below) / (any_value(pos) * any_value(neg)) as auc, sum(p * tp / nullif(seen, 0)) / any_value(pos) as ap, any_value(pos / (pos + neg)) as share from {n}k group by 1),
 {n}g as (select *, sum(p + z) over (partition by rep, lang order by s desc) as seen, sum(p) over (partition by rep, lang) as pos, sum(z) over (partition by rep, lang) as neg, sum(z) over (partition by rep, lang order by s) - z / 2 as below from {n}b),
 {n}h as (select rep, lang, any_value(pos) as pos, any_value(neg) as neg, sum(p * least(greatest(0.1::double * (pos + neg) - (seen - p - z), 0), p + z) / nullif(p + z, 0)) / nullif(any_value(pos), 0) as recall, sum(p * below) / nullif(any_value(pos) * any_value(neg), 0) as auc from {n}g group by 1, 2),
 {n}s as (select rep, sum(case when pos > 0 and neg > 0 then recall * pos else 0 end) / sum(pos) as strat_recall, sum(auc * pos) filter (where pos > 0 and neg > 0) / sum(pos) filter (where pos > 0 and neg > 0) as strat_auc from {n}h group by 1),
 {n}r as (select rep, recall, auc, ap, recall / share as lift, strat_recall, strat_auc from {n}o join {n}s using (rep))"""


@query(f"""with x as ({_SCORED}), {_draws("a", "score", "quality")} select metric, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from (unpivot a_r on recall, auc, ap, lift, strat_recall, strat_auc into name metric value v) group by 1""")
def q_class_intervals(s, d):
    """Intervals of the ranking metrics, positives and negatives resampled apart."""
    x = resampling.replicates(scored(s, d), "doc_id", "quality", "score", "lang", REPS)
    return resampling.intervals(x, [*resampling.METRICS, "strat_recall", "strat_auc"]).select("metric", r6("low").alias("low"), r6("high").alias("high"))


_OTHER = "doc_id % 89"


@query(f"""with x as ({_SCORED}), {_draws("a", "score", "quality")}, {_draws("b", _OTHER, "quality")}, {_draws("c", "score", "toxic")}, {_draws("f", _OTHER, "toxic")},
 m as (select a_r.rep, (a_r.recall + c_r.recall) / 2 as a, (b_r.recall + f_r.recall) / 2 as b, (a_r.strat_recall + c_r.strat_recall) / 2 as sa, (b_r.strat_recall + f_r.strat_recall) / 2 as sb from a_r join b_r using (rep) join c_r using (rep) join f_r using (rep)),
 o as (select avg(a - b) as delta, quantile_cont(a - b, 0.025) as low, quantile_cont(a - b, 0.975) as high, avg((a > b)::int) as p_better, avg(sa - sb) as head_delta from m)
 select round(delta, 6) as delta, round(low, 6) as low, round(high, 6) as high, round(p_better, 6) as p_better, round(head_delta, 6) as head_delta, p_better >= 0.9 and head_delta >= -0.01 as keep from o""")
def q_keep_rule(s, d):
    """Whether one scorer replaces another: both on the same draws over two tasks."""
    x = scored(s, d).withColumn("other", (F.col("doc_id") % 89).cast("double"))
    of = lambda c: {y: resampling.replicates(x, "doc_id", y, c, "lang", REPS) for y in ("quality", "toxic")}
    out = resampling.keep_rule(of("score"), of("other"))
    return out.select(*resampling.rounded(out, "keep"))


@query()
def q_candidate_folds(s, d):
    """Trigger candidates over days left out by year, the index chosen inside each fold, and the one that is best."""
    days = shipped_days(s, d).groupBy("date", "year").agg(F.max("f1").alias("a"), F.sum("f2").alias("b"), F.avg("f3").alias("c"), F.count(F.lit(1)).cast("double").alias("d"), F.max("label").alias("label"))
    x = selection.compared(selection.left_out(days, ["a", "b", "c", "d"], "label", "year"))
    chosen = selection.best(x)
    return x.select("candidate", r6("auc").alias("auc"), r6("ap").alias("ap"), "n", (F.col("candidate") == chosen).alias("chosen"))
