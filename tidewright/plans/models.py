"""Catalogue, third part: components, boosted and bagged scores, horizons, streamed evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, spatial
from ..sources import tables as t
from .catalog import _POINTS, _REPORTS, HORIZONS, points, query, r6

BAGS, NEGATIVES = 30, 5


@query(f"""with recursive p as ({_POINTS}), e as (select a.id as a, b.id as b from p a join p b on a.id <> b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02),
 r as (select id, id as comp from p union select e.b, r.comp from r join e on e.a = r.id) select id, min(comp) as comp from r group by 1""")
def q_components(s, d):
    """Groups of points within 0.02 of one another, named by their least id."""
    return spatial.groups_within(points(s, d), 0.02)


_TRIGS = ", ".join(f"({h}, {x}::double)" for h, x in HORIZONS)


@query(f"select p_partkey as route_id, h::integer as horizon_h, round(p_retailprice * trig, 6) as weighted from part, (values {_TRIGS}) as v(h, trig)")
def q_join_cross_horizon(s, d):
    """Every route with every horizon; the horizons are literals, so nothing is shuffled."""
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon_h"), F.lit(x).alias("trig")) for k, x in HORIZONS])).alias("h")
    x = t.table(s, d, "part").select(F.col("p_partkey").alias("route_id"), "p_retailprice", h)
    return x.select("route_id", F.col("h.horizon_h").alias("horizon_h"), r6(F.col("p_retailprice") * F.col("h.trig")).alias("weighted"))


def vectors(s, d, positive):
    from pyspark.ml.functions import array_to_vector

    return t.table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), positive.cast("double").alias("label"))


@query()
def q_gbt_scores(s, d):
    """Boosted trees over all vectors, 160 rounds of depth 4: is the label at least 5?"""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    x = vectors(s, d, F.col("label") >= 5).persist()
    model = GBTClassifier(maxIter=160, maxDepth=4, stepSize=0.035, subsamplingRate=0.85, seed=1).fit(x)
    x.unpersist()
    return model.transform(x).select("vec_id", r6(vector_to_array("probability")[1]).alias("score"))


@query()
def q_pu_bagging(s, d):
    """Mean over bags of a logistic model: label 0 against hashed negatives, about five to a positive.  All rows are scored.

    A negative joins a bag where its hash falls below the wanted share, so a bag needs no sort and no limit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = vectors(s, d, F.col("label") == 0).persist()
    n = x.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    share = min(1.0, NEGATIVES * (n["pos"] or 0.0) / (n["neg"] or 1.0))
    models = []
    for bag in range(BAGS):
        u = F.pmod(F.xxhash64("vec_id", F.lit(bag)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        models.append(LogisticRegression(regParam=0.01, maxIter=50).fit(x.filter((F.col("label") == 1) | (u < share))))
    x.unpersist()
    margin = lambda m: F.aggregate(
        F.zip_with("v", F.array(*[F.lit(float(c)) for c in m.coefficients]), lambda a, b: a * b), F.lit(float(m.intercept)), lambda a, b: a + b
    )
    v = x.select("vec_id", vector_to_array("features").alias("v"))
    total = sum((1 / (1 + F.exp(-margin(m))) for m in models), F.lit(0.0))
    return v.select("vec_id", r6(total / F.lit(float(BAGS))).alias("score"))


@query(f"""with r as (select * from ({_REPORTS}) where status is not null), m as (select route_id, max(ts) as last from r group by 1)
 select route_id::bigint as route_id, round(sum(case when status = 'dry' then -ln(3.0::double) when official then ln(10.0::double) else ln(3.0::double) end * power(0.5::double, epoch(last - ts) / 1800.0::double)), 6) as log_odds
 from r join m using (route_id) group by 1""")
def stream_evidence(s, d):
    """Decayed log-odds by route at its latest report, by keyed state."""
    from ..streaming.jobs import evidence
    from ..streaming.run import latest

    rows = t.reports(s, d).withColumn("route_id", F.col("route_id").cast("long"))
    return latest(s, rows, evidence, "route_id").select("route_id", r6("log_odds").alias("log_odds"))
