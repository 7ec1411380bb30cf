"""Zero-inflated features: presence, magnitude and their product for each entity, and the moments of the composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.functions.scalars import state_code


def utterance_composite(obs: DataFrame, mode: str = "reference") -> DataFrame:
    """Adds state and z: (ln x - mean) / sd over all positive rows for those, 0 for zeros, NULL for missing ones."""
    d = obs.withColumn("state", state_code(F.col("x"), mode))
    lx = F.when(F.col("x") > 0, F.ln("x"))
    stats = d.agg(F.avg(lx).alias("__m"), F.stddev_pop(lx).alias("__s"))
    d = d.crossJoin(F.broadcast(stats))
    z = (F.ln("x") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return d.withColumn("z", F.when(F.col("x") > 0, z).when(F.col("x") == 0, 0.0)).drop("__m", "__s")


def fit(obs: DataFrame, mode: str = "reference") -> DataFrame:
    """Of each entity: n_pos, n_meas, r = n_pos / n_meas (0 if none), m = mean z of positive rows, v = r m (0 if r is 0), present."""
    d = utterance_composite(obs, mode)
    pos = F.col("x") > 0
    g = d.groupBy("entity").agg(F.count_if(pos).alias("n_pos"), F.count_if(F.col("state") != 3).alias("n_meas"), F.avg(F.when(pos, F.col("z"))).alias("m"))
    r = F.coalesce(F.try_divide(F.col("n_pos").cast("double"), F.col("n_meas")), F.lit(0.0))
    return g.select("entity", "n_pos", "n_meas", r.alias("r"), "m", F.when(r > 0, r * F.col("m")).otherwise(0.0).alias("v"), (r > 0).alias("present"))


def variance(h: DataFrame) -> DataFrame:
    """phi Var(v | P) + phi (1 - phi) E[v | P]^2, with its two terms; the direct variance of v beside it."""
    p = F.col("present")
    d = h.agg(F.avg(p.cast("double")).alias("phi"), F.coalesce(F.var_pop(F.when(p, F.col("v"))), F.lit(0.0)).alias("vp"), F.coalesce(F.avg(F.when(p, F.col("v"))), F.lit(0.0)).alias("ep"), F.var_pop("v").alias("direct"))
    a, b = F.col("phi") * F.col("vp"), F.col("phi") * (1 - F.col("phi")) * F.col("ep") * F.col("ep")
    return d.select("phi", a.alias("within"), b.alias("between"), (a + b).alias("var"), "direct")


def covariance(h: DataFrame, means: DataFrame, mode: str = "reference") -> DataFrame:
    """Covariance of v with every feature's entity mean (entity, feature, x).

    Mode "reference": phi over all entities, moments over those whose mean is known, an empty side counts as 0. Mode
    "direct": the covariance over entities with a known mean. Equal where nothing is missing.
    """
    if mode == "direct":
        return h.join(means, "entity").groupBy("feature").agg(F.covar_pop("v", "x").alias("cov"))
    phi = h.agg(F.avg(F.col("present").cast("double")).alias("phi"))
    p, known = F.col("present"), F.col("x").isNotNull()
    d = h.join(means, "entity").groupBy("feature").agg(
        F.coalesce(F.covar_pop(F.when(p & known, F.col("v")), F.when(p & known, F.col("x"))), F.lit(0.0)).alias("c"), F.coalesce(F.avg(F.when(p & known, F.col("v"))), F.lit(0.0)).alias("ev"),
        F.coalesce(F.avg(F.when(p, F.col("x"))), F.lit(0.0)).alias("xp"), F.coalesce(F.avg(F.when(~p, F.col("x"))), F.lit(0.0)).alias("xa"), F.count_if(~p & known).alias("na"),
    ).crossJoin(F.broadcast(phi))
    return d.select("feature", (F.col("phi") * F.col("c") + F.when(F.col("na") > 0, F.col("phi") * (1 - F.col("phi")) * F.col("ev") * (F.col("xp") - F.col("xa"))).otherwise(0.0)).alias("cov"))


def presence_rate(obs: DataFrame, train: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each entity (of each group of by): share of positive among measured rows where `train` holds; 0 where there are none."""
    t = F.expr(train)
    g = obs.groupBy(*by, "entity").agg(F.sum(F.when(t & (F.col("x") > 0), 1).otherwise(0)).alias("p"), F.sum(F.when(t & F.col("x").isNotNull(), 1).otherwise(0)).alias("m"))
    return g.select(*by, "entity", F.coalesce(F.try_divide(F.col("p").cast("double"), F.col("m")), F.lit(0.0)).alias("rate"))
