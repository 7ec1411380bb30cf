"""Entity statistics of long observation tables: moments, variance components, quality summaries. NULL is missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgrain.functions import scalars


def zscore(df: DataFrame, column: str, by: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """Adds z: distance from the mean in standard deviations over measured rows; a deviation of 0 divides by 1."""
    sd = F.stddev_pop(column) if ddof == 0 else F.stddev_samp(column)
    stats = df.groupBy(*(by or [])).agg(F.avg(column).alias("__m"), sd.alias("__s"))
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn("z", (F.col(column) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def entity_moments(obs: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """n, mean and ss (squared distance from the mean) of each entity with measured rows; summed on the map side."""
    return obs.where("x is not null").groupBy(*by, "entity").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("ss"))


def variance_components(obs: DataFrame, by: tuple[str, ...] = ("feature",), anova: bool = False) -> DataFrame:
    """One-way random effects, unbalanced: f_star, icc, sigma_b2, sigma_w2, n, s; NULL where N <= S or S < 2.

    n0 = (N - sum n_i^2 / N) / (S - 1); sigma_b2 = max((MSB - MSW) / n0, 0), sigma_w2 = MSW. With anova also f = MSB / MSW.
    """
    n, mean = F.col("n"), F.col("mean")
    m = entity_moments(obs, by).groupBy(*by).agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("S"), F.sum(n * n).alias("n2"), F.sum(n * mean).alias("t1"), F.sum(n * mean * mean).alias("t2"), F.sum("ss").alias("ssw"))
    ok = (F.col("S") >= 2) & (F.col("N") > F.col("S"))
    msb = F.greatest((F.col("t2") - F.col("t1") * F.col("t1") / F.col("N")), F.lit(0.0)) / F.nullif(F.col("S") - 1, F.lit(0))
    msw = F.col("ssw") / F.nullif(F.col("N") - F.col("S"), F.lit(0))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / F.nullif(F.col("S") - 1, F.lit(0))
    m = m.select(*by, F.col("N").alias("n"), F.col("S").alias("s"), F.when(ok, msb).alias("msb"), F.when(ok, msw).alias("msw"), F.when(ok, n0).alias("n0"))
    b = F.greatest(F.try_divide(F.col("msb") - F.col("msw"), F.col("n0")), F.lit(0.0))
    m = m.withColumn("sigma_b2", F.when(F.col("n0").isNotNull(), b)).withColumnRenamed("msw", "sigma_w2")
    out = [F.when(F.col("sigma_w2") > 0, F.col("sigma_b2") / F.col("sigma_w2")).alias("f_star"), F.try_divide(F.col("sigma_b2"), F.col("sigma_b2") + F.col("sigma_w2")).alias("icc"), "sigma_b2", "sigma_w2", "n", "s"]
    return m.select(*by, *out, *([F.when(F.col("sigma_w2") > 0, F.col("msb") / F.col("sigma_w2")).alias("f")] if anova else []))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) by the regularised incomplete beta function (continued fraction)."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def ratio_within_between(obs: DataFrame) -> DataFrame:
    """Sample variance of entity means over the mean sample variance within entities of at least two rows."""
    own = obs.where("x is not null").groupBy("feature", "entity").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    return own.groupBy("feature").agg(F.try_divide(F.var_samp("m"), F.avg("v")).alias("ratio"))


def coverage(obs: DataFrame) -> DataFrame:
    """Share of measured cells and number of missing ones."""
    return obs.groupBy("feature").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"), F.count_if(F.col("x").isNull()).alias("n_missing"))


def distribution(obs: DataFrame) -> DataFrame:
    """n, mean, sd, min, max; sd NULL below two rows."""
    return obs.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))


def zero_inflation(obs: DataFrame) -> DataFrame:
    """Counts of zeros and ones, extremes, distinct share, skewness before and after log, mode share, and the four flags."""
    x = F.col("x")
    measured = obs.where("x is not null")
    mode = measured.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(F.max("c").alias("mode_n"), F.count(F.lit(1)).alias("n_unique"))
    lx = F.when(x > 0, F.ln(x))
    d = measured.groupBy("feature").agg(
        F.count("x").alias("n"), F.count_if(x == 0).alias("n_zero"), F.count_if(x == 1).alias("n_one"), F.count_if(x < 0).alias("n_negative"), F.min("x").alias("low"), F.max("x").alias("high"), skew(x).alias("skew"), skew(lx).alias("skew_log")
    ).join(mode, "feature")
    return d.select(
        "feature", "n", "n_zero", "n_one", "low", "high", (F.col("n_unique") / F.col("n")).alias("frac_unique"), "skew",
        (F.col("mode_n") / F.col("n") > 0.02).alias("spike"), ((F.col("n_zero") / F.col("n") > 0.02) & (F.col("n") - F.col("n_zero") > 20)).alias("zero_inflated"),
        F.coalesce((F.abs("skew") > 2) & (F.abs("skew_log") < F.abs("skew")), F.lit(False)).alias("log_helps"), (F.col("n_negative") > 0).alias("has_negative"),
    )


def skew(x: Column) -> Column:
    """Population skewness, NULL where nothing varies."""
    return F.when(F.var_pop(x) > 1e-18, F.skewness(x))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def stratum_combine(parts: DataFrame, value: str, size: str) -> DataFrame:
    """Sum of Q_g S_g / S over strata."""
    return parts.agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias(value))


def entity_failures(obs: DataFrame) -> DataFrame:
    """Entities and features whose entity mean is missing: finite observations (0) of how many, and whether the feature is missing for all entities."""
    cells = obs.groupBy("feature", "entity").agg(F.count("x").alias("finite"), F.count(F.lit(1)).alias("n"))
    overall = cells.groupBy("feature").agg((F.sum("finite") == 0).alias("everywhere"))
    return cells.where("finite = 0").join(overall, "feature").select("entity", "feature", "finite", "n", F.when(F.col("everywhere"), "all").otherwise("entity").alias("scope"))


def entity_summary(obs: DataFrame) -> DataFrame:
    """One row: entities, complete ones (a mean for every feature that any entity has), features, and those missing everywhere."""
    cells = obs.groupBy("feature", "entity").agg((F.count("x") > 0).alias("has"))
    known = cells.groupBy("feature").agg(F.max("has").alias("any"))
    per = cells.join(known, "feature").groupBy("entity").agg(F.bool_and(F.col("has") | ~F.col("any")).alias("complete"))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.count_if("complete").alias("complete")).crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("features"), F.count_if(~F.col("any")).alias("missing_everywhere"))))


def feature_failures(obs: DataFrame) -> DataFrame:
    """For each feature: entities without a mean, and whether no entity has one."""
    cells = obs.groupBy("feature", "entity").agg((F.count("x") > 0).alias("has"))
    return cells.groupBy("feature").agg(F.count_if(~F.col("has")).alias("failed"), (~F.max("has")).alias("everywhere"))


def qa_report(obs: DataFrame) -> DataFrame:
    """(section, item, value): counts, coverage, missing cells, distribution and within/between ratio of every feature."""
    out = obs.agg(F.count_distinct("obs_id").cast("double").alias("observations"), F.count_distinct("entity").cast("double").alias("entities"), F.count_distinct("feature").cast("double").alias("features"))
    out = out.select(F.lit("counts").alias("section"), F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in out.columns])).alias("x")).select("section", "x.*")
    for d in (coverage(obs), distribution(obs).drop("n"), ratio_within_between(obs)):
        cells = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("double").alias("value")) for c in d.columns if c != "feature"])
        out = out.unionByName(d.select(F.col("feature").alias("item"), F.explode(cells).alias("x")).select("x.section", "item", "x.value"))
    return out


def fisher_invariance(obs: DataFrame) -> DataFrame:
    """most: the largest difference that centring and scaling each feature makes to f_star; 0 but for rounding."""
    m = obs.groupBy("feature").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    z = obs.join(F.broadcast(m), "feature").withColumn("x", (F.col("x") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")
    both = variance_components(obs).select("feature", F.col("f_star").alias("a")).join(variance_components(z).select("feature", F.col("f_star").alias("b")), "feature")
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.count("a").alias("features"))


def transformed(obs: DataFrame, kinds: dict[str, str], default: str = "identity") -> DataFrame:
    """obs with each feature's x transformed as kinds says: identity, log, or log_nonzero."""
    x = scalars.transform(F.col("x"), default)
    for name, kind in kinds.items():
        x = F.when(F.col("feature") == name, scalars.transform(F.col("x"), kind)).otherwise(x)
    return obs.withColumn("x", x)


def transform_counts(obs: DataFrame, kinds: dict[str, str], default: str = "identity") -> DataFrame:
    """Of each feature: its transform, and how many zeros and values that are not positive a logarithm leaves out."""
    kind = F.lit(default)
    for name, k in kinds.items():
        kind = F.when(F.col("feature") == name, k).otherwise(kind)
    logged = kind.startswith("log")
    return obs.groupBy("feature").agg(F.first(kind).alias("kind"), F.count_if(logged & (F.col("x") == 0)).alias("n_zero"), F.count_if(logged & (F.col("x") <= 0)).alias("n_non_positive"))
