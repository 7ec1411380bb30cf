"""Between-entity covariance, correlation, and effective dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features up to which a covariance table is brought to the driver as a matrix.
MOST_FEATURES = 2000


def entity_means(obs: DataFrame) -> DataFrame:
    """(entity, feature, x): mean over measured rows, NULL if there are none."""
    return obs.groupBy("entity", "feature").agg(F.avg("x").alias("x"))


def feature_names(obs: DataFrame) -> list[str]:
    """Names of the features, sorted; refuses more than MOST_FEATURES."""
    names = sorted(r["feature"] for r in obs.select("feature").distinct().limit(MOST_FEATURES + 1).collect())
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return names


def complete(means: DataFrame) -> DataFrame:
    """Means of entities that have all features (listwise deletion)."""
    p = means.agg(F.count_distinct("feature").alias("__p"))
    have = means.where("x is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("__n"))
    return means.join(have.crossJoin(F.broadcast(p)).where("__n = __p").select("entity"), "entity", "left_semi")


def pairwise_covariance(means: DataFrame, ddof: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, cov) for i <= j: over entities with both means; the diagonal over each feature's own. Fewer than two give 0.
    Means without an entity (NULL) belong to none and are left out.

    Each entity's cells are gathered into one row and its pairs made there: the join on entity that a self-join would need
    is spared, and sums are made on the map side.
    """
    cells = means.where("x is not null and entity is not null").groupBy(*by, "entity").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, k: F.transform(F.slice("c", k + 1, F.size("c") - k), lambda b: F.struct(a["feature"].alias("i"), b["feature"].alias("j"), a["x"].alias("a"), b["x"].alias("b")))))
    p = cells.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")
    cov = F.covar_pop("a", "b") if ddof == 0 else F.covar_samp("a", "b")
    return p.groupBy(*by, "i", "j").agg(F.coalesce(F.when(F.count(F.lit(1)) > 1, cov), F.lit(0.0)).alias("cov"))


def screen(cov: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Only features whose between-entity standard deviation reaches the floor."""
    keep = cov.where((F.col("i") == F.col("j")) & (F.sqrt("cov") >= floor)).select("i")
    return cov.join(keep, "i", "left_semi").join(keep.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "cov")


def correlation(cov: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, r), r = cov / sqrt(var_i var_j), for i <= j."""
    d = cov.where("i = j").select(*by, F.col("i").alias("f"), F.greatest("cov", F.lit(1e-300)).alias("v"))
    c = cov.join(d.select(*by, F.col("f").alias("i"), F.col("v").alias("vi")), [*by, "i"]).join(d.select(*by, F.col("f").alias("j"), F.col("v").alias("vj")), [*by, "j"])
    return c.select(*by, "i", "j", (F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))).alias("r"))


def pr_by(means: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, pr) of entity means, over features that vary; pair moments are grouped by (by, i, j)."""
    cov = pairwise_covariance(means, by=by)
    keep = cov.where("i = j and cov > 1e-24").select(*by, "i")
    cov = cov.join(keep, [*by, "i"], "left_semi").join(keep.withColumnRenamed("i", "j"), [*by, "j"], "left_semi")
    r = correlation(cov, by)
    p = F.count_if(F.col("i") == F.col("j")).cast("double")
    return r.groupBy(*by).agg((p * p / F.sum(_double(F.col("r")))).alias("pr"))


def _double(r: Column) -> Column:
    return F.when(F.col("i") == F.col("j"), r * r).otherwise(2 * r * r)


def participation_ratio(corr: DataFrame) -> DataFrame:
    """p^2 / sum r^2: what (sum of eigenvalues)^2 / sum of their squares is for a matrix with unit diagonal and no negative eigenvalue."""
    p = F.count_if(F.col("i") == F.col("j")).cast("double")
    return corr.agg(p.cast("long").alias("p"), (p * p / F.sum(_double(F.col("r")))).alias("pr"))


def incremental(corr: DataFrame, order: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """PR of each leading set of features: order (feature, k) from 1. Shell sums over the later feature, then a running sum."""
    o = F.broadcast(order)
    ranked = corr.join(o.select(F.col("feature").alias("i"), F.col("k").alias("ki")), "i").join(o.select(F.col("feature").alias("j"), F.col("k").alias("kj")), "j")
    shells = ranked.groupBy(*by, F.greatest("ki", "kj").alias("k")).agg(F.sum(_double(F.col("r"))).alias("shell"))
    run = Window.partitionBy(*by).orderBy("k")  # one row a feature
    d = shells.withColumn("pr", F.col("k") * F.col("k") / F.sum("shell").over(run))
    return d.select(*by, "k", "pr", (F.col("pr") - F.lag("pr").over(run)).alias("gain")).join(o, "k").select(*by, "k", "feature", "pr", "gain")


def saturation(curve: DataFrame, least: float = 0.05) -> DataFrame:
    """First k from 2 on whose gain is below `least`."""
    return curve.agg(F.min(F.when((F.col("k") >= 2) & (F.col("gain") < least), F.col("k"))).alias("k"))


def fisher_order(components: DataFrame) -> DataFrame:
    """Features by descending f_star, unknown ones last, ties by name."""
    return components.select("feature", F.row_number().over(Window.orderBy(F.desc_nulls_last("f_star"), "feature")).cast("long").alias("k"))


def matrix(table: DataFrame, value: str) -> tuple[list[str], np.ndarray]:
    """A covariance or correlation table as a symmetric matrix; refuses more than MOST_FEATURES features."""
    names = feature_names(table.where("i = j").select(F.col("i").alias("feature")))
    at, m = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in table.select("i", "j", value).collect():
        if r["i"] in at and r["j"] in at:
            m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r[value]
    return names, m


def repaired(corr: DataFrame, floor: float = -1e-10) -> DataFrame:
    """(i, j, r) of a correlation table whose matrix has no eigenvalue below the floor: else they are set to 0 and the diagonal to 1 again."""
    names, m = matrix(corr, "r")
    if len(names) and np.linalg.eigvalsh(m)[0] < floor:
        m = clip_psd(m)
        d = np.sqrt(np.maximum(np.diag(m), 1e-300))
        m = m / np.outer(d, d)
    rows = [(names[i], names[j], float(m[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return corr.sparkSession.createDataFrame(rows, "i string, j string, r double")


def clip_psd(m: np.ndarray) -> np.ndarray:
    """Negative eigenvalues set to 0."""
    w, v = np.linalg.eigh(m)
    return m if not len(w) or w[0] >= -1e-12 else (v * np.maximum(w, 0)) @ v.T


def dimensions(m: np.ndarray, share: float = 0.9) -> dict[str, float]:
    """pr, dim90 (eigenvalues that reach the share), entropy_dim (exp of their entropy), condition number."""
    w = np.sort(np.maximum(np.linalg.eigvalsh(m), 0))[::-1] if len(m) else np.zeros(0)
    if not w.sum():
        return {"pr": float("nan"), "dim90": 0, "entropy_dim": float("nan"), "condition": float("nan")}
    p = w / w.sum()
    q = p[p > 0]
    return {"pr": float(1 / (p * p).sum()), "dim90": int(np.searchsorted(np.cumsum(p), share - 1e-12) + 1), "entropy_dim": float(np.exp(-(q * np.log(q)).sum())), "condition": float(w[0] / w[-1]) if w[-1] > 0 else float("inf")}


def pr_of(x: np.ndarray) -> float:
    """PR of the correlation matrix of a complete entity-by-feature matrix; constant columns are left out."""
    x = x[:, x.std(0) > 1e-12]
    if x.shape[1] == 0:
        return float("nan")
    r = np.corrcoef(x, rowvar=False).reshape(x.shape[1], x.shape[1])
    return float(x.shape[1] ** 2 / (r * r).sum())
