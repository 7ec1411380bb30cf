"""Seeded orders, folds, nested subsets, permutations and bootstraps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.functions.scalars import ascending, hash_order
from obsgrain.operators.cuts import cut
from obsgrain.operators.ranks import quantiles, ranked
from obsgrain.operators.spectrum import feature_names, incremental, pr_by
from obsgrain.operators.stats import variance_components


def entity_order(obs: DataFrame, seed: int = 0) -> DataFrame:
    """(stratum, entity, rank): entities of each stratum in hash order, so subsets by rank are nested."""
    named = obs.select("stratum", "entity").distinct().withColumn("__o", hash_order(F.lit(seed), F.col("entity")))
    return ranked(named, ["__o", "entity"], ("stratum",), "rank").drop("__o")


def top_per_group(df: DataFrame, by: list[str], order: list, m: int) -> DataFrame:
    """First m rows of each group, nulls of a named column last. Spark prunes groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*[ascending(c)[0] if isinstance(c, str) else c for c in order]))).where(F.col("__k") <= m).drop("__k")


def nested_subset(obs: DataFrame, n: int, m: int, seed: int = 0) -> DataFrame:
    """m first observations of each of the n first entities of each stratum."""
    keep = entity_order(obs, seed).where(F.col("rank") <= n).select("stratum", "entity")
    return top_per_group(obs.join(keep, ["stratum", "entity"], "left_semi"), ["stratum", "entity"], ["obs_id"], m)


def folds(rows: DataFrame, k: int, label: str = "entity", seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds fold: stratified by label (within each group of by), in hash order of obs_id."""
    w = Window.partitionBy(*by, label).orderBy(*ascending(hash_order(F.lit(seed), F.col("obs_id")), "obs_id"))
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("long"))


def dealt(labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(replicate, obs_id, entity): labels (obs_id, entity) dealt anew n times.

    The label of the observation with the k-th id goes to that with the k-th hash of (seed, replicate, id). Ranks are counted
    by ranges, so no task sorts all observations.
    """
    own = cut(ranked(labels.select("obs_id", "entity").distinct(), ["obs_id"]))
    perms = own.select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    perms = ranked(perms.withColumn("__o", hash_order(F.lit(seed), F.col("replicate"), F.col("obs_id"))), ["__o", "obs_id"], ("replicate",)).drop("__o")
    return perms.join(own.select("k", "entity"), "k").select("replicate", "obs_id", "entity")


def permuted_means(obs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(replicate, entity, feature, x): entity means after labels are dealt anew; an observation's features travel in one row.

    Rows that share an id get the same label and all count.
    """
    names = feature_names(obs)
    wide = obs.where("obs_id is not null").groupBy("obs_id").pivot("feature", names).agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    wide = wide.select("obs_id", *[F.col(f"`{c}_{a}`").alias(f"{a}{k}") for k, c in enumerate(names) for a in "sn"])
    means = dealt(obs, n, seed).join(wide, "obs_id").groupBy("replicate", "entity").agg(*[F.try_divide(F.sum(f"s{k}"), F.sum(f"n{k}")).alias(f"x{k}") for k in range(len(names))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"x{k}").alias("x")) for k, c in enumerate(names)])
    return means.select("replicate", "entity", F.explode(cells).alias("c")).select("replicate", "entity", "c.feature", "c.x")


def pr_null(obs: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """PR after entity labels are dealt anew over observations, n times: (replicate, pr). The replicate is a grouping key."""
    return pr_by(permuted_means(obs, n, seed), ("replicate",)).select("replicate", "pr")


def pr_null_curve(obs: DataFrame, order: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """k, mean and 97.5th percentile of the PR of the first k features in the order, over n dealings of the labels."""
    curves = cut(incremental(correlations_by(permuted_means(obs, n, seed)), order, ("replicate",)))
    high = quantiles(curves, "pr", [0.975], ("k",))
    return curves.groupBy("k").agg(F.avg("pr").alias("mean")).join(high.select("k", F.get("q", F.lit(0)).alias("high")), "k")


def correlations_by(means: DataFrame, by: tuple[str, ...] = ("replicate",)) -> DataFrame:
    from obsgrain.operators.spectrum import correlation, pairwise_covariance

    return correlation(pairwise_covariance(means, by=by), by)


def fstar_null(obs: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """Mean and largest f_star over features and n dealings of the labels."""
    rows = obs.drop("entity").join(dealt(obs, n, seed), "obs_id")
    f = variance_components(rows, ("replicate", "feature"))
    return f.agg(F.avg("f_star").alias("mean"), F.max("f_star").alias("most"), F.count("f_star").alias("n"))


#: Poisson(1) is at least k + 1 where a uniform number reaches the k-th of these.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)])).tolist()


def poisson_weight(*parts: Column) -> Column:
    """How often a bootstrap takes a row: Poisson(1) by the first 32 bits of the MD5 of the parts, the same in any engine."""
    u = F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def pr_bootstrap(means: DataFrame, n: int = 200, seed: int = 0, tasks: int = 256) -> DataFrame:
    """PR of n resamples of entities with replacement: (replicate, pr), over pairs of measured means; what has no entity (NULL) is none.

    Each entity is taken Poisson(1) times in a replicate, which needs no count of all entities and no entity-by-feature matrix
    in one place: each of at most `tasks` tasks sums weighted moments of its entities, replicates by pairs, and one row a
    task and replicate is added up.
    """
    names = feature_names(means)
    p = len(names)
    wide = means.where("entity is not null").groupBy("entity").pivot("feature", names).agg(F.first("x"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: poisson_weight(F.lit(seed), b, F.col("entity")).cast("int"))
    rows = wide.select("entity", F.array(*[F.col(f"`{c}`") for c in names]).alias("x")).repartition(min(tasks, max(1, wide.rdd.getNumPartitions())), "entity").select("x", weights.alias("w"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 3, p * p))
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                x = np.array([[np.nan if v is None else v for v in r] for r in part["x"]], float).reshape(len(part), p)
                w = np.stack(part["w"].to_numpy()).astype(float)
                m = np.isfinite(x).astype(float)
                x = np.nan_to_num(x)
                for k, (a, b) in enumerate(((m, m), (x, m), (x, x))):
                    total[:, k] += w.T @ (a[:, :, None] * b[:, None]).reshape(len(part), -1)
        yield pd.DataFrame({"replicate": range(n), "sums": [t.ravel() for t in total]})

    def ratio(pdf: pd.DataFrame) -> pd.DataFrame:
        c, sx, sxx = np.sum(np.stack(pdf["sums"].to_numpy()), 0).reshape(3, p, p)
        c = np.maximum(c, 1e-300)
        cov = sxx / c - (sx / c) * (sx.T / c)
        v = np.diag(cov).copy()
        keep = v > 1e-24
        r2 = (cov[np.ix_(keep, keep)] ** 2) / np.outer(v[keep], v[keep])
        return pd.DataFrame({"replicate": pdf["replicate"][:1], "pr": [keep.sum() ** 2 / r2.sum() if keep.any() else np.nan]})

    sums = rows.mapInPandas(moments, "replicate long, sums array<double>")
    return sums.groupBy("replicate").applyInPandas(ratio, "replicate long, pr double")


def interval(replicates: DataFrame) -> DataFrame:
    """Mean and the 2.5th and 97.5th percentile of pr; the replicates are few."""
    return replicates.agg(F.avg("pr").alias("mean"), F.percentile("pr", F.lit(0.025)).alias("low"), F.percentile("pr", F.lit(0.975)).alias("high"))
