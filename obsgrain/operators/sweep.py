"""Measures on nested subsets of growing entity count: the size is a grouping key, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgrain.operators import classify, info
from obsgrain.operators.cuts import cut
from obsgrain.operators.resample import entity_order, top_per_group
from obsgrain.operators.spectrum import pr_by
from obsgrain.operators.stats import entity_moments


def replicate(obs: DataFrame, grid: list[int], m: int, seed: int = 0, pooled: bool = True) -> DataFrame:
    """Rows of every subset of the grid, with column size: the n first entities of each stratum, m first observations of each."""
    order = entity_order(obs, seed)
    sizes = F.array(*[F.lit(g).cast("long") for g in grid])
    keep = order.where(F.col("rank") <= max(grid)).select("stratum", "entity", F.explode(F.filter(sizes, lambda g: g >= F.col("rank"))).alias("size"))
    first = top_per_group(obs, ["stratum", "entity", *([] if "feature" not in obs.columns else ["feature"])], ["obs_id"], m)
    return first.join(keep, ["stratum", "entity"])


def participation_ratios(rows: DataFrame, by: tuple[str, ...] = ("size",)) -> DataFrame:
    """Entities, ceiling log2 S and PR for each size: pair moments are grouped by (size, i, j)."""
    means = entity_moments(rows, (*by, "feature")).select(*by, "entity", "feature", F.col("mean").alias("x"))
    s = means.groupBy(*by).agg(F.count_distinct("entity").alias("s"))
    return s.join(pr_by(means, by), list(by)).select(*by, "s", F.log2("s").alias("ceiling"), "pr")


def summed_information(rows: DataFrame, nbin: int = 5, by: tuple[str, ...] = ("size",)) -> DataFrame:
    """(by, summed_mi): the corrected mutual information of all features, for each size; the null is exact."""
    keys = (*by, "feature")
    binned = cut(info.quantile_bins(rows, nbin, keys))
    entities = rows.groupBy(*by).agg(F.count_distinct("entity").alias("s"))
    mi = info.corrected(info.mutual_information(binned, entities, keys), info.exact_null(binned, entities, keys), keys)
    return mi.groupBy(*by).agg(F.sum("i_corrected").alias("summed_mi"))


def measures(rows: DataFrame, nbin: int = 5, k: int = 5, kinds: tuple[str, ...] = ("logreg", "lda"), hurdle: str | None = None, by: tuple[str, ...] = ("size",)) -> DataFrame:
    """For each size: s, ceiling, pr, summed_mi and fano (the best classifier's mean held-out information)."""
    rows = cut(rows)
    pr = participation_ratios(rows, by)
    held = classify.run_folds(rows, k, kinds, hurdle, by=by)
    sizes = rows.groupBy(*by).agg(F.count_distinct("entity").alias("s"))
    fano = info.fano_bounds(held.join(sizes, list(by)), (*by, "kind", "fold"), F.col("s"))
    best = fano.groupBy(*by, "kind").agg(F.avg("i_xent").alias("x")).groupBy(*by).agg(F.max("x").alias("fano"))
    return pr.join(summed_information(rows, nbin, by), list(by)).join(best, list(by))


def within(per_size: DataFrame, values: list[str], by: str = "size") -> DataFrame:
    """Measures of each (size, stratum) combined over strata: each weighs as many entities as it has."""
    return per_size.groupBy(by).agg(*[(F.sum(F.col(v) * F.col("s")) / F.sum("s")).alias(v) for v in values], F.sum("s").alias("s"))


def add_points(obs: DataFrame, grid: list[int], path: str, m: int, seed: int = 0, **options) -> list[int]:
    """Measures the sizes of the grid that the table at path lacks and appends them, one folder a size; returns those sizes.

    A sweep that was broken off is gone on with; sizes may also be measured by separate jobs, since subsets are nested by hash.
    """
    spark = obs.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    done = {r["size"] for r in spark.read.parquet(path).select("size").distinct().collect()} if there else set()
    todo = [g for g in grid if g not in done]
    if todo:
        measures(replicate(obs, todo, m, seed), **options).withColumn("size", F.col("size").cast("int")).write.mode("append").partitionBy("size").parquet(path)
    return todo


def combined(spark: SparkSession, path: str, values: tuple[str, ...] = ("pr", "summed_mi", "fano")) -> DataFrame:
    """Slopes against log2 of the number of entities of all points written so far."""
    return slopes(spark.read.parquet(path), "s", list(values))


def slopes(points: DataFrame, x: str, values: list[str]) -> DataFrame:
    """Slope of each value against log2 of x."""
    return points.agg(*[F.regr_slope(F.col(v), F.log2(F.col(x))).alias(v) for v in values])
