"""The whole analysis of an observation table in one call: Fisher components, participation ratio, information, held-out classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.operators import classify, hurdle, info, resample, spectrum, stats
from obsgrain.operators.cuts import cut


def _long(df: DataFrame, section: str, item: str, value: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))


def _wide(df: DataFrame, section: str, prefix: str = "") -> DataFrame:
    """One row of numbers as items."""
    cells = F.array(*[F.struct(F.lit(prefix + c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(section).alias("section"), F.explode(cells).alias("x")).select("section", "x.*")


def option_means(obs: DataFrame, zero_inflated: str | None, option: str = "C", mode: str = "reference") -> DataFrame:
    """Entity means (entity, feature, x), the zero-inflated feature by its composite (option C), its rate (B) or left out (none)."""
    means = spectrum.entity_means(obs.where(F.col("feature") != zero_inflated) if zero_inflated else obs)
    if not zero_inflated or option == "none":
        return means
    h = hurdle.fit(obs.where(F.col("feature") == zero_inflated).drop("feature"), mode)
    return means.unionByName(h.select("entity", F.lit(zero_inflated).alias("feature"), F.col("v" if option == "C" else "r").alias("x")))


def information(obs: DataFrame, zero_inflated: str | None, nbin: int) -> DataFrame:
    """Corrected mutual information of every feature; a zero-inflated one has a bin for its zeros. The null is exact."""
    rest = obs.where(F.col("feature") != zero_inflated) if zero_inflated else obs
    binned = info.quantile_bins(rest, nbin).select("feature", "entity", "obs_id", "bin")
    if zero_inflated:
        binned = binned.unionByName(info.hurdle_bins(obs.where(F.col("feature") == zero_inflated), nbin).select("feature", "entity", "obs_id", "bin"))
    binned, s = cut(binned), info.entity_count(obs)
    return info.with_empty(info.corrected(info.mutual_information(binned, s), info.exact_null(binned, s)), obs)


def fisher(obs: DataFrame, zero_inflated: str | None) -> DataFrame:
    """Variance components of every feature, of a zero-inflated one's composite."""
    if not zero_inflated:
        return stats.variance_components(obs)
    z = hurdle.utterance_composite(obs.where(F.col("feature") == zero_inflated)).withColumn("x", F.col("z")).select(*obs.columns)
    return stats.variance_components(obs.where(F.col("feature") != zero_inflated).unionByName(z))


def analyze(obs: DataFrame, zero_inflated: str | None = None, bins: tuple[int, ...] = (2, 3, 5, 10), boot: int = 1000, null: int = 200, folds: int = 5, kinds: tuple[str, ...] = ("logreg", "lda", "mlp"), seed: int = 0) -> DataFrame:
    """(section, item, value) of everything that is measured on obs (entity, obs_id, feature, x), which is written once and read by all parts.

    Sections: size (s, n, ceiling), fisher (f_star by feature), pr_C, pr_B and pr_none (pr, p, bootstrap mean, low and high), pr_null,
    pr_curve (PR of the leading features in order of f_star), mi_BINS (corrected information by feature), mi_summed (by bins),
    mi_presence, fano_KIND (mean and deviation over folds), fano_null and fano_best. boot, null or kinds of 0 or () leave a part out.
    """
    obs = cut(obs)
    sizes = obs.agg(F.count_distinct("entity").alias("s"), F.count_distinct("obs_id").alias("n")).withColumn("ceiling", F.log2("s"))
    parts = [_wide(sizes, "size")]
    components = cut(fisher(obs, zero_inflated))
    parts.append(_long(components, "fisher", "feature", "f_star"))
    for option in ("C", "B", "none") if zero_inflated else ("none",):
        means = cut(option_means(obs, zero_inflated, option))
        corr = cut(spectrum.correlation(spectrum.screen(spectrum.pairwise_covariance(means))))
        parts.append(_wide(spectrum.participation_ratio(corr), f"pr_{option}"))
        if boot:
            parts.append(_wide(resample.interval(resample.pr_bootstrap(means, boot, seed)), f"pr_{option}", "boot_"))
        if option in ("C", "none") and not (zero_inflated and option == "none"):
            kept = components.join(corr.where("i = j").select(F.col("i").alias("feature")), "feature", "left_semi")
            parts.append(_long(spectrum.incremental(corr, spectrum.fisher_order(kept)), "pr_curve", "feature", "pr"))
    if null:
        draws = resample.pr_null(obs, null, seed)
        parts.append(_wide(draws.agg(F.avg("pr").alias("mean"), F.stddev_pop("pr").alias("sd")), "pr_null"))
    summed = None
    for nbin in bins:
        mi = cut(information(obs, zero_inflated, nbin))
        parts.append(_long(mi, f"mi_{nbin}", "feature", "i_corrected"))
        one = mi.agg(F.lit(str(nbin)).alias("item"), F.sum("i_corrected").alias("value"))
        summed = one if summed is None else summed.unionByName(one)
    if summed is not None:
        parts.append(_long(summed, "mi_summed", "item", "value"))
    if zero_inflated:
        z = obs.where((F.col("feature") == zero_inflated) & F.col("x").isNotNull()).withColumn("bin", (F.col("x") > 0).cast("int"))
        s = info.entity_count(obs)
        parts.append(_long(info.corrected(info.mutual_information(z, s), info.exact_null(z, s)), "mi_presence", "feature", "i_corrected"))
    if kinds:
        entities = sizes.first()["s"]
        held = cut(classify.summary(classify.run_folds(obs, folds, kinds, zero_inflated, seed=seed), entities))
        for kind in kinds:
            parts.append(_wide(held.where(F.col("kind") == kind).drop("kind"), f"fano_{kind}"))
        parts.append(_wide(classify.headline(held), "fano_best"))
        chance = classify.run_folds(obs, folds, kinds[:1], zero_inflated, seed=seed, shuffled=True, only=(0,))
        parts.append(_wide(classify.summary(chance, entities).drop("kind"), "fano_null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def within(obs: DataFrame, **options) -> DataFrame:
    """analyze() of each stratum of obs (with column stratum), combined: a value weighs as many entities as its stratum has."""
    out = None
    for r in obs.groupBy("stratum").agg(F.count_distinct("entity").alias("s")).orderBy("stratum").collect():  # strata are few
        one = analyze(obs.where(F.col("stratum").eqNullSafe(F.lit(r["stratum"]))).drop("stratum"), **options).withColumn("__s", F.lit(r["s"]))
        out = one if out is None else out.unionByName(one)
    return out.where("value is not null").groupBy("section", "item").agg((F.sum(F.col("value") * F.col("__s")) / F.sum("__s")).alias("value"))
