"""Curation: selection, resolution of sources, voting, merges, audits, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.functions.scalars import ascending, hash_order
from obsgrain.operators.ranks import quantiles, ranked


def having(df: DataFrame, key: str, where: str, least: int) -> DataFrame:
    """Rows that satisfy `where`, of keys with at least so many of them."""
    kept = df.where(where)
    keys = kept.groupBy(key).count().where(F.col("count") >= least).select(key)
    return kept.join(keys, key, "left_semi")


def select_entities(df: DataFrame, n: int, m: int, least_duration: float, seed: int = 0) -> DataFrame:
    """n entities of each stratum with at least m long enough observations, in hash order, and their m first observations.

    df: entity, stratum, obs_id, duration.
    """
    kept = having(df, "entity", f"duration >= {least_duration}", m)
    order = kept.select("stratum", "entity").distinct().withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy(*ascending(hash_order(F.lit(seed), F.col("entity")), "entity"))))
    chosen = kept.join(order.where(F.col("k") <= n).select("stratum", "entity"), ["stratum", "entity"], "left_semi")
    return chosen.withColumn("k", F.row_number().over(Window.partitionBy("stratum", "entity").orderBy("obs_id"))).where(F.col("k") <= m).drop("k")


def availability(df: DataFrame, need: int, m: int) -> DataFrame:
    """Of each stratum: entities, least and most observations, whether there are enough of both."""
    per = df.groupBy("stratum", "entity").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("stratum").agg(F.count(F.lit(1)).alias("entities"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_and(F.col("n") >= m).alias("all_enough"), (F.count(F.lit(1)) >= need).alias("available"))


def fill_limit(preferred: DataFrame, rest: DataFrame, total: int, order: list) -> DataFrame:
    """All preferred rows and as many of the rest, by order, as fill up to total. The order must be total."""
    have = preferred.agg(F.count(F.lit(1)).alias("__n"))
    ranked = rest.orderBy(*order).limit(total).withColumn("__k", F.row_number().over(Window.orderBy(*order)))  # at most `total` rows
    return preferred.unionByName(ranked.crossJoin(F.broadcast(have)).where(F.col("__k") <= F.greatest(F.lit(total) - F.col("__n"), F.lit(0))).drop("__k", "__n"))


def priority_resolve(wanted: DataFrame, offers: DataFrame, key: str, value: str, priority: str, default: str) -> DataFrame:
    """The value of the offer with the least priority for each wanted key, else the default."""
    best = offers.groupBy(key).agg(F.min_by(value, priority).alias(value))
    return wanted.join(best, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_in_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First non-NULL value of each group by an explicit order."""
    return df.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def votes(clips: DataFrame, tagged: float = 0.9, tie_to: str = "b") -> DataFrame:
    """Decision for each entity from two probabilities a clip (pa, pb): counts, majority, mean signed confidence, decision.

    A clip votes for the larger, for b if equal. Decision: tie if equally many, tagged from 90 % agreement on, else ambiguous.
    """
    a = F.col("pa") > F.col("pb")
    g = clips.groupBy("entity").agg(F.count_if(a).alias("n_a"), F.count_if(~a).alias("n_b"), F.sum(F.when(a, F.col("pa"))).alias("ca"), F.sum(F.when(~a, F.col("pb"))).alias("cb"))
    n = F.col("n_a") + F.col("n_b")
    most, tie = F.greatest("n_a", "n_b"), F.col("n_a") == F.col("n_b")
    for_a = (F.col("n_a") > F.col("n_b")) | (tie & F.lit(tie_to == "a"))
    ca, cb = F.coalesce("ca", F.lit(0.0)), F.coalesce("cb", F.lit(0.0))
    conf = F.when(for_a, ca - cb).otherwise(cb - ca) / n
    return g.select("entity", "n_a", "n_b", F.when(tie, "tie").when(for_a, "a").otherwise("b").alias("majority"), most.alias("majority_count"), conf.alias("avg_conf"), F.when(tie, "tie").when(most >= n * tagged, "tagged").otherwise("ambiguous").alias("decision"))


def tally(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ambiguous, ties): the undecided entities, ambiguous ones by majority and confidence, ties by confidence, both descending."""
    ambiguous = decisions.where("decision = 'ambiguous'").orderBy(F.desc("majority_count"), F.desc_nulls_last("avg_conf"), "entity")
    return ambiguous, decisions.where("decision = 'tie'").orderBy(F.desc_nulls_last("avg_conf"), "entity")


def mixed_order(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Rows sorted by several keys, each ascending (True) or descending (False); nulls last either way."""
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys])


def top(df: DataFrame, k: int, keys: list[tuple[str, bool]]) -> DataFrame:
    """The first k rows of mixed_order: each task keeps k rows, none is sorted as a whole."""
    return mixed_order(df, keys).limit(k)


def subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every row of a is in b, and how many different ones are not."""
    rest = a.distinct().join(b.distinct(), [a[c].eqNullSafe(b[c]) for c in a.columns], "left_anti")
    return rest.agg((F.count(F.lit(1)) == 0).alias("is_subset"), F.count(F.lit(1)).alias("n_outside"))


def usable_mean(target: DataFrame, measured: DataFrame, key: str, value: str, low: float, high: float, scale: float = 1.0) -> DataFrame:
    """Mean of usable values (low <= value <= high) for each key, scaled, looked up for every target row."""
    mean = measured.where(F.col(value).between(low, high)).groupBy(key).agg((F.avg(value) * scale).alias(value))
    return target.join(mean, key, "left")


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, median, quartiles and mean of each group."""
    d = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = quantiles(df, value, [0.25, 0.5, 0.75], (by,)).select(F.col(by).alias("__by"), "q")
    return d.join(q, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(2)).alias("q75"), "mean")


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """5th, 50th and 95th percentile and mean; one row."""
    q = quantiles(df, value, [0.05, 0.5, 0.95])
    return df.agg(F.avg(value).alias("mean")).join(F.broadcast(q), F.lit(True), "left").select(*[F.get("q", F.lit(k)).alias(f"p{p}") for k, p in enumerate((5, 50, 95))], "mean")


def drift(now: DataFrame, frozen: DataFrame, key: str, value: str) -> DataFrame:
    """How many frozen decisions agree, drift or are missing."""
    j = frozen.select(key, F.col(value).alias("__was")).join(now.select(key, F.col(value).alias("__is")), key, "left")
    return j.agg(F.count_if(F.col("__is") == F.col("__was")).alias("agree"), F.count_if(F.col("__is") != F.col("__was")).alias("drift"), F.count_if(F.col("__is").isNull()).alias("missing"))


def drift_examples(now: DataFrame, frozen: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """The first n frozen decisions, by key, that drift or are missing: key, was, now."""
    j = frozen.select(key, F.col(value).alias("was")).join(now.select(key, F.col(value).alias("now")), key, "left")
    return j.where(F.col("now").isNull() | (F.col("now") != F.col("was"))).orderBy(key).limit(n)


def missing_files(wanted: DataFrame, found: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(present and missing keys of each group, the missing ones), found being a listing of files or any table of keys."""
    return presence(wanted, found, key, by), wanted.join(found.select(key).distinct(), key, "left_anti").select(by, key)


def presence(wanted: DataFrame, have: DataFrame, key: str, by: str) -> DataFrame:
    """Present and missing keys of each group."""
    j = wanted.join(have.select(key).distinct().withColumn("__here", F.lit(True)), key, "left")
    return j.groupBy(by).agg(F.count_if(F.col("__here").isNotNull()).alias("present"), F.count_if(F.col("__here").isNull()).alias("missing"))


def shards(df: DataFrame, n: int, order: list) -> DataFrame:
    """Round-robin shard number by the order, without one sorted task."""
    return ranked(df, order, (), "__k").withColumn("shard", ((F.col("__k") - 1) % n).cast("long")).drop("__k")


def group_ordinals(df: DataFrame, by: str, order: list, size: int = 100) -> DataFrame:
    """Folder and place within it: rank // size + 1 and rank % size + 1, and a name of both."""
    d = ranked(df, order, (by,), "__k").withColumn("__k", F.col("__k") - 1).withColumn("folder", F.floor(F.col("__k") / size).cast("long") + 1).withColumn("place", (F.col("__k") % size).cast("long") + 1).drop("__k")
    return d.withColumn("name", F.format_string("%s%03d_%02d", F.col(by).cast("string"), F.col("folder"), F.col("place")))


def joined_names(df: DataFrame, by: str, name: str) -> DataFrame:
    """Sorted names of each group, comma-joined."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))


def histogram_of_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done, key, "left_anti")


def pct(flag: Column) -> Column:
    return 100 * F.avg(flag.cast("double"))
