"""Information of features about entities: value bins, conditional entropy, mutual information with exact or hashed nulls, Fano bounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.functions.scalars import hash_order
from obsgrain.operators.cuts import bounded, cut
from obsgrain.operators.ranks import quantiles, ranked


def quantile_bins(obs: DataFrame, nbin: int, by: tuple[str, ...] = ("feature",), floor: int = 0) -> DataFrame:
    """Adds bin: how many distinct interior quantile edges lie at or below x, plus floor. Fewer than three distinct edges give one bin.

    Edges are exact and linearly interpolated (by ranks, if there are many rows); one row of edges a group is joined back,
    broadcast if their number allows it.
    """
    edges = quantiles(obs, "x", [i / nbin for i in range(nbin + 1)], by).withColumn("__e", F.array_distinct("q"))
    inner = F.when(F.size("__e") < 3, F.array().cast("array<double>")).otherwise(F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0))))
    edges = cut(edges.select(*by, inner.alias("__e")))
    measured = obs.where("x is not null")
    joined = measured.join(bounded(edges), list(by)) if by else measured.crossJoin(F.broadcast(edges))
    return joined.withColumn("bin", F.size(F.filter("__e", lambda e: e <= F.col("x"))) + floor).drop("__e")


def hurdle_bins(obs: DataFrame, nbin: int) -> DataFrame:
    """Bin 0 for zeros, quantile bins of ln x from 1 on for positive values."""
    keep = [c for c in obs.columns]
    zero = obs.where("x = 0").withColumn("bin", F.lit(0))
    positive = quantile_bins(obs.where("x > 0").withColumn("x", F.ln("x")), nbin, by=("feature",) if "feature" in keep else (), floor=1)
    return zero.unionByName(positive)


def conditional_entropy(binned: DataFrame, by: tuple[str, ...] = ("feature",), label: str = "entity") -> DataFrame:
    """H(label | bin) in bits, n and the number of bins: counts by bin and label, then sums."""
    cells = binned.groupBy(*by, "bin", label).agg(F.count(F.lit(1)).alias("c"))
    bins = Window.partitionBy(*by, "bin")
    cells = cells.withColumn("nb", F.sum("c").over(bins))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), (-F.sum(F.col("c") * F.log2(F.col("c") / F.col("nb")))).alias("h"), F.count_distinct("bin").alias("n_bins"))
    return total.select(*by, "n", "n_bins", (F.col("h") / F.col("n")).alias("h_cond"))


def entity_count(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count_distinct("entity").alias("s"))


def _with_s(df: DataFrame, entities: DataFrame) -> DataFrame:
    """df with s: of one row for all, or of the row for df's group."""
    keys = [c for c in entities.columns if c != "s"]
    return df.join(entities, keys) if keys else df.crossJoin(F.broadcast(entities))


def mutual_information(binned: DataFrame, entities: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """i_raw = log2 S - H(entity | bin), S being the number of all entities (or, if entities has them, of those of a group)."""
    return _with_s(conditional_entropy(binned, by), entities).select(*by, "n", "n_bins", (F.log2("s") - F.col("h_cond")).alias("i_raw"))


def hashed_null(binned: DataFrame, entities: DataFrame, n_perm: int, by: tuple[str, ...] = ("feature",), seed: int = 0) -> DataFrame:
    """Mean i_raw over label permutations: labels by rank of obs_id meet rows by rank of a hash of (seed, permutation, obs_id).

    The order does not depend on the group. So groups that are measured on the same rows are dealt once, and a dealt row is an id
    and a label; the bins of all groups of a row meet it afterwards and are counted before they are shuffled.
    """
    group = F.struct(*by)
    cells = binned.select(group.alias("g"), "obs_id", "entity", "bin").repartition("obs_id")
    # rows that share an id are told apart, so each is dealt its own label
    cells = cells.withColumn("copy", F.row_number().over(Window.partitionBy("obs_id", "g").orderBy("entity", "bin")))
    wide = cells.groupBy("obs_id", "copy", "entity").agg(F.array_sort(F.collect_list(F.struct("g", "bin"))).alias("c"))
    wide = cut(wide.withColumn("id", F.monotonically_increasing_id()))
    same = cut(_measured_together(wide.select(F.transform("c", lambda x: x["g"]).alias("m"))))
    of = bounded(same)
    parts = wide.select("id", "obs_id", "copy", "entity", F.explode("c").alias("x")).join(of, F.col("x.g") == F.col("g"))
    rows = cut(parts.groupBy("id", "cls").agg(F.first("obs_id").alias("obs_id"), F.first("copy").alias("copy"), F.first("entity").alias("entity"), F.collect_list("x").alias("c")))
    n = rows.count()
    own = ranked(rows.select("cls", "obs_id", "copy", "entity"), ["obs_id", "copy"], ("cls",), rows=n, drop=("obs_id", "copy"))
    perms = rows.select("cls", "id", "obs_id", "copy", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    perms = perms.withColumn("__o", F.unhex(hash_order(F.lit(seed), F.col("perm"), F.col("obs_id"))))
    dealt = ranked(perms, ["__o", "obs_id", "copy"], ("cls", "perm"), rows=n * n_perm, drop=("__o", "obs_id", "copy")).join(own, ["cls", "k"])
    mixed = dealt.select("cls", "id", "perm", "entity").join(rows.select("cls", "id", "c"), ["cls", "id"]).select("perm", "entity", F.explode("c").alias("x")).select("perm", "entity", "x.g.*", "x.bin")
    one = conditional_entropy(mixed, (*by, "perm")).crossJoin(F.broadcast(entities))
    return one.groupBy(*by).agg(F.avg(F.log2("s") - F.col("h_cond")).alias("i_null"))


def _measured_together(masks: DataFrame) -> DataFrame:
    """(g, cls) of rows that each list the groups measured on them: groups measured on exactly the same rows are one class.

    Two groups are, if as many rows have both as have either; counted over the distinct lists.
    """
    lists = masks.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    pairs = lists.select("n", F.explode("m").alias("a"), "m").select("n", "a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    alone = pairs.where("a = b")
    both = pairs.join(alone.select("a", F.col("n").alias("na")), "a").join(alone.select("b", F.col("n").alias("nb")), "b").where("n = na and n = nb")
    least = both.groupBy("a").agg(F.min("b").alias("first"))
    classes = least.select("first").distinct().withColumn("cls", F.monotonically_increasing_id())
    return least.join(cut(classes), "first").select(F.col("a").alias("g"), "cls")


def sampled_null(binned: DataFrame, entities: DataFrame, n_perm: int, by: tuple[str, ...] = ("feature",), seed: int = 0) -> DataFrame:
    """Mean i_raw over n_perm label permutations, each drawn as what it does to the counts: by, i_null.

    Dealing labels at random over rows gives a table of bins by labels with the margins of the data, distributed as bins
    drawn in turn without replacement (multivariate hypergeometric). So a permutation costs bins times labels, however many
    rows there are; no row is moved. One task draws for one group's label counts, which it holds.
    """
    keys = [*by]
    a = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list("n")).alias("a"))
    c = binned.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list("n")).alias("c"))
    rows = a.join(c, keys).crossJoin(F.broadcast(entities)).withColumn("seed", F.xxhash64(F.lit(seed), *keys))

    def run(batches):
        for batch in batches:
            out = []
            for sizes, labels, s, start in zip(batch["a"], batch["c"], batch["s"], batch["seed"], strict=True):
                rng, total, labels = np.random.default_rng(int(start) & ((1 << 64) - 1)), 0.0, np.asarray(labels, np.int64)
                for _ in range(n_perm):
                    left, h = labels.copy(), 0.0
                    for size in sizes:
                        got = rng.multivariate_hypergeometric(left, int(size)) if size < left.sum() else left.copy()
                        left -= got
                        got = got[got > 0]
                        h -= float((got * np.log2(got / size)).sum())
                    total += math.log2(s) - h / labels.sum()
                out.append(total / n_perm)
            yield batch[keys].assign(i_null=out)

    kinds = dict(rows.select(*keys).dtypes)
    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "i_null double"]))


def ln_factorial(x: Column) -> Column:
    """ln x! of whole numbers: a table below 16, Stirling's series from there (error below 1e-11)."""
    table = F.lit([math.lgamma(k + 1) for k in range(16)])
    y = F.greatest(x, F.lit(16.0))
    series = y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 16, table[F.greatest(F.least(x, F.lit(15.0)), F.lit(0.0)).cast("int")]).otherwise(series)


def overlaps(a: Column, c: Column, n: Column) -> tuple[Column, Column]:
    """Least and most m of a hypergeometric sum that weigh anything in a double.

    P(|m - ac/n| >= t) <= 2 exp(-2 t^2 / min(a, c)) (Hoeffding): all beyond t = 8 sqrt(min(a, c)) together weighs below 1e-54.
    """
    mid, reach = a.cast("double") * c / n, 8 * F.sqrt(F.least(a, c).cast("double"))
    return F.greatest(F.lit(1).cast("long"), a + c - n, F.floor(mid - reach).cast("long")), F.least(a, c, F.ceil(mid + reach).cast("long"))


def exact_null(binned: DataFrame, entities: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The expectation of i_raw over all label permutations, by the hypergeometric distribution.

    E[MI] = sum over bin sizes a, label sizes c and overlaps m of m/N log2(N m / (a c)) Hyp(m; N, a, c); only distinct
    (a, c) pairs with their multiplicities are enumerated. i_null = E[MI] + log2 S - H(labels).
    """
    keys = [*by]
    a = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("a")).groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("na"))
    c = binned.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("nc"))
    n = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))
    low, high = overlaps(F.col("a"), F.col("c"), F.col("N"))
    m = a.join(c, keys).join(n, keys).where(high >= low).withColumn("m", F.explode(F.sequence(low, high)))
    N, A, C, M = (F.col(x).cast("double") for x in ("N", "a", "c", "m"))
    lf = ln_factorial
    p = F.exp(lf(A) + lf(C) + lf(N - A) + lf(N - C) - lf(N) - lf(M) - lf(A - M) - lf(C - M) - lf(N - A - C + M))
    mi = m.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nc") * M / N * F.log2(N * M / (A * C)) * p).alias("e_mi"))
    h = c.join(n, keys).groupBy(*keys).agg((-F.sum(F.col("nc") * C / N * F.log2(C / N))).alias("h"))
    return _with_s(mi.join(h, keys), entities).select(*keys, (F.col("e_mi") + F.log2("s") - F.col("h")).alias("i_null"))


def corrected(raw: DataFrame, null: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """i_corrected = max(0, i_raw - i_null); 0 where nothing was measured."""
    return raw.join(null, [*by], "left").select(*by, "n", "n_bins", "i_raw", F.coalesce("i_null", F.lit(0.0)).alias("i_null"), F.greatest(F.col("i_raw") - F.coalesce("i_null", F.lit(0.0)), F.lit(0.0)).alias("i_corrected"))


def with_empty(found: DataFrame, obs: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """found (the result of corrected) with n_missing, and a row of zeros for each group that has no measured row."""
    every = obs.groupBy(*by).agg(F.count_if(F.col("x").isNull()).alias("n_missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(found, [*by], "left").select(*by, zero("n"), "n_missing", zero("n_bins"), zero("i_raw"), zero("i_null"), zero("i_corrected"))


def fano_bounds(predictions: DataFrame, by: tuple[str, ...] = (), entities: Column | None = None) -> DataFrame:
    """acc, i_fano and i_xent from (label, predicted, q_true); S is the number of labels unless given. NULL i_fano for S < 2."""
    s = F.count_distinct("label") if entities is None else F.max(entities)
    d = predictions.groupBy(*by).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("acc"), F.avg(F.log2(F.least(F.greatest("q_true", F.lit(1e-12)), F.lit(1.0)))).alias("lq"), s.alias("s"))
    pe = 1 - F.col("acc")
    hb = F.when((pe > 0) & (pe < 1), -pe * F.log2(pe) - (1 - pe) * F.log2(1 - pe)).otherwise(0.0)
    rest = F.when(F.col("s") > 2, pe * F.log2(F.greatest(F.col("s") - 1, F.lit(1)))).otherwise(0.0)
    return d.select(*by, "acc", F.when(F.col("s") >= 2, F.log2("s") - hb - rest).alias("i_fano"), (F.log2("s") + F.col("lq")).alias("i_xent"), "s")
