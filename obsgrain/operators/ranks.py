"""Ranks and exact quantiles without a task that holds a whole group: rows are dealt by ranges, each range counts its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.functions.scalars import ascending
from obsgrain.operators.cuts import bounded, cut

#: Rows from which quantiles are found by ranks instead of an aggregate that holds a group's distinct values.
RANKED_FROM = 1 << 22


#: Rows of a range where the number of rows is known.
RANGE_ROWS = 1 << 18


def ranked(df: DataFrame, order: list, by: tuple[str, ...] = (), name: str = "k", rows: int | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank from 1 in the given order, within each group of `by` (nulls are a group). Ties are ranked in any order, nulls of a named column last.

    A range is sorted once and lies as it was sorted, so a rank is a difference of row numbers and what lies before: one row a
    range and group, broadcast if their number allows it. rows: how many df has, if that is known; the ranges then hold about
    RANGE_ROWS each, whatever df's size. drop: columns that only order.
    """
    sort = [*by, *[ascending(c)[0] if isinstance(c, str) else c for c in order]]
    dealt = df.repartitionByRange(*([] if rows is None else [max(1, -(-rows // RANGE_ROWS))]), *sort).sortWithinPartitions(*sort)
    d = cut(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")).drop(*drop))
    per = d.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = per.withColumn("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")) - F.col("__first"))
    before = bounded(cut(before.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__p").alias("__of"), "__b")))
    same = F.col("__p") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = d.join(before, same)
    return out.withColumn(name, F.col("__i") + F.col("__b") + 1).drop("__p", "__i", "__of", "__b", *[f"__by_{c}" for c in by])


def quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (), method: str = "auto") -> DataFrame:
    """by, q: exact, linearly interpolated quantiles of the measured values, as an array in the order of probs.

    method "aggregate" holds a group's distinct values in one task, "ranked" deals rows by ranges; "auto" is ranked from
    RANKED_FROM rows on. Both give the same numbers.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    if method == "aggregate" or (method == "auto" and rows.limit(RANKED_FROM + 1).count() <= RANKED_FROM):
        return rows.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    sizes = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    d = ranked(rows, ["__v"], by, "__k", rows=sizes.agg(F.sum("__n").alias("n")).first()["n"])
    d = d.join(bounded(sizes.select(*[F.col(c).alias(f"__g_{c}") for c in by], "__n")), _all_same(by)) if by else d.crossJoin(F.broadcast(sizes))
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    ends = [e for k, a in enumerate(at) for e in (F.max(F.when(F.col("__k") - 1 == F.floor(a), F.col("__v"))).alias(f"__l{k}"), F.max(F.when(F.col("__k") - 1 == F.ceil(a), F.col("__v"))).alias(f"__h{k}"))]
    wanted = F.lit(False)
    for a in at:
        wanted |= (F.col("__k") - 1).isin(F.floor(a), F.ceil(a))
    g = d.where(wanted).groupBy(*by).agg(F.max("__n").alias("__n"), *ends)
    # between two equal values lies that value itself: a sum of two shares may be off by a bit, and rows tied with an edge change sides
    low, high = ([F.col(f"__{e}{k}") for k in range(len(at))] for e in "lh")
    found = [F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi) for lo, hi, a in zip(low, high, at, strict=True)]
    return g.select(*by, F.array(*found).alias("q"))


def _all_same(by: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return same
