"""Mixing sources to target weights by hash thresholds: nested histograms find each source's budget, one filter applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.llm.common import bounded, cut, fresh

#: Words are what these bytes separate.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits in all, and those that one histogram resolves: at most 65,536 buckets a source and level.
BITS, STEP = 48, 16
#: A source is used at most so many times over.
REPEATS = 3


def size_of(text: Column) -> Column:
    """Words of a text; a null one has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def spot_of(doc_id: Column, text: Column, seed: int) -> Column:
    """48 bits of the MD5 of seed and id, or of the text's MD5 where there is no id; the same in any engine."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(said), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weight: Column | None = None) -> DataFrame:
    """(source, source_size) with each one's target: all words shared by weight, at most REPEATS times a source's size, the excess reshared.

    Sources by code point, null last, weigh 1, 2, 3, repeating, unless `weight` (positive whole numbers) says otherwise.
    Resharing until none is above its cap ends at one level L with target = min(cap, L * weight); sorted by cap over weight,
    the first source whose share of what is left fits under its cap gives L. One row a source: windows over all of them
    see narrow rows only.
    """
    weight = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1 if weight is None else weight
    rows = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * REPEATS)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(by_cap).alias("k"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    fits = F.col("words_left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    level = F.col("words_left").cast("double") / F.col("weight_left")
    rows = rows.withColumn("first", F.min(F.when(fits, F.struct("k", level.alias("level")))).over(every))
    target = F.when(F.col("k") < F.col("first.k"), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """Where each source's budget ends: `whole` copies of every document and one more of those below `edge` (or at it, if `closed`).

    sized: source, size, spot; aims: the result of targets. Every level sums the sizes of the documents in the bucket where
    the level before ended, in buckets of the next bits; sums are made before they are shuffled, and no row is sorted.
    """
    state = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(REPEATS))).otherwise(0).cast("long"))
    state = state.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at_edge"))
    for shift in range(BITS - STEP, -1, -STEP):
        state = cut(state)
        inside = sized.join(bounded(state.select(F.col("source").alias("__source"), "edge")), F.col("source").eqNullSafe(F.col("__source")) & (F.shiftright("spot", shift + STEP) == F.col("edge")))
        sums = inside.groupBy("source", F.shiftright("spot", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = sums.join(bounded(state.select(F.col("source").alias("__source"), "rest", "below")), F.col("source").eqNullSafe(F.col("__source")))
        run = run.withColumn("up_to", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        ends = run.where(F.col("up_to") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "up_to", "size")).alias("end"))
        ends = ends.select(F.col("source").alias("__source"), "end")
        kept = state.join(ends, F.col("source").eqNullSafe(F.col("__source")), "left")
        state = kept.select(
            "source", "source_size", "weight", "target", "whole", "rest",
            F.coalesce("end.bucket", F.lit(0).cast("long")).alias("edge"), F.coalesce(F.col("end.up_to") - F.col("end.size"), F.lit(0).cast("long")).alias("below"), F.coalesce("end.size", F.lit(0).cast("long")).alias("at_edge"),
        )
    return cut(state.withColumn("closed", F.col("below") + F.col("at_edge") - F.col("rest") < F.col("rest") - F.col("below")))


def plan(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized, limits): id, source, size and hash of every row of docs, written once and read by every level; each source's thresholds."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), spot_of(F.col("doc_id"), F.col("text"), seed).alias("spot")))
    return sized, thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weight))


def copies() -> Column:
    """How often the mix takes a row that has spot and its source's thresholds."""
    return F.col("whole") + ((F.col("spot") < F.col("edge")) | ((F.col("spot") == F.col("edge")) & F.col("closed"))).cast("long")


def mix(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """How many words the mix takes of every document; one row per row of docs.

    Columns: doc_id, size, source_size, target, taken, source, copies. A null text has size 0; null is a source of its own,
    the last; a source without words has target 0; rows without an id are told apart by their texts; repeated rows share a
    hash and are taken or left together; a table without rows gives none; a very long text is a document like any other,
    so a source's words come as near its target as the document at the edge allows. Columns other than doc_id, source and text are not read.
    """
    sized, limits = plan(docs, seed, weight)
    rows = sized.join(bounded(limits.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), "source", copies().alias("copies"))


def mixed(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs; texts are filtered where they lie.

    Nulls, repeated rows and empty tables as in mix().
    """
    _, limits = plan(docs, seed, weight)
    own = dict(zip(limits.columns, fresh(docs, *[f"__of_{c}" for c in limits.columns]), strict=True))
    spot, copy = fresh(docs, "__spot", "__copy")
    limits = bounded(limits.select(*[F.col(c).alias(name) for c, name in own.items()]))
    rows = docs.withColumn(spot, spot_of(docs["doc_id"], docs["text"], seed)).join(limits, docs["source"].cast("string").eqNullSafe(F.col(own["source"])))
    edge, closed = F.col(own["edge"]), F.col(own["closed"])
    more = F.col(own["whole"]) + ((F.col(spot) < edge) | ((F.col(spot) == edge) & closed)).cast("long")
    return rows.withColumn(copy, F.explode(F.when(more > 0, F.sequence(F.lit(1).cast("long"), more)))).select(*[docs[c] for c in docs.columns])


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT AS spot
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM src),
ranked AS (
  SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT k AS k0, words_left::DOUBLE / weight_left::DOUBLE AS l FROM ranked WHERE words_left * w <= cap * weight_left ORDER BY k LIMIT 1),
aims AS (SELECT source, source_size, CASE WHEN k < k0 THEN cap::DOUBLE ELSE l * w END AS target FROM ranked, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM aims),
runs AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, s.source, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spot) AS up_to, sum(s.size) OVER (PARTITION BY s.source, s.spot) AS own
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
took AS (SELECT *, whole + (up_to <= rest OR (up_to - own <= rest AND up_to - rest < rest - (up_to - own)))::BIGINT AS copies FROM runs)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM took
"""
