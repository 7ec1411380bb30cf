"""Document fingerprints by consistent weighted sampling: gamma-based samples for each weighted word, in SQL functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.llm.common import bounded, cut
from obsgrain.llm.exact import located, place

#: Samples of a fingerprint: its likeness has a standard error of at most 0.09.
SAMPLES = 32
#: What separates words.
BLANK = r"[\x20\x09-\x0D]+"
#: Documents of a range of ids, and into how many ranges each of two levels divides at most.
RANGE_ROWS, FAN = 512, 1 << 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")


def weighted(text: Column, edited: Column) -> Column:
    """Array of (term, which, weight): a word's 63-bit hash, 0 for words of text and 1 for those of edited, and how often it occurs there."""
    marked = F.concat(F.transform(words(text), lambda w: F.shiftleft(F.xxhash64(w), 1)), F.transform(words(edited), lambda w: F.shiftleft(F.xxhash64(w), 1) + 1))
    return F.sort_array(marked)


def _runs(ordered: Column) -> Column:
    """Where each run of equal numbers starts."""
    return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (ordered[i] != ordered[F.greatest(i - 1, F.lit(0))]))


def sample(term: Column, log_weight: Column, k: int, seed: int = 0) -> Column:
    """ln a of the k-th sample for a term, given the logarithm of its weight.

    r = -ln(u1 u2) and c = -ln(u3 u4) are Gamma(2, 1), b is uniform, all from two hashes of term and k; t = floor(ln S / r + b);
    ln a = ln c - r (t - b + 1). The term with the least value is the sample: as the value is a function of term and t,
    two texts have the same least value where they have sampled the same term at the same t, which happens with the
    probability of their generalised Jaccard similarity.
    """
    unit = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) / float(1 << bits)
    h1, h2 = (F.xxhash64(term, F.lit(2 * k + i + 1000 * seed)) for i in (0, 1))
    r, b = -F.ln(unit(h1, 1, 21) * unit(h1, 22, 21)), unit(h1, 43, 21)
    c = F.ln(-F.ln(unit(h2, 2, 31) * unit(h2, 33, 31)))
    return F.when(log_weight == 0, c - r * (1 - b)).otherwise(c - r * (F.floor(log_weight / r + b) - b + 1))


def _divided(ids: list[int]) -> tuple[list[int], list[int]]:
    """(cuts, parts) of sorted quantiles: cuts between ranges, and into how many parts each range is dealt by a hash.

    An id that is several of the quantiles has a range of its own, in so many parts.
    """
    times = Counter(ids)
    cuts = sorted({c for v, n in times.items() for c in ((v, v + 1) if n > 1 else (v,))})
    return cuts, [1, *(times[c] if times[c] > 1 else 1 for c in cuts)]


def _place(value: Column, cuts: Column, depth: int) -> Column:
    """How many of the ascending cuts (filled up to 2^depth with the largest number) lie at or below a value, by halving."""
    steps = F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1))
    half = lambda i: F.pow(F.lit(2), i).cast("int")
    return F.aggregate(steps, F.lit(0), lambda lo, i: F.when(F.get(cuts, lo + half(i) - 1) <= value, lo + half(i)).otherwise(lo))


def ranges(docs: DataFrame) -> DataFrame:
    """docs with own (a hash of the text) and their range: high, low and part, in the order of ids.

    Ranges have about RANGE_ROWS documents, from approximate percentiles on two levels: up to FAN ranges of up to FAN each. An id
    that many rows share, or none, is dealt into parts by the hash of its text and, for equal texts, of the row. The cuts, at
    most FAN * FAN numbers, are the only thing that reaches the driver.
    """
    spark, big = docs.sparkSession, (1 << 63) - 1
    docs = docs.withColumn("own", F.xxhash64("text"))
    ids = docs.select("doc_id")
    n, named = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    wanted = -(-named // RANGE_ROWS)
    tops = max(1, min(FAN, -(-wanted // FAN)))
    quantiles = lambda m: F.percentile_approx("doc_id", [i / m for i in range(1, m)], 10 * m)
    high = sorted(set(ids.agg(quantiles(tops).alias("q")).first()["q"] or [])) if tops > 1 else []
    depth = max(1, (len(high) + 1).bit_length())
    padded = F.lit([*high, *[big] * ((1 << depth) - len(high))]).cast("array<bigint>")
    first = lambda d: d.withColumn("high", F.when(F.col("doc_id").isNull(), -1).otherwise(_place(F.col("doc_id"), padded, depth)))
    each = max(2, min(FAN, -(-wanted // tops)))
    low = [(r["high"], *_divided(sorted(r["q"]))) for r in first(ids.where("doc_id is not null")).groupBy("high").agg(quantiles(each).alias("q")).collect()] if named else []
    fine = max([1, *((len(cuts) + 1).bit_length() for _, cuts, _ in low)])
    rows = [(h, cuts + [big] * ((1 << fine) - len(cuts)), parts) for h, cuts, parts in low] + [(-1, [big] * (1 << fine), [max(1, -(-(n - named) // RANGE_ROWS))])]
    table = spark.createDataFrame(rows, "high int, cuts array<bigint>, parts array<int>")
    out = first(docs).join(F.broadcast(table), "high").withColumn("low", F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id"), F.col("cuts"), fine)))
    parts = F.coalesce(F.get("parts", F.col("low")), F.lit(1))
    spread = F.when(parts > 1, F.pmod(F.xxhash64("own", "at"), parts)).otherwise(0).cast("int")
    return out.withColumn("part", spread).drop("cuts", "parts")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (of rows with a number `at` that tells them apart), own, high, low, part and, by descending doc_id, the next row's next_id, next_text and next_own; after the last row comes the first.

    Ranges of ids are sorted apart: one shuffle of the texts. The row that follows a range's last one travels along as a copy.
    Rows of one id are in the order of their parts and hashes, null ids come last.
    """
    rows = ranges(docs.select("doc_id", "text", "at"))
    key = ["high", "low", "part"]
    # ~own grows as own falls
    tops = rows.groupBy(*key).agg(F.max(F.struct("doc_id", F.bitwise_not("own").alias("inverse"))).alias("top"))
    order = Window.orderBy(F.desc("high"), F.desc("low"), "part")  # one row a range
    heads = tops.select(*key, F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__next"))
    heads = bounded(cut(heads.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("__next.doc_id").alias("__id"), F.bitwise_not(F.col("__next.inverse")).alias("__own"))))
    copies = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own"))).groupBy("__high", "__low", "__part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("own").alias("own"))
    copies = copies.select(*[F.col(f"__{c}").alias(c) for c in key], "doc_id", "text", "own", F.lit(1).alias("copy"))
    every = rows.select(*key, "doc_id", "text", "own", F.lit(0).alias("copy")).unionByName(copies)
    inside = Window.partitionBy(*key).orderBy("copy", F.col("doc_id").desc_nulls_last(), "own")
    out = every.select("*", *[F.lead(c).over(inside).alias(f"next_{c.removeprefix('doc_')}") for c in ("doc_id", "text", "own")])
    return out.where("copy = 0").drop("copy")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; one row per row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 bits a sample, in hex),
    near_edited, near_next (share of equal samples), next_id. A null text is empty; texts without words share one
    fingerprint (zeros), which is like itself and nothing else. A single row is its own next. Repeated rows give repeated
    rows; a table without rows gives none; columns other than doc_id and text are not read. A very long text is sorted with
    its range and costs time in proportion to its words.

    Terms are grouped within the ranges that the texts were dealt into, so texts are shuffled once and terms not at all.
    """
    docs = located(docs)
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(*place(docs)).alias("at")))
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 2 as int))"), F.expr("substring(next_text, 1, cast(length(text) div 2 as int))"))
    key = ["high", "low", "part", "row", "doc_id", "n_chars", "edited_sha256", "own", "next_id", "next_own"]
    rows = rows.select("high", "low", "part", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), "next_id", "next_own", "own", edited.alias("edited"))
    rows = rows.select(*[c for c in key if c not in ("row", "edited_sha256")], F.monotonically_increasing_id().alias("row"), F.sha2("edited", 256).alias("edited_sha256"), weighted(F.col("text"), F.col("edited")).alias("terms"))
    rows = rows.withColumn("starts", F.when(F.size("terms") > 0, _runs(F.col("terms"))).otherwise(F.array().cast("array<int>")))
    ends = F.expr("transform(starts, (s, i) -> named_struct('h', terms[s], 'w', if(i + 1 < size(starts), starts[i + 1], size(terms)) - s))")
    terms = rows.select(*key, F.explode_outer(ends).alias("x")).select(*key, F.shiftright("x.h", 1).alias("term"), F.col("x.h").bitwiseAND(1).alias("which"), F.ln(F.col("x.w").cast("double")).alias("weight"))
    sides = terms.groupBy(*key, "which").agg(*[F.min(sample(F.col("term"), F.col("weight"), k, seed)).alias(f"s{k}") for k in range(samples)])
    bits = sides.select(*key, "which", *[F.hash(f"s{k}").alias(f"b{k}") for k in range(samples)])
    both = bits.groupBy(*key).agg(*[F.max(F.when(F.col("which") == which, F.col(f"b{k}"))).alias(f"{name}{k}") for which, name in ((0, "t"), (1, "e")) for k in range(samples)])
    prints = lambda name: F.array(*[F.coalesce(F.col(f"{name}{k}"), F.lit(0)) for k in range(samples)])
    signed = cut(both.select("doc_id", "n_chars", "edited_sha256", "own", "next_id", "next_own", prints("t").alias("print"), prints("e").alias("edited_print")))
    nexts = signed.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own"), F.col("print").alias("next_print")).dropDuplicates(["next_id", "next_own"])
    nexts = nexts.select(F.col("next_id").alias("__id"), F.col("next_own").alias("__own"), "next_print")
    both = signed.join(nexts, F.col("next_id").eqNullSafe(F.col("__id")) & (F.col("next_own") == F.col("__own")), "left")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", _hex("print").alias("fingerprint"), _hex("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"), "next_id",
    )


def _hex(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of samples that two fingerprints (arrays) have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")
