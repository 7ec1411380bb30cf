"""Labelled segments: runs, predecessors, spans, and joins of points to intervals and to nearest samples.

Segments: utt_id, seq, label, start, end (half-open, contiguous, ordered by seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closures, stops and silences of the 61-label phone set.
CLOSURES = ["bcl", "dcl", "gcl", "pcl", "tcl", "kcl"]
STOPS = ["b", "d", "g", "p", "t", "k"]
SILENCE = ["h#", "pau", "epi"]

#: Classes of the 61-label phone set.
PHONE_CLASSES = {
    "silence": ["h#", "pau", "epi"],
    "vowel": ["iy", "ih", "eh", "ey", "ae", "aa", "aw", "ay", "ah", "ao", "oy", "ow", "uh", "uw", "ux", "er", "ax", "ix", "axr", "ax-h"],
    "nasal": ["m", "n", "ng", "em", "en", "eng", "nx"],
    "liquid": ["l", "el", "r"],
    "glide": ["w", "y", "hh", "hv"],
    "voiced_obstruent": ["b", "d", "g", "jh", "z", "zh", "v", "dh", "dx", "bcl", "dcl", "gcl"],
    "voiceless_obstruent": ["p", "t", "k", "ch", "s", "sh", "f", "th", "q"],
    "closure": ["pcl", "tcl", "kcl"],
}
SONORANT = ["vowel", "nasal", "liquid", "glide"]
VOICED = [*SONORANT, "voiced_obstruent"]
SPEECH = [*VOICED, "voiceless_obstruent"]
SIBILANTS = ["s", "sh", "z", "zh"]


def phone_class(label: Column) -> Column:
    out = None
    for name, labels in PHONE_CLASSES.items():
        out = (F if out is None else out).when(label.isin(*labels), name)
    return out.otherwise("other")


def masks(frames: DataFrame) -> DataFrame:
    """Adds class, voiced, sonorant, speech and sibilant to rows with a label."""
    d = frames.withColumn("class", phone_class(F.col("label")))
    return d.select("*", F.col("class").isin(*VOICED).alias("voiced"), F.col("class").isin(*SONORANT).alias("sonorant"), F.col("class").isin(*SPEECH).alias("speech"), F.col("label").isin(*SIBILANTS).alias("sibilant"))


def _in_order() -> Window:
    return Window.partitionBy("utt_id").orderBy("seq")


def runs(segments: DataFrame, silence: list[str] = SILENCE) -> DataFrame:
    """Maximal runs of segments that are not silence: utt_id, run, start, end, n."""
    silent = F.col("label").isin(*silence)
    d = segments.withColumn("run", F.sum(silent.cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(~silent).groupBy("utt_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def run_lengths(segments: DataFrame, silence: list[str] = SILENCE) -> DataFrame:
    """Mean length and number of runs of each utterance; NULL and 0 if all is silence."""
    r = runs(segments, silence).groupBy("utt_id").agg(F.avg(F.col("end") - F.col("start")).alias("mean_length"), F.count(F.lit(1)).alias("n"))
    return segments.select("utt_id").distinct().join(r, "utt_id", "left").select("utt_id", "mean_length", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def preceded(segments: DataFrame, labels: list[str] = STOPS, by: list[str] = CLOSURES) -> DataFrame:
    """Mean length and number of segments of the labels whose predecessor is one of `by`."""
    d = segments.withColumn("before", F.lag("label").over(_in_order()))
    hit = F.col("label").isin(*labels) & F.coalesce(F.col("before").isin(*by), F.lit(False))
    return d.groupBy("utt_id").agg(F.avg(F.when(hit, F.col("end") - F.col("start"))).alias("mean_length"), F.count_if(hit).alias("n"))


def rate(segments: DataFrame, events: list[str] = PHONE_CLASSES["vowel"], silence: list[str] = SILENCE, scale: float = 1.0) -> DataFrame:
    """Events over the span from the first to the last segment that is not silence; NULL without such a span."""
    loud = ~F.col("label").isin(*silence)
    d = segments.groupBy("utt_id").agg(F.count_if(F.col("label").isin(*events)).alias("n"), F.min(F.when(loud, F.col("start"))).alias("a"), F.max(F.when(loud, F.col("end"))).alias("b"))
    return d.select("utt_id", F.try_divide(F.col("n") * F.lit(float(scale)), F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a"))).alias("rate"), "n")


def frames_of(segments: DataFrame, length: int = 400, hop: int = 160) -> DataFrame:
    """Frame numbers whose centre (number * hop + length // 2) lies in each segment: an interval join by arithmetic.

    Each segment makes its own frames, so points meet segments without a range join. Frames must fit: their end lies within
    the utterance.
    """
    half = length // 2
    total = F.max("end").over(Window.partitionBy("utt_id"))
    d = segments.withColumn("__n", F.greatest(F.floor((total - length) / hop) + 1, F.lit(0)))
    first = F.greatest(F.ceil((F.col("start") - half) / hop), F.lit(0))
    last = F.least(F.ceil((F.col("end") - half) / hop), F.col("__n")) - 1
    d = d.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    return d.select("utt_id", "frame", (F.col("frame") * hop + half).alias("center"), "label")


def interval_join(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The label of the segment with start <= at < end for each point (utt_id, at); '' if there is none.

    Segments of an utterance do not overlap. One union sorted by utterance and time carries the segment that began last, so
    rows grow with points and segments, not with their pairs.
    """
    p = points.select("utt_id", "at", F.lit(1).alias("__p"), F.struct(*[F.col(c) for c in points.columns]).alias("__row"), F.lit(None).cast("struct<end:double,label:string>").alias("__s"))
    s = segments.select("utt_id", F.col("start").alias("at"), F.lit(0).alias("__p"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.struct(F.col("end").cast("double").alias("end"), F.col("label").cast("string").alias("label")).alias("__s"))
    began = F.last("__s", True).over(Window.partitionBy("utt_id").orderBy("at", "__p").rowsBetween(Window.unboundedPreceding, 0))
    d = p.unionByName(s).withColumn("__b", began).where("__p = 1")
    return d.select("__row.*", F.when(F.col("at") < F.col("__b.end"), F.col("__b.label")).otherwise("").alias("label"))


def in_any(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds inside: 1 if any interval (utt_id, start, end) holds the point, else 0; intervals may overlap.

    Some interval holds a point if of those that began by then the latest end lies beyond it: a running maximum over one
    union sorted by utterance and time, no pairs.
    """
    p = points.select("utt_id", "at", F.lit(1).alias("__p"), F.struct(*[F.col(c) for c in points.columns]).alias("__row"), F.lit(None).cast("double").alias("__end"))
    i = intervals.select("utt_id", F.col("start").alias("at"), F.lit(0).alias("__p"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col("end").cast("double").alias("__end"))
    latest = F.max("__end").over(Window.partitionBy("utt_id").orderBy("at", "__p").rowsBetween(Window.unboundedPreceding, 0))
    d = p.unionByName(i).withColumn("__latest", latest).where("__p = 1")
    return d.select("__row.*", F.coalesce(F.col("__latest") > F.col("at"), F.lit(False)).cast("int").alias("inside"))


def segment_lists(segments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Each utterance's segments in order: utt_id, segments (array of start, end, label); with wanted, one row for each of its utt_ids, null if it has none."""
    lists = segments.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    return wanted.select("utt_id").distinct().join(lists, "utt_id", "left") if wanted is not None else lists


def windows(segments: DataFrame, before: float, after: float) -> DataFrame:
    """Segments widened by `before` and `after`, cut at 0 and at the utterance's end: utt_id, seq, label, low, high."""
    total = F.max("end").over(Window.partitionBy("utt_id"))
    return segments.select("utt_id", "seq", "label", F.greatest(F.lit(0.0), F.col("start") - before).alias("low"), F.least(total.cast("double"), F.col("end") + after).alias("high"))


def timing(segments: DataFrame, events: list[str], labels: list[str], by: list[str], silence: list[str], scale: float = 1.0) -> DataFrame:
    """The three measures of an utterance's segments joined: rate, stop (after `by`) and run, each with its number of events."""
    one = rate(segments, events, silence, scale).withColumnsRenamed({"n": "n_rate"})
    two = preceded(segments, labels, by).withColumnsRenamed({"mean_length": "stop", "n": "n_stop"})
    three = run_lengths(segments, silence).withColumnsRenamed({"mean_length": "run", "n": "n_run"})
    return one.join(two, "utt_id").join(three, "utt_id")


def nearest(points: DataFrame, samples: DataFrame) -> DataFrame:
    """The value of the sample (utt_id, at, value) nearest in time to each point (utt_id, at); of two as near, the later.

    One union sorted by utterance and time: last value at or before, first at or after, then the nearer. Ends are clamped.
    """
    both = points.select("utt_id", "at", F.lit(1).alias("__p"), F.lit(None).cast("struct<at:double,value:double>").alias("__s")).unionByName(
        samples.select("utt_id", "at", F.lit(0).alias("__p"), F.struct(F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value")).alias("__s"))
    )
    w = Window.partitionBy("utt_id").orderBy("at", "__p")
    back = Window.partitionBy("utt_id").orderBy(F.col("at").desc(), F.col("__p").asc())
    d = both.withColumn("__b", F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.last("__s", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    before, after = F.col("at") - F.col("__b.at"), F.col("__a.at") - F.col("at")
    take = F.when(F.col("__b").isNull(), F.col("__a.value")).when(F.col("__a").isNull(), F.col("__b.value")).when(after <= before, F.col("__a.value")).otherwise(F.col("__b.value"))
    return d.where("__p = 1").select("utt_id", "at", take.alias("value"))
