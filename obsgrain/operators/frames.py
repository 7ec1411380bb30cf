"""Frame features over arrays of samples or spectra, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.functions.scalars import semitones

#: Fewest measured frames for an aggregate.
LEAST_FRAMES = 5


def pre_emphasis(samples: Column, c: float = 0.97) -> Column:
    """y[0] = x[0], y[t] = x[t] - c x[t-1]."""
    return F.transform(samples, lambda x, i: F.when(i == 0, x).otherwise(x - c * F.get(samples, i - 1)))


def framed(signals: DataFrame, length: int, hop: int) -> DataFrame:
    """utt_id, frame, samples array: 1 + (n - length) // hop frames of each signal; none of one too short."""
    n = F.floor((F.size("samples") - length) / hop)
    d = signals.where(F.size("samples") >= length).select("utt_id", "samples", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame"))
    return d.select("utt_id", "frame", F.slice("samples", (F.col("frame") * hop + 1).cast("int"), length).alias("samples"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def rms(samples: Column) -> Column:
    return F.sqrt(total(F.transform(samples, lambda x: x * x)) / F.size(samples))


def band(power: Column, freqs: Column, low: float, high: float) -> Column:
    """Sum of power at low <= frequency < high."""
    return F.aggregate(F.zip_with(power, freqs, lambda p, f: F.when((f >= low) & (f < high), p).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def ratio(num: Column, den: Column, tiny: float = 1e-12) -> Column:
    return num / (den + tiny)


def moments(power: Column, freqs: Column, tiny: float = 1e-12) -> dict[str, Column]:
    """Power-weighted centroid, deviation, skewness and kurtosis."""
    p = F.transform(power, lambda x: x / (total(power) + tiny))
    mu = total(F.zip_with(p, freqs, lambda a, f: a * f))
    central = lambda k: total(F.zip_with(p, freqs, lambda a, f: a * F.pow(f - mu, F.lit(float(k)))))
    sd = F.sqrt(central(2))
    return {"centroid": mu, "sd": sd, "skewness": central(3) / F.pow(sd + tiny, F.lit(3.0)), "kurtosis": central(4) / F.pow(sd + tiny, F.lit(4.0))}


def entropy(power: Column, tiny: float = 1e-12) -> Column:
    """-sum p ln(p + tiny), p the share of power."""
    t = total(power) + tiny
    return -total(F.transform(power, lambda x: (x / t) * F.ln(x / t + tiny)))


def rolloff(power: Column, freqs: Column, share: float = 0.85) -> Column:
    """First frequency where the running sum of power reaches the share of all."""
    aim = share * total(power)
    run = F.aggregate(F.arrays_zip(power.alias("p"), freqs.alias("f")), F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("f")), lambda a, x: F.struct((a["s"] + x["p"]).alias("s"), F.when(a["f"].isNull() & (a["s"] + x["p"] >= aim), x["f"].cast("double")).otherwise(a["f"]).alias("f")))
    return run["f"]


def peak(power: Column, freqs: Column, low: float) -> Column:
    """Frequency of the largest power at or above `low`."""
    pairs = F.filter(F.zip_with(power, freqs, lambda p, f: F.struct(p.alias("p"), (-f).alias("f"))), lambda x: -x["f"] >= low)
    return -F.array_max(pairs)["f"]


def delta(frames: DataFrame, column: str) -> Column:
    """|x[t] - x[t-1]| where both are known."""
    return F.abs(F.col(column) - F.lag(column).over(Window.partitionBy("utt_id").orderBy("frame")))


def flux(power: str = "power") -> Column:
    """Euclidean distance of magnitudes from the frame before; NULL for the first."""
    before = F.lag(power).over(Window.partitionBy("utt_id").orderBy("frame"))
    return F.when(before.isNotNull(), F.sqrt(total(F.zip_with(F.col(power), before, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), F.lit(2.0))))))


def peak_db(power: Column, freqs: Column, low: Column, high: Column) -> Column:
    """10 log10 of the largest power with low <= frequency <= high."""
    inside = F.filter(F.zip_with(power, freqs, lambda p, f: F.when((f >= low) & (f <= high), p)), lambda x: x.isNotNull())
    return 10 * F.log10(F.array_max(inside) + 1e-12)


def guarded(value: Column, kind: str = "mean", mask: Column | None = None, least: int = LEAST_FRAMES) -> list[Column]:
    """[aggregate, count] over measured frames inside the mask; NULL below `least` of them. Kinds: mean, median, sd_semitone."""
    v = value if mask is None else F.when(mask, value)
    agg = {"mean": F.avg(v), "median": F.median(v), "sd_semitone": F.stddev_samp(semitones(F.when(v > 0, v)))}[kind]
    return [F.when(F.count(v) >= least, agg), F.count(v)]
