"""Writers: tables, manifests, provenance, reports."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(records: DataFrame, features: list[str]) -> DataFrame:
    """Maps `features` and `coverage` as columns: each name, then cov_ and name."""
    ids = [c for c in records.columns if c not in ("features", "coverage")]
    return records.select(*ids, *[F.try_element_at("features", F.lit(n)).alias(n) for n in features], *[F.try_element_at("coverage", F.lit(n)).alias(f"cov_{n}") for n in features])


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of the configuration as sorted, compact JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; a path that exists is an error, so what is being read is never overwritten."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays are comma-joined."""
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c, kind in df.dtypes if kind.startswith("array")}
    (df.withColumns(joined) if joined else df).write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


def record_tree(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON records in one folder for each value of `by`; the commit protocol makes each write whole."""
    df.write.mode("append").partitionBy(*by).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_manifest(obs_wide: DataFrame, features: list[str], ok: str = "decode_ok", entity: str = "speaker_id", name: str | None = None, config: dict | None = None) -> DataFrame:
    """(section, item, value) of a run: totals, each feature's measured share, rows of each entity, and failed rows by name."""
    cells = [F.count(F.lit(1)).cast("double").alias("rows"), F.count_if(F.col(ok)).cast("double").alias("decoded"), F.count_if(~F.col(ok)).cast("double").alias("failures"), F.count_distinct(entity).cast("double").alias("entities")]
    shares = [F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features]

    def section(label: str, exprs: list) -> DataFrame:
        one = obs_wide.agg(*exprs)
        return one.select(F.lit(label).alias("section"), F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in one.columns])).alias("x")).select("section", "x.*")

    out = section("total", cells).unionByName(section("measured", shares)) if shares else section("total", cells)
    out = out.unionByName(obs_wide.groupBy(F.col(entity).cast("string").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("entity").alias("section"), "item", "value"))
    if name:
        out = out.unionByName(obs_wide.where(~F.col(ok)).select(F.lit("failed").alias("section"), F.col(name).cast("string").alias("item"), F.lit(1.0).alias("value")))
    if config is not None:
        hashed = out.sparkSession.createDataFrame([("config", config_hash(config), 1.0)], "section string, item string, value double")
        out = out.unionByName(hashed)
    return out


#: Different counts of observations an entity that a provenance record lists at most.
MOST_COUNTS = 100_000


def provenance(spark: SparkSession, path: str, rows: DataFrame, entity: str, stratum: str) -> dict:
    """Digest of the files, row and entity counts, entities by stratum and histogram of observations an entity, for a JSON file.

    The digest is the SHA-256 of the files' digests in the order of their names. Raises if the histogram is longer than
    MOST_COUNTS.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h"))
    one = files.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ","), 256).alias("h")).first()
    per = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.min(stratum).alias("g"))
    counts = per.groupBy("n").count().orderBy("n").limit(MOST_COUNTS + 1).collect()
    strata = per.groupBy("g").count().limit(MOST_COUNTS + 1).collect()
    if max(len(counts), len(strata)) > MOST_COUNTS:
        raise ValueError(f"more than {MOST_COUNTS} different counts or strata")
    return {
        "sha256": one["h"][:16], "files": one["n"], "n": rows.count(), "s": per.count(), "by_stratum": {str(r["g"]): r["count"] for r in strata},
        "observations": {str(r["n"]): r["count"] for r in counts}, "at": datetime.now(UTC).isoformat(),
    }


def number(x: float | None, digits: int = 4) -> str:
    return "-" if x is None or x != x else f"{x:.{digits}g}"


def markdown(df: DataFrame, n: int = 10, order: list | None = None) -> str:
    """First n rows, in the given order, of a result as a Markdown table."""
    head = df.columns
    rows = [[number(v) if isinstance(v, float) else str(v) for v in r] for r in (df.orderBy(*order) if order else df).limit(n).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def report(found: DataFrame, title: str, n: int = 50) -> str:
    """A Markdown report of an analysis (section, item, value): a table a section, its first n items by value, descending."""
    parts = [f"# {title}"]
    for r in found.select("section").distinct().orderBy("section").collect():
        own = found.where(F.col("section") == r["section"]).select("item", "value")
        parts += [f"\n## {r['section']}\n", markdown(own, n, [F.desc_nulls_last("value"), F.col("item")])]
    return "\n".join(parts) + "\n"


def to_json_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and json: every other column as one JSON object, nulls left out."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("json"))


def plot_data(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histogram for a figure: bin, low, high, n; equal widths between the extremes."""
    ends = df.agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    width = (F.col("__b") - F.col("__a")) / bins
    d = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor(F.when(width > 0, (F.col(column) - F.col("__a")) / width).otherwise(0.0)), F.lit(bins - 1)).cast("long"))
    return d.groupBy("bin", "__a", "__b").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("__a") + F.col("bin") * width).alias("low"), (F.col("__a") + (F.col("bin") + 1) * width).alias("high"), "n")
