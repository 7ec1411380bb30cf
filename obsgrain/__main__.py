"""Command line: runs an operator over tables and writes its result as Parquet.

    python -m obsgrain query NAME SF_DIR OUT            a registered query
    python -m obsgrain analyze TABLE OUT [--hurdle F]   everything that is measured on (entity, obs_id, feature, x), and a report
    python -m obsgrain sweep TABLE OUT --grid 4,8,16    measures on nested subsets, only of sizes that OUT lacks, and their slopes
    python -m obsgrain select TABLE OUT -n N -m M       entities and observations of (entity, stratum, obs_id, duration)
    python -m obsgrain extract TABLE OUT                the 40 features of (utt_id, samples, sex, phones)
    python -m obsgrain quality TABLE OUT                recording quality of (utt_id, samples, phones)
    python -m obsgrain report TABLE                     quality report of (entity, obs_id, feature, x), printed
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from obsgrain.operators import analysis, extract, select, stats, sweep
from obsgrain.plans import catalogue
from obsgrain.sources import writers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="obsgrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    for name, places in (("query", ("name", "sf_dir", "out")), ("analyze", ("table", "out")), ("sweep", ("table", "out")), ("select", ("table", "out")), ("extract", ("table", "out")), ("quality", ("table", "out")), ("report", ("table",))):
        s = sub.add_parser(name)
        for x in places:
            s.add_argument(x)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--hurdle", help="the zero-inflated feature")
        s.add_argument("--grid", default="", help="sizes, comma-joined")
        s.add_argument("-n", type=int, default=10, help="entities of a stratum")
        s.add_argument("-m", type=int, default=10, help="observations of an entity")
        s.add_argument("--least", type=float, default=0.0, help="shortest duration")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "query":
        catalogue.QUERIES[a.name](spark, a.sf_dir).write.parquet(a.out)
        return 0
    table = spark.read.parquet(a.table)
    if a.what == "analyze":
        analysis.analyze(table, a.hurdle, seed=a.seed).write.parquet(a.out)
        print(writers.report(spark.read.parquet(a.out), "Analysis"))
    elif a.what == "sweep":
        sizes = [int(x) for x in a.grid.split(",")]
        sweep.add_points(table, sizes, a.out, a.m, a.seed, hurdle=a.hurdle)
        print(writers.markdown(sweep.combined(spark, a.out)))
    elif a.what == "select":
        select.select_entities(table, a.n, a.m, a.least, a.seed).write.parquet(a.out)
    elif a.what in ("extract", "quality"):
        (extract.extract if a.what == "extract" else extract.recording_quality)(table).write.parquet(a.out)
    else:
        print(writers.report(stats.qa_report(table), "Quality"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
