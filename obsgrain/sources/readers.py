"""Readers: delimited tables, alignments, TextGrids, transcripts, JSON records, recordings."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path: str | list[str], schema: str | None = None, tolerant: bool = False) -> DataFrame:
    """Tab-separated with a header. With a schema columns are typed, else strings; tolerant: no quoting, broken lines dropped."""
    r = spark.read.option("header", True).option("sep", "\t")
    r = r.option("quote", "").option("mode", "DROPMALFORMED") if tolerant else r
    return (r.schema(schema) if schema else r).csv(path)


def listed(column: str, sep: str = ",") -> Column:
    """Items of a joined string, empty ones left out."""
    return F.filter(F.split(F.coalesce(F.col(column), F.lit("")), sep), lambda x: x != "")


def priority_files(spark: SparkSession, paths: list[str], key: str, wanted: DataFrame | None = None) -> DataFrame:
    """Several tables in order: of rows with one key the last file's wins (within a file the first by its columns); only wanted keys."""
    out = None
    for k, p in enumerate(paths):
        one = tsv(spark, p, tolerant=True).withColumn("__k", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if wanted is not None:
        out = out.join(wanted.select(key).distinct(), key, "left_semi")
    rest = [c for c in out.columns if c not in (key, "__k")]
    best = out.groupBy(key).agg(F.min(F.struct((-F.col("__k")).alias("__k"), *rest)).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in rest]).select(*[c for c in out.columns if c != "__k"])


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, start, end, label from lines of `start end label`; lines with fewer fields are left out."""
    t = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    f = F.split(F.trim(F.col("line")), r"\s+")
    return t.where(F.size(f) >= 3).select("path", "seq", f[0].try_cast("long").alias("start"), f[1].try_cast("long").alias("end"), f[2].alias("label")).where("start is not null and end is not null")


def transcript(text: Column) -> Column:
    """A transcript line without its two leading numbers."""
    got = F.regexp_extract(F.trim(text), r"^\S+\s+\S+\s+(.*)$", 1)
    return F.when(got != "", got).otherwise(F.trim(text))


def identifiers(path: Column) -> list[Column]:
    """split, region, speaker, sex, basename from the last parts of split/region/speaker/file."""
    p = F.split(path, "/")
    last = lambda k: F.try_element_at(p, F.lit(-k))
    return [last(4).alias("split"), last(3).alias("region"), last(2).alias("speaker_id"), F.upper(F.substring(last(2), 1, 1)).alias("sex"), F.regexp_replace(last(1), r"\.[^.]*$", "").alias("basename")]


def textgrid_tier(text: Column, tier: str = "phones") -> Column:
    """Intervals of a named tier: array of (start, end, label); an empty label is `sil`."""
    block = F.regexp_extract(text, rf'(?s)name = "{tier}"(.*?)(?:item \[|\z)', 1)
    number = lambda name: F.transform(F.regexp_extract_all(F.regexp_replace(block, r"(?s)^.*?intervals: size[^\n]*\n", ""), F.lit(rf"{name} = ([-0-9.eE+]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    labels = F.transform(F.regexp_extract_all(block, F.lit(r'text = "([^"]*)"'), F.lit(1)), lambda x: F.when(F.trim(x) == "", "sil").otherwise(F.trim(x)))
    return F.arrays_zip(number("xmin").alias("start"), number("xmax").alias("end"), labels.alias("label"))


def textgrids(spark: SparkSession, path: str, tier: str = "phones", mark: str | None = None) -> DataFrame:
    """path, seq, start, end, label of a tier of every TextGrid file; only intervals of the mark, if one is given."""
    t = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(textgrid_tier(F.col("value"), tier)).alias("seq", "i"))
    d = t.select("path", "seq", "i.*")
    return d.where(F.col("label") == mark) if mark else d


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records under a folder, one a file; files that are no record are left out."""
    r = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad")
    return r.schema(f"{schema}, __bad string").json(path).where("__bad is null").drop("__bad")


def discover(spark: SparkSession, path: str, glob: str = "*.wav", speaker: str | None = None) -> DataFrame:
    """Recordings under a folder, with identifiers from their paths; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", *identifiers(F.col("path")))
    return d.where(F.col("speaker_id") == speaker) if speaker else d


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and rate of a PCM WAV or SPHERE file."""
    if content[:7] == b"NIST_1A":
        size = int(content[8:16])
        head = dict(line.split(maxsplit=2)[::2] for line in content[:size].decode("ascii", "replace").split("\n") if len(line.split(maxsplit=2)) == 3)
        raw = np.frombuffer(content[size:], "<i2" if head.get("sample_byte_format", "01") == "01" else ">i2")
        channels, rate, full = int(head.get("channel_count", 1)), int(head["sample_rate"]), 32768.0
    else:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
        full = float(1 << (8 * width - 1))
        raw = raw.astype(float) - 128 if width == 1 else raw
    return raw[: len(raw) // channels * channels].reshape(-1, channels).mean(1) / full, rate


def decoded(files: DataFrame) -> DataFrame:
    """path, samples, sample_rate, duration, decode_ok, error of every file (path, content); one that fails is a row, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, rate = decode(content)
                    rows.append((p, x.tolist(), rate, len(x) / rate, True, None))
                except Exception as e:  # a broken file is reported in its row
                    rows.append((p, [], 0, 0.0, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "samples", "sample_rate", "duration", "decode_ok", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, samples array<double>, sample_rate int, duration double, decode_ok boolean, error string")


def recordings(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """decoded() of every recording under a folder."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def members(archives: DataFrame, suffix: str = "") -> DataFrame:
    """archive, name, content of the regular files in tar archives (path, content), plain or compressed, whose names end with suffix.

    Members are taken out one after the other; an archive that cannot be read gives a row with its error as name and no content.
    """
    import tarfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith(suffix):
                                yield pd.DataFrame([(p, m.name, tar.extractfile(m).read())], columns=["archive", "name", "content"])
                except tarfile.TarError as e:
                    yield pd.DataFrame([(p, f"{type(e).__name__}: {e}", None)], columns=["archive", "name", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def tar_members(spark: SparkSession, path: str, glob: str = "*.tar*", suffix: str = "") -> DataFrame:
    """members() of every archive under a folder."""
    return members(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path), suffix)


def config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, read by Spark so that it may lie in any store."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length of the files under a folder; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
