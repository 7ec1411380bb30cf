"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, and a check of the full bytes on every hit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from obsgrain.llm.common import bounded, cut, fresh, scratch, settings

#: What does not count when texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
#: State lies in RocksDB, within a fixed share of each executor's memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # many small stores: disk that each sets aside beforehand would exceed what it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: What the stream carries of a row; file and at say where its content lies.
ARRIVAL = "doc_id long, digest string, text_sha256 string, points long, file string, at long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def located(docs: DataFrame) -> DataFrame:
    """docs such that each row has a place (file and row number in it): a plain Parquet scan as it is, anything else as a written copy."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString().lower() == "parquet":
        return docs
    path = scratch(docs.sparkSession, "located")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row number of each row of a plain Parquet scan, also if it has a column called _metadata."""
    metadata = docs.metadataColumn("_metadata")
    return metadata.getField("file_path"), metadata.getField("row_index")


def _place(docs: DataFrame) -> list[Column]:
    file, at = place(docs)
    return [file.alias("file"), at.alias("at")]


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream carries of each located document: its id, digests, length in code points and place."""
    bare = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(bare).alias("digest"), (F.lit(None).cast("string") if digest is sha256 else sha256(bare)).alias("text_sha256"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("points"), *_place(docs),
    )


def land(rows: DataFrame, state_dir: str) -> str:
    """Lands arrivals under a name made of what they are; the same rows landed before are not landed again. Returns that name.

    Files are written aside and moved when they are whole, so a landing that was broken off leaves nothing to the stream.
    """
    spark = rows.sparkSession
    aside = f"{state_dir}/aside-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    h = F.xxhash64("doc_id", "digest", "points", "file", "at")
    made = spark.read.schema(rows.schema).parquet(aside).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    run = f"{made['n']}-{(made['x'] or 0) & ((1 << 64) - 1):016x}-{made['s'] or 0:x}"
    fs, source = _files(spark, aside)
    _, target = _files(spark, f"{state_dir}/arrivals/run={run}")
    if fs.exists(target):
        fs.delete(source, True)
    else:
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot move {aside}")
    return run


def keyed(stream: DataFrame) -> DataFrame:
    """The stateful operator: for each digest the row that stays (most code points, then smallest id), with its place, and how many came.

    Partial sums are made before the shuffle, so a digest that a third of all rows share arrives as one row a task.
    """
    rank = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "run", "file", "at")
    return stream.groupBy("digest").agg(F.min(rank).alias("stays"), F.count(F.lit(1)).alias("group_size"))


def consume(spark: SparkSession, stream: DataFrame, state_dir: str) -> DataFrame:
    """Runs the stream over what there is by now; returns digest, stays, group_size as of the last batch.

    state_dir holds the stream's checkpoint (offsets and state) and each batch's changed keys; called again with the same
    folder after more input, or after a crash, it goes on where it stopped: a batch that is run again overwrites its files.
    """
    out = f"{state_dir}/changed"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        query = keyed(stream).writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = keyed(stream).schema.add("batch", IntegerType())
    changed = spark.read.option("basePath", out).schema(schema).parquet(f"{out}/batch=*") if exists(spark, out) else spark.createDataFrame([], schema)
    return changed.groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("last")).select("digest", "last.*")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Groups of equal texts; one row per row of docs (and of all that came before with the same state_dir).

    Columns: doc_id, keep_id, group_size, kept, text_sha256, then file and at, where the row lies. A null text counts as
    empty; all empty texts are one group. Of rows that tie in length, the smallest id stays, a null id last; of repeated rows
    one stays, told apart by their places. A table without rows gives none. Columns other than doc_id and text are not read.
    A very long text costs what it is long; only its digest is in the stream.

    The narrow arrivals are landed as files of the shared folder and streamed from there; called again for the same
    documents, as after a crash, it counts none twice. A digest met more than once is a hit: the texts of all rows under it
    are fetched by their places and their full bytes compared; should texts of one digest differ, they are told apart.
    """
    spark = docs.sparkSession
    state_dir = state_dir or scratch(spark, "exact")
    docs = located(docs)
    run = land(arrivals(docs, digest), state_dir)
    schema = f"{ARRIVAL}, run string"
    landed = spark.read.schema(schema).parquet(f"{state_dir}/arrivals")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{state_dir}/arrivals")
    state = cut(consume(spark, stream, state_dir))
    sha = F.col("digest") if digest is sha256 else F.col("text_sha256")
    same = F.struct("run", "file", "at") == F.struct("stays.run", "stays.file", "stays.at")
    out = landed.join(state, "digest").select("doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), same.alias("kept"), sha.alias("text_sha256"), "file", "at", "digest")
    split = collisions(docs, landed, state, run, digest)
    if split is None:
        return out.drop("digest")
    return out.join(bounded(split), "digest", "left_anti").drop("digest").unionByName(_apart(docs, landed.join(bounded(split), "digest", "left_semi"), run, digest))


def _keyed_places(rows: DataFrame, *more: str) -> DataFrame:
    """Places as two numbers: a hash of the file's name and the row number in it."""
    return rows.select(F.xxhash64("file").alias("__file"), F.col("at").alias("__at"), *more)


def fetched(docs: DataFrame, rows: DataFrame, run: str, digest: Callable[[Column], Column]) -> DataFrame:
    """What lies at the places of rows (run, file, at): doc_id, points, bytes and digest, with the place and the run.

    Rows of this run are in docs, older ones in the files they name. Places are two numbers; up to a checked number of them
    they are broadcast and no other text is moved, beyond it both sides are shuffled by place, each of which occurs once, so
    that no group of copies meets in one task.
    """
    spark, rows = docs.sparkSession, cut(rows.select("run", "file", "at"))
    own = bounded(_keyed_places(rows.where(F.col("run") == run)))
    at = lambda scan: scan.select(*_place(scan), F.col("doc_id").cast("long").alias("doc_id"), "text")
    here = (F.xxhash64("file") == F.col("__file")) & (F.col("at") == F.col("__at"))
    out = at(docs).join(own, here, "left_semi").withColumn("run", F.lit(run))
    older = rows.where(F.col("run") != run)
    files = [unquote(r["file"]) for r in older.select("file").distinct().toLocalIterator()]
    if files:
        scan = spark.read.schema(docs.select("doc_id", "text").schema).parquet(*files)
        out = out.unionByName(at(scan).join(bounded(_keyed_places(older, "run")), here).drop("__file", "__at"))
    return out.withColumn("points", F.length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("bytes", normalised(F.col("text"))).drop("text").withColumn("digest", digest(F.col("bytes")))


def collisions(docs: DataFrame, landed: DataFrame, state: DataFrame, run: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Digests under which different texts lie, or None if the bytes of all hits agree. Equal bytes are merged before the shuffle."""
    hits = landed.join(bounded(cut(state.where("group_size > 1").select("digest"))), "digest", "left_semi")
    texts = fetched(docs, hits, run, digest).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    several = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    return None if several.isEmpty() else several


def _apart(docs: DataFrame, rows: DataFrame, run: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The result for rows under whose digests different texts lie, grouped by the bytes themselves."""
    rows = fetched(docs, rows, run, digest)
    rank = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "run", "file", "at")
    groups = rows.groupBy("bytes").agg(F.min(rank).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    same = F.struct("run", "file", "at") == F.struct("stays.run", "stays.file", "stays.at")
    return rows.join(groups, "bytes").select("doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), same.alias("kept"), sha256(F.col("bytes")).alias("text_sha256"), "file", "at")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: one of each group of equal texts, told apart by their places, not by id.

    Null texts are a group with empty ones; rows without an id and repeated rows are treated like any others; a table
    without rows gives none. The places of dropped rows are broadcast up to a checked number, else both sides are shuffled.
    """
    docs = located(docs)
    names = fresh(docs, "__file", "__at")
    gone = bounded(cut(_keyed_places(exact_dedup(docs).where(~F.col("kept"))).toDF(*names)))
    file, at = place(docs)
    return docs.join(gone, (F.xxhash64(file) == F.col(names[0])) & (at == F.col(names[1])), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, count(*)::BIGINT AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
