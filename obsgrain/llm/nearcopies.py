"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.llm.common import bounded, buffers, cut, fresh, lean, lookup, scratch, settings, slices, texts, tidy
from obsgrain.llm.exact import located, place
from obsgrain.llm.tokens import SPACE, mix, shingles, words

#: Words of a shingle and least similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares one of 12 bands of 3 samples with probability 0.9998.
BANDS, ROWS = 12, 3
#: Cells of the document-frequency sketch, whatever the corpus; what other shingles add to a cell on average is taken off.
CELLS = 1 << 20
#: A shingle in fewer than one of so many documents is as rare as any. So the sketch's error, which is a fixed share of the
#: corpus, matters as little in a large one as in a small one.
RAREST = 1000
#: Weights are tf * (1 + RARITY * idf), idf = ln(min(RAREST, documents / documents with it)) / ln(RAREST), in 0..1.
RARITY = 1.0
#: Size of a bucket up to which its pairs are listed; size of a block of a larger one; pairs of one leader that meet in a task.
ALL, BLOCK, FAN = 16, 512, 256
_BLOCK = 1 << 14
#: A row with profiles is as large as its texts: what passes to Python at once is bounded by bytes.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_SPACED = ~SPACE


def profile(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, tf, text) of every distinct shingle of every text, sorted; then each word's hash and each text's first word.

    At most 4,096 texts at once. Case and the kind of white space do not count.
    """
    data, offs = buffers(pc.utf8_lower(column))
    hashes, first = words(data, offs, _SPACED)
    sh, text = shingles(hashes, first, SHINGLE)
    keys = np.sort((text.astype(np.uint64) << np.uint64(52)) | (sh >> np.uint64(12)))
    if not keys.size:
        return keys, np.empty(0, np.int64), np.empty(0, np.int64), hashes, first
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, tf = keys[new], np.diff(np.append(new, keys.size))
    return keys & np.uint64((1 << 52) - 1), tf, (keys >> np.uint64(52)).astype(np.int64), hashes, first


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    """Counts in the fewest bytes each, and how many those are."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return width, x.astype(f"<u{width}").tobytes()


def _unpacked(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype(np.int64)


def _sketch(rows: DataFrame, read) -> tuple[np.ndarray, int]:
    """Rows with a shingle in each cell, and rows with shingles. read(batch) yields (shingles, number of rows that have any).

    Every task counts its own rows in blocks of cells; blocks are added in groups of at most 64 until one row a block is left.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for sh, full in read(batch):
                cells += np.bincount((sh & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                n += full
        if n:
            blocks = [_packed(b) for b in cells.reshape(-1, _BLOCK)]
            k = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([k] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array([w for w, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())],
                ["block", "part", "n", "width", "cells"],
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        width, raw = _packed(sum(_unpacked(w, x) for w, x in zip(rows["width"], rows["cells"], strict=True)))
        return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1] // 64, "n": [rows["n"].sum()], "width": [width], "cells": [raw]})

    schema = "block int, part int, n long, width int, cells binary"
    tasks = max(1, rows.rdd.getNumPartitions())
    sums = rows.mapInArrow(lean(count), schema)
    while tasks > 1:
        sums = sums.groupBy("block", F.floor(F.col("part") / 64).alias("group")).applyInPandas(add, schema)
        tasks = -(-tasks // 64)
    found = sums.collect()  # one row a block: CELLS numbers in all
    cells = np.zeros((CELLS // _BLOCK, _BLOCK), np.int64)
    for r in found:
        cells[r["block"]] += _unpacked(r["width"], r["cells"])
    return cells.ravel(), max([0, *(r["n"] for r in found)])


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each cell of the sketch, and documents with words; over all of docs."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for part in slices(batch, 1 << 18):
            sh, _, text, _, _ = profile(part.column("text"))
            yield sh, len(np.unique(text))

    return _sketch(docs.select("text"), read)


def log_rarity(cells: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + RARITY * idf) for each cell. The mean of all cells, which is what other shingles add, is taken off first."""
    if not n:
        return np.zeros(len(cells), np.float32)
    own = np.clip(cells - cells.mean(), 1, n)
    return np.log1p(RARITY * np.log(np.minimum(n / own, RAREST)) / np.log(RAREST)).astype(np.float32)


@lru_cache(maxsize=2)
def _draws(seed: int) -> tuple[np.ndarray, ...]:
    """Tables of Gamma(2, 1) draws r and ln c, and a multiplier for each sample."""
    rng = np.random.default_rng(seed)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.integers(1 << 62, 1 << 63, BANDS * ROWS).astype(np.uint64) | np.uint64(1)


def signature(sh: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """Consistent weighted samples of each text, one column a sample.

    For a term of weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b + 1), with r, c ~ Gamma(2, 1) and b ~ U(0, 1)
    drawn by term and sample. The term with the least ln a and its t are the sample; as ln a is a function of both, its bits
    name them. Only table look-ups and exact arithmetic, so equal terms give equal bits wherever they are computed.
    """
    r_of, c_of, by = _draws(seed)
    out = np.empty((len(starts), len(by)), np.uint32)
    for k, m in enumerate(by):
        h = mix(sh * m)
        at = (h >> np.uint64(48)).astype(np.int64)
        b = ((h >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        r = r_of[at]
        t = np.floor(log_weight / r + b)
        out[:, k] = np.minimum.reduceat(c_of[at] - r * (t - b + np.float32(1)), starts).view(np.uint32)
    return out


def _log_weights(sh: np.ndarray, tf: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    logs = np.log(np.arange(1, max(2, int(tf.max(initial=1)) + 1)).astype(np.float64)).astype(np.float32)
    return logs[tf - 1] + rarity[(sh & np.uint64(CELLS - 1)).astype(np.int64)]


def signed(docs: DataFrame, rarity, seed: int = 0) -> DataFrame:
    """doc_id, n (distinct shingles), a 128-bit digest of the words in order, and the keys of the bands. rarity: a Spark broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 18):
                sh, tf, text, hashes, first = profile(part.column("text"))
                rows = part.num_rows
                n = np.bincount(text, minlength=rows)
                full = np.flatnonzero(n)
                keys = np.zeros((rows, BANDS), np.uint64)
                digest = np.zeros((2, rows), np.uint64)
                if full.size:
                    starts = np.searchsorted(text, full)
                    sig = signature(sh, _log_weights(sh, tf, rarity.value), starts, seed).astype(np.uint64)
                    for b in range(BANDS):
                        key = np.full(full.size, b + 1, np.uint64)
                        for x in sig[:, b * ROWS : (b + 1) * ROWS].T:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
                        keys[full, b] = key
                    count = np.diff(first)
                    place = (np.arange(len(hashes)) - np.repeat(first[:-1], count)).astype(np.uint64)
                    for d, salt in zip(digest, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB), strict=True):
                        d[full] = np.add.reduceat(mix((hashes ^ np.uint64(salt)) + mix(place + np.uint64(salt))), first[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), pa.ListArray.from_arrays(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))],
                    ["doc_id", "n", "d1", "d2", "keys"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, keys array<long>")


PROFILE = "doc_id long, sh array<long>, tf array<int>, w array<float>"


def profiles(docs: DataFrame, rarity) -> DataFrame:
    """doc_id, sh (distinct shingles, ascending), tf (how often each occurs) and w (its weight) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 18):
                sh, tf, text, _, _ = profile(part.column("text"))
                offs = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                w = np.exp(_log_weights(sh, tf, rarity.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offs, pa.array(sh.astype(np.int64))), pa.ListArray.from_arrays(offs, pa.array(tf.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(w))], ["doc_id", "sh", "tf", "w"])

    return docs.mapInArrow(lean(run), PROFILE)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], offs - offs[0]


def similarities(sh_a: pa.Array, w_a: pa.Array, sh_b: pa.Array, w_b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of profiles, from all their shingles. At most 4,096 pairs."""
    n, sides = len(sh_a), []
    for sh, w in ((sh_a, w_a), (sh_b, w_b)):
        values, offs = _flat(sh)
        pair = np.repeat(np.arange(n), np.diff(offs))
        sides.append(((pair.astype(np.uint64) << np.uint64(52)) | values.astype(np.uint64), _flat(w)[0].astype(float), pair))
    (ka, wa, pa_), (kb, wb, pb) = sides
    if not ka.size or not kb.size:
        return np.zeros(n)
    at = np.minimum(np.searchsorted(kb, ka), kb.size - 1)
    hit = kb[at] == ka
    both = np.bincount(pa_[hit], np.minimum(wa[hit], wb[at[hit]]), n)
    return both / np.maximum(np.bincount(pa_, wa, n) + np.bincount(pb, wb, n) - both, 1e-9)


def verified(pairs: DataFrame, said: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b, salt) whose profiles, looked up in said, are similar, as (a, b, similarity) with a < b.

    Many pairs may have the same a: its profile is sent once for each of its salts, so they meet in as many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sim = similarities(*(part.column(c) for c in ("sh_a", "w_a", "sh_b", "w_b")))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim)], ["a", "b", "similarity"])

    side = lambda x: said.select(F.col("doc_id").alias(x), F.col("sh").alias(f"sh_{x}"), F.col("w").alias(f"w_{x}"))
    leaders = pairs.select("a", "salt").distinct().join(side("a"), "a")
    found = pairs.join(side("b"), "b").join(leaders, ["a", "salt"]).mapInArrow(lean(run), "a long, b long, similarity double").where(F.col("similarity") >= similar)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def candidates(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b, salt) to compare in each bucket (key, node, size, lead): all in one of up to ALL nodes, else those with its leader."""
    nodes = buckets.where(F.col("size") <= ALL).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("n"))
    listed = F.flatten(F.transform("n", lambda x, k: F.transform(F.slice("n", k + 2, F.greatest(F.size("n") - k - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = nodes.select(F.explode(listed).alias("p")).select("p.a", "p.b", F.lit(0).cast("long").alias("salt"))
    large = buckets.where((F.col("size") > ALL) & (F.col("lead") != F.col("node"))).select(F.col("lead").alias("a"), F.col("node").alias("b"), F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / FAN)).alias("salt"))
    return small.unionByName(large).groupBy("a", "b").agg(F.min("salt").alias("salt"))


def different(nodes: DataFrame) -> DataFrame:
    """Buckets (key, node, size) of (key, node) rows with two nodes at least; of buckets with the same nodes only one.

    Copies of a text meet in many buckets. Sets of nodes are told apart by their size, least, largest and a 64-bit hash.
    """
    sets = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1")
    kept = cut(sets.groupBy("size", "x", "low", "high").agg(F.min("key").alias("key")).select("key", "size"))
    return lookup(nodes, kept, ["key"], salt="node")


def led(buckets: DataFrame, seed: int = 0) -> DataFrame:
    """Buckets (key, node, size) with each one's leader: the node that meets most others, which copies were often made from."""
    reach = buckets.groupBy("node").agg(F.sum("size").alias("reach"))
    order = F.xxhash64("node", F.lit(seed))
    lead = buckets.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", order.alias("h"), "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    return lookup(buckets, cut(lead), ["key"], salt="node")


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of larger buckets, with label, of those buckets whose nodes are not all in one component."""
    named = lookup(buckets.where(F.col("size") > ALL), labels, ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    still = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    return lookup(named, cut(still), ["key"], "left_semi", salt="node")


def prefixes(said: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, key): each profile's rarest shingles, the fewest such that the others weigh less than `similar` of all.

    Texts of at least that similarity share one of them: in the common order of shingles, were no prefix shingle shared, all
    shared ones would lie beyond the prefix that ends first and weigh too little. Rarity is counted among the given profiles.
    """

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for part in parts(batch):
            yield _flat(part.column("sh"))[0].astype(np.uint64), part.num_rows

    cells = said.sparkSession.sparkContext.broadcast(_sketch(said.select("sh"), read)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            sh, offs = _flat(batch.column("sh"))
            w = _flat(batch.column("w"))[0].astype(float)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            order = np.lexsort((sh, cells.value[sh & (CELLS - 1)], row))
            before = np.cumsum(w[order]) - w[order]
            total = np.bincount(row, w, batch.num_rows)
            behind = total[row] - (before - np.repeat(before[offs[:-1][np.diff(offs) > 0]], np.diff(offs)[np.diff(offs) > 0]))
            keep = order[behind >= similar * total[row] * (1 - 1e-6)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[keep])), pa.array(sh[keep])], ["node", "key"])

    return said.select("doc_id", "sh", "w").mapInArrow(lean(run), "node long, key long")


def block_links(buckets: DataFrame, said: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b, similarity) that connect nodes of each bucket (key, node, label, size) beyond the labels they have.

    A bucket's nodes fall in blocks of about BLOCK; every two blocks meet in one task, which compares all their nodes by
    matrix products and returns the links that join labels not joined before. Rows grow with nodes times blocks, not pairs.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    spread = buckets.select("key", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    cells = spread.select("key", "node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return cells.join(said.withColumnRenamed("doc_id", "node"), "node").groupBy("key", "low", "high").applyInArrow(_compare(similar), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _compare(similar: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, keep = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(keep))
        label = table.column("label").to_numpy()
        a, b, sim = similar_pairs(*(table.column(c).combine_chunks() for c in ("sh", "tf", "w")), similar)
        parent = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j, how in zip(a.tolist(), b.tolist(), sim.tolist(), strict=True):
            x, y = find(label[i]), find(label[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((*sorted((int(nodes[i]), int(nodes[j]))), how))
        return pa.table({"a": pa.array([x for x, _, _ in out], pa.int64()), "b": pa.array([y for _, y, _ in out], pa.int64()), "similarity": pa.array([z for *_, z in out], pa.float64())})

    return run


def similar_pairs(sh: pa.Array, tf: pa.Array, w: pa.Array, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of rows whose weighted Jaccard similarity is at least `similar`, and that similarity.

    A shingle that occurs t times stands for t units of equal weight, so that the smaller of two weights is a sum of shared
    units: a matrix product over the units of many rows, single additions over those of few.
    """
    values, offs = _flat(sh)
    times, weight = _flat(tf)[0], _flat(w)[0].astype(float)
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    total = np.bincount(row, weight, n)
    unit = np.repeat(weight / times, times)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times)
    name = mix(np.repeat(values.astype(np.uint64), times) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.repeat(row, times)
    _, column, count = np.unique(name, return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float64)
    many = np.flatnonzero(count > 8)
    place = np.full(len(count), -1)
    place[many] = np.arange(len(many))
    at = place[column]
    for low in range(0, len(many), 2048):
        use = (at >= low) & (at < low + 2048)
        m = np.zeros((n, min(2048, len(many) - low)))
        m[row[use], at[use] - low] = np.sqrt(unit[use])
        both += m @ m.T
    few = np.flatnonzero((count[column] > 1) & (count[column] <= 8))
    few = few[np.argsort(column[few], kind="stable")]
    for d in range(1, 8):
        if len(few) <= d:
            break
        i, j = few[:-d], few[d:]
        same = column[i] == column[j]
        np.add.at(both, (row[i[same]], row[j[same]]), unit[i[same]])
        np.add.at(both, (row[j[same]], row[i[same]]), unit[i[same]])
    sim = both / np.maximum(total[:, None] + total[None] - both, 1e-9)
    a, b = np.nonzero(np.triu(sim >= similar - 1e-9, 1))
    return a, b, sim[a, b]


#: Edges up to which one task joins them; more are joined by rounds of shuffles.
ONE_TASK = 1 << 18


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, label): the least node reachable over the edges (a, b), which are already cut.

    A counted, bounded number of edges is united in one task. Beyond it, labels spread in rounds: the least label among
    neighbours, then a jump to the label's label, until nothing changes.
    """
    one_task = ONE_TASK if one_task is None else one_task
    if edges.limit(one_task + 1).count() <= one_task:
        return cut(edges.coalesce(1).mapInArrow(lean(_unite), "node long, label long"))
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = lookup(both, labels.select(F.col("node").alias("other"), "label"), ["other"], salt="node").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        after = cut(lookup(step, jump, ["label"], "left", salt="node").select("node", "was", F.least("label", "to").alias("label")))
        labels = after.select("node", "label")
        if after.where("was != label").isEmpty():
            return labels


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def near_copies(docs: DataFrame, similar: float = SIMILAR, seed: int = 0) -> DataFrame:
    """Classes of near copies; one row per row of docs.

    Columns: doc_id, class_id (the least doc_id of its class), exact_id (the least doc_id with the same words), near_id and
    similarity (the most similar different text it was linked with, by its exact_id; null if with none). Texts without words (null, empty) are one class; a text of fewer than five words is one shingle. A doc_id names a document: rows that
    share it share its class. A row without a doc_id gets the class of the texts with the same words, null if there is none
    with an id. A table without rows gives none; columns other than doc_id and text are not read. A very long text is one
    row with a profile in proportion.

    Texts with the same words are one node. In buckets of up to ALL nodes, all are compared. In a larger one all are compared
    with the node that meets most others, which connects a group of copies at the cost of one comparison a member. Nodes of
    buckets that are not connected by then meet again by their rarest shingles, of which texts of that similarity share one;
    what is large and not connected even so is compared whole, in blocks. So no pair that shares a bucket is left out.
    """
    with settings(docs.sparkSession, BATCHES):
        return _classes(docs, similar, seed)


def _classes(docs: DataFrame, similar: float, seed: int) -> DataFrame:
    """The result of near_copies. What runs Python runs here; the result itself only joins tables that are written."""
    spark = docs.sparkSession
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rarity = spark.sparkContext.broadcast(log_rarity(*frequencies(rows)))
    sig = cut(signed(rows, rarity, seed))
    copies = cut(sig.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    member = lookup(sig, copies.withColumn("copied", F.lit(True)), ["d1", "d2"], "left", salt="doc_id")
    member = member.select("doc_id", F.when(F.col("copied"), F.col("least")).otherwise(F.col("doc_id")).alias("exact_id"), "n", "keys", F.coalesce("copied", F.lit(False)).alias("copied"))
    own = member.where("doc_id = exact_id and n > 0").select(F.col("doc_id").alias("node"), "keys", "copied")
    # a text with copies may have several rows of the id that stands for it
    nodes = own.where("not copied").select("node", "keys").unionByName(own.where("copied").groupBy("node").agg(F.first("keys").alias("keys"))).select("node", F.explode("keys").alias("key"))
    active = cut(different(nodes))
    path = scratch(spark, "near")
    profiles(lookup(rows.where("doc_id is not null"), cut(active.select(F.col("node").alias("doc_id")).distinct()), ["doc_id"], "left_semi"), rarity).write.parquet(path)
    said = spark.read.schema(PROFILE).parquet(path)
    active = cut(led(active, seed))
    tidy(spark)
    edges = cut(verified(candidates(active), said, similar))
    tidy(spark)
    labels = components(edges)
    rest = cut(unsettled(active, labels).select("node").distinct())
    if not rest.isEmpty():
        # (rows of one doc_id with different texts are compared by any of them)
        again = cut(prefixes(lookup(said, rest.withColumnRenamed("node", "doc_id"), ["doc_id"], "left_semi"), similar).distinct())
        again = cut(led(cut(different(again)), seed))
        edges = cut(edges.unionByName(verified(candidates(again), said, similar)).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
        labels = components(edges)
        tidy(spark)
        last = cut(block_links(unsettled(again, labels), said, similar))
        if not last.isEmpty():
            edges = cut(edges.unionByName(last))
            labels = components(edges)
    sides = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    best = sides.groupBy("node").agg(F.max(F.struct("similarity", (-F.col("other")).alias("back"))).alias("best"))
    named = cut(labels.join(best, "node", "left").select(F.col("node").alias("exact_id"), "label", (-F.col("best.back")).alias("near_id"), F.col("best.similarity").alias("similarity")))
    out = lookup(member.select("doc_id", "exact_id"), named, ["exact_id"], "left", salt="doc_id")
    return out.select("doc_id", F.coalesce("label", "exact_id").alias("class_id"), "exact_id", "near_id", "similarity")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each class (the one that gives the class its id). found: the result of near_copies.

    Only ids are looked up; rows without an id stay; of several rows of the id that stays, the first by place stays.
    """
    found, (name, f, r) = cut(found), fresh(docs, "__id", "__f", "__r")
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias(name)).distinct()
    again = cut(found.where("doc_id = class_id").groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(name))
    if not again.isEmpty():
        docs = located(docs)
        file, at = place(docs)
        places = docs.select(F.col("doc_id").cast("long").alias(name), F.struct(F.xxhash64(file).alias("f"), at.alias("r")).alias("place")).join(bounded(again), name)
        first = cut(places.groupBy(name).agg(F.min("place").alias("first")))
        extra = cut(places.join(bounded(first), name).where("place != first").select(F.col("place.f").alias(f), F.col("place.r").alias(r)))
        docs = docs.join(bounded(extra), (F.xxhash64(file) == F.col(f)) & (at == F.col(r)), "left_anti")
    return docs.join(bounded(cut(gone)), docs["doc_id"].cast("long") == F.col(name), "left_anti")
