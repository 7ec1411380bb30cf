"""Language identification: a convolutional network over bytes, trained in numpy, applied to windows of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsgrain.llm.common import buffers, lean, slices, texts

#: Bytes of a window; windows follow each other and cover the whole text, the last one is filled with zero bytes.
WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
#: Bounds of the training sample: documents for each language, windows taken from each, and documents in all. Every language
#: is learned; where there are more than 200 each has fewer documents. No more than 93 MB reach the driver.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_ALL = 600, 6, 120_000
UNKNOWN = "und"


@dataclass
class Model:
    """tables[w][i]: what byte i of a filter of width w adds, for each of 256 bytes; then a dense layer to the languages."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray


def windows(data: np.ndarray, offs: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows, and each one's text. An empty text has none."""
    sizes = np.diff(offs)
    count = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[text] + k * length
    at = start[:, None] + np.arange(length)
    inside = at < offs[text + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(data.size - 1, 0))], 0).astype(np.uint8), text


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(sample: list[tuple[str, str]], seed: int = 0, epochs: int = 5, batch: int = 128, rate: float = 0.05) -> Model:
    """Learns from (text, language) pairs by Adagrad on softmax loss; max pooling passes gradients to one place a filter."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in sample})
    model = Model(langs, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    if not sample:
        return model
    rows, labels = [], []
    for text, lang in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        x, _ = windows(raw, np.array([0, raw.size]))
        pick = np.unique(np.linspace(0, len(x) - 1, TRAIN_WINDOWS).astype(int)) if len(x) else []
        rows.append(x[pick])
        labels += [langs.index(lang)] * len(pick)
    x, y = np.concatenate(rows), np.array(labels)
    params = [*model.tables.values(), model.bias, model.dense, model.out]
    seen = [np.full_like(p, 1e-3) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            bx, by = x[pick], y[pick]
            n, best, place = len(bx), [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                z = sum(model.tables[w][i][bx[:, i : i + span]] for i in range(w))
                p = z.argmax(1)
                place.append(p)
                best.append(np.take_along_axis(z, p[:, None], 1)[:, 0])
            h = np.concatenate(best, 1) + model.bias
            a = np.maximum(h, 0)
            d = _softmax(a @ model.dense + model.out)
            d[np.arange(n), by] -= 1
            d /= n
            back = (d @ model.dense.T) * (h > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(model.tables[w])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(w):
                    np.add.at(g[i], (bx[np.arange(n)[:, None], place[k] + i], np.arange(FILTERS)), part)
                grads.append(g)
            grads += [back.sum(0), a.T @ d, d.sum(0)]
            for p, s, g in zip(params, seen, grads, strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
    return model


class Scorer:
    """Applies a model; filters read two bytes at once from tables of 65,536 rows."""

    def __init__(self, model: Model):
        self.model = model
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, FILTERS)
        self.steps = []
        for w in WIDTHS:
            t = model.tables[w]
            self.steps.append((w, [(i, pair(t[i], t[i + 1]) if i + 1 < w else t[i], i + 1 < w) for i in range(0, w, 2)]))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language for each window."""
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        best = []
        for w, tables in self.steps:
            span, z = WINDOW - w + 1, None
            for i, table, two in tables:
                part = np.take(table, (pairs if two else x)[:, i : i + span], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            best.append(z.max(1))
        return _softmax(np.maximum(np.concatenate(best, 1) + self.model.bias, 0) @ self.model.dense + self.model.out)

    def texts(self, data: np.ndarray, offs: np.ndarray, block: int = 256) -> np.ndarray:
        """Mean probabilities over a text's windows, by the bytes in each; a text without windows gets zeros."""
        n = len(offs) - 1
        total = np.zeros((n, len(self.model.langs)))
        x, text = windows(data, offs)
        weight = (x != 0).sum(1)
        for at in range(0, len(x), block):
            part = slice(at, at + block)
            np.add.at(total, text[part], self.windows(x[part]) * weight[part, None])
        return total / np.maximum(np.bincount(text, weight, n), 1)[:, None]


def held_out(column: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS, seed: int = 0, in_all: int = TRAIN_ALL) -> Model:
    """Fits on at most per_lang different texts of each language (in_all shared evenly, if that is less), chosen by a hash of the text.

    Rows without a language, without text, or held out are not learned from. What reaches the driver is TRAIN_WINDOWS windows
    a text, evenly spaced over the whole of it; ties break by text.
    """
    rows = texts(docs.where("lang is not null"), "lang", "doc_id").where((F.length("text") > 0) & ~held_out())
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()  # one row a language
    if not counts:
        return fit([])
    per_lang = max(1, min(per_lang, in_all // len(counts)))
    # a hash decides before anything is sorted: what is sorted is bounded, whatever the input; copies count once
    least = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * per_lang + 20) / max(1, r["n"]))) for r in counts], "lang string, keep double")
    spot = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # the training windows are spread over the whole text, so only they travel
    step = F.greatest(F.lit(1), F.floor(F.length("text") / TRAIN_WINDOWS))
    spread = F.concat(*[F.expr(f"substring(text, cast({k} * greatest(1, floor(length(text) / {TRAIN_WINDOWS})) + 1 as int), {WINDOW})") for k in range(TRAIN_WINDOWS)])
    near = F.when(step * TRAIN_WINDOWS < WINDOW * TRAIN_WINDOWS, F.substring("text", 1, WINDOW * TRAIN_WINDOWS)).otherwise(spread)
    chosen = rows.join(F.broadcast(least), "lang").where(spot < F.col("keep")).select("lang", spot.alias("spot"), near.alias("text")).distinct()
    ranked = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))).where(F.col("k") <= per_lang)
    return fit([(t, lang) for _, lang, t in sorted((r["spot"], r["lang"], r["text"]) for r in ranked.collect())], seed)


def predict(scorer: Scorer, data: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs = scorer.model.langs
    if not langs:
        return [UNKNOWN] * len(letters), np.zeros(len(letters))
    p = scorer.texts(data, offs)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(p.argmax(1).tolist(), letters.tolist(), strict=True)], np.where(letters, p.max(1), 0.0)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, but for those that language_id calls `und`: null and empty texts and those without letters.

    The network gives any text with letters the likeliest of the learned languages, so none of these goes, short and odd ones
    included; if nothing could be learned, they stay too. Rows are decided where they lie: ids, repeated rows and other
    columns play no part, a table without rows gives none.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model_b.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = pc.fill_null(batch.column(at).cast(pa.string()), "")
            whole = pa.RecordBatch.from_arrays([column], ["text"])
            keep = []
            for part in slices(whole, 1 << 18):
                letters = pc.match_substring_regex(part.column(0), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
                said, _ = predict(scorer, *buffers(part.column(0)), letters)
                keep += [x != UNKNOWN for x in said] if scorer.model.langs else letters.tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text; one row per row of docs, no shuffle.

    Columns: doc_id, held_out, lang_pred, score, n_windows. A text that is null, empty or without letters is `und` with
    score 0, as is every text if nothing could be learned. A null doc_id stays null; repeated rows give repeated rows; a
    table without rows gives none; columns other than doc_id and text are not read. A very long text is read whole.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, 1 << 18):
                column = part.column("text")
                letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
                data, offs = buffers(column)
                said, score = predict(scorer, data, offs, letters)
                ids = part.column("doc_id").cast(pa.int64())
                held = [x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(said, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(-(-np.diff(offs) // WINDOW))], ["doc_id", "held_out", "lang_pred", "score", "n_windows"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, n_windows long")
