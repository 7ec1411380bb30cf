"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy, with thresholds for each language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.llm.common import buffers, lean, slices, texts
from obsgrain.llm.tokens import ALNUM, words

#: Hash buckets of words (as many again are for their first PREFIX bytes), size of an embedding, filter widths and filters of each width.
PREFIX = 4
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Bounds of the training sample: labelled documents of each class, and words of one (of a longer text, windows of
#: TRAIN_WINDOW words spread evenly over the whole of it). At 8 bytes a word no more than 66 MB reach the driver.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_WINDOW = 2000, 2048, 128
CUT = 0.7


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each word of all texts, and where each text's words begin; case does not count.

    A word's embedding is the sum of its own and its prefix's, so that compounds of a known stem are known too.
    """
    data, offs = buffers(pc.utf8_lower(column))
    hashes, first, heads = words(data, offs, ALNUM, PREFIX)
    return np.stack([(hashes >> np.uint64(48)).astype(np.int64) % BUCKETS, BUCKETS + (heads >> np.uint64(48)).astype(np.int64) % BUCKETS]), first


def _pool(model: Model, tok: np.ndarray, first: np.ndarray, places: bool = False):
    """Largest response of each filter in each text, and where it is; texts shorter than a filter get its response to what they have."""
    n, m = len(first) - 1, tok.shape[1]
    x = np.concatenate([model.embed[tok[0]] + model.embed[tok[1]], np.zeros((max(WIDTHS), SIZE), np.float32)])
    text = np.repeat(np.arange(n), np.diff(first))
    left = first[text + 1] - np.arange(m)
    full = np.flatnonzero(np.diff(first))
    best, at = [], []
    for w in WIDTHS:
        z = np.zeros((m, FILTERS), np.float32)
        for i in range(w):
            part = x[i : i + m] @ model.filters[w][i]
            if i:
                part[left <= i] = 0
            z += part
        top = np.zeros((n, FILTERS), np.float32)
        if full.size:
            top[full] = np.maximum.reduceat(z, first[full], axis=0)
        best.append(top)
        if places:
            rows, cols = np.nonzero(z == top[text])
            p = np.full((n, FILTERS), -1, np.int64)
            p[text[rows][::-1], cols[::-1]] = rows[::-1]
            at.append(p)
    return np.concatenate(best, 1), at, left


def _take(tok: np.ndarray, first: np.ndarray, texts_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and offsets of some of the texts."""
    sizes = first[texts_ + 1] - first[texts_]
    f = np.concatenate([[0], np.cumsum(sizes)])
    return tok[:, np.repeat(first[texts_] - f[:-1], sizes) + np.arange(f[-1])], f


def logits(model: Model, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    pooled, _, _ = _pool(model, tok, first)
    return np.maximum(pooled + model.bias, 0) @ model.dense + model.out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(model: Model, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    a, b = model.scale
    return _sigmoid(a * logits(model, tok, first) + b)


def windowed(tok: np.ndarray, first: np.ndarray, most: int = TRAIN_WORDS, window: int = TRAIN_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Words and offsets with at most `most` words of each text: those of a longer one in windows spread evenly over it."""
    picks = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a <= most:
            picks.append(np.arange(a, b))
        else:
            starts = np.linspace(a, b - window, most // window).astype(np.int64)
            picks.append((starts[:, None] + np.arange(window)).ravel())
    return tok[:, np.concatenate([np.empty(0, np.int64), *picks])], np.concatenate([[0], np.cumsum([len(p) for p in picks])]).astype(np.int64)


def fit_texts(sample: list[tuple[str, int, str | None]], seed: int = 0) -> Model:
    """fit() on (text, label, language)."""
    parts = [windowed(*tokens(pa.array([t], pa.string())))[0] for t, _, _ in sample]
    return fit([(tok, y, lang) for tok, (_, y, lang) in zip(parts, sample, strict=True)], seed)


def fit(sample: list[tuple[np.ndarray, int, str | None]], seed: int = 0, epochs: int = 8, batch: int = 32, rate: float = 0.05) -> Model:
    """Learns from (word buckets, label, language); the language serves the thresholds alone, never a score.

    An embedding's first number starts as the log odds of its word or prefix among toxic documents, the rest at random. A fifth of
    the sample is kept to scale the output by logistic regression and to find each language's threshold.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (2 * BUCKETS, SIZE)).astype(np.float32), {w: rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))
    label = np.array([y for _, y, _ in sample], np.float32)
    if not len(sample) or label.min() == label.max():
        model.dense[:], model.out = 0, float(-8.0 if not len(sample) or label.max() == 0 else 8.0)
        return model
    tok = np.concatenate([t for t, _, _ in sample], 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([t.shape[1] for t, _, _ in sample])])
    order = rng.permutation(len(sample))
    kept, learn = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(label[kept])) < 2 or len(set(label[learn])) < 2:
        kept = learn = order
    docs_with = np.zeros((2, 2 * BUCKETS))
    for i in learn:
        docs_with[int(label[i]), np.unique(tok[:, first[i] : first[i + 1]])] += 1
    n1, n0 = label[learn].sum(), (1 - label[learn]).sum()
    odds = np.log((docs_with[1] + 0.5) / (n1 + 1)) - np.log((docs_with[0] + 0.5) / (n0 + 1))
    odds *= np.minimum(docs_with.sum(0) / 8, 1)
    model.embed[:, 0] = odds / 2
    params = [model.embed, *model.filters.values(), model.bias, model.dense]
    seen, seen_out = [np.full_like(p, 1e-2) for p in params], 1e-2
    balance = np.where(label > 0, len(learn) / (2 * n1), len(learn) / (2 * n0))
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            t, f = _take(tok, first, chunk)
            pooled, at, left = _pool(model, t, f, True)
            h = pooled + model.bias
            a = np.maximum(h, 0)
            d = (_sigmoid(a @ model.dense + model.out) - label[chunk]) * balance[chunk] / len(chunk)
            back = (d[:, None] * model.dense * (h > 0)).astype(np.float32)
            rows, values = [], []
            grads = []
            for k, w in enumerate(WIDTHS):
                g, part, place = np.zeros_like(model.filters[w]), back[:, k * FILTERS : (k + 1) * FILTERS], at[k]
                ok = place >= 0
                for i in range(w):
                    use = ok & (left[np.maximum(place, 0)] > i) if len(left) else ok
                    q, c = np.nonzero(use)
                    own, head = t[:, place[q, c] + i]
                    np.add.at(g[i].T, c, (model.embed[own] + model.embed[head]) * part[q, c][:, None])
                    rows += [own, head]
                    values += [model.filters[w][i].T[c] * part[q, c][:, None]] * 2
                grads.append(g)
            rows, values = np.concatenate(rows), np.concatenate(values)
            ids, back_to = np.unique(rows, return_inverse=True)
            g_embed = np.zeros((len(ids), SIZE), np.float32)
            np.add.at(g_embed, back_to, values)
            seen[0][ids] += g_embed**2
            model.embed[ids] -= rate * g_embed / np.sqrt(seen[0][ids])
            for p, s, g in zip(params[1:], seen[1:], [*grads, back.sum(0), (a.T @ d).astype(np.float32)], strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
            seen_out += float(d.sum()) ** 2
            model.out -= rate * float(d.sum()) / np.sqrt(seen_out)
    z, y = np.concatenate([logits(model, *_take(tok, first, chunk)) for chunk in np.array_split(kept, len(kept) // 64 + 1)]), label[kept]
    model.scale = _platt(z, y)
    p = _sigmoid(model.scale[0] * z + model.scale[1])
    langs = np.array([sample[i][2] or "" for i in kept])
    for lang in sorted(set(langs)):
        own = langs == lang
        model.thresholds[lang] = _threshold(p[own], y[own])
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0.1) and offset of a logistic regression with softened targets, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([z, np.ones_like(z)], 1).astype(float), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (beta - [1, 0]))
        beta -= np.clip(step, -1, 1)
    return max(float(beta[0]), 0.1), float(beta[1])


def _threshold(p: np.ndarray, y: np.ndarray, default: float = CUT) -> float:
    """The cut with the best F1 among those midway between scores; the default where a language has under 20 rows or one class."""
    if len(y) < 20 or y.min() == y.max():
        return default
    s = np.unique(p)
    cuts = np.concatenate([[default], (s[1:] + s[:-1]) / 2])
    f1 = [2 * (hit := ((p >= c) & (y > 0)).sum()) / max(1, 2 * hit + ((p >= c) != (y > 0)).sum()) for c in cuts]
    return float(cuts[int(np.argmax(f1))])


def held_out(column: str = "doc_id"):
    """Rows whose labels are never read."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, seed: int = 0) -> Model:
    """Fits on at most per_class toxic and per_class other labelled documents, chosen by a hash of doc_id; held-out rows are left out.

    Labels other than 0 and 1 are ignored; of several labels of one document the largest counts, of several texts of one
    doc_id the least. Words are hashed where the texts lie; what reaches the driver is bounded by per_class and TRAIN_WORDS.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(seed))
    # a hash decides before anything is sorted: about 1.2 times the bound of ids is, whatever the input
    spot = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    ids = None
    for y in (0, 1):
        some = known.where((F.col("__y") == y) & (spot < min(1.0, (1.2 * per_class + 50) / max(1, counts.get(y, 0)))))
        some = some.orderBy(order, "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("p"), F.max("__y").cast("int").alias("y")).select("doc_id", "y", "p.lang", "p.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 19):
                tok, first = windowed(*tokens(part.column("text")))
                offs = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("lang"), *(pa.ListArray.from_arrays(offs, pa.array(t.astype(np.int32))) for t in tok)], ["doc_id", "y", "lang", "own", "head"])

    sample = rows.mapInArrow(lean(run), "doc_id long, y int, lang string, own array<int>, head array<int>").toArrow().combine_chunks().sort_by("doc_id")
    sides = [sample[c].combine_chunks() for c in ("own", "head")]
    if not sample.num_rows:
        return fit([], seed)
    flat = np.stack([x.flatten().to_numpy() for x in sides])
    cuts = np.concatenate([[0], np.cumsum(np.array([len(x) for x in sides[0]]))])
    return fit([(flat[:, a:b], y, lang) for a, b, y, lang in zip(cuts[:-1], cuts[1:], sample["y"].to_pylist(), sample["lang"].to_pylist(), strict=True)], seed)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every whole text; one row per row of docs, no shuffle.

    Columns: doc_id, held_out, score, predicted (score >= 0.7), lang_cut (the threshold of the row's language), flagged
    (score >= lang_cut). The language picks lang_cut only; the score is a function of the text. A null or empty text is
    scored like any other, as one without words; a very long text is scored whole, its words held in memory at once. A null
    doc_id is not held out; repeated rows give repeated rows; a table without rows gives none; other columns are not read.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for batch in batches:
            for part in slices(batch, 1 << 19):
                score = scores(model, *tokens(part.column("text"))).astype(float)
                ids = part.column("doc_id").cast(pa.int64())
                held = [x is not None and zlib.crc32(str(x).encode()) % 3 == 1 for x in ids.to_pylist()]
                cut = np.array([model.thresholds.get(x or "", CUT) for x in part.column("lang").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(cut), pa.array(score >= cut)], ["doc_id", "held_out", "score", "predicted", "lang_cut", "flagged"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, lang_cut double, flagged boolean")
