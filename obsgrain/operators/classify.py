"""Held-out classification of entities: designs, logistic regression, discriminant analysis, a small network, bounds."""

from __future__ import annotations

import mmap
import os
import platform
import signal
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgrain.functions.scalars import hash_order
from obsgrain.operators.cuts import cut
from obsgrain.operators.hurdle import presence_rate
from obsgrain.operators.info import fano_bounds
from obsgrain.operators.ranks import ranked
from obsgrain.operators.resample import folds
from obsgrain.operators.spectrum import feature_names


#: Up to so many features each cell is compared with the name of each.
FEW_FEATURES = 64


def design(obs: DataFrame, hurdle: str | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Wide rows (by, obs_id, entity, one column a feature); a hurdle feature enters as ln of its positive values."""
    x = F.when(F.col("feature") == hurdle, F.when(F.col("x") > 0, F.ln("x"))).otherwise(F.col("x")) if hurdle else F.col("x")
    names = feature_names(obs)
    rows = obs.groupBy(*by, "obs_id", "entity")
    if not 0 < len(names) <= FEW_FEATURES:
        return rows.pivot("feature", names).agg(F.first(x)), names
    # cells of an observation are put together where they lie: a pivot would move each of them
    return rows.agg(*[F.first(F.when(F.col("feature") == c, x), ignorenulls=True).alias(c) for c in names]), names


def softmax_regression(x: np.ndarray, y: np.ndarray, s: int, c: float = 1.0, steps: int = 200) -> np.ndarray:
    """Multinomial logistic regression with an L2 penalty 1/C, by accelerated gradient steps; returns weights with the offset last."""
    p = x.shape[1] + 1
    w = np.zeros((p, s))
    v, top = w.copy(), np.zeros((p, p))
    for z, _ in _blocks(x, y):
        top += z.T @ z
    rate = 1.0 / (0.5 * np.linalg.eigvalsh(top)[-1] + 1 / c)
    for k in range(steps):
        g = np.zeros((p, s))
        for z, of in _blocks(x, y):
            q = _softmax(z @ v)
            q[np.arange(len(q)), of] -= 1
            g += z.T @ q
        g[:-1] += v[:-1] / c
        nxt = v - rate * g
        v, w = nxt + k / (k + 3) * (nxt - w), nxt
    return w


#: Cells of a block of rows that a fit works on at a time, beside the rows themselves.
BLOCK_CELLS = 1 << 20


def _blocks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with a one for the offset, and their labels, a block at a time."""
    step = max(1, BLOCK_CELLS // (x.shape[1] + 1))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        yield np.c_[part, np.ones(len(part))], y[at : at + step]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def shrunk_covariance(r: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage of the covariance of centred rows towards a multiple of the identity."""
    return _shrunk(r.T @ r / len(r), (r**2).T @ (r**2) / len(r), len(r))


def _shrunk(s: np.ndarray, s4: np.ndarray, n: int) -> np.ndarray:
    """The same of the mean products of the cells of n centred rows and of their squares."""
    p = len(s)
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (s4 - s**2).sum() / n / p) if d2 > 0 else 0.0
    k = b2 / d2 if d2 > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p)


def discriminant(x: np.ndarray, y: np.ndarray, s: int) -> np.ndarray:
    """Linear discriminant analysis with shared, shrunk covariance; weights with the offset last, classes without rows get none."""
    n, p = np.bincount(y, minlength=s), x.shape[1]
    means = np.stack([np.bincount(y, x[:, j], s) for j in range(p)], 1) / np.maximum(n, 1)[:, None]
    ss, s2, s4 = np.zeros(p), np.zeros((p, p)), np.zeros((p, p))
    for z, of in _blocks(x, y):
        ss += ((z[:, :-1] - means[of]) ** 2).sum(0)
    scale = np.maximum(np.sqrt(ss / max(1, len(x))), 1e-12)
    for z, of in _blocks(x, y):
        r = (z[:, :-1] - means[of]) / scale
        s2 += r.T @ r
        r *= r
        s4 += r.T @ r
    cov = _shrunk(s2 / max(1, len(x)), s4 / max(1, len(x)), max(1, len(x))) * np.outer(scale, scale)
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0]
    off = -0.5 * (means.T * coef).sum(0) + np.log(np.maximum(n, 1e-300) / max(1, n.sum()))
    return np.r_[coef, off[None]]


def hidden(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """What a network says of each row, before the softmax."""
    return np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3]


#: A training step's rows are worked on in so many parts, each at most by a process of its own: the sums are the same however many there are.
PARTS = 2
#: Steps whose rows are looked up together.
AHEAD = 16
#: From so many rows on a network is trained by several processes.
CREW_ROWS = 4000


def network(x: np.ndarray, y: np.ndarray, s: int, units: int = 128, alpha: float = 1e-3, epochs: int = 120, seed: int = 0, processes: int = 1) -> list[np.ndarray]:
    """One hidden layer of rectified units, L2 penalty, Adam; returns weights and offsets of both layers.

    processes: that share each step, forks of this one (at most PARTS); the result does not depend on them.
    """
    (n, p), rng = x.shape, np.random.default_rng(seed)
    crew = max(1, min(processes, PARTS)) if n >= CREW_ROWS else 1
    first, size = (p + 1) * units, (p + 1) * units + (units + 1) * s
    # shared by the crew: how far each has come (a cache line each), parameters, gradients of the parts
    shared = mmap.mmap(-1, 8 * (8 * PARTS + (1 + PARTS) * size))
    clock = memoryview(shared)[: 64 * PARTS].cast("q")
    theta, *grads = np.frombuffer(shared, float, offset=64 * PARTS).reshape(1 + PARTS, size)
    layers = lambda a: (a[:first].reshape(p + 1, units), a[first : size - s].reshape(units, s), a[size - s :])
    w, u, b = layers(theta)
    w[:p] = rng.normal(0, np.sqrt(2 / p), (p, units))
    u[:] = rng.normal(0, np.sqrt(1 / units), (units, s))
    steps, decay = max(1, n // 200), np.zeros(size)
    decay[: p * units] = decay[first : size - s] = alpha / max(1, n)
    sums, room, names, zero = [layers(g) for g in grads], {}, np.arange(s)[:, None], np.zeros(units)

    def part(z: np.ndarray, label: np.ndarray, of: int, j: int) -> None:
        """The gradient by these rows (with a one for the offset) of a batch of so many."""
        r = len(z)
        if r not in room:
            room[r] = *np.empty((2, r, units)), np.empty((r, units), bool), np.empty((s, r)), np.empty((s, r), bool), np.empty(r)
        a, h, on, d, own, top = room[r]
        np.maximum(np.matmul(z, w, out=a), zero, out=a)
        np.add(np.matmul(u.T, a.T, out=d), b[:, None], out=d)
        np.exp(np.subtract(d, np.maximum.reduce(d, axis=0, out=top), out=d), out=d)
        np.divide(d, np.add.reduce(d, axis=0, out=top), out=d)
        np.divide(np.subtract(d, np.equal(names, label, out=own), out=d), of, out=d)
        np.multiply(np.matmul(d.T, u.T, out=h), np.greater(a, zero, out=on), out=h)
        dw, du, db = sums[j]
        np.matmul(z.T, h, out=dw)
        np.matmul(a.T, d.T, out=du)
        np.add.reduce(d, axis=1, out=db)

    def work(me: int, alive) -> None:
        """All steps of one of the crew: the gradients of its parts, then its share of the parameters."""
        at, others, mine = 0, [8 * i for i in range(crew) if i != me], range(me, PARTS, crew)
        share = slice(size * me // crew, size * (me + 1) // crew)
        own, pull = theta[share], decay[share]
        g, h, m, v = np.zeros((4, len(own)))
        slices, t = [a[share] for a in grads], 0
        cuts = np.arange(steps + 1) * (n // steps) + np.minimum(np.arange(steps + 1), n % steps)  # of batches, as array_split has them
        mids = [cuts[:-1] + (cuts[1:] - cuts[:-1]) * j // PARTS for j in range(PARTS + 1)]
        most = AHEAD * int(max(np.diff(mids, axis=0).max(initial=0), 1))
        z, found = {j: np.ones((most, p + 1)) for j in mine}, np.empty((most, p))

        def meet() -> None:
            nonlocal at
            at += 1
            clock[8 * me] = at
            for i in others:
                turns = 0
                while clock[i] < at:
                    turns += 1
                    if turns > 500:  # the other one has no core just now
                        os.sched_yield()
                        if turns % 500 == 0:
                            alive()

        for _ in range(epochs):
            order = rng.permutation(n)
            for first_step in range(0, steps, AHEAD):
                block = range(first_step, min(first_step + AHEAD, steps))
                label, ends = {}, dict.fromkeys(mine, 0)
                for j in mine:
                    rows = np.concatenate([order[mids[j][k] : mids[j + 1][k]] for k in block])
                    np.take(x, rows, axis=0, out=found[: len(rows)], mode="clip")
                    z[j][: len(rows), :p], label[j] = found[: len(rows)], y[rows]
                for k in block:
                    for j in mine:
                        lo = ends[j]
                        ends[j] = hi = lo + int(mids[j + 1][k] - mids[j][k])
                        part(z[j][lo:hi], label[j][lo:hi], int(cuts[k + 1] - cuts[k]), j)
                    meet()
                    np.multiply(pull, own, out=g)
                    for a in slices:
                        np.add(g, a, out=g)
                    t += 1
                    np.add(np.multiply(m, 0.9, out=m), np.multiply(g, 0.1, out=h), out=m)
                    np.add(np.multiply(v, 0.999, out=v), np.multiply(np.multiply(g, g, out=g), 0.001, out=g), out=v)
                    np.add(np.sqrt(np.divide(v, 1 - 0.999**t, out=h), out=h), 1e-8, out=h)
                    np.multiply(np.divide(m, h, out=h), 1e-3 / (1 - 0.9**t), out=h)
                    np.subtract(own, h, out=own)
                    meet()

    _together(work, crew)
    w, u, b = layers(theta.copy())
    return [w[:p], w[p:], u, b[None]]


def _together(work, crew: int) -> None:
    """Runs work(i, alive) for each i of the crew, 0 here and the others in forks; alive() ends or raises when one of them is gone."""
    top, forks = os.getpid(), []

    def gone() -> None:
        if os.getppid() != top:
            os._exit(1)

    def all_there() -> None:
        for pid in list(forks):
            done, status = os.waitpid(pid, os.WNOHANG)
            if done:
                forks.remove(pid)
                if status:
                    raise RuntimeError("a process that trained a part of the network ended early")

    try:
        for i in range(1, crew):
            pid = os.fork()
            if not pid:
                code = 1
                try:
                    work(i, gone)
                    code = 0
                finally:
                    os._exit(code)  # nothing of the task goes on in a fork
            forks.append(pid)
        work(0, all_there)
    except BaseException:
        for pid in forks:
            os.kill(pid, signal.SIGKILL)
        raise
    finally:
        for pid in forks:
            os.waitpid(pid, 0)


def crew_size(fits: int, hosts: int) -> int:
    """Processes for one of so many fits that run at a time on so many machines: cores of this machine that are left for it. Other processors than x86 may show writes of a process in another order."""
    cores = len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else 1
    return max(1, min(PARTS, cores // -(-fits // hosts))) if platform.machine() in ("x86_64", "AMD64") else 1


#: Labels that a model tells apart at most: the models of all folds are sent to every task.
MOST_LABELS = 100_000


def training_scale(rows: DataFrame, columns: list[str], k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, held, n, mean, sd): of the rows outside each fold, arrays over the columns; a mean without values is 0, a deviation of 0 is 1.

    Missing cells count as the mean, which adds nothing to the deviation (a population one).
    """
    held = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("held")).where("held != fold")
    cells = [e for j, c in enumerate(columns) for e in (F.coalesce(F.avg(f"`{c}`"), F.lit(0.0)).alias(f"__m{j}"), (F.coalesce(F.var_pop(f"`{c}`"), F.lit(0.0)) * F.count(f"`{c}`") / F.count(F.lit(1))).alias(f"__v{j}"))]
    g = held.groupBy(*by, "held").agg(F.count(F.lit(1)).alias("n"), *cells)
    sd = [F.when(F.col(f"__v{j}") > 1e-24, F.sqrt(f"__v{j}")).otherwise(1.0) for j in range(len(columns))]
    return g.select(*by, "held", "n", F.array(*[f"__m{j}" for j in range(len(columns))]).alias("mean"), F.array(*sd).alias("sd"))


def _ready(pdf: pd.DataFrame, columns: list[str], mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    x = pdf[columns].to_numpy(float)
    return (np.where(np.isfinite(x), x, mean) - mean) / sd


def _slots(spark: SparkSession, fits: int) -> tuple[int, int]:
    """Task slots for each of so many fits, and the machines that have them."""
    sc = spark.sparkContext
    hosts = [i.host() for i in sc._jsc.sc().statusTracker().getExecutorInfos()]
    if len(hosts) > 1:  # the driver is one of them
        hosts.remove(next((h for h in hosts if h == sc.getConf().get("spark.driver.host")), hosts[0]))
    return max(1, sc.defaultParallelism // max(1, fits)), len(set(hosts)) or 1


def run_folds(obs: DataFrame, k: int = 5, kinds: tuple[str, ...] = ("logreg", "lda"), hurdle: str | None = None, presence: str = "none", seed: int = 0, shuffled: bool = False, by: tuple[str, ...] = (), most_train: int | None = None, only: tuple[int, ...] | None = None) -> DataFrame:
    """Held-out predictions: by, kind, fold, obs_id, label, predicted, q_true; folds and models within each group of by.

    One task fits the models of a fold on all its training rows (with most_train on so many at most, taken by a hash of obs_id):
    it holds one matrix of them, filled a batch at a time. Every row is then predicted where it lies. presence
    "none" leaves the presence rate of a hurdle feature out; "speaker_lookup" adds the rate that training rows of the row's
    own entity have, a function of the label that flatters every result. shuffled deals labels anew by hash. only: the folds that are fitted and predicted, all of them if None.
    """
    wide, names = design(obs, hurdle, by)
    wide = cut(folds(wide, k, "entity", seed, by))
    columns = list(names)
    if presence == "speaker_lookup" and hurdle:
        rated = obs.where(F.col("feature") == hurdle).join(wide.select(*by, "obs_id", "fold"), [*by, "obs_id"])
        held = rated.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("held"))
        rates = presence_rate(held, "held != fold", (*by, "held"))
        wide = cut(wide.join(rates.groupBy(*by, "entity").pivot("held", list(range(k))).agg(F.first("rate")).withColumnsRenamed({str(f): f"__rate{f}" for f in range(k)}), [*by, "entity"]))
    rate = [f"__rate{f}" for f in range(k) if f"__rate{f}" in wide.columns]
    if shuffled:
        own = ranked(wide.select(*by, "entity", "obs_id"), ["obs_id"], by).select(*by, "k", "entity")
        anew = ranked(wide.select(*by, "obs_id").withColumn("__o", hash_order(F.lit(seed), F.lit("labels"), F.col("obs_id"))), ["__o", "obs_id"], by).drop("__o")
        wide = cut(wide.drop("entity").join(anew.join(own, [*by, "k"]).drop("k"), [*by, "obs_id"]))
    every = columns + rate
    scale = {(*(r[c] for c in by), r["held"]): (r["n"], np.array(r["mean"]), np.array(r["sd"])) for r in training_scale(wide, every, k, by).collect()}  # one row a fold and group
    labels: dict[tuple, list[str]] = {}
    for r in wide.select(*by, F.col("entity").cast("string").alias("entity")).where("entity is not null").distinct().limit(MOST_LABELS + 1).collect():
        labels.setdefault(tuple(r[c] for c in by), []).append(r["entity"])
    if sum(map(len, labels.values())) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = {g: sorted(x) for g, x in labels.items()}
    slots, hosts = _slots(obs.sparkSession, len(scale))
    own = lambda held: names + ([f"__rate{held}"] if rate else [])
    at = {c: j for j, c in enumerate(every)}

    def scaled(pdf: pd.DataFrame, group: tuple, held: int) -> np.ndarray:
        _, mean, sd = scale[(*group, held)]
        pick = [at[c] for c in own(held)]
        return _ready(pdf, own(held), mean[pick], sd[pick])

    def fit(group: tuple, held: int, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        out, s = [], len(labels[group])
        for kind in kinds:
            w = network(x, y, s, seed=seed, processes=min(slots, crew_size(len(scale), hosts))) if kind == "mlp" else [(softmax_regression if kind == "logreg" else discriminant)(x, y, s)]
            out += [{**dict(zip(by, group, strict=True)), "held": held, "kind": kind, "part": j, "rows": len(a), "weights": np.ravel(a).tolist()} for j, a in enumerate(w)]
        return pd.DataFrame(out)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come fold by fold; a fold's matrix is let go of before the next."""
        now, x, y, n = None, None, None, 0
        for batch in batches:
            for key, pdf in batch.groupby([*by, "held"], dropna=False, sort=False):
                group, held = tuple(None if c != c else c for c in key[:-1]), int(key[-1])
                if now != (group, held):
                    if now is not None:
                        yield fit(*now, x[:n], y[:n])
                    now, n = (group, held), 0
                    x, y = np.empty((scale[(*group, held)][0], len(own(held)))), np.empty(scale[(*group, held)][0], np.int32)
                x[n : n + len(pdf)] = scaled(pdf, group, held)
                y[n : n + len(pdf)] = np.searchsorted(labels[group], pdf["entity"].to_numpy(str))
                n += len(pdf)
        if now is not None:
            yield fit(*now, x[:n], y[:n])

    most = max([1, *(n for n, _, _ in scale.values())])
    copies = wide.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("held")).where("held != fold and entity is not null")
    copies = copies if only is None else copies.where(F.col("held").isin(*only))
    chosen = copies if most_train is None or most <= most_train else copies.where(F.pmod(F.xxhash64("obs_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most_train / most))
    types = dict(wide.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "held long, kind string, part int, rows long, weights array<double>"])
    models: dict[tuple, dict[str, list[np.ndarray]]] = {}
    for r in sorted(chosen.repartition(min(1000, 64 * max(1, len(scale))), *by, "held").sortWithinPartitions(*by, "held", "obs_id").mapInPandas(fits, schema).collect(), key=lambda r: r["part"]):
        models.setdefault((*(r[c] for c in by), r["held"]), {}).setdefault(r["kind"], []).append(np.reshape(r["weights"], (r["rows"], -1)))
    sent = obs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, pdf in batch.groupby([*by, "fold"], dropna=False):
                group, held = tuple(key[:-1]), int(key[-1])
                known, x = np.array(labels[group]), scaled(pdf, group, held)
                y = np.searchsorted(known, pdf["entity"].to_numpy(str))
                for kind, w in sent.value.get((*group, held), {}).items():
                    p = _softmax(hidden(w, x) if kind == "mlp" else np.c_[x, np.ones(len(x))] @ w[0])
                    yield pd.DataFrame({**{c: pdf[c] for c in by}, "kind": kind, "fold": held, "obs_id": pdf["obs_id"], "label": known[y], "predicted": known[p.argmax(1)], "q_true": p[np.arange(len(p)), y]})

    out = ", ".join([*(f"`{c}` {types[c]}" for c in by), "kind string, fold long, obs_id long, label string, predicted string, q_true double"])
    asked = wide.where("entity is not null")
    return (asked if only is None else asked.where(F.col("fold").isin(*only))).mapInPandas(predict, out)


def summary(predictions: DataFrame, entities: int) -> DataFrame:
    """Mean and population deviation over folds of acc, i_fano and i_xent for each kind."""
    f = fano_bounds(predictions, ("kind", "fold"), F.lit(entities))
    return f.groupBy("kind").agg(*[e for c in ("acc", "i_fano", "i_xent") for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))])


def headline(summaries: DataFrame) -> DataFrame:
    """The best i_fano and the best i_xent, which may come from different classifiers."""
    return summaries.agg(F.max("i_fano_mean").alias("i_fano"), F.max("i_xent_mean").alias("i_xent"))
