"""Closed-form identities and edge cases of operators."""

import collections
import hashlib
import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsgrain.functions import scalars
from obsgrain.operators import analysis, classify, cuts, frames, hurdle, info, kernels, ranks, resample, segments, select, spectrum, stats, sweep
from obsgrain.sources import readers, writers


def obs(spark, rows):
    """rows: (entity, obs_id, feature, x)."""
    return spark.createDataFrame([(e, "s", o, f, x) for e, o, f, x in rows], "entity string, stratum string, obs_id long, feature string, x double")


def test_three_states(spark):
    d = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (math.nan,), (math.inf,), (None,)], "x double")
    both = d.select(scalars.state_code(F.col("x"), "reference").alias("a"), scalars.state_code(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in both] == [1, 2, 3, 3, 3, 3]
    assert [r["b"] for r in both] == [1, 2, 1, 3, 3, 3]


def test_fisher_matches_numpy_on_unbalanced_groups(spark):
    rng = np.random.default_rng(0)
    rows, groups = [], []
    for e, n in enumerate((1, 2, 5, 9)):
        x = rng.normal(e, 1, n)
        groups.append(x)
        rows += [(str(e), 100 * e + k, "a", float(v)) for k, v in enumerate(x)]
    rows += [("none", 999, "a", None)]
    got = stats.variance_components(obs(spark, rows), anova=True).first()
    n = np.array([len(g) for g in groups])
    every, s = np.concatenate(groups), len(groups)
    msb = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / (s - 1)
    msw = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n.sum() - s)
    n0 = (n.sum() - (n**2).sum() / n.sum()) / (s - 1)
    assert got["s"] == s and got["n"] == n.sum()
    assert got["f_star"] == pytest.approx(max((msb - msw) / n0, 0) / msw)
    assert got["f"] == pytest.approx(msb / msw)


def test_f_tail_known_values():
    assert stats.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert stats.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert stats.f_tail(0.0, 2, 3) == 1.0


def test_pr_of_copies_is_one_and_of_independent_columns_is_their_number(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rows = [(str(e), e, f, float(x[e])) for e in range(200) for f in "abc"]
    corr = spectrum.correlation(spectrum.pairwise_covariance(spectrum.entity_means(obs(spark, rows))))
    assert spectrum.participation_ratio(corr).first()["pr"] == pytest.approx(1)
    assert spectrum.pr_of(rng.normal(size=(20000, 8))) == pytest.approx(8, abs=0.5)


def test_pairwise_covariance_keeps_each_features_own_support(spark):
    rows = [("1", 1, "a", 1.0), ("2", 2, "a", 2.0), ("3", 3, "a", 4.0), ("1", 1, "b", 3.0), ("2", 2, "b", 1.0), ("3", 3, "b", None), ("4", 4, "b", 7.0)]
    got = {(r["i"], r["j"]): r["cov"] for r in spectrum.pairwise_covariance(spectrum.entity_means(obs(spark, rows))).collect()}
    assert got["a", "a"] == pytest.approx(np.var([1, 2, 4])) and got["b", "b"] == pytest.approx(np.var([3, 1, 7]))
    assert got["a", "b"] == pytest.approx(np.cov([1, 2], [3, 1], ddof=0)[0, 1])


def test_dimensions_agree_with_frobenius_form():
    r = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    assert spectrum.dimensions(r)["pr"] == pytest.approx(9 / (r**2).sum())
    assert np.linalg.eigvalsh(spectrum.clip_psd(np.array([[1, 2], [2, 1.0]])))[0] >= -1e-12


def test_hurdle_decomposition_is_the_direct_moment(spark):
    rng = np.random.default_rng(2)
    rows = [(str(e), 100 * e + k, "z", float(max(rng.normal(e % 5, 1) - 2, 0))) for e in range(40) for k in range(8)]
    h = hurdle.fit(obs(spark, rows).drop("feature"))
    v = hurdle.variance(h).first()
    assert v["var"] == pytest.approx(v["direct"], abs=1e-10)
    means = obs(spark, [(str(e), e, "a", float(rng.normal())) for e in range(40)]).select("entity", "feature", "x")
    assert hurdle.covariance(h, means).first()["cov"] == pytest.approx(hurdle.covariance(h, means, "direct").first()["cov"], abs=1e-10)


def test_bins_with_ties_and_constants(spark):
    b = info.quantile_bins(obs(spark, [("e", k, "c", 1.0) for k in range(9)] + [("e", k, "t", float(k // 5)) for k in range(10)]), 5)
    assert {r["bin"] for r in b.where("feature = 'c'").collect()} == {0}
    assert b.where("feature = 't'").select("bin").distinct().count() <= 2


def test_exact_null_is_the_mean_of_shuffles(spark):
    rng = np.random.default_rng(3)
    y, b = rng.integers(0, 4, 30), rng.integers(0, 3, 30)
    d = spark.createDataFrame([("f", str(e), int(x), k) for k, (e, x) in enumerate(zip(y, b, strict=True))], "feature string, entity string, bin int, obs_id long")
    got = info.exact_null(d, info.entity_count(d)).first()["i_null"]

    def raw(y):
        h = 0
        for v in set(b):
            p = np.bincount(y[b == v]) / (b == v).sum()
            h += (b == v).mean() * -(p[p > 0] * np.log2(p[p > 0])).sum()
        return 2 - h

    assert got == pytest.approx(np.mean([raw(rng.permutation(y)) for _ in range(4000)]), abs=0.01)


def test_fano_bounds_of_a_perfect_classifier(spark):
    d = spark.createDataFrame([(str(k), str(k), 1.0) for k in range(8)], "label string, predicted string, q_true double")
    r = info.fano_bounds(d).first()
    assert r["acc"] == 1 and r["i_fano"] == pytest.approx(3) and r["i_xent"] == pytest.approx(3)


def test_classifiers_find_separate_groups_and_not_shuffled_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(str(e), 20 * e + k, f, float(rng.normal(3 * e if f == "a" else -e, 0.3))) for e in range(6) for k in range(20) for f in "ab"]
    o = obs(spark, rows)
    s = {r["kind"]: r for r in classify.summary(classify.run_folds(o, 4, ("logreg", "lda", "mlp")), 6).collect()}
    assert min(s["logreg"]["acc_mean"], s["lda"]["acc_mean"]) > 0.95 and s["mlp"]["acc_mean"] > 0.4
    assert classify.summary(classify.run_folds(o, 4, ("lda",), shuffled=True), 6).first()["acc_mean"] < 0.5


def test_segments(spark):
    labels = ["h#", "p", "pcl", "p", "aa", "s", "pau", "iy", "h#"]
    s = spark.createDataFrame([("u", k, x, 100 * k, 100 * k + 100) for k, x in enumerate(labels)], "utt_id string, seq long, label string, start long, end long")
    assert segments.run_lengths(s).first()[1:] == (300.0, 2)
    assert segments.preceded(s).first()[1:] == (100.0, 1)
    r = segments.rate(s).first()
    assert r["n"] == 2 and r["rate"] == pytest.approx(2 / 700)
    quiet = s.withColumn("label", F.lit("h#"))
    assert segments.run_lengths(quiet).first()[1:] == (None, 0) and segments.rate(quiet).first()["rate"] is None
    at = spark.createDataFrame([("u", 0), ("u", 99), ("u", 100), ("u", 900)], "utt_id string, at long")
    assert [r["label"] for r in segments.interval_join(at, s).orderBy("at").collect()] == ["h#", "h#", "p", ""]
    f = segments.frames_of(s, 40, 30).collect()
    assert len(f) == 29 and all(labels[r["center"] // 100] == r["label"] for r in f)
    assert segments.masks(s).where("voiced and sonorant").count() == 2


def test_nearest_takes_the_later_of_two(spark):
    p = spark.createDataFrame([("u", 0.5), ("u", -3.0), ("u", 9.0), ("v", 1.0)], "utt_id string, at double")
    s = spark.createDataFrame([("u", 0.0, 10.0), ("u", 1.0, 11.0), ("u", 2.0, 12.0)], "utt_id string, at double, value double")
    assert {(r["utt_id"], r["at"]): r["value"] for r in segments.nearest(p, s).collect()} == {("u", 0.5): 11, ("u", -3): 10, ("u", 9): 12, ("v", 1.0): None}


def test_guarded_aggregates(spark):
    d = spark.createDataFrame([("a", float(x)) for x in range(3)] + [("b", float(x)) for x in range(10)] + [("c", x) for x in (1.0, 2.0, 3.0, 4.0, 10.0, None, None)], "g string, x double")
    got = {r["g"]: (r["m"], r["n"]) for r in d.groupBy("g").agg(*[c.alias(n) for c, n in zip(frames.guarded(F.col("x")), "mn", strict=True)]).collect()}
    assert got == {"a": (None, 3), "b": (4.5, 10), "c": (4.0, 5)}


def test_votes(spark):
    def clips(e, a, b):
        return [(e, 0.9, 0.1)] * a + [(e, 0.2, 0.8)] * b

    d = spark.createDataFrame(clips("w", 10, 0) + clips("x", 9, 1) + clips("y", 6, 4) + clips("z", 5, 5), "entity string, pa double, pb double")
    got = {r["entity"]: (r["majority"], r["decision"]) for r in select.votes(d).collect()}
    assert got == {"w": ("a", "tagged"), "x": ("a", "tagged"), "y": ("a", "ambiguous"), "z": ("tie", "tie")}


def test_subsets_are_nested_and_balanced(spark):
    o = obs(spark, [(f"{s}{e}", 100 * e + k, "a", 1.0) for s in "FM" for e in range(12) for k in range(5)]).withColumn("stratum", F.substring("entity", 1, 1))
    small, large = ({tuple(r) for r in resample.nested_subset(o, n, 3).select("entity", "obs_id").collect()} for n in (3, 7))
    assert small < large and len(small) == 18 and len(large) == 42


def test_kernels():
    rate = 16000
    t = np.arange(800) / rate
    x = np.tile(np.exp(-60 * t) * np.sin(2 * np.pi * 700 * t) + np.exp(-80 * t) * np.sin(2 * np.pi * 1800 * t), 4)
    found = [f for f, b in kernels.poles(kernels.burg(x[:400], 8)) if b < 400]
    assert any(abs(f - 700) < 60 for f in found) and any(abs(f - 1800) < 60 for f in found)
    tone = sum(np.sin(2 * np.pi * 150 * k * np.arange(rate) / rate) / k for k in range(1, 20))
    f0 = kernels.pitch(tone, "M")
    assert np.nanmedian(f0) == pytest.approx(150, rel=0.01)
    assert not np.isfinite(kernels.pitch(np.zeros(rate), "M")).any()
    jitter, shimmer = kernels.perturbation(tone[:4000], 150.0)
    assert jitter < 0.02 and shimmer < 0.05
    assert np.isnan(kernels.perturbation(tone[:100], 150.0)[0])
    assert set(kernels.glottal_params(tone[:3200], 150.0)) == {"GCT", "CQ", "NAQ", "MFDR", "SQ"}
    assert kernels.noise_excitation(tone[:4000]) <= 1 + 1e-9
    assert np.nanmedian(kernels.cepstral_peak(tone)) > 5
    p, f = kernels.power_spectrum(tone)
    ihi, shr = kernels.harmonics(p[0], f, 150.0)
    # the search window is a tenth of k F0 wide, so high harmonics may meet their neighbours
    assert 0 <= ihi < 300 and shr < 1 and np.isnan(kernels.harmonics(p[0], f, 4000.0)[0])
    assert np.isnan(kernels.modulation(np.ones(10), np.zeros(10, bool)))
    w, f5, b5 = kernels.match_formants([700.0, 1800.0], [(690.0, 80.0), (1750.0, 90.0), (3000.0, 200.0)], 5000.0)
    assert w == [80.0, 90.0] and (f5, b5) == (3000.0, 200.0)
    assert kernels.bandwidth(np.random.default_rng(0).normal(size=4000)) > 6000


def test_kernel_failures_are_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "utt_id long, samples array<double>")
    out = {r["utt_id"]: r for r in kernels.apply(d, lambda x: [{"first": float(x[0])}], "first double").collect()}
    assert out[1]["first"] == 1 and out[1]["error"] is None and "IndexError" in out[2]["error"]


def test_sources(spark, tmp_path):
    import wave

    (tmp_path / "TRAIN/DR1/FABC").mkdir(parents=True)
    (tmp_path / "TRAIN/DR1/FABC/S1.phn").write_text("0 10 h#\n10 30 aa\nbroken line\n1 2\n")
    with wave.open(str(tmp_path / "TRAIN/DR1/FABC/S1.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.arange(0, 16000, 2, dtype="<i2").tobytes())
    (tmp_path / "TRAIN/DR1/FABC/S2.wav").write_bytes(b"no sound")
    a = readers.alignments(spark, str(tmp_path / "TRAIN/DR1/FABC/S1.phn"))
    assert [(r["start"], r["end"], r["label"]) for r in a.orderBy("seq").collect()] == [(0, 10, "h#"), (10, 30, "aa")]
    r = {x["path"][-6:]: x for x in readers.recordings(spark, str(tmp_path)).collect()}
    assert r["S1.wav"]["decode_ok"] and r["S1.wav"]["duration"] == 1.0 and not r["S2.wav"]["decode_ok"] and r["S2.wav"]["error"]
    d = readers.discover(spark, str(tmp_path)).where("basename = 'S1'").first()
    assert (d["split"], d["region"], d["speaker_id"], d["sex"]) == ("TRAIN", "DR1", "FABC", "F")
    t = spark.createDataFrame([(1, "a,b,,c"), (2, None)], "k int, clips string")
    assert [r[0] for r in t.orderBy("k").select(readers.listed("clips")).collect()] == [["a", "b", "c"], []]
    writers.tsv(t.where("k = 1").withColumn("l", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "t"))
    assert readers.tsv(spark, str(tmp_path / "t")).first()["l"] == "x,y"
    with pytest.raises(Exception):
        writers.tsv(t, str(tmp_path / "t"))
    assert writers.config_hash({"b": 1, "a": 2}) == writers.config_hash({"a": 2, "b": 1}) and len(writers.config_hash({})) == 16
    assert writers.plot_data(spark.createDataFrame([(float(k),) for k in range(10)], "x double"), "x", 5).agg(F.sum("n")).first()[0] == 10
    assert spark.createDataFrame([("0 100 Say it.",), ("one",)], "t string").select(readers.transcript(F.col("t"))).collect()[0][0] == "Say it."


def test_resumable_stream(spark, tmp_path):
    from obsgrain.streaming.resume import resumable

    src = str(tmp_path / "in")
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(src)
        q = resumable(spark.readStream.schema("id long").parquet(src), lambda d: d.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


# -- ranks and quantiles


@pytest.mark.parametrize("by", [(), ("g",)])
def test_ranks_by_ranges(spark, by):
    """Also of a group that lies in many ranges, and of the null group."""
    rng = np.random.default_rng(0)
    rows = [(str(int(rng.integers(0, 3))) if k % 10 else None, float(v)) for k, v in enumerate(rng.permutation(500))] + [("hot", float(1000 + k)) for k in range(700)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = ranks.ranked(d, ["v"], by).collect()
    groups = {}
    for g, v in rows:
        groups.setdefault(g if by else "", []).append(v)
    want = {(g, v): k + 1 for g, vs in groups.items() for k, v in enumerate(sorted(vs))}
    assert len(got) == len(rows) and all(r["k"] == want[r["g"] if by else "", r["v"]] for r in got)
    assert ranks.ranked(d.limit(0), ["v"], by).count() == 0


def test_quantiles_by_ranks_are_the_aggregates(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{k % 4}" if k % 9 else None, None if k % 11 == 0 else float(round(rng.normal(), 1))) for k in range(900)] + [("one", 3.5), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for by in ((), ("g",)):
        a, b = ({(r["g"] if by else ""): list(r["q"]) for r in ranks.quantiles(d, "v", probs, by, m).collect()} for m in ("aggregate", "ranked"))
        assert a.keys() == b.keys() and all(b[g] == pytest.approx(a[g], abs=1e-12) for g in a)


def test_ranges_stay_small_where_the_number_of_rows_is_known(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    d = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2000).alias("v"))
    r = ranks.ranked(d, ["v"], ("g",), rows=2000).withColumn("p", F.spark_partition_id()).collect()
    sizes = [sum(x["p"] == p for x in r) for p in {x["p"] for x in r}]
    assert len(sizes) >= 15 and max(sizes) < 400
    for g in range(3):
        assert [x["k"] for x in sorted((x for x in r if x["g"] == g), key=lambda x: x["v"])] == list(range(1, sum(x["g"] == g for x in r) + 1))


def test_quantiles_of_equal_values_are_that_value(spark):
    """Both methods, bit for bit: a sum of two shares of one value may be off by its last bit."""
    rng = np.random.default_rng(0)
    rows = [(f"g{k}", float(v)) for k, v in enumerate(rng.random(200)) for _ in range(3 + k)]
    d, want = spark.createDataFrame(rows, "g string, v double"), dict(rows)
    for m in ("aggregate", "ranked"):
        assert all(set(r["q"]) == {want[r["g"]]} for r in ranks.quantiles(d, "v", [0.2, 0.4, 0.6, 0.8], ("g",), m).collect()), m


def test_bounded(spark, monkeypatch):
    monkeypatch.setattr(cuts, "BROADCAST_ROWS", 3)
    assert "hint" in cuts.bounded(spark.range(3))._jdf.queryExecution().logical().toString().lower() or "broadcast" in cuts.bounded(spark.range(3))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in cuts.bounded(spark.range(4))._jdf.queryExecution().logical().toString().lower()


# -- resampling


def test_sampled_null_of_a_small_table(spark):
    d = spark.createDataFrame([("f", str(k % 3), k % 2, k) for k in range(12)] + [("g", "only", 0, k) for k in range(5)], "feature string, entity string, bin int, obs_id long")
    got = {r["feature"]: r["i_null"] for r in info.sampled_null(d, info.entity_count(d), 3000).collect()}
    want = {r["feature"]: r["i_null"] for r in info.exact_null(d, info.entity_count(d)).collect()}
    assert got["f"] == pytest.approx(want["f"], abs=0.02) and got["g"] == pytest.approx(want["g"])


def test_bootstrap_by_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 4))
    x[3, 1] = np.nan
    means = spark.createDataFrame([(f"e{i}", f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(30) for j in range(4)], "entity string, feature string, x double")
    got = {r["replicate"]: r["pr"] for r in resample.pr_bootstrap(means, 25).collect()}
    assert len(got) == 25
    for b in range(25):
        u = np.array([int(hashlib.md5(f"0:{b}:e{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(30)])
        taken = np.repeat(np.arange(30), np.searchsorted(resample._POISSON, u, "right"))
        y, cov = x[taken], np.zeros((4, 4))
        for i in range(4):
            for j in range(4):
                both = np.isfinite(y[:, i]) & np.isfinite(y[:, j])
                cov[i, j] = np.cov(y[both, i], y[both, j], ddof=0)[0, 1]
        r2 = cov**2 / np.outer(np.diag(cov), np.diag(cov))
        assert got[b] == pytest.approx(16 / r2.sum())


def test_labels_are_dealt_anew(spark):
    d = spark.createDataFrame([(k, f"e{k % 5}") for k in range(60)], "obs_id long, entity string")
    rows = resample.dealt(d, 3).collect()
    for b in range(3):
        own = [r for r in rows if r["replicate"] == b]
        assert len(own) == 60 and len({r["obs_id"] for r in own}) == 60
        assert sorted(r["entity"] for r in own) == sorted(f"e{k % 5}" for k in range(60)) and any(r["entity"] != f"e{r['obs_id'] % 5}" for r in own)


def test_null_curve_of_independent_features(spark):
    rng = np.random.default_rng(5)
    o = obs(spark, [(f"e{k % 20}", k, f, float(rng.normal())) for k in range(400) for f in "abc"])
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "feature string, k long")
    curve = {r["k"]: (r["mean"], r["high"]) for r in resample.pr_null_curve(o, order, 10).collect()}
    assert curve[1][0] == pytest.approx(1) and 1.5 < curve[2][0] <= 2 and curve[3][0] <= curve[3][1] <= 3


# -- correlation


def test_repair_leaves_no_negative_eigenvalue(spark):
    bad = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0), ("a", "b", 0.9), ("a", "c", -0.9), ("b", "c", 0.9)], "i string, j string, r double")
    names, m = spectrum.matrix(spectrum.repaired(bad), "r")
    assert names == ["a", "b", "c"] and np.linalg.eigvalsh(m)[0] > -1e-9 and np.allclose(np.diag(m), 1)
    good = bad.withColumn("r", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.1))
    assert np.allclose(spectrum.matrix(spectrum.repaired(good), "r")[1], spectrum.matrix(good, "r")[1])


def test_listwise_means(spark):
    means = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 3.0), ("2", "b", None), ("3", "a", 4.0)], "entity string, feature string, x double")
    assert {r["entity"] for r in spectrum.complete(means).collect()} == {"1"}


def test_more_features_than_allowed_raise(spark, monkeypatch):
    monkeypatch.setattr(spectrum, "MOST_FEATURES", 2)
    o = obs(spark, [("e", 1, f, 1.0) for f in "abc"])
    with pytest.raises(ValueError):
        spectrum.feature_names(o)


# -- classifiers


def test_classifiers_on_a_sample_of_training_rows(spark):
    """Fewer training rows than there are: every row is still predicted, and separate groups are still told apart."""
    rng = np.random.default_rng(6)
    rows = [(str(e), 40 * e + k, f, float(rng.normal(3 * e if f == "a" else -e, 0.3))) for e in range(4) for k in range(40) for f in "ab"]
    out = classify.run_folds(obs(spark, rows), 4, ("lda",), most_train=60)
    assert out.count() == 160 and classify.summary(out, 4).first()["acc_mean"] > 0.9


def test_training_scale_is_of_the_other_folds(spark):
    rows = spark.createDataFrame([(k % 3, float(k), None if k % 4 == 0 else 5.0) for k in range(12)], "fold long, a double, b double")
    for r in classify.training_scale(rows, ["a", "b"], 3).collect():
        a = np.array([k for k in range(12) if k % 3 != r["held"]], float)
        assert r["n"] == 8 and r["mean"][0] == pytest.approx(a.mean()) and r["sd"][0] == pytest.approx(a.std()) and list((r["mean"][1], r["sd"][1])) == [5.0, 1.0]


def test_presence_rate_of_training_rows_only(spark):
    rng = np.random.default_rng(7)
    rows = [(str(e), 20 * e + k, f, float(max(rng.normal(e, 1), 0))) for e in range(3) for k in range(20) for f in "az"]
    out = classify.run_folds(obs(spark, rows), 4, ("lda",), hurdle="z", presence="speaker_lookup")
    assert out.count() == 60
    assert classify.summary(out, 3).first()["acc_mean"] >= classify.summary(classify.run_folds(obs(spark, rows), 4, ("lda",), hurdle="z"), 3).first()["acc_mean"] - 0.05


def test_sweep_of_groups_is_each_group_alone(spark):
    rng = np.random.default_rng(8)
    o = obs(spark, [(f"e{e:02d}", 10 * e + k, f, float(rng.normal(e % 4, 1))) for e in range(12) for k in range(8) for f in "abc"])
    got = {r["size"]: r for r in sweep.measures(sweep.replicate(o, [4, 8], 8), k=3, kinds=("lda",)).collect()}
    for size in (4, 8):
        alone = resample.nested_subset(o, size, 24).drop("stratum")
        b = info.quantile_bins(alone, 5)
        mi = info.corrected(info.mutual_information(b, info.entity_count(alone)), info.exact_null(b, info.entity_count(alone))).agg(F.sum("i_corrected")).first()[0]
        assert got[size]["s"] == size and got[size]["summed_mi"] == pytest.approx(mi, abs=1e-6)
        fano = classify.summary(classify.run_folds(alone, 3, ("lda",)), size).first()["i_xent_mean"]
        assert got[size]["fano"] == pytest.approx(fano, abs=1e-6)


def test_analysis_within_strata(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{s}{e}", s, 100 * e + k + 10_000 * (s == "y"), f, float(rng.normal(e, 1))) for s in "xy" for e in range(4 if s == "x" else 6) for k in range(6) for f in "ab"]
    o = spark.createDataFrame(rows, "entity string, stratum string, obs_id long, feature string, x double")
    options = {"bins": (2,), "boot": 0, "null": 0, "kinds": ()}
    both = {(r["section"], r["item"]): r["value"] for r in analysis.within(o, **options).collect()}
    x, y = ({(r["section"], r["item"]): r["value"] for r in analysis.analyze(o.where(F.col("stratum") == s).drop("stratum"), **options).collect()} for s in "xy")
    assert both["pr_none", "pr"] == pytest.approx(0.4 * x["pr_none", "pr"] + 0.6 * y["pr_none", "pr"]) and both["mi_summed", "2"] == pytest.approx(0.4 * x["mi_summed", "2"] + 0.6 * y["mi_summed", "2"])


# -- intervals


def test_points_in_intervals_by_brute_force(spark):
    rng = np.random.default_rng(10)
    segs, points, spans = [], [], []
    for u in range(5):
        at = 0.0
        for k in range(rng.integers(0, 8)):
            end = at + float(rng.integers(1, 5))
            if rng.random() < 0.8:
                segs.append((u, k, at, end, f"s{k}"))
            at = end
        spans += [(u, float(a), float(a + rng.integers(1, 9))) for a in rng.integers(0, 20, 3)]
        points += [(u, float(v) / 2, i) for i, v in enumerate(rng.integers(-2, 60, 15))]
    p = spark.createDataFrame(points, "utt_id long, at double, i long")
    got = segments.interval_join(p, spark.createDataFrame(segs, "utt_id long, seq long, start double, end double, label string")).collect()
    assert len(got) == len(points) and all(r["label"] == next((x for u, _, a, b, x in segs if u == r["utt_id"] and a <= r["at"] < b), "") for r in got)
    inside = segments.in_any(p, spark.createDataFrame(spans, "utt_id long, start double, end double")).collect()
    assert len(inside) == len(points) and all(r["inside"] == any(u == r["utt_id"] and a <= r["at"] < b for u, a, b in spans) for r in inside)


# -- reports, manifests, sources


def test_reports_and_provenance(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([("pr", "x", 2.0), ("pr", "y", 5.0), ("mi", "x", None)], "section string, item string, value double")
    text = writers.report(d, "Title")
    assert text.startswith("# Title") and text.index("| y | 5 |") < text.index("| x | 2 |") and "## mi" in text
    (tmp_path / "a.bin").write_bytes(b"abc")
    rows = spark.createDataFrame([("e1", "g"), ("e1", "g"), ("e2", "h")], "entity string, stratum string")
    p = writers.provenance(spark, str(tmp_path), rows, "entity", "stratum")
    assert p["n"] == 3 and p["s"] == 2 and p["files"] == 1 and p["observations"] == {"1": 1, "2": 1} and p["by_stratum"] == {"g": 1, "h": 1}
    monkeypatch.setattr(writers, "MOST_COUNTS", 1)
    with pytest.raises(ValueError):
        writers.provenance(spark, str(tmp_path), rows, "entity", "stratum")


def test_archives_configuration_and_listing(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, raw in (("d/one.txt", b"1"), ("d/two.wav", b"22")):
            entry = tarfile.TarInfo(name)
            entry.size = len(raw)
            t.addfile(entry, io.BytesIO(raw))
    (tmp_path / "b.tar").write_bytes(b"broken")
    got = {r["name"]: r["content"] for r in readers.tar_members(spark, str(tmp_path), suffix=".wav").collect()}
    assert bytes(got["d/two.wav"]) == b"22" and len(got) == 2 and None in got.values()
    (tmp_path / "c.json").write_text('{"bins": [2, 3]}')
    assert readers.config(spark, str(tmp_path / "c.json")) == {"bins": [2, 3]}
    assert {r["name"] for r in readers.listing(spark, str(tmp_path), "*.tar*").collect()} == {"a.tar.gz", "b.tar"}
    counts, missing = select.missing_files(spark.createDataFrame([("a.tar.gz", "x"), ("z.tar", "x")], "name string, g string"), readers.listing(spark, str(tmp_path)), "name", "g")
    assert counts.first()["present"] == 1 and [r["name"] for r in missing.collect()] == ["z.tar"]


# -- command line and resumed sweeps


def test_a_sweep_is_gone_on_with(spark, tmp_path):
    rng = np.random.default_rng(11)
    o = obs(spark, [(f"e{e:02d}", 10 * e + k, f, float(rng.normal(e % 4, 1))) for e in range(12) for k in range(6) for f in "ab"])
    path = str(tmp_path / "points")
    assert sweep.add_points(o, [4, 8], path, 6, k=3, kinds=("lda",)) == [4, 8]
    assert sweep.add_points(o, [4, 8, 12], path, 6, k=3, kinds=("lda",)) == [12]
    whole = {r["size"]: r["pr"] for r in sweep.measures(sweep.replicate(o, [4, 8, 12], 6), k=3, kinds=("lda",)).collect()}
    assert {r["size"]: r["pr"] for r in spark.read.parquet(path).collect()} == pytest.approx(whole)
    assert math.isfinite(sweep.combined(spark, path).first()["pr"])


def test_command_line(spark, sf, tmp_path, capsys):
    from obsgrain.__main__ import main

    assert main(["query", "state_codes", sf, str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 2
    o = obs(spark, [(f"e{k % 4}", k, f, float(k % 4 + k % 3)) for k in range(24) for f in "ab"])
    o.write.parquet(str(tmp_path / "obs"))
    assert main(["report", str(tmp_path / "obs")]) == 0 and "## coverage" in capsys.readouterr().out
    spark.createDataFrame([(f"e{k % 5}", "s", k, 5.0) for k in range(40)], "entity string, stratum string, obs_id long, duration double").write.parquet(str(tmp_path / "sel"))
    assert main(["select", str(tmp_path / "sel"), str(tmp_path / "chosen"), "-n", "2", "-m", "3"]) == 0 and spark.read.parquet(str(tmp_path / "chosen")).count() == 6


# -- values of kernels


def test_spectral_values_by_a_plain_transform():
    """Each bin by its sums of sines and cosines, for a frame of noise."""
    x = np.random.default_rng(0).normal(size=600)
    p, f = kernels.power_spectrum(x, 16000, 400, 160)
    y = np.array([x[0], *(x[i] - 0.97 * x[i - 1] for i in range(1, 600))])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    for frame in (0, 1):
        part = y[frame * 160 : frame * 160 + 400] * w
        for k in (0, 1, 7, 100, 200):
            angle = 2 * np.pi * k * np.arange(400) / 400
            assert p[frame, k] == pytest.approx((part * np.cos(angle)).sum() ** 2 + (part * np.sin(angle)).sum() ** 2) and f[k] == k * 40
    s = kernels.spectral(x)
    q = p[1] / p[1].sum()
    mu = (q * f).sum()
    sd = np.sqrt((q * (f - mu) ** 2).sum())
    assert s["spectral_skewness"][1] == pytest.approx((q * (f - mu) ** 3).sum() / sd**3) and s["spectral_kurtosis"][1] == pytest.approx((q * (f - mu) ** 4).sum() / sd**4)
    assert s["spectral_flux"][1] == pytest.approx(np.linalg.norm(np.sqrt(p[1]) - np.sqrt(p[0]))) and np.isnan(s["spectral_flux"][0])
    assert s["alpha_ratio"][1] == pytest.approx(p[1][(f >= 1000) & (f < 5000)].sum() / p[1][(f >= 50) & (f < 1000)].sum()) and s["SPI"][1] == pytest.approx(p[1][f >= 4000].sum() / p[1][f < 4000].sum())


def test_burg_finds_the_poles_of_a_resonance():
    """Noise through a filter of three resonances of known frequencies and bandwidths."""
    want, a = [(700, 80), (1900, 120), (3100, 150)], np.array([1.0])
    for freq, width in want:
        r, angle = np.exp(-np.pi * width / 16000), 2 * np.pi * freq / 16000
        a = np.convolve(a, [1, -2 * r * np.cos(angle), r * r])
    noise, x = np.random.default_rng(0).normal(size=30_000), np.zeros(30_000)
    for t in range(6, 30_000):
        x[t] = noise[t] - a[1:] @ x[t - 6 : t][::-1]
    assert kernels.burg(x, 6) == pytest.approx(a, abs=0.05)
    found = kernels.poles(kernels.burg(x, 6), 16000)
    assert [f for f, _ in found] == pytest.approx([f for f, _ in want], rel=0.02) and [b for _, b in found] == pytest.approx([b for _, b in want], rel=0.3)


def test_known_formants_take_the_nearest_pole():
    widths, f5, b5 = kernels.match_formants([500.0, 1500.0, np.nan, 3500.0], [(480.0, 50.0), (520.0, 70.0), (1900.0, 90.0), (3490.0, 110.0), (4300.0, 130.0), (4800.0, 2000.0)], 5000.0)
    assert widths[0] in (50.0, 70.0) and np.isnan(widths[1]) and np.isnan(widths[2]) and widths[3] == 110.0 and (f5, b5) == (4300.0, 130.0)


@pytest.mark.parametrize("f0", [110.0, 180.0, 240.0])
def test_pitch_and_voice_quality_of_a_regular_voice(f0):
    t = np.arange(16000) / 16000
    x = 0.1 * sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 20))
    f = kernels.pitch(x, "F" if f0 > 150 else "M", 16000)
    jitter, shimmer = kernels.perturbation(x, f0, 16000)
    assert np.nanmedian(f) == pytest.approx(f0, rel=0.02) and 0 <= jitter < 0.02 and 0 <= shimmer < 0.05
    rough = x * np.repeat(np.random.default_rng(0).uniform(0.5, 1.5, 200), 80)
    assert kernels.perturbation(rough, f0, 16000)[1] > shimmer
    noise = np.random.default_rng(1).normal(0, 0.1, 16000)
    assert np.nanmean(kernels.cepstral_peak(x, 16000)) > np.nanmean(kernels.cepstral_peak(noise, 16000))


def test_hashed_null_deals_groups_measured_together_once(spark, monkeypatch):
    """Against plain Python, with rows missing in one feature and an id that two rows share."""
    dealt, ranked = [], ranks.ranked
    monkeypatch.setattr(info, "ranked", lambda df, *a, **k: dealt.append(df.count()) or ranked(df, *a, **k))
    rows = [(f"e{k % 3}", k, f, (k * 7 + j * 5) % 4) for k in range(60) for j, f in enumerate("abc") if f != "c" or k % 2]
    b = spark.createDataFrame(rows, "entity string, obs_id long, feature string, bin int")
    got = {r["feature"]: r["i_null"] for r in info.hashed_null(b, info.entity_count(b), 4).collect()}
    assert dealt == [60 + 30, 4 * (60 + 30)]
    for f in "abc":
        own, total = sorted((k, e, x) for e, k, g, x in rows if g == f), 0.0
        for p in range(4):
            order = sorted(own, key=lambda r: hashlib.md5(f"0:{p}:{r[0]}".encode()).hexdigest())
            both = collections.Counter((o[2], r[1]) for o, r in zip(order, own, strict=True))
            bins = collections.Counter(o[2] for o in order)
            total += math.log2(3) + sum(c * math.log2(c / bins[x]) for (x, _), c in both.items()) / len(own)
        assert got[f] == pytest.approx(total / 4, abs=1e-9)
    twice = b.unionByName(b.where("obs_id = 0"))
    assert {r["feature"] for r in info.hashed_null(twice, info.entity_count(b), 2).collect()} == set("abc") and dealt[2] == 61 + 30


def test_folds_are_fitted_on_all_rows_a_block_at_a_time(monkeypatch):
    assert inspect.signature(classify.run_folds).parameters["most_train"].default is None
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    x = rng.normal(0, 1, (500, 4)) + y[:, None]
    whole = [f(x, y, 3) for f in (classify.softmax_regression, classify.discriminant)]
    monkeypatch.setattr(classify, "BLOCK_CELLS", 100)
    for a, b in zip(whole, (classify.softmax_regression(x, y, 3), classify.discriminant(x, y, 3)), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    means = np.stack([x[y == k].mean(0) for k in range(3)])
    r = x - means[y]
    coef = np.linalg.solve(classify.shrunk_covariance(r / r.std(0)) * np.outer(r.std(0), r.std(0)), means.T)
    assert np.allclose(whole[1][:-1], coef)


def test_exact_null_lists_only_overlaps_that_weigh_something(spark):
    """Against the sum over all overlaps; 40,000 rows in two bins of half, one label on a half."""
    b = spark.range(40000).select((F.col("id") % 2).cast("string").alias("entity"), F.lit("f").alias("feature"), (F.col("id") % 4 > 1).cast("int").alias("bin"))
    n, half = 40000, 20000
    lf = math.lgamma
    want = 4 * math.fsum(m / n * math.log2(n * m / half**2) * math.exp(4 * lf(half + 1) - lf(n + 1) - 2 * lf(m + 1) - 2 * lf(half - m + 1)) for m in range(1, half + 1))
    assert info.exact_null(b, info.entity_count(b)).first()["i_null"] == pytest.approx(want, rel=1e-6)
    low, high = spark.range(1).select(*info.overlaps(*[F.lit(x).cast("long") for x in (half, half, n)])).first()
    assert 8500 < low < half // 2 < high < 11500


def test_only_the_folds_asked_for_are_fitted(spark):
    rows = [(f"e{k % 3}", k, f, float((k % 3) * (j + 1) + (k * 7 % 11) / 5)) for k in range(60) for j, f in enumerate("ab")]
    o = spark.createDataFrame(rows, "entity string, obs_id long, feature string, x double")
    every = classify.run_folds(o, 4, ("lda",), shuffled=True).where("fold = 2")
    one = classify.run_folds(o, 4, ("lda",), shuffled=True, only=(2,))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect())) and one.count() == 15


def plain_network(x, y, s, epochs):
    """The steps of classify.network as the formulas have them, by one process."""
    rng = np.random.default_rng(0)
    params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], 128)), np.zeros((1, 128)), rng.normal(0, np.sqrt(1 / 128), (128, s)), np.zeros((1, s))]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // 200)):
            a = np.maximum(x[pick] @ params[0] + params[1], 0)
            z = a @ params[2] + params[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - np.eye(s)[y[pick]]) / len(pick)
            h = (d @ params[2].T) * (a > 0)
            t += 1
            for k, g in enumerate([x[pick].T @ h + 1e-3 * params[0] / len(x), h.sum(0, keepdims=True), a.T @ d + 1e-3 * params[2] / len(x), d.sum(0, keepdims=True)]):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] -= 1e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return params


@pytest.mark.parametrize("n", [1, 3, 399, 5077])
def test_a_network_is_the_same_by_one_process_or_several(n):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(n, 5)), rng.integers(0, 7, n).astype(np.int32)
    one, two, plain = classify.network(x, y, 7, epochs=4), classify.network(x, y, 7, epochs=4, processes=2), plain_network(x, y, 7, 4)
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    assert all(a.shape == b.shape and np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(one, plain, strict=True))


def test_a_network_fails_when_a_process_of_it_does():
    def work(i, alive):
        if i:
            raise ValueError
        while True:
            alive()

    with pytest.raises(RuntimeError, match="ended early"):
        classify._together(work, 2)


def test_a_design_moves_one_row_an_observation(spark):
    o = obs(spark, [(str(k % 3), k, f, None if f == "b" and k % 2 else float(k)) for k in range(12) for f in "abc"])
    wide, names = classify.design(o)
    assert names == ["a", "b", "c"] and "pivot" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["obs_id"]: (r["entity"], r["a"], r["b"], r["c"]) for r in wide.collect()} == {k: (str(k % 3), k, None if k % 2 else k, k) for k in range(12)}
