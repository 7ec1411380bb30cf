"""Utterance features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsgrain.operators import extract


def voice(seconds=1.0, f0=120.0, rate=16000):
    t = np.arange(int(seconds * rate)) / rate
    return 0.1 * sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 25))


def test_a_voiced_utterance_has_its_features():
    x = np.concatenate([np.zeros(1600), voice(), np.random.default_rng(0).normal(0, 0.05, 4000), np.zeros(1600)])
    n = len(x)
    got = extract.features(x, [(0, 1600, "h#"), (1600, 9600, "aa"), (9600, 10000, "tcl"), (10000, 10400, "t"), (10400, 17600, "iy"), (17600, n - 1600, "s"), (n - 1600, n, "h#")])
    assert list(got) == list(extract.FEATURES) and len(got) == 40
    assert got["F0"][0] == pytest.approx(120, rel=0.02) and got["VFI"][0] == 0 and got["SSPF"][1] > 10
    assert got["speech_rate"][0] == pytest.approx(2 / ((n - 3200) / 16000)) and got["VOT"] == (400 / 16000, 1) and got["BGD"][1] == 1
    assert np.isfinite([got[k][0] for k in ("jitter", "CPP", "GNE", "RMS", "F1", "Nasality", "AMD")]).all()


def test_silence_has_none():
    got = extract.features(np.zeros(32000), [(0, 32000, "h#")])
    assert all(np.isnan(v) for k, (v, _) in got.items()) and got["BGD"][1] == 0


def test_unvoiced_noise_has_no_voice_features():
    got = extract.features(np.random.default_rng(1).normal(0, 0.05, 32000), [(0, 32000, "s")])
    assert np.isnan(got["F0"][0]) and np.isfinite(got["RMS"][0]) and np.isfinite(got["SSPF"][0])


def test_quality():
    q = extract.quality(np.concatenate([np.full(3200, 0.001), voice(0.5)]), [(0, 3200, "h#"), (3200, 11200, "aa")])
    assert q["snr_db"] > 30 and q["clip_pct"] == 0 and q["bandwidth_hz"] > 100
    assert extract.quality(np.ones(640), [])["clip_pct"] == 100


def test_extract_reports_failures(spark):
    d = spark.createDataFrame([(1, voice(0.3).tolist(), "M", [(0, 4800, "aa")]), (2, None, "F", [])], "utt_id long, samples array<double>, sex string, phones array<struct<start:long,end:long,label:string>>")
    out = {r["utt_id"]: r for r in extract.extract(d).collect()}
    assert out[1]["error"] is None and out[1]["F0"] == pytest.approx(120, rel=0.02) and out[1]["cov_F0"] > 5
    assert out[2]["F0"] is None and out[2]["cov_F0"] == 0


def test_voiced_utterances_always_have_a_share_of_creak():
    """Too few voiced frames for a mean: the share is 0 with their number as coverage; without any it is missing."""
    x = np.concatenate([voice(0.05), np.random.default_rng(0).normal(0, 0.05, 16000)])
    got = extract.features(x, [(0, 800, "aa"), (800, len(x), "s")])
    assert got["VFI"][0] == 0 and 0 < got["VFI"][1] < extract.LEAST
    assert np.isnan(extract.features(x, [(0, len(x), "s")])["VFI"][0])


def test_formants_and_creak_from_outside(spark):
    x = voice(0.4)
    frames = 1 + (len(x) - 400) // 160
    rows = [(k, x.tolist(), "M", [(0, len(x), "aa")], [[600.0, 1200.0, None, 3500.0]] * frames if k else None, [(0.1, 0.2)] if k else None) for k in (0, 1)]
    d = spark.createDataFrame(rows, "utt_id long, samples array<double>, sex string, phones array<struct<start:long,end:long,label:string>>, formants array<array<double>>, creak array<struct<start:double,end:double>>")
    out = {r["utt_id"]: r for r in extract.extract(d).collect()}
    assert out[1]["error"] is None and out[1]["F1"] == 600 and out[1]["F2"] == 1200 and out[1]["F3"] is None and 0.15 < out[1]["VFI"] < 0.4
    assert out[0]["VFI"] == 0 and out[0]["F1"] != 600
    q = extract.recording_quality(d).collect()
    assert len(q) == 2 and all(r["clip_pct"] == 0 and r["bandwidth_hz"] > 100 for r in q)
    assert extract.recording_quality(d.withColumn("samples", F.lit(None).cast("array<double>"))).first()["snr_db"] is None


def test_utterances_of_one_file_are_dealt_over_tasks(spark, sf):
    from obsgrain.plans import data_queries
    from obsgrain.plans.tables import signals

    n = signals(spark, sf).count()
    d = data_queries._utterances(spark, sf)
    assert d.rdd.getNumPartitions() == -(-n // data_queries._TASK_UTTERANCES) > 1
    assert d.select("utt_id").distinct().count() == n
