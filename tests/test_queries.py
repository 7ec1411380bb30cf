"""Every query with an oracle, against DuckDB on the smallest tables."""

import collections
import hashlib
import math
import os

import duckdb
import pytest

from obsgrain.operators import info, resample
from obsgrain.plans import catalogue
from obsgrain.plans.tables import obs_d

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows, columns):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, bool):
            return str(int(x))
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_duckdb(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def gaps(sf, tmp_path_factory):
    """Documents without a language, an id, a text or letters, and some that share an id."""
    d = tmp_path_factory.mktemp("gaps")
    c = duckdb.connect()
    c.execute(
        "COPY (SELECT CASE doc_id WHEN 77 THEN NULL WHEN 20 THEN 10 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 41 = 3 THEN NULL WHEN doc_id % 43 = 5 THEN '' ELSE text END AS text, CASE doc_id WHEN 10 THEN 'en' WHEN 20 THEN 'en' ELSE CASE WHEN doc_id % 23 <> 4 THEN lang END END AS lang, "
        f"source, CASE WHEN doc_id % 41 <> 3 THEN n_chars END AS n_chars FROM '{sf}/documents.parquet') TO '{d}/documents.parquet' (FORMAT parquet)"
    )
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    return c, str(d)


def _same_with_gaps(spark, gaps, name):
    c, d = gaps
    got, want = catalogue.QUERIES[name](spark, d), c.sql(catalogue.ORACLE_SQL[name])
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", "fisher_components fisher_table_long hurdle_cov speaker_means pairwise_cov participation_ratio pr_exclude pr_incremental pr_option_b".split())
def test_missing_language_or_id_is_no_entity(spark, gaps, name):
    _same_with_gaps(spark, gaps, name)


@pytest.mark.parametrize("name", ["fstar_null", "pr_bootstrap", "pr_null"])
def test_what_has_no_id_is_dealt_last_and_shared_ids_count(spark, gaps, name):
    _same_with_gaps(spark, gaps, name)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_permutation_null_of_all_features(spark, sf):
    obs = obs_d(spark, sf)
    got = {r["feature"]: r["i_null"] for r in info.hashed_null(info.quantile_bins(obs, 5), info.entity_count(obs), 40).collect()}
    s, rows = info.entity_count(obs).first()["s"], collections.defaultdict(list)
    for r in info.quantile_bins(obs, 5).collect():
        rows[r["feature"]].append((r["obs_id"], r["entity"], r["bin"]))
    assert set(got) == set(rows) == {r[0] for r in obs.select("feature").distinct().collect()} and len(got) == 27
    for feature, cells_ in rows.items():
        labels, total = [e for _, e, _ in sorted(cells_)], 0.0
        for p in range(40):
            dealt = sorted((hashlib.md5(f"0:{p}:{i}".encode()).hexdigest(), i, b) for i, _, b in cells_)
            both, bins = collections.Counter((b, e) for (_, _, b), e in zip(dealt, labels, strict=True)), collections.Counter(b for _, _, b in dealt)
            total += math.log2(s) + sum(c * math.log2(c / bins[b]) for (b, _), c in both.items()) / len(labels)
        assert got[feature] == pytest.approx(total / 40, abs=2e-6), feature


def test_sampled_null_is_the_permutations_one(spark, sf):
    """200 draws for every feature; their mean lies within a few standard errors of the exact expectation."""
    got = {r["feature"]: r["i_null"] for r in catalogue.QUERIES["mi_permutation_null"](spark, sf).collect()}
    want = {r["feature"]: r["i_null"] for r in catalogue.QUERIES["mi_exact_null"](spark, sf).collect()}
    assert set(got) == set(want) and len(got) == 27
    assert all(got[f] == pytest.approx(want[f], abs=0.03) for f in got)


def test_analysis_has_what_the_single_queries_have(spark, sf):
    found = {(r["section"], r["item"]): r["value"] for r in catalogue.QUERIES["analysis_block"](spark, sf).collect()}
    one = lambda name, column: catalogue.QUERIES[name](spark, sf).first()[column]
    assert found["pr_C", "pr"] == pytest.approx(one("pr_option_c", "pr")) and found["pr_B", "pr"] == pytest.approx(one("pr_option_b", "pr")) and found["pr_none", "pr"] == pytest.approx(one("pr_exclude", "pr"))
    assert found["pr_C", "boot_mean"] == pytest.approx(one("pr_bootstrap", "mean"), abs=1e-3) and found["pr_null", "mean"] == pytest.approx(one("pr_null", "mean"), abs=1e-3)
    f = {r["feature"]: r["f_star"] for r in catalogue.QUERIES["fisher_components"](spark, sf).collect()}
    assert all(found["fisher", k] == pytest.approx(v, abs=1e-5) for k, v in f.items() if k != "z" and v is not None)
    assert found["mi_presence", "z"] == pytest.approx(one("presence_mi", "i_corrected")) and {"2", "3", "5", "10"} == {i for s, i in found if s == "mi_summed"}
    s = info.entity_count(obs_d(spark, sf)).first()["s"]
    assert found["size", "s"] == s and found["size", "ceiling"] == pytest.approx(math.log2(s), abs=1e-5)
    assert found["fano_best", "i_xent"] == pytest.approx(max(found[f"fano_{k}", "i_xent_mean"] for k in ("logreg", "lda", "mlp"))) and ("fano_null", "acc_mean") in found
    assert len([1 for s, _ in found if s == "pr_curve"]) == found["pr_C", "p"]


def test_replicates_as_in_the_reference(spark, sf, monkeypatch):
    monkeypatch.setattr(resample, "interval", lambda replicates: replicates)
    assert catalogue.QUERIES["pr_null"](spark, sf).count() == 200 and catalogue.QUERIES["pr_bootstrap"](spark, sf).count() == 1000
