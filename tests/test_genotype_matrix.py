"""Principal components and LD pruning against NumPy and a walk through the sites one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.operators import components as C
from helixloom.operators import pruning as L


def matrix(seed, people, sites, lost=0.02):
    """Dosages with a few clines, so that components stand out; NaN where missing."""
    rng = np.random.default_rng(seed)
    place = rng.standard_normal((people, 3)) * [0.25, 0.12, 0.06]
    p = np.clip(rng.uniform(0.1, 0.9, sites) + place @ rng.standard_normal((3, sites)), 0.02, 0.98)
    d = rng.binomial(2, p).astype(float)
    d[rng.random(d.shape) < lost] = np.nan
    d[:, 3] = 0  # no variation
    d[: people // 2, 5] = np.nan  # often missing
    return d


def frame(spark, d, name="site_id long, sample long, dosage int", ids=None):
    rows = [(int(s), int(ids[i] if ids else i), None if np.isnan(d[i, s]) else int(d[i, s])) for i in range(len(d)) for s in range(d.shape[1])]
    return spark.createDataFrame(rows, name).repartition(5)


def by_numpy(d, k, need=None):
    mean = np.nanmean(d, 0)
    kept = (np.isnan(d).mean(0) < 0.05) & (np.minimum(mean / 2, 1 - mean / 2) > 0.01)
    if need is not None:
        kept &= ~np.isnan(d[need])
    a, mu = d[:, kept], mean[kept]
    z = (np.where(np.isnan(a), mu, a) - mu) / np.sqrt(mu * (1 - mu / 2))
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    return u[:, :k] * s[:k], s[:k] ** 2, z, kept


def pcs_of(df, people, k):
    out = np.full((people, k), np.nan)
    for r in df.collect():
        out[r["sample"], r["axis"] - 1] = r["pc"]
    return out


@pytest.mark.parametrize("most_gram", [C.MOST_GRAM, 10])
def test_components(spark, most_gram):
    d, k = matrix(1, 40, 300), 3
    found = C.principal_components(frame(spark, d), k, most_gram=most_gram)
    want, variances, z, kept = by_numpy(d, k)
    got = pcs_of(found.people, 40, k)
    assert found.sites == kept.sum() and np.allclose(found.variances, variances, rtol=1e-4)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-2 if most_gram == 10 else 1e-6)
    inner = got.T @ got
    assert np.allclose(inner, np.diag(variances), atol=1e-3 * variances[0])  # orthogonal, scaled
    assert (got[np.argmax(np.abs(got), axis=0), np.arange(k)] > 0).all()


def test_whole_matrix_is_rebuilt_from_all_axes(spark):
    d = matrix(2, 15, 120)
    found = C.principal_components(frame(spark, d), 15)
    _, _, z, kept = by_numpy(d, 15)
    pcs = pcs_of(found.people, 15, len(found.variances))
    loads = {r["site_id"]: np.array(r["loading"]) for r in found.loadings.collect()}
    v = np.stack([loads[s] for s in np.flatnonzero(kept)])
    assert np.allclose(v.T @ v, np.eye(len(found.variances)), atol=1e-8) and np.allclose(pcs @ v.T, z, atol=1e-8)


def test_people_projected_on_their_own_panel_stand_where_they_stood(spark):
    d = matrix(3, 20, 200)
    cohort = frame(spark, d)
    found = C.principal_components(cohort, 4)
    assert np.allclose(pcs_of(C.project(cohort, found.loadings), 20, 4), pcs_of(found.people, 20, 4), atol=1e-8)


def test_region_with_a_person(spark):
    d = matrix(4, 30, 200, lost=0.01)
    panel = frame(spark, d[:-1])
    me = spark.createDataFrame([(s, None if np.isnan(x) else int(x)) for s, x in enumerate(d[-1])], "site_id long, dosage int")
    found = C.region_components(panel, me, 3)
    want, _, _, kept = by_numpy(d, 3, need=-1)
    got = {(r["sample"], r["axis"]): r["pc"] for r in found.people.collect()}
    assert found.sites == kept.sum()
    assert np.allclose(np.abs([[got[(i if i < 29 else -1, a)] for a in (1, 2, 3)] for i in range(30)]), np.abs(want), atol=1e-6)


def test_components_of_odd_panels(spark):
    none = spark.createDataFrame([], "site_id long, sample long, dosage int")
    assert C.principal_components(none).people.count() == 0
    flat = spark.createDataFrame([(1, i, 1) for i in range(4)] + [(None, 1, 2), (2, None, 1)], "site_id long, sample long, dosage int")
    assert C.principal_components(flat).variances == [] or max(C.principal_components(flat).variances) < 1e-9


def one_by_one(d, pos, window, num, den):
    kept = []
    for i in range(d.shape[1]):
        ok = True
        for j in kept:
            if i - j < window:
                both = ~np.isnan(d[:, i]) & ~np.isnan(d[:, j])
                x, y, n = d[both, i], d[both, j], both.sum()
                cov = n * (x @ y) - x.sum() * y.sum()
                ok &= not den * cov**2 > num * (n * (x @ x) - x.sum() ** 2) * (n * (y @ y) - y.sum() ** 2)
        if ok:
            kept.append(i)
    return kept


def linked(seed, people, sites):
    """Runs of sites that resemble the one before them."""
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 3, (people, sites)).astype(float)
    for s in range(1, sites):
        same = rng.random(people) < 0.8
        d[same, s] = d[same, s - 1]
    d[rng.random(d.shape) < 0.03] = np.nan
    return d


@pytest.mark.parametrize("window,num,den,parts", [(7, 1, 5, 1), (7, 1, 5, 6), (16, 1, 20, 3), (500, 1, 10, 4), (2, 1, 3, 2)])
def test_pruning(spark, window, num, den, parts):
    chroms = {1: linked(5, 25, 130), 2: linked(6, 25, 41)}
    rows = [(1000 * c + s, c, 10 * s + c, i, None if np.isnan(d[i, s]) else int(d[i, s])) for c, d in chroms.items() for s in range(d.shape[1]) for i in range(25)]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1, 1, 1), (7, None, 1, 1, 1)], "site_id long, chrom_order int, pos int, sample long, dosage int").repartition(parts)
    got = {(r["chrom_order"], r["site_id"] % 1000): r["kept"] for r in L.ld_prune(df, window, num, den).collect()}
    for c, d in chroms.items():
        assert [s for s in range(d.shape[1]) if got[(c, s)]] == one_by_one(d, None, window, num, den)


def test_pruning_leaves_out_ranges(spark):
    d = linked(7, 10, 30)
    df = spark.createDataFrame([(s, 1, 10 * s, i, None if np.isnan(d[i, s]) else int(d[i, s])) for s in range(30) for i in range(10)], "site_id long, chrom_order int, pos int, sample long, dosage int")
    ranges = spark.createDataFrame([(1, 50, 120), (2, 0, 900)], "chrom_order int, start_pos int, end_pos int")
    left = [s for s in range(30) if not 50 < 10 * s <= 120]
    got = {r["site_id"]: r["kept"] for r in L.ld_prune(df, 8, 1, 5, ranges).collect()}
    assert sorted(got) == left and [s for s in left if got[s]] == [left[i] for i in one_by_one(d[:, left], None, 8, 1, 5)]
    assert L.ld_prune(df.filter(F.lit(False))).count() == 0


def test_thinning_takes_few_rounds(spark, monkeypatch):
    from helixloom.operators import pruning as L

    rng = np.random.default_rng(8)
    d = rng.integers(0, 3, (600, 12))
    df = spark.createDataFrame([(s, 1, 10 * s, p, int(d[s, p])) for s in range(600) for p in range(12)], "site_id long, chrom_order int, pos int, sample int, dosage int")
    rounds, plain = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: (rounds.append(name), plain(df, name))[1])
    got = {r["site_id"] for r in L.ld_prune(df, 6, 1, 4).filter("kept").collect()}
    stays = []
    for s in range(600):
        near = [k for k in stays if k > s - 6]
        if not L.correlated(d[[s]], d[near], 1, 4).any() if near else True:
            stays.append(s)
    assert got == set(stays)
    assert rounds.count("decided") <= 3


def test_parts_of_a_cohort_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 100)
    df = spark.createDataFrame([(s, p, (s + p) % 3) for s in range(90) for p in range(10)], "site_id long, sample int, dosage int")
    plan = C._once(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [site_id" in plan and plan.rstrip().count(", 9") >= 1
    assert C.principal_components(df, 2).sites == 90
