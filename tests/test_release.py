"""Releases written to a folder, and the risk kernels' identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.functions import risk as K
from helixloom.operators import release as L


def test_publish_open_and_query(spark, tmp_path):
    a = spark.createDataFrame([(2, "x", 0.5), (1, None, 0.25), (1, None, 0.25)], "pos int, name string, af_all double")
    b = spark.createDataFrame([("k", 1)], "key string, n int")
    path = str(tmp_path / "rel")
    assert L.releases(spark, path).count() == 0
    first = L.publish_release({"a": a, "b": b}, path, {"a": ["pos"]})
    assert first["id"] == "r0001" and first["previous"] is None
    assert L.publish_release({"a": a.repartition(3), "b": b}, path) is None  # the same rows in another order
    second = L.publish_release({"a": a, "b": b.union(b)}, path)
    assert second["previous"] == "r0001"
    now, old = L.open_release(spark, path), L.open_release(spark, path, "r0001")
    assert (now["b"].count(), old["b"].count(), now["a"].count()) == (2, 1, 3)
    L.open_release(spark, path)
    assert [r["n"] for r in L.query(spark, "SELECT count(*) AS n FROM a;").collect()] == [3]
    assert L.query(spark, "SELECT pos FROM a", 2).count() == 2
    with pytest.raises(ValueError):
        L.query(spark, "DROP VIEW a")
    with pytest.raises(ValueError):
        L.open_release(spark, path, "r0009")
    assert L.release_row(now["b"], "key", "k").count() == 1 and L.release_row(now["b"], "key", "no").count() == 0


def test_public_copies(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.1, "me"), (1, 2, 0.2, "me"), (2, 3, 0.3, "you")], "chrom int, pos int, af_x double, who string")
    public = L.export_public(df, ("who",), "chrom", 2)
    assert dict(public.dtypes) == {"chrom": "int", "pos": "int", "af_x": "float", "part": "int"}
    assert {r["chrom"]: r["part"] for r in public.collect()} == {0: 0, 1: 0, 2: 1}
    with pytest.raises(ValueError):
        L.write_public({"v": public}, str(tmp_path / "p"), truth_set=False, forbidden=[])
    with pytest.raises(ValueError):
        L.write_public({"v": df}, str(tmp_path / "p"), truth_set=True, forbidden=["me"])
    assert not (tmp_path / "p").exists()
    L.write_public({"v": public}, str(tmp_path / "p"), truth_set=True, forbidden=["me"])
    assert spark.read.parquet(str(tmp_path / "p/v")).count() == 3


@pytest.mark.parametrize("hazard", [False, True])
def test_mean_risk_is_the_baseline(hazard):
    effect, baseline = np.array([1.1, 1.5, 2.5, 0.7]), np.array([0.01, 0.1, 0.3, 0.05])
    a = K.solved(effect, baseline, hazard)
    z = np.random.default_rng(1).normal(size=400_000)
    line = np.log(effect)[:, None] * z
    risk = 1 - np.exp(-a[:, None] * np.exp(line)) if hazard else 1 / (1 + np.exp(-(a[:, None] + line)))
    assert np.allclose(risk.mean(axis=1), baseline, rtol=0.01)


def test_risk_from_curve_averages_to_the_baseline(spark):
    rows = [(float(z),) for z in np.random.default_rng(2).normal(size=4000)]
    df = spark.createDataFrame(rows, "z double")
    mean = df.select(F.avg(K.from_auroc(F.col("z"), F.lit(0.65), F.lit(0.1))).alias("m")).first()["m"]
    assert abs(mean - 0.1) < 0.005
    q = spark.range(1).select(K.inverse_normal(F.lit(0.975)).alias("a"), K.inverse_normal(F.lit(0.001)).alias("b")).first()
    assert abs(q["a"] - 1.959963985) < 1e-7 and abs(q["b"] + 3.090232306) < 1e-7


def test_digest_of_more_rows_than_a_long_sum_holds(spark):
    from helixloom.operators.changes import digest

    half = 9_500_000
    a, b, whole = (digest(spark.range(lo, hi)).first() for lo, hi in ((0, half), (half, 2 * half), (0, 2 * half)))
    assert whole["n_rows"] == 2 * half and whole["digest"] == (a["digest"] + b["digest"]) % (1 << 63) and a["digest"] + b["digest"] > 1 << 63
