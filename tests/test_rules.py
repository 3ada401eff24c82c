"""Rules on a few rows each."""

import pytest
from pyspark.sql import functions as F

from helixloom.functions import alleles as A
from helixloom.functions import evidence as E
from helixloom.functions import reads as R
from helixloom.operators import intervals as I


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("gt,zyg", [("0/1", "het"), ("0|1", "het"), ("1/1", "hom"), ("0/0", "ref"), ("1", "hemi"), ("./1", "nocall"), ("./.", "nocall"), ("1/2", "het")])
def test_zygosity(spark, gt, zyg):
    assert one(spark, A.zygosity(F.col("g")), g=gt) == zyg


@pytest.mark.parametrize("ref,alt,want", [("CA", "C", (11, "A", "")), ("A", "ATG", (11, "", "TG")), ("CTG", "CAG", (11, "T", "A")), ("A", "G", (10, "A", "G"))])
def test_trim(spark, ref, alt, want):
    assert tuple(one(spark, A.trim_alleles(F.lit(10), F.col("r"), F.col("a")), r=ref, a=alt)) == want


def test_fisher(spark):
    p = one(spark, R.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=8, b=2, c=1, d=5)
    assert abs(p - 0.034965) < 1e-5


def test_flagged_frequency_is_unknown(spark):
    assert one(spark, E.is_rare(F.col("p"), F.lit(None).cast("double"), F.lit(True)), p=0.0001) is False
    assert one(spark, E.is_rare(F.col("p"), F.lit(None).cast("double"), F.lit(None).cast("boolean")), p=0.0001) is True


@pytest.mark.parametrize("gq,dp,vaf,zyg,level", [(40, 20, 0.5, "het", 3), (40, 20, 0.1, "het", 2), (25, 12, 0.5, "het", 2), (5, 3, 0.5, "het", 1), (40, 20, 0.5, "hom", 2)])
def test_call_level(spark, gq, dp, vaf, zyg, level):
    c = F.col
    assert one(spark, E.call_level(F.lit("PASS"), c("gq"), c("dp"), c("vaf"), c("z"), F.lit(None).cast("string")), gq=gq, dp=dp, vaf=vaf, z=zyg) == level


def test_point_at_interval_edges(spark):
    points = spark.createDataFrame([(1, 100), (1, 101), (1, 200), (1, 201)], "c int, pos int")
    spans = spark.createDataFrame([(1, 100, 200)], "c int, s int, e int")
    assert sorted(r["pos"] for r in I.points_in(points, spans, ["c"], "pos", "s", "e", width=64).collect()) == [101, 200]


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 21, 30), (2, 5, 6)], "c int, s int, e int")
    assert sorted(map(tuple, I.merge(df, ["c"], "s", "e").select("c", "s", "e").collect())) == [(1, 0, 20), (1, 21, 30), (2, 5, 6)]


def test_strand_test_takes_one_step_a_table(spark):
    from math import comb

    def exact(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        ways = [comb(r, x) * comb(n - r, k - x) for x in range(max(0, k - (n - r)), min(r, k) + 1)]
        here = comb(r, a) * comb(n - r, k - a)
        return sum(w for w in ways if w <= here) / sum(ways)

    tables = [(8, 2, 1, 5), (0, 6, 6, 0), (6, 0, 0, 6), (3, 3, 3, 3), (0, 0, 4, 5), (30, 0, 1, 29), (400, 600, 500, 500), (5, 2000, 9, 1500), (0, 0, 0, 0)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int").select("*", R.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p"))
    for r in df.collect():
        assert abs(r["p"] - exact(r["a"], r["b"], r["c"], r["d"])) < 1e-9
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("ln(") <= 4  # a factorial each took nine a table
