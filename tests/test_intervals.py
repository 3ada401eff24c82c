"""Interval joins, merges and depth runs against brute force, with intervals of any length and bins of any width."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.operators import genotype as G
from helixloom.operators import intervals as I

CUT = 64


def spans(seed, n, far=400_000):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([0, 1, 5, 60, 1000, 20_000, 150_000]) + rng.randrange(3)
        s = rng.randrange(far) if rng.random() < 0.8 else CUT * rng.randrange(200)
        out.append((rng.randrange(2), s, s + size, k))
    return out


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("longest", [None, 10**9])
def test_points(spark, how, longest):
    rng = random.Random(1)
    ivs = spans(2, 120)
    pts = [(rng.randrange(2), p) for s in ivs[:40] for p in (s[1], s[1] + 1, s[2], s[2] + 1)] + [(0, 5), (0, 5)]
    p, i = spark.createDataFrame(pts, "chrom int, pos int"), spark.createDataFrame(ivs, "chrom int, s int, e int, id int")
    got = I.points_in(p, i, ["chrom"], "pos", "s", "e", how, width=CUT, longest=longest)
    hits = {x: [v[3] for v in ivs if v[0] == x[0] and v[1] < x[1] <= v[2]] for x in pts}
    if how in ("left_semi", "left_anti"):
        assert sorted(map(tuple, got.collect())) == sorted(x for x in pts if bool(hits[x]) == (how == "left_semi"))
    else:
        want = [(*x, v) for x in pts for v in hits[x] or ([None] if how == "left" else [])]
        assert sorted(((r["chrom"], r["pos"], r["id"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("longest", [None, 10**9])
def test_overlapping_pairs(spark, longest):
    a, b = spans(3, 90), spans(4, 90)
    x, y = spark.createDataFrame(a, "chrom int, s int, e int, id int"), spark.createDataFrame(b, "chrom int, s2 int, e2 int, id2 int")
    got = [(r["id"], r["id2"]) for r in I.overlaps(x, y, ["chrom"], ("s", "e"), ("s2", "e2"), width=CUT, longest=longest).collect()]
    assert sorted(got) == sorted((v[3], w[3]) for v in a for w in b if v[0] == w[0] and v[1] < w[2] and w[1] < v[2])


def test_short_intervals_copy_no_point_and_long_ones_are_copied_a_few_times(spark):
    one = spark.createDataFrame([(1, 0, 250_000_000)], "chrom int, s int, e int")
    pts = spark.createDataFrame([(1, 77)], "chrom int, pos int")
    assert I.highest(10) == 0 and I.highest(I.WIDTH * I.FACTOR + 1) == 1
    top = I.highest(250_000_000)
    filed = one.withColumn("level", I._level(I.F.lit(250_000_000), I.WIDTH)).withColumn("bin", I._touched(I.F.col("s"), I.F.col("e"), I._width(I.F.col("level"), I.WIDTH)))
    assert filed.count() <= I.FACTOR + 1 and 0 < top < I.LEVELS
    assert I.points_in(pts, one, ["chrom"], "pos", "s", "e").count() == 1


@pytest.mark.parametrize("width", [CUT, 5000, 64 * I.WIDTH])
def test_merge(spark, width):
    rows = [r for r in spans(5, 200) if width > CUT or r[2] - r[1] < 2000]
    got = sorted(map(tuple, I.merge(spark.createDataFrame(rows, "chrom int, s int, e int, id int"), ["chrom"], "s", "e", width).collect()))
    want = []
    for c, s, e, _ in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((c, s, e))
    assert got == want


@pytest.mark.parametrize("width", [CUT, 777, 64 * I.WIDTH])
def test_depth_runs(spark, width):
    rng = random.Random(6)
    rows = [(rng.randrange(2), s, s + rng.randrange(0, 90)) for s in [rng.choice([rng.randrange(900), CUT * rng.randrange(14), 5000 + rng.randrange(200)]) for _ in range(120)]]
    got = sorted((r["chrom"], r["start_pos"], r["end_pos"], r["cls"]) for r in I.depth_runs(spark.createDataFrame(rows, "chrom int, s int, e int"), ["chrom"], "s", "e", (1, 3, 6), width).collect())
    want = []
    for c in (0, 1):
        mine = [(s, e) for k, s, e in rows if k == c and s < e]
        for p in range(min(s for s, _ in mine), max(e for _, e in mine)):
            cls = sum(sum(s <= p < e for s, e in mine) >= b for b in (1, 3, 6))
            if want and want[-1][0] == c and want[-1][3] == cls and want[-1][2] == p:
                want[-1] = (c, want[-1][1], p + 1, cls)
            else:
                want.append((c, p, p + 1, cls))
    assert got == sorted(want)


SITES = [  # site, calls, state of the place -> genotype
    ((1, 100, "A", "G"), [], "CALLABLE", "0/0"),
    ((1, 100, "A", "G"), [], "HIGH", "./."),  # only callable counts
    ((1, 100, "A", "G"), [], None, "./."),
    ((1, 100, "A", "G"), [(100, "A", "G", "PASS", "0/1", 30)], None, "0/1"),
    ((1, 100, "A", "G"), [(100, "A", "G", "PASS", "1|0", 20)], None, "0/1"),
    ((1, 100, "A", "G"), [(100, "A", "G", "PASS", "1/1", 19)], "CALLABLE", "./."),
    ((1, 100, "A", "G"), [(100, "A", "G", "LowQual", "1/1", 50)], "CALLABLE", "./."),
    ((1, 100, "A", "G"), [(100, "A", "G", "PASS", "0/1", 30), (100, "A", "T", "PASS", "0/1", 30)], "CALLABLE", "./."),  # two alleles
    ((1, 100, "A", "G"), [(100, "A", "T", "PASS", "0/1", 30)], "CALLABLE", "./."),  # another allele
    ((1, 100, "A", "G"), [(100, "A", "T", "NoCall", "./.", 3)], "CALLABLE", "./."),
    ((1, 100, "A", "G"), [(100, "A", "T", "RefCall", "0/0", 25)], None, "0/0"),
    ((1, 100, "A", "G"), [(100, "A", "T", "RefCall", "0/0", 19)], None, "./."),
    ((1, 100, "A", "G"), [(97, "CTTA", "C", "PASS", "0/1", 50)], "CALLABLE", "./."),  # last letter of one's own deletion
    ((1, 100, "A", "G"), [(97, "CTT", "C", "PASS", "0/1", 50)], "CALLABLE", "0/0"),  # just behind one
    ((1, 100, "A", "G"), [(97, "CTTA", "C", "PASS", "0/0", 50)], "CALLABLE", "0/0"),  # not carried
    ((1, 100, "A", "G"), [(99, "TA", "GC", "PASS", "0/1", 50)], "CALLABLE", "./."),  # hidden in a change of two letters
    ((1, 100, "A", "G"), [(98, "TA", "GC", "PASS", "0/1", 50)], "CALLABLE", "0/0"),
    ((1, 100, "AC", "A"), [(126, "C", "CT", "PASS", "0/1", 50)], "CALLABLE", "./."),  # another indel 25 letters off
    ((1, 100, "AC", "A"), [(127, "C", "CT", "PASS", "0/1", 50)], "CALLABLE", "0/0"),
    ((1, 100, "A", "G"), [(101, "C", "CT", "PASS", "0/1", 50)], "CALLABLE", "0/0"),  # single letters do not mind indels nearby
    ((1, 100, "AC", "A"), [(100, "AC", "A", "PASS", "0/1", 50)], None, "0/1"),
    ((22, 100, "A", "G"), [(100, "A", "G", "PASS", "0/1", 30)], None, "./."),  # not an autosome
    ((1, 200_000, "A", "G"), [(100, "A" * 150_000 + "C", "A", "PASS", "0/1", 50)], "CALLABLE", "0/0"),  # behind a long deletion
    ((1, 140_000, "A", "G"), [(100, "A" * 150_000 + "C", "A", "PASS", "0/1", 50)], "CALLABLE", "./."),  # inside it
]


def test_genotypes_at_sites(spark):
    """Each case has a person of its own; here they are told apart by the chromosome's place in the list."""
    got = []
    variants = "chrom_order int, pos int, ref string, alt string, filter string, gt string, gq int"
    for (chrom, pos, ref, alt), calls, state, _ in SITES:
        v = spark.createDataFrame([(chrom, *x) for x in calls], variants)
        i = spark.createDataFrame([(chrom, pos - 1, pos, state)] if state else [], "chrom_order int, start_pos int, end_pos int, state string")
        got.append(G.genotype_sites(spark.createDataFrame([(chrom, pos, ref, alt)], "chrom_order int, pos int, ref string, alt string"), v, i).first()["gt"])
    assert got == [x[3] for x in SITES]


def test_a_gene_of_many_exons_and_calls(spark):
    from helixloom.operators.copies import copy_events

    n = 60_000
    at = F.col("id") * 100
    exons = spark.range(n).select(F.lit("G").alias("gene"), at.cast("int").alias("start_pos"), (at + 80).cast("int").alias("end_pos"), F.lit("DEL").alias("kind"))
    breaks = spark.range(n).select(F.lit("G").alias("gene"), (at - 50).cast("int").alias("start_pos"), (at + 120).cast("int").alias("end_pos"), F.lit("DEL").alias("kind"))
    runs = spark.createDataFrame([("G", 10, 20, "DEL", 1), ("G", 10, 20, "DUP", 1), ("G", 100 * n + 500, 100 * n + 600, "DEL", 1)], "gene string, start_pos int, end_pos int, kind string, exons long")
    events = copy_events(breaks, runs, exons)
    assert "bin" in events._jdf.queryExecution().optimizedPlan().toString()  # no join on the gene alone
    got = {(r["breakpoint"], r["exons"]): r["count"] for r in events.groupBy("breakpoint", "exons").count().collect()}
    assert got == {(True, 3): n - 2, (True, 2): 2, (False, 1): 2}


def test_callable_intervals_are_merged_before_sites_meet_them(spark):
    sites = spark.createDataFrame([(1, 50, "A", "G"), (1, 900, "A", "G")], "chrom_order int, pos int, ref string, alt string")
    none = spark.createDataFrame([], "chrom_order int, pos int, ref string, alt string, filter string, gt string, gq int")
    spans = spark.range(5000).select(F.lit(1).alias("chrom_order"), (F.col("id") % 40).cast("int").alias("start_pos"), F.lit(100).alias("end_pos"), F.lit("CALLABLE").alias("state"))
    out = G.genotype_sites(sites, none, spans)
    assert "_island" in out._jdf.queryExecution().analyzed().toString()
    assert {(r["pos"], r["gt"]) for r in out.collect()} == {(50, "0/0"), (900, "./.")}


@pytest.mark.parametrize("reach,width", [(10, CUT), (100, 16), (10, I.WIDTH)])
def test_nearest_other(spark, reach, width):
    rng = random.Random(8)
    rows = [(rng.choice([0, 1, None]), rng.choice([rng.randrange(3000), CUT * rng.randrange(40), None]), rng.choice([True, False, False, None])) for _ in range(500)]
    got = I.nearest_other(spark.createDataFrame(rows, "chrom int, pos int, yes boolean"), F.col("yes"), ["chrom"], "pos", reach, width)
    marked = {x[:2] for x in rows if x[2] and None not in x}
    near = lambda c, p: [abs(q - p) for d, q in marked if p is not None and d == c and abs(q - p) <= reach]
    want = {(c, p, min([g for g in near(c, p) if g], default=None), int((c, p) in marked)) for c, p, _ in rows}
    found = [(r["chrom"], r["pos"], r["nearest"], r["at_point"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_nearest_pass_variant_joins_nothing(spark):
    from helixloom.plans import QUERIES

    plan = QUERIES["nearest_pass_variant"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
