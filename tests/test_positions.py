"""Genotypes at positions: records and callable intervals across the edges of bins, and one shuffle of each side."""

import pytest

from helixloom.operators import positions as P

CASES = [  # position (pos, ref, alts, here, haploid), records (pos, ref, alt, filter, gt, gq), callable intervals -> gt, status
    ((2048, "AC", ["A"], "AC", False), [(2049, "C", "T", "PASS", "0/1", 40)], [], "./.", "other_variant"),  # from the last letter of a bin on
    ((2049, "A", ["G"], "A", False), [(2040, "ACGTACGTACGT", "A", "PASS", "0/1", 40)], [], "./.", "other_variant"),  # a record from the bin before
    ((2049, "A", ["G"], "A", False), [(2040, "ACGTACGTA", "A", "PASS", "0/1", 40)], [(0, 9000)], "0/0", "reference"),  # ends before it
    ((5000, "A", ["G"], "A", False), [], [(0, 3000), (2500, 5001)], "0/0", "reference"),
    ((5000, "A", ["G"], "A", False), [], [], "./.", "not_callable"),
    ((4096, "A", ["G"], "A", False), [], [(4095, 4096)], "0/0", "reference"),
    ((4097, "A", ["G"], "A", False), [], [(4095, 4096), (7, 7)], "./.", "not_callable"),
    ((100, "A", ["C", "G"], "A", False), [(100, "A", "C", "PASS", "0/1", 40), (100, "A", "G", "PASS", "0|1", 40)], [], "1/2", "variant"),
    ((100, "A", ["C"], "A", False), [(100, "A", "C", "RefCall", "0/0", 40)], [], "0/0", "reference"),
    ((100, "A", ["C"], "A", False), [(100, "A", "C", None, "1/1", 40)], [], "1/1", "variant"),
    ((100, "A", ["C"], "A", True), [(100, "A", "C", "PASS", "0/1", 40)], [], "./.", "het_haploid"),
    ((100, "A", ["C"], None, False), [(100, "A", "C", "PASS", "0/1", 40)], [], "./.", "no_reference"),
    ((100, "A", ["C"], "C", False), [(100, "A", "C", "PASS", "1/1", 40)], [], "1/1", "variant"),
    ((1000, "A" * 3000, ["A"], "A" * 3000, False), [(3999, "A", "C", "PASS", "0/1", 40)], [], "./.", "other_variant"),  # longer than a bin
]


def tables(spark):
    p = [(i, i, *x[0]) for i, x in enumerate(CASES)]
    v = [(i, *r) for i, x in enumerate(CASES) for r in x[1]]
    k = [(i, *r) for i, x in enumerate(CASES) for r in x[2]]
    return (
        spark.createDataFrame(p, "position_id long, chrom_order int, pos int, ref string, alts array<string>, here string, haploid boolean"),
        spark.createDataFrame(v, "chrom_order int, pos int, ref string, alt string, filter string, gt string, gq int"),
        spark.createDataFrame(k, "chrom_order int, start_pos int, end_pos int"),
    )


@pytest.mark.parametrize("longest", [None, 3000, 1_000_000])
def test_positions_at_the_edges_of_bins(spark, longest):
    got = {r["position_id"]: (r["gt"], r["status"]) for r in P.genotype_positions(*tables(spark), longest).collect()}
    assert got == {i: x[3:] for i, x in enumerate(CASES)}


def test_positions_without_records(spark):
    p, v, k = tables(spark)
    got = {r["status"] for r in P.genotype_positions(p, v.limit(0), k.limit(0)).collect()}
    assert got == {"not_callable", "no_reference"} and P.genotype_positions(p.limit(0), v, k).count() == 0


def test_each_side_is_read_and_shuffled_once(spark, tmp_path):
    """Positions read three times, and shuffled anew with each join, filled the disk."""
    read = []
    for name, df in zip(("positions", "records", "callable"), tables(spark)):
        df.write.parquet(f"{tmp_path}/{name}")
        read.append(spark.read.parquet(f"{tmp_path}/{name}"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = P.genotype_positions(*read, 3000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    assert sum("FileScan" in x and "position_id" in x for x in lines) == 1
    assert sum("FileScan" in x and "gt#" in x for x in lines) == 1
    assert not any("Exchange" in x and "position_id" in x for x in lines)


def test_a_written_projection_leaves_no_shuffles(spark):
    from helixloom.fixtures import Tables

    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before, was = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    t = Tables(spark, "/root/testdata/sf0.001").written("fx_variants")
    assert shuffled() <= before and t.fx_variants.count() > 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was
