"""Grades with their reasons, roles, routes, compounds and re-counts, case by case."""

import pytest
from pyspark.sql import functions as F

from helixloom.functions import evidence as E
from helixloom.operators import grading as G

c = F.col


def values(spark, columns, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(columns.alias("x")).collect()]


ROLES = [
    (["AR"], "het", "1", "carrier"),
    (["AR"], "hom", "1", "affected"),
    (["AR", "DG"], "het", "1", "carrier"),
    (["AD"], "het", "1", "possible"),
    (["AD"], "hom", "1", "possible"),
    (["AD", "AR"], "het", "1", "possible"),
    (["AD", "AR"], "hom", "1", "affected"),
    (["XLR"], "het", "X", "carrier"),
    (["XLR"], "hemi", "X", "affected"),
    (["XLR"], "het", "1", "unknown"),
    (["XLD"], "het", "X", "possible"),
    (["XLD"], "hemi", "X", "affected"),
    (["MT"], "hom", "MT", "unknown"),
    (["MF", "SP"], "hom", "1", "unknown"),
    ([], "het", "1", "unknown"),
    (None, "het", "1", "unknown"),
    (["AR"], None, None, "unknown"),
]


def test_roles(spark):
    assert values(spark, E.role(c("m"), c("z"), c("x")), "m array<string>, z string, x string, want string", ROLES) == [r[3] for r in ROLES]


EVIDENCE = [  # stars, class, popmax, af, flagged, validity, low penetrance -> level, reasons
    ((3, "pathogenic", 0.0001, None, False, "Definitive", False), 2, ["stars_3", "rare", "gene_supported"]),
    ((3, "pathogenic", 0.0001, None, False, "Disputed", False), 0, ["stars_3", "rare", "gene_disputed"]),
    ((3, "pathogenic", 0.0001, None, False, "Limited", True), 1, ["stars_3", "rare", "gene_limited", "low_penetrance"]),
    ((3, "pathogenic", None, None, None, None, None), 2, ["stars_3", "not_seen"]),
    ((3, "pathogenic", None, 0.002, False, None, False), 2, ["stars_3"]),
    ((2, "likely_pathogenic", 0.02, None, False, "Strong", False), 0, ["stars_2", "bs1_common", "gene_supported"]),
    ((4, "pathogenic", 0.06, None, False, None, False), 0, ["stars_4", "ba1_common"]),
    ((4, "pathogenic", 0.06, None, True, None, False), 2, ["stars_4", "frequency_flagged"]),  # a flagged frequency is unknown
    ((4, "drug_response", None, None, None, "Disputed", False), 1, ["stars_4", "drug_response_capped"]),
    ((4, "conflicting", None, None, None, None, False), 0, ["stars_4", "labs_disagree"]),
    ((None, "risk_factor", 0.3, None, False, None, False), 0, ["stars_0"]),
]


def test_evidence(spark):
    args = "stars int, cls string, popmax double, af double, flagged boolean, validity string, low boolean"
    df = spark.createDataFrame([x[0] for x in EVIDENCE], args).coalesce(1)
    shared = (c("popmax"), c("af"), c("flagged"))
    got = df.select(E.clinvar_level(c("stars"), c("cls"), *shared, c("validity")), F.concat(E.evidence_reasons(c("stars"), c("cls"), *shared), E.further_reasons(c("cls"), *shared, c("validity"), c("low")))).collect()
    assert [tuple(r) for r in got] == [(level, reasons) for _, level, reasons in EVIDENCE]


CALLS = [  # filter, gq, dp, vaf, zygosity, provider, truth -> level, reasons
    (("PASS", 40, 20, 0.5, "het", None, False), 3, ["strong_reads"]),
    (("PASS", 20, 10, 0.5, "het", "agree", False), 2, ["moderate_reads", "provider_agrees"]),
    (("PASS", 40, 20, 0.1, "het", "disagree", False), 1, ["strong_reads", "unbalanced_reads", "provider_disagrees"]),
    (("PASS", None, None, None, "het", None, False), 1, ["thin_reads"]),
    (("RefCall", 40, 20, 0.5, "het", None, True), 1, ["not_passed"]),
    (("PASS", 0, 0, None, "het", "disagree", True), 3, ["benchmark"]),
    ((None, 40, 20, 0.7, "hom", None, False), 2, ["strong_reads", "unbalanced_reads"]),
]


def test_calls(spark):
    names = ["f", "gq", "dp", "vaf", "z", "p", "t"]
    df = spark.createDataFrame([x[0] for x in CALLS], "f string, gq int, dp int, vaf double, z string, p string, t boolean").coalesce(1)
    got = df.select(E.call_level(*map(c, names)), E.call_reasons(*map(c, names))).collect()
    assert [tuple(r) for r in got] == [(level, reasons) for _, level, reasons in CALLS]


ROUTES = [
    ("drug_response", "carrier", True, True, "pgx", "drug_response"),
    ("pathogenic", "carrier", False, True, "traits", "association"),
    ("pathogenic", "carrier", True, False, "carrier", "carrier"),
    ("pathogenic", "affected", True, False, "health", "risk"),
    ("risk_factor", "unknown", False, False, "health", "risk"),
    ("conflicting", "possible", False, False, "health", "uncertain"),
    ("pathogenic", "common", False, False, "health", "uncertain"),
    ("predicted", "possible", False, False, "health", "predicted"),
    ("predicted", "carrier", False, False, "carrier", "carrier"),
    ("pathogenic", "possible", False, False, "health", "monogenic"),
]


def test_routes(spark):
    df = spark.createDataFrame(ROUTES, "cls string, role string, low boolean, blood boolean, a string, b string").coalesce(1)
    assert [tuple(r[0]) for r in df.select(G.route(c("cls"), c("role"), c("low"), c("blood"))).collect()] == [r[4:] for r in ROUTES]


def found(spark, rows):
    return spark.createDataFrame([(f"v{i}", *r) for i, r in enumerate(rows)], "claim_id string, gene string, section string, grp string, role string, cls string, rule string, consequence string, aa_change string, reportable boolean")


def test_compounds(spark):
    one = ("carrier", "carrier", "carrier")
    rows = [("A", *one, "likely_pathogenic", "Biallelic P and LP", "missense", None, False), ("A", *one, "conflicting", "Biallelic P and LP", "missense", None, False), ("B", *one, "conflicting", None, None, None, False), ("B", *one, "conflicting", None, None, None, False),
            ("C", *one, "pathogenic", None, None, None, False), (None, *one, "pathogenic", None, None, None, False), (None, *one, "pathogenic", None, None, None, False), ("A", "health", "monogenic", "possible", "pathogenic", "Biallelic P and LP", None, None, False)]
    got = {r["claim_id"]: (r["section"], r["grp"], r["role"], r["compound"], r["reportable"]) for r in G.compounds(found(spark, rows)).collect()}
    assert got["v0"] == ("health", "compound", "possible", "compound", True)  # two likely ones are severe, and both copies may be hit
    assert got["v1"] == ("health", "compound", "possible", "compound", False)
    assert got["v2"] == got["v3"] == (*one, "note", False)
    assert got["v4"] == got["v5"] == got["v6"] == (*one, None, False) and got["v7"][3] is None


@pytest.mark.parametrize("status,flags,call,want", [("disagrees", [], 3, "Low"), ("weak", [], 3, "Medium"), ("confirmed", ["one_strand"], 3, "Medium"), ("confirmed", [], 1, "Low"), ("confirmed", [], 3, "High"), ("disagrees", [], 0, "Not callable"), ("not_checkable", ["look_alike"], 3, "Medium"), (None, None, 3, "High")])
def test_recounts_lower_and_never_raise(spark, status, flags, call, want):
    claim = spark.createDataFrame([("f", "G", 7, "health", "x", 2, call, ["reads"])], "claim_id string, gene string, site_key long, section string, grp string, evidence int, call int, call_reasons array<string>")
    sites = spark.createDataFrame([(7 if status else 8, status, flags, "odd", ["gc"])], "site_key long, status string, flags array<string>, note string, difficult array<string>")
    genes = spark.createDataFrame([("G", "disagrees")], "gene string, status string")
    r = G.after_recount(claim, sites, genes).first()
    assert r["call_level"] == want and r["call_reasons"][0] == "reads"
    if status:
        assert r["call_reasons"][-1] == "difficult_region" and (status == "not_checkable") == ("recount_not_possible" in r["call_reasons"])


def test_results_of_medicines_take_their_worst_gene(spark):
    rows = [("a", "A, B", None, "pgx", "pgx_drug", 2, 3, []), ("b", "A", None, "pgx", "pgx_gene", 2, 3, []), ("c", "B", None, "health", "x", 2, 3, []), ("d", "Z", None, "pgx", "pgx_gene", 2, 3, [])]
    claims = spark.createDataFrame(rows, "claim_id string, gene string, site_key long, section string, grp string, evidence int, call int, call_reasons array<string>")
    sites = spark.createDataFrame([], "site_key long, status string, flags array<string>, note string, difficult array<string>")
    genes = spark.createDataFrame([("A", "confirmed"), ("B", "unclear")], "gene string, status string")
    got = {r["claim_id"]: (r["status"], r["call_level"]) for r in G.after_recount(claims, sites, genes).collect()}
    assert got == {"a": ("unclear", "Medium"), "b": ("confirmed", "High"), "c": (None, "High"), "d": (None, "High")}


def test_positions_whose_products_go_beyond_32_bits(spark, tmp_path):
    from pyspark.sql import functions as F

    from helixloom import plans

    folder = "/root/testdata/sf0.001"
    for name in ("part", "lineitem"):
        key = "p_partkey" if name == "part" else "l_partkey"
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.withColumn(key, F.col(key) + 1_170_000).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("full_findings", "full_compounds"):
        assert len(plans.QUERIES[name](spark, str(tmp_path)).collect()) > 0


def test_filters_on_classes_and_zygosity_stay_small_enough_to_be_compiled(spark):
    """The JVM never compiles a method of more than 8,000 bytes: a plan that copies a rule's cases into one ran ten times longer."""
    import contextlib
    import io
    import re

    from helixloom.plans import QUERIES

    text = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the final plan at once
    try:
        with contextlib.redirect_stdout(text):
            QUERIES["claims_from_annotations"](spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_rank_of_joined_terms(spark):
    rows = [("intron&stop_gained", 9), ("splice_region", 4), ("missense&start_lost", 8), ("unheard_of", 0), ("", 0), ("not_missense", 0), (None, None)]
    got = spark.createDataFrame(rows, "csq string, rank int").select("rank", E.consequence_rank(F.col("csq")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["rank"] for r in got]


def test_claims_hold_what_predictors_name_and_what_is_known_of_genes(spark):
    from helixloom.plans import QUERIES

    told = {r["cls"]: r["n"] for r in QUERIES["claims_from_annotations"](spark, "/root/testdata/sf0.001").groupBy("cls").agg(F.count("*").alias("n")).collect()}
    assert told["predicted"] > 100 and told["pathogenic"] > 0

    base = {"chrom_order": 0, "chrom": "1", "ref": "A", "alt": "G", "filter": "PASS", "zygosity": "het", "gq": 40, "dp": 30, "vaf": 0.5, "consequence": "missense", "gene": "D", "known_gene": None, "aa_change": None, "significance": None,
            "cls": "other", "conflicts": None, "stars": None, "popmax": None, "af_1kg": None, "flagged": None, "provider_genotype": None, "am": None, "revel": None, "loeuf": None, "low_penetrance": False, "blood_group": False}
    path = {"cls": "pathogenic", "significance": "Pathogenic", "stars": 3}
    rows = [
        {"revel": 0.95},  # predictors alone
        {"revel": 0.95, "gene": "N"},  # no disease is linked to the gene
        {"revel": 0.95, "filter": "RefCall"},
        {"revel": 0.95, "cls": "benign", "significance": "Benign"},  # labs have settled it
        {"consequence": "stop_gained", "gene": "R"},  # breaks a recessive gene
        {**path, "gene": "D"},  # disputed link
        {**path, "gene": None, "known_gene": "R"},  # the record's gene, recessive: a carrier
        {**path, "alt": "ATG", "provider_genotype": "AG", "gene": "X"},  # a provider's letter says nothing of an insertion
    ]
    schema = "chrom_order int, chrom string, ref string, alt string, filter string, zygosity string, gq int, dp int, vaf double, consequence string, gene string, known_gene string, aa_change string, significance string, cls string, conflicts string, stars int, popmax double, af_1kg double, flagged boolean, provider_genotype string, am double, revel double, loeuf double, low_penetrance boolean, blood_group boolean, pos int"
    a = spark.createDataFrame([tuple({**base, **r, "pos": i}[x.split()[0]] for x in schema.split(", ")) for i, r in enumerate(rows)], schema)
    genes = spark.createDataFrame([("D", "Disputed", ["AD"], None, True), ("R", "Strong", ["AR"], None, True), ("N", None, ["AR"], None, False)], "gene string, validity string, modes array<string>, rule string, disease_gene boolean")
    got = {r["claim_id"].split("-")[2]: r for r in G.claims(a, genes).collect()}
    assert sorted(got) == ["0", "4", "5", "6", "7"]
    assert [got[k]["cls"] for k in ("0", "4")] == ["predicted", "predicted"] and got["0"]["reasons"] == ["revel_strong", "not_seen", "prediction_only"]
    assert [got[k]["section"] for k in ("0", "4", "5", "6")] == ["health", "carrier", "health", "carrier"]
    assert [got[k]["evidence_level"] for k in ("0", "5", "6", "7")] == ["Limited", "Limited", "Strong", "Strong"]
    assert got["6"]["gene"] == "R" and got["7"]["call_confidence"] == "High"
