"""Rules of highlights over tables that are there, and over none."""

import pytest
from pyspark.sql import functions as F

from helixloom.operators import highlights as H


def test_no_tables(spark):
    assert H.highlighted(spark, {}).count() == 0
    assert H.highlighted(spark, {"variants": spark.range(3)}).count() == 0


def test_missing_columns_are_null_and_null_flags_false(spark):
    claims = spark.createDataFrame([(1, "a", "carrier", None, "G"), (1, "b", "traits", "x", "G")], "person long, claim_id string, section string, grp string, gene string")
    got = H.highlighted(spark, {"claims": claims}).collect()
    assert [(r["kind"], r["ref_key"], r["sensitive"], r["rank"], r["title"]) for r in got] == [("carrier", "a", False, 1, "G")]
    hla = spark.createDataFrame([(1, "x", None), (1, "y", True), (1, "z", False)], "person long, association_id string, notable boolean")
    assert [r["ref_key"] for r in H.highlighted(spark, {"hla_associations": hla}).collect()] == ["y"]


def test_a_gene_counts_medicines_of_two_sources_only(spark):
    genes = spark.createDataFrame([(1, "G", "Poor", "poor"), (2, "G", "Poor", "poor"), (1, "N", "Normal", "normal")], "person long, gene string, phenotype string, phenotype_class string")
    drugs = spark.createDataFrame(
        [(1, "a", "CPIC", "change", True, ["G", "N"]), (1, "a", "DPWG", "change", True, ["G"]), (1, "b", "FDA", "change", True, ["G"]), (1, "c", "CPIC", "note", True, ["G"]), (1, "d", "CPIC", "change", False, ["G"]), (1, "e", "DPWG", "change", True, ["G"])],
        "person long, drug string, source string, tier string, matched boolean, genes array<string>",
    )
    got = {r["person"]: r["notable_because"] for r in H.highlighted(spark, {"pgx_genes": genes, "pgx_drugs": drugs}).collect()}
    assert got == {1: "Poor, medicines to change: 2", 2: "Poor"}
    assert {r["notable_because"] for r in H.highlighted(spark, {"pgx_genes": genes}).collect()} == {"Poor"}


@pytest.mark.parametrize("p,words", [(0.2, "below the 1st"), (1.0, "the 1st"), (2.4, "the 2nd"), (3.0, "the 3rd"), (4.9, "the 5th"), (11.2, "the 11th"), (13.0, "the 13th"), (95.0, "the 95th"), (97.6, "the 98th"), (99.6, "above the 99th")])
def test_places(spark, p, words):
    assert spark.range(1).select(H.percentile_place(F.lit(p)).alias("w")).first()["w"] == words + " percentile"


def test_ranks_within_a_person(spark):
    claims = spark.createDataFrame([(1, "a", "carrier", "", "B", "Limited"), (1, "b", "health", "monogenic", "A", "Limited"), (1, "c", "carrier", "", "A", "Strong"), (2, "d", "carrier", "", "A", None)], "person long, claim_id string, section string, grp string, gene string, overall string")
    cnv = spark.createDataFrame([(1, "e", ["X", "Y"], "possible_loss", "Limited"), (1, "f", None, "common", "Strong")], "person long, event_id string, genes array<string>, status string, overall string")
    got = {r["ref_key"]: r["rank"] for r in H.highlighted(spark, {"claims": claims, "cnv_events": cnv}).collect()}
    assert got == {"c": 1, "b": 2, "e": 3, "a": 4, "d": 1}
