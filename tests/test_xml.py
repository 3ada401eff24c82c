"""XML files, read in parallel and flattened."""

import pytest
from pyspark.sql import functions as F

from helixloom.sources import xml as X

AGES = """<?xml version="1.0" encoding="UTF-8"?>
<JDBOR><DisorderList count="3">
<Disorder id="1"><OrphaCode>58</OrphaCode><Name lang="en">Alexander disease</Name>
 <AverageAgeOfOnsetList count="2"><AverageAgeOfOnset id="9"><Name lang="en">Infancy</Name></AverageAgeOfOnset><AverageAgeOfOnset id="8"><Name lang="en">Adult</Name></AverageAgeOfOnset></AverageAgeOfOnsetList>
 <TypeOfInheritanceList count="2"><TypeOfInheritance><Name lang="en">Autosomal dominant</Name></TypeOfInheritance><TypeOfInheritance><Name lang="en">Unknown</Name></TypeOfInheritance></TypeOfInheritanceList></Disorder>
<Disorder id="2"><OrphaCode>61</OrphaCode><Name lang="en">Alpha-mannosidosis</Name><AverageAgeOfOnsetList count="0"/>
 <TypeOfInheritanceList count="1"><TypeOfInheritance><Name lang="en">Autosomal recessive</Name></TypeOfInheritance></TypeOfInheritanceList></Disorder>
<Disorder id="3"><Name lang="en">without a code</Name></Disorder>
</DisorderList></JDBOR>"""

PREVALENCE = """<JDBOR><DisorderList>
<Disorder><OrphaCode>58</OrphaCode><Name>Alexander disease</Name><PrevalenceList>
 <Prevalence><PrevalenceType><Name>Annual incidence</Name></PrevalenceType><PrevalenceClass><Name>1-9 / 1 000 000</Name></PrevalenceClass><PrevalenceGeographic><Name>Europe</Name></PrevalenceGeographic></Prevalence>
 <Prevalence><PrevalenceType><Name>Point prevalence</Name></PrevalenceType><PrevalenceClass><Name>Unknown</Name></PrevalenceClass><PrevalenceGeographic><Name>Worldwide</Name></PrevalenceGeographic></Prevalence>
 <Prevalence><PrevalenceType><Name>Point prevalence</Name></PrevalenceType><PrevalenceClass><Name>&lt;1 / 1 000 000</Name></PrevalenceClass><PrevalenceGeographic><Name>Japan</Name></PrevalenceGeographic></Prevalence>
 <Prevalence><PrevalenceType><Name>Point prevalence</Name></PrevalenceType></Prevalence></PrevalenceList></Disorder>
<Disorder><OrphaCode>99</OrphaCode><Name>Only here</Name><PrevalenceList/></Disorder>
</DisorderList></JDBOR>"""

GENES = """<JDBOR><DisorderList><Disorder><OrphaCode>58</OrphaCode><DisorderGeneAssociationList>
 <DisorderGeneAssociation><Gene id="1"><Name>glial</Name><Symbol>GFAP</Symbol></Gene><DisorderGeneAssociationType><Name>Disease-causing germline mutation(s) in</Name></DisorderGeneAssociationType><DisorderGeneAssociationStatus><Name>Assessed</Name></DisorderGeneAssociationStatus></DisorderGeneAssociation>
 <DisorderGeneAssociation><Gene><Symbol>OTHER</Symbol></Gene></DisorderGeneAssociation></DisorderGeneAssociationList></Disorder>
<Disorder><OrphaCode>61</OrphaCode></Disorder></DisorderList></JDBOR>"""

TEXTS = """<summaries xmlns:h="x"><gene-summary><gene-symbol> GFAP </gene-symbol><name>glial fibrillary acidic protein</name><ghr-page>https://a.b/gfap</ghr-page>
 <related-health-condition-list><related-health-condition><name>Alexander disease</name></related-health-condition><related-health-condition/></related-health-condition-list>
 <db-key-list><db-key><db>OMIM</db><key>137780</key></db-key><db-key><db>NCBI Gene</db><key>2670</key></db-key></db-key-list>
 <text-list><text><text-role>location</text-role><html>17q21</html></text><text><text-role>function</text-role><html><p>The gene   makes a
 <b>protein</b> &amp; more.</p><ul><li>one</li><li> </li><li>two</li></ul></html></text></text-list><reviewed>2020-01</reviewed></gene-summary>
<health-condition-summary><name>Alexander disease</name><text-list><text><text-role>description</text-role><html>no  paragraph</html></text></text-list></health-condition-summary></summaries>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    for name, text in {"ages": AGES, "prevalence": PREVALENCE, "genes": GENES, "texts": TEXTS}.items():
        (d / f"{name}.xml").write_text(text)
    return d


def test_rare_diseases(spark, folder):
    ages, prevalence = X.elements(spark, f"{folder}/ages.xml", "Disorder", X.AGES), X.elements(spark, f"{folder}/prevalence.xml", "Disorder", X.PREVALENCE)
    got = {r["disease_id"]: r for r in X.rare_diseases(ages, prevalence).collect()}
    assert set(got) == {"ORPHA:58", "ORPHA:61", "ORPHA:99"}
    a = got["ORPHA:58"]
    assert (a["name"], a["onset"], a["inheritance"], a["modes"]) == ("Alexander disease", ["Infancy", "Adult"], ["Autosomal dominant", "Unknown"], ["AD"])
    assert a["prevalence"] == "<1 / 1 000 000 (point prevalence, Japan)"
    assert (got["ORPHA:61"]["modes"], got["ORPHA:61"]["onset"], got["ORPHA:61"]["prevalence"]) == (["AR"], [], None)
    assert got["ORPHA:99"]["prevalence"] is None and got["ORPHA:99"]["modes"] == []


def test_gene_links(spark, folder):
    got = sorted(map(tuple, X.gene_links(X.elements(spark, f"{folder}/genes.xml", "Disorder", X.GENES)).collect()))
    assert got == [("GFAP", "ORPHA:58", "Disease-causing germline mutation(s) in", "Assessed"), ("OTHER", "ORPHA:58", None, None)]


def test_texts(spark, folder):
    g = X.gene_texts(X.elements(spark, f"{folder}/texts.xml", "gene-summary", X.GENE_SUMMARY)).first()
    assert (g["gene"], g["ncbi_id"], g["conditions"], g["reviewed"]) == ("GFAP", "2670", ["Alexander disease"], "2020-01")
    assert g["function"] == "The gene makes a protein & more.\none\ntwo"
    c = X.condition_texts(X.elements(spark, f"{folder}/texts.xml", "health-condition-summary", X.CONDITION_SUMMARY)).first()
    assert (c["name"], c["description"], c["url"]) == ("Alexander disease", "no paragraph", "")


def test_texts_in_a_column(spark):
    df = spark.createDataFrame([("<Disorder><OrphaCode>5</OrphaCode><Name>N</Name></Disorder>",), ("not xml",), (None,)], "value string")
    assert [r["disease_id"] for r in X.ages(X.parsed(df, "value", X.AGES)).collect()] == ["ORPHA:5"]
    assert spark.range(1).select(X.flat(F.lit(None).cast("string"))).first()[0] == ""
