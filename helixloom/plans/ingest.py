"""Readers of knowledge files over lines that are written from the given tables; the SQL gives what each line says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import knowledge as S
from .matching import read
from .registry import query

T = "chr(9)"


def _line(*parts: str) -> str:
    return f" || {T} || ".join(parts)


_REVIEW = "CASE case_id % 6 WHEN 0 THEN 'practice_guideline' WHEN 1 THEN 'reviewed_by_expert_panel' WHEN 2 THEN 'criteria_provided,_multiple_submitters,_no_conflicts' WHEN 3 THEN 'criteria_provided,_single_submitter' WHEN 4 THEN 'no_assertion_provided' ELSE '.' END"
_SIG = "CASE case_id % 8 WHEN 0 THEN 'Pathogenic|low_penetrance' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Conflicting_classifications_of_pathogenicity' WHEN 3 THEN 'Likely_benign' WHEN 4 THEN 'VUS-high' WHEN 5 THEN 'Affects' WHEN 6 THEN '.' ELSE 'protective' END"
CLINICAL = "SELECT " + _line("'chr' || CASE WHEN case_id % 24 = 0 THEN 'M' ELSE CAST(1 + case_id % 24 AS STRING) END", "CAST(case_id * 10 AS STRING)", "CAST(case_id AS STRING)", "'A'", "CASE WHEN case_id % 13 = 0 THEN '.' ELSE 'G' END", _SIG, _REVIEW, "CASE WHEN case_id % 3 = 0 THEN '.' ELSE 'Some_disease|Other_one' END", "CASE case_id % 3 WHEN 0 THEN '.' WHEN 1 THEN 'AB1:12' ELSE 'AB1:12|CD2:7' END", "CASE case_id % 3 WHEN 0 THEN '.' WHEN 1 THEN 'SO:1|missense_variant,SO:2|missense_variant' ELSE 'SO:1|intron_variant,SO:3|nonsense' END", "'MONDO:MONDO:1'") + " AS value FROM fx_cases UNION ALL SELECT '#comment' AS value FROM region"


@query("ingest_clinical_variants", f"""WITH v AS (SELECT case_id, CASE WHEN case_id % 24 = 0 THEN 'MT' ELSE CAST(1 + case_id % 24 AS VARCHAR) END AS chrom FROM fx_cases WHERE case_id % 13 <> 0)
 SELECT chrom, (CASE WHEN chrom = 'MT' THEN 24 WHEN chrom IN ('23', '24') THEN 99 ELSE chrom::INT - 1 END)::INT AS chrom_order, (case_id * 10)::INT AS pos, 'A' AS ref, 'G' AS alt, case_id AS variation_id, CASE WHEN case_id % 8 = 6 THEN NULL ELSE {_SIG} END AS significance,
 ['pathogenic', 'likely_pathogenic', 'conflicting', 'likely_benign', 'uncertain', 'association', 'other', 'protective'][case_id % 8 + 1] AS cls, case_id % 8 = 0 AS low_penetrance, [4, 3, 2, 1, 0, 0][case_id % 6 + 1] AS stars, CASE case_id % 3 WHEN 1 THEN ['AB1'] WHEN 2 THEN ['AB1', 'CD2'] END AS genes,
 CASE case_id % 3 WHEN 1 THEN ['missense_variant'] WHEN 2 THEN ['intron_variant', 'nonsense'] END AS consequences, CASE WHEN case_id % 3 <> 0 THEN 'Some disease|Other one' END AS conditions, 'MONDO:MONDO:1' AS condition_ids FROM v""")
def _(t):
    return S.clinical_variants(read(t, CLINICAL))


SUBS = "SELECT " + _line("CAST(case_id AS STRING)", "CASE case_id % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'drug response' ELSE 'not provided' END", "CASE case_id % 4 WHEN 0 THEN 'Mar 07, 2024' WHEN 1 THEN '-' WHEN 2 THEN 'odd' ELSE 'Dec 31, 2019' END", "CASE case_id % 3 WHEN 0 THEN 'C1:Some name;C2:Other' WHEN 1 THEN 'na:Third: piece; :' ELSE '' END", "CASE WHEN case_id % 2 = 0 THEN 'yes' ELSE 'no' END") + " AS value FROM fx_cases"


@query("ingest_submissions", """SELECT case_id AS variation_id, ['Pathogenic', 'Likely pathogenic', 'drug response', 'not provided'][case_id % 4 + 1] AS significance, ['pathogenic', 'likely_pathogenic', 'drug_response', 'other'][case_id % 4 + 1] AS cls, CASE case_id % 4 WHEN 0 THEN DATE '2024-03-07' WHEN 3 THEN DATE '2019-12-31' END AS evaluated,
 CASE case_id % 3 WHEN 0 THEN ['Some name', 'Other'] WHEN 1 THEN ['Third: piece'] ELSE [] END AS conditions, case_id % 2 = 0 AS contributes FROM fx_cases""")
def _(t):
    return S.submissions(read(t, SUBS))


FREQ = "SELECT " + _line("CAST(1 + case_id % 20 AS STRING)", "CAST(case_id AS STRING)", "'C'", "CASE case_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'T,G' ELSE 'A,<DEL>' END", "CASE case_id % 3 WHEN 0 THEN '0.25' WHEN 1 THEN '0.5,x' ELSE '0.125,0.75' END") + " AS value FROM fx_cases"


@query("ingest_allele_frequencies", "SELECT CAST(1 + case_id % 20 AS VARCHAR) AS chrom, case_id::INT AS pos, 'C' AS ref, CASE case_id % 3 WHEN 2 THEN 'A' ELSE 'T' END AS alt, CASE case_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.125 END::DOUBLE AS af FROM fx_cases UNION ALL SELECT CAST(1 + case_id % 20 AS VARCHAR), case_id, 'C', 'G', NULL FROM fx_cases WHERE case_id % 3 = 1")
def _(t):
    return S.allele_frequencies(read(t, FREQ))


SV = "SELECT " + _line("'chr' || CAST(1 + case_id % 20 AS STRING)", "CAST(case_id * 100 AS STRING)", "CAST(case_id * 100 + 50 AS STRING)", "'sv' || CAST(case_id AS STRING)", "CASE case_id % 6 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INS' WHEN 3 THEN 'CNV' WHEN 4 THEN 'BND' ELSE 'MCNV' END", "CASE WHEN case_id % 7 = 0 THEN 'NA' ELSE '0.5' END", "'0.25'", "CASE WHEN case_id % 2 = 0 THEN 'NA' ELSE 'AB1,CD2' END") + " AS value FROM fx_cases"


@query("ingest_structural_frequencies", "SELECT CAST(1 + case_id % 20 AS VARCHAR) AS chrom, case_id * 100 AS start_pos, case_id * 100 + 50 AS end_pos, 'sv' || case_id AS name, ['DEL', 'DUP', '', 'CNV', '', 'MCNV'][case_id % 6 + 1] AS svtype, CASE WHEN case_id % 7 <> 0 THEN 0.5 END::DOUBLE AS af, 0.25::DOUBLE AS popmax_af, CASE WHEN case_id % 2 = 1 THEN 'AB1,CD2' END AS genes FROM fx_cases WHERE case_id % 6 NOT IN (2, 4)")
def _(t):
    return S.structural_frequencies(read(t, SV))


MISSENSE = "SELECT " + _line("'chr' || CAST(1 + case_id % 5 AS STRING)", "CAST(case_id % 60 AS STRING)", "'A'", "'C'", "'p' || CAST(case_id AS STRING)", "CASE WHEN case_id % 9 = 0 THEN '.' ELSE CAST(case_id % 17 AS STRING) || '.5' END") + " AS value FROM fx_cases"


@query("ingest_missense_scores", "SELECT CAST(1 + case_id % 5 AS VARCHAR) AS chrom, (case_id % 60)::INT AS pos, 'A' AS ref, 'C' AS alt, max(case_id % 17 + 0.5)::DOUBLE AS score, arg_max('p' || case_id, {'s': case_id % 17, 'p': 'p' || case_id}) AS protein FROM fx_cases WHERE case_id % 9 <> 0 GROUP BY 1, 2")
def _(t):
    return S.missense_scores(read(t, MISSENSE))


CONSTRAINT = "SELECT " + _line("'G' || CAST(case_id % 50 AS STRING)", "'T' || CAST(case_id AS STRING)", "CASE WHEN case_id % 3 = 0 THEN 'true' ELSE 'false' END", "CASE WHEN case_id % 2 = 0 THEN 'true' ELSE 'false' END", "CASE WHEN case_id % 5 = 0 THEN 'NA' ELSE '0.' || CAST(case_id % 10 AS STRING) || '5' END", "CASE WHEN case_id % 7 = 0 THEN '' ELSE '1' END") + " AS value FROM fx_cases"


@query("ingest_gene_constraint", """WITH x AS (SELECT 'G' || (case_id % 50) AS gene, 'T' || case_id AS tx, {'a': (case_id % 3 = 0)::INT * 2 + (case_id % 2 = 0)::INT, 'b': 'T' || case_id} AS o, CASE WHEN case_id % 5 <> 0 THEN ((case_id % 10) * 10 + 5) / 100 END AS loeuf, CASE WHEN case_id % 7 <> 0 THEN 1 END AS pli FROM fx_cases WHERE case_id % 3 = 0 OR case_id % 2 = 0)
 SELECT gene, arg_max(tx, o) AS transcript, arg_max(loeuf, o)::DOUBLE AS loeuf, arg_max(pli, o)::DOUBLE AS pli FROM x GROUP BY 1""")
def _(t):
    return S.gene_constraint(read(t, CONSTRAINT))


HPO = "SELECT " + _line("'OMIM:' || CAST(case_id % 70 AS STRING)", "'disease'", "CASE case_id % 5 WHEN 0 THEN 'HP:0000006' WHEN 1 THEN 'HP:0000007' WHEN 2 THEN 'HP:0001419' WHEN 3 THEN 'HP:0001427' ELSE 'HP:0009999' END", "CASE WHEN case_id % 3 = 0 THEN 'P' ELSE 'I' END") + " AS value FROM fx_cases"


@query("ingest_disease_modes", "SELECT 'OMIM:' || (case_id % 70) AS disease_id, coalesce(list_sort(list(DISTINCT ['AD', 'AR', 'XLR', 'MT', ''][case_id % 5 + 1]) FILTER (case_id % 3 <> 0 AND case_id % 5 <> 4)), []) AS modes FROM fx_cases GROUP BY 1")
def _(t):
    return S.disease_modes(read(t, HPO))


OBO = "SELECT CASE WHEN case_id % 5 = 0 THEN '[Typedef]' ELSE '[Term]' END || chr(10) || 'id: MONDO:' || CAST(case_id AS STRING) || chr(10) || 'name: term ' || CAST(case_id AS STRING) || chr(10) || CASE WHEN case_id % 3 = 0 THEN 'def: \"A text.\" [x]' || chr(10) ELSE '' END || 'xref: OMIM:' || CAST(case_id % 9 AS STRING) || ' (source)' || chr(10) || 'xref: OTHER:1' || chr(10) || 'xref: ORPHA:' || CAST(case_id % 4 AS STRING) || CASE WHEN case_id % 7 = 0 THEN chr(10) || 'is_obsolete: true' ELSE '' END AS value FROM fx_cases"


@query("ingest_ontology_terms", "SELECT 'MONDO:' || case_id AS id, 'term ' || case_id AS name, CASE WHEN case_id % 3 = 0 THEN 'A text.' ELSE '' END AS definition, ['OMIM:' || (case_id % 9), 'ORPHA:' || (case_id % 4)] AS xrefs FROM fx_cases WHERE case_id % 5 <> 0 AND case_id % 7 <> 0")
def _(t):
    return S.ontology_terms(read(t, OBO))


GENES = "SELECT " + _line("CAST(case_id AS STRING)", "CASE WHEN case_id % 4 = 0 THEN '-' ELSE 'OFF' || CAST(case_id AS STRING) END", "'SYM' || CAST(case_id AS STRING)") + " AS value FROM fx_cases"
SUMMARIES = "SELECT " + _line("CAST(case_id - case_id % 3 AS STRING)", "CASE case_id % 3 WHEN 0 THEN 'Alliance' WHEN 1 THEN 'OMIM' ELSE 'RefSeq' END", "'<p>About ' || CAST(case_id AS STRING) || '</p>'") + " AS value FROM fx_cases WHERE case_id % 5 <> 4"


@query("ingest_gene_summaries", "WITH s AS (SELECT case_id - case_id % 3 AS id, arg_min(case_id, 2 - case_id % 3) AS best FROM fx_cases WHERE case_id % 5 <> 4 GROUP BY 1) SELECT CASE WHEN case_id % 4 = 0 THEN 'SYM' ELSE 'OFF' END || case_id AS gene, coalesce('About ' || best, '') AS summary, ['Alliance', 'OMIM', 'RefSeq'][best % 3 + 1] AS source FROM fx_cases LEFT JOIN s ON s.id = case_id")
def _(t):
    return S.gene_summaries(read(t, GENES), read(t, SUMMARIES))


GWAS = "SELECT " + _line("'rs' || CAST(o_custkey % 90 AS STRING)", "'trait' || CAST(o_custkey % 3 AS STRING)", "'rs1-' || CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN '?' ELSE 'G' END", "CASE WHEN o_orderkey % 11 = 0 THEN 'NR' ELSE CAST(o_orderkey % 40 AS STRING) END", "'1.' || CAST(o_orderkey % 7 AS STRING)", "'GCST' || CAST(o_orderkey AS STRING)", "CAST(o_orderkey % 8 AS STRING)") + " AS value FROM orders"
FEATURED = "SELECT DISTINCT 'rs' || CAST(o_custkey % 90 AS STRING) AS rsid, 'trait' || CAST(o_custkey % 3 AS STRING) AS trait FROM orders WHERE o_custkey % 90 < 50"


@query("featured_associations", """WITH a AS (SELECT 'rs' || (o_custkey % 90) AS rsid, 'trait' || (o_custkey % 3) AS trait, ['A', '?', 'G'][o_orderkey % 3 + 1] AS allele, o_orderkey % 40 AS p, (10 + o_orderkey % 7) / 10 AS ob, 'GCST' || o_orderkey AS study, (o_orderkey % 8)::VARCHAR AS pmid FROM orders WHERE o_custkey % 90 < 50 AND o_orderkey % 11 <> 0 AND o_orderkey % 40 >= 7.30103),
 r AS (SELECT *, row_number() OVER (PARTITION BY rsid, trait ORDER BY allele = '?', p DESC, study DESC) AS k FROM a) SELECT rsid, trait, max(allele) FILTER (k = 1) AS effect_allele, max(ob) FILTER (k = 1)::DOUBLE AS or_beta, max(study) FILTER (k = 1) AS best_study, count(DISTINCT pmid) AS publications, count(DISTINCT study) AS studies FROM r GROUP BY 1, 2""")
def _(t):
    return S.featured_associations(S.associations(read(t, GWAS)), read(t, FEATURED))


METRICS = "SELECT " + _line("'PPM' || CAST(o_orderkey AS STRING)", "'PGS' || CAST(o_custkey % 60 AS STRING)", "'PSS' || CAST(o_orderkey % 70 AS STRING)", "'PGP' || CAST(o_orderkey % 5 AS STRING)") + " AS value FROM orders"
SCORES = "SELECT " + _line("'PGS' || CAST(case_id - 1 AS STRING)", "'PGP' || CAST(case_id % 5 AS STRING)") + " AS value FROM fx_cases WHERE case_id <= 50"
SETS = "SELECT " + _line("'PSS' || CAST(case_id AS STRING)", "CASE WHEN case_id % 4 = 0 THEN 'NR' ELSE CAST(case_id * 10 AS STRING) || '.0' END") + " AS value FROM fx_cases WHERE case_id < 60"


@query("ingest_evaluations", "SELECT 'PPM' || o_orderkey AS ppm_id, 'PGS' || (o_custkey % 60) AS pgs_id, o_orderkey % 5 <> (o_custkey % 60 + 1) % 5 AS independent, CASE WHEN o_orderkey % 70 BETWEEN 1 AND 59 AND (o_orderkey % 70) % 4 <> 0 THEN (o_orderkey % 70) * 10 END AS n FROM orders WHERE o_custkey % 60 < 50")
def _(t):
    return S.evaluations(read(t, METRICS), read(t, SCORES), read(t, SETS))


SHEET = "SELECT CASE WHEN case_id % 10 = 0 THEN '+++,+++' WHEN case_id % 10 = 1 THEN 'GENE,RATING' ELSE 'G' || CAST(case_id AS STRING) || ',' || CAST(case_id % 13 AS STRING) END AS value FROM fx_cases"


@query("ingest_gene_ratings", "SELECT 'G' || case_id AS gene, (case_id % 13)::VARCHAR AS rating, unnest(['Adult', 'Pediatric']) AS context FROM fx_cases WHERE case_id % 10 > 1")
def _(t):
    return S.gene_ratings({"Adult": read(t, SHEET), "Pediatric": read(t, SHEET)})


@query("row_count_expectations", "SELECT 'autism_genes' AS name, count(*) AS n_rows, count(*) >= 1000 AS whole FROM part UNION ALL SELECT 'associations', count(*), count(*) >= 100 FROM orders")
def _(t):
    return S.expect_rows(t.part, 1000, "autism_genes").union(S.expect_rows(S.associations(read(t, GWAS)), 100, "associations"))


CHROMS = "SELECT case_id, CASE case_id % 5 WHEN 0 THEN 'chr' ELSE '' END || CASE case_id % 28 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' WHEN 26 THEN 'MT' WHEN 27 THEN 'Un_1' ELSE CAST(case_id % 28 AS STRING) END AS raw FROM fx_cases"


@query("chromosome_names", f"WITH c AS ({CHROMS}) SELECT case_id, CASE WHEN case_id % 28 = 25 THEN 'MT' ELSE replace(raw, 'chr', '') END AS chrom, (CASE WHEN case_id % 28 BETWEEN 1 AND 24 THEN case_id % 28 - 1 WHEN case_id % 28 IN (25, 26) THEN 24 ELSE 99 END)::INT AS chrom_order FROM c")
def _(t):
    from ..functions.alleles import canon_chrom, chrom_order

    return read(t, CHROMS).select("case_id", canon_chrom(F.col("raw")).alias("chrom"), chrom_order(F.col("raw")).alias("chrom_order"))
