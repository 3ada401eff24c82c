"""More readers over lines that are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import knowledge as S
from ..sources import xml as X
from .ingest import _line
from .matching import read
from .registry import query

c = F.col
STANDARD = "SELECT " + _line("'G' || CAST(case_id % 30 AS STRING)", "'T' || CAST(case_id % 90 AS STRING) || '.' || CAST(case_id % 4 AS STRING)", "'MANE Select'", "CASE WHEN case_id % 5 = 0 THEN '-' ELSE 'NM_' || CAST(case_id AS STRING) END") + " AS value FROM fx_cases WHERE case_id % 7 = 0"
EXONS = "SELECT 'G' || CAST(p_partkey % 30 AS STRING) AS gene, 'T' || CAST(p_partkey % 90 AS STRING) AS transcript, CAST(p_partkey * 100 AS INT) AS start_pos, CAST(p_partkey * 100 + p_size AS INT) AS end_pos FROM part"


@query("standard_transcripts", "SELECT 'G' || (case_id % 30) AS gene, 'T' || (case_id % 90) AS transcript, 'MANE Select' AS status, CASE WHEN case_id % 5 <> 0 THEN 'NM_' || case_id END AS refseq FROM fx_cases WHERE case_id % 7 = 0")
def _(t):
    return S.standard_transcripts(read(t, STANDARD))


@query("panel_exons", f"""WITH e AS ({EXONS}), s AS (SELECT DISTINCT 'G' || (case_id % 30) AS gene, 'T' || (case_id % 90) AS transcript FROM fx_cases WHERE case_id % 7 = 0), n AS (SELECT e.gene, e.transcript, count(*) AS n, bool_or(s.gene IS NOT NULL) AS std FROM e LEFT JOIN s ON e.gene = s.gene AND e.transcript = s.transcript GROUP BY 1, 2),
 k AS (SELECT gene, transcript FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY std DESC, n DESC, transcript) AS k FROM n) WHERE k = 1) SELECT e.* FROM e JOIN k USING (gene, transcript)""")
def _(t):
    return S.panel_exons(read(t, EXONS), S.standard_transcripts(read(t, STANDARD)))


TYPES = "SELECT " + _line("CASE WHEN case_id % 9 = 0 THEN 'MICA' ELSE 'HLA-A' || CAST(case_id AS STRING) END", "CAST(case_id % 3 AS STRING)", "CASE WHEN case_id % 3 = 0 THEN '.' ELSE 'HLA-A*02:01:03' END", "'55.7'", "CASE WHEN case_id % 3 = 2 THEN 'HLA-A*24:02' ELSE '.' END", "'12'") + " AS value FROM fx_cases"


@query("ingest_immune_types", "SELECT 'HLA-A' || case_id AS gene, CASE case_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['*02:01', '*02:01'] ELSE ['*02:01', '*24:02'] END AS alleles, CASE case_id % 3 WHEN 0 THEN [] WHEN 1 THEN [55, 55] ELSE [55, 12] END AS qualities FROM fx_cases WHERE case_id % 9 <> 0")
def _(t):
    return S.immune_types(read(t, TYPES))


_Q = "chr(34)"
DOCS = "SELECT replace('{`drugs`:[{`name`:`d' || CAST(case_id AS STRING) || '`,`guidelines`:[' || CASE case_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{`source`:`CPIC`,`annotations`:[]}' ELSE '{`source`:`DPWG`,`annotations`:[{`recommendation`:`less`,`genotypes`:[{`gene`:`B`,`phenotype`:`x`},{`gene`:`A`,`phenotype`:`y`},{`gene`:`B`,`phenotype`:`z`}]},{`recommendation`:`more`,`genotypes`:[]}]}' END || ']}]}', '`', chr(34)) AS value FROM fx_cases"


@query("ingest_guideline_report", "SELECT 'd' || case_id AS drug, [NULL, 'CPIC', 'DPWG'][case_id % 3 + 1] AS source, CASE WHEN case_id % 3 = 2 THEN 'less' END AS recommendation, CASE WHEN case_id % 3 = 2 THEN ['A', 'B'] END AS genes FROM fx_cases UNION ALL SELECT 'd' || case_id, 'DPWG', 'more', [] FROM fx_cases WHERE case_id % 3 = 2")
def _(t):
    return S.guideline_report(read(t, DOCS))


@query("call_labels", "SELECT chrom, pos, ref, alt, CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END AS copies, CASE WHEN gq < 10 THEN 'fp' ELSE 'tp' END AS label FROM fx_variants")
def _(t):
    return S.call_labels(tp=t.fx_variants.filter("gq >= 10"), fp=t.fx_variants.filter("gq < 10"))


LISTED = "SELECT CASE WHEN case_id = 1 THEN 'gene,category,condition,rule' ELSE 'G' || CAST(case_id % 60 AS STRING) || ',cat' || CAST(case_id % 60 % 3 AS STRING) || ',cond' || CAST(case_id % 7 AS STRING) || ',All' END AS value FROM fx_cases"


@query("ingest_actionable_genes", "SELECT 'G' || (case_id % 60) AS gene, 'cat' || (case_id % 60 % 3) AS category, 'All' AS rule, list_sort(list(DISTINCT 'cond' || (case_id % 7))) AS conditions FROM fx_cases WHERE case_id <> 1 GROUP BY 1, 2, 3")
def _(t):
    return S.actionable_genes(read(t, LISTED))


PANEL = "SELECT " + _line("'S' || CAST(c_custkey AS STRING)", "'P' || CAST(c_custkey % 9 AS STRING)", "'R' || CAST(c_custkey % 4 AS STRING)") + " AS value FROM customer"
FREE = "SELECT 'S' || CAST(c_custkey AS STRING) AS sample FROM customer WHERE c_custkey % 3 <> 0"


@query("panel_samples", "SELECT x.panel, 'S' || c_custkey AS sample, 'P' || (c_custkey % 9) AS population, ['EUR', 'AFR', 'other', 'EAS'][c_custkey % 4 + 1] AS grp, c_custkey % 3 = 0 AS related FROM customer, (SELECT unnest(['one', 'two']) AS panel) x")
def _(t):
    return S.panel_samples({"one": read(t, PANEL), "two": read(t, PANEL)}, {"R0": "EUR", "R1": "AFR", "R3": "EAS"}, read(t, FREE))


@query("difficult_regions", """WITH i AS (SELECT chrom_order, start_pos, end_pos, unnest(CASE WHEN state = 'CALLABLE' THEN ['repeat'] ELSE ['repeat', 'segdup'] END) AS reason FROM fx_intervals), o AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY reason, chrom_order ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM i),
 k AS (SELECT *, sum(f) OVER (PARTITION BY reason, chrom_order ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT chrom_order, min(start_pos) AS start_pos, max(end_pos) AS end_pos, reason FROM k GROUP BY chrom_order, reason, g""")
def _(t):
    cols = ["chrom_order", "start_pos", "end_pos"]
    return S.difficult_regions({"repeat": t.fx_intervals.select(*cols), "segdup": t.fx_intervals.filter("state <> 'CALLABLE'").select(*cols)})


SITES = "SELECT " + _line("'chr' || CAST(1 + case_id % 22 AS STRING)", "CAST(case_id * 5 AS STRING)", "CASE WHEN case_id % 3 = 0 THEN '.' ELSE 'rs' || CAST(case_id AS STRING) END", "'A'", "CASE WHEN case_id % 2 = 0 THEN 'G,T' ELSE 'C' END", "'.'", "'PASS'", "'X=1;PX=G' || CAST(case_id % 12 AS STRING) || ';POI'") + " AS value FROM fx_cases"


@query("defining_positions", "SELECT 'G' || (case_id % 12) AS gene, (1 + case_id % 22)::VARCHAR AS chrom, (case_id * 5)::INT AS pos, CASE WHEN case_id % 3 <> 0 THEN 'rs' || case_id END AS rsid, 'A' AS ref, CASE WHEN case_id % 2 = 0 THEN ['G', 'T'] ELSE ['C'] END AS alts FROM fx_cases")
def _(t):
    return S.defining_positions(read(t, SITES))


@query("ingest_score_weights", "SELECT score_id, (chrom_order + 1)::VARCHAR AS chrom, pos, effect_allele, other_allele, weight FROM fx_weights WHERE chrom_order < 22 UNION ALL SELECT 'X' || score_id, CASE WHEN pos % 2 = 0 THEN '7' END, pos, effect_allele, NULL, weight FROM fx_weights WHERE pos % 2 = 0")
def _(t):
    w = t.fx_weights.select("score_id", (c("chrom_order") + 1).cast("string").alias("chrom"), "pos", "effect_allele", "other_allele", "weight")
    more = t.fx_weights.select(F.concat(F.lit("X"), "score_id").alias("score_id"), F.when(c("pos") % 2 == 0, "7").otherwise("X").alias("chrom"), "pos", "effect_allele", "weight")
    return S.score_weights([w, more])


LOCI = "SELECT CASE WHEN case_id % 10 = 0 THEN 'broken {' ELSE replace('{`locus`:`L' || CAST(case_id AS STRING) || '`,`motif`:`CAG`,`ages`:[' || CAST(case_id % 30 AS STRING) || '],`refs`:[`pmid:1`,`doi:2`]}', '`', chr(34)) END AS value FROM fx_cases"


@query("ingest_repeat_loci", "SELECT 'L' || case_id AS locus, 'CAG' AS motif, [(case_id % 30)::INT] AS ages, ['1'] AS pmids FROM fx_cases WHERE case_id % 10 <> 0")
def _(t):
    x = S.json_records(read(t, LOCI), "locus string, motif string, ages array<int>, refs array<string>").filter("locus IS NOT NULL")
    return x.select("locus", "motif", "ages", F.transform(F.filter("refs", lambda r: r.startswith("pmid:")), lambda r: F.substring(r, 6, 1 << 30)).alias("pmids"))


@query("catalogue_genes", "SELECT 'HLA-' || chr((65 + c_custkey % 5)::INT) || '*0' || (c_custkey % 9) AS allele, 'HLA-' || chr((65 + c_custkey % 5)::INT) AS gene FROM customer")
def _(t):
    a = F.concat(F.lit("HLA-"), F.chr((65 + c("c_custkey") % 5).cast("int")), F.lit("*0"), (c("c_custkey") % 9).cast("string"))
    return S.catalogue_genes(t.customer.select(a.alias("allele")))


#: A disease's parts as XML, made of a part's columns; every third names no prevalence.
DISORDER = """SELECT '<Disorder><OrphaCode>' || CAST(p_partkey AS STRING) || '</OrphaCode><Name lang="en">Disease ' || CAST(p_partkey AS STRING) || '</Name><PrevalenceList>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE
  '<Prevalence><PrevalenceType><Name>' || CASE WHEN p_size % 2 = 0 THEN 'Point prevalence' ELSE 'Annual incidence' END || '</Name></PrevalenceType><PrevalenceClass><Name>' || CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE '1-' || CAST(p_size AS STRING) || ' / 100 000' END || '</Name></PrevalenceClass><PrevalenceGeographic><Name>' || CASE WHEN p_size % 3 = 0 THEN 'Worldwide' ELSE 'Europe' END || '</Name></PrevalenceGeographic></Prevalence>' ||
  '<Prevalence><PrevalenceType><Name>Point prevalence</Name></PrevalenceType><PrevalenceClass><Name>Not yet documented</Name></PrevalenceClass><PrevalenceGeographic><Name>Worldwide</Name></PrevalenceGeographic></Prevalence>' END || '</PrevalenceList></Disorder>' AS value FROM part"""


@query("rare_disease_prevalence", """SELECT 'ORPHA:' || p_partkey AS disease_id, 'Disease ' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size % 5 = 0 AND NOT (p_size % 2 = 0 AND p_size % 3 = 0) THEN 'Not yet documented (point prevalence, Worldwide)'
  ELSE CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE '1-' || p_size || ' / 100 000' END || ' (' || CASE WHEN p_size % 2 = 0 THEN 'point prevalence' ELSE 'annual incidence' END || ', ' || CASE WHEN p_size % 3 = 0 THEN 'Worldwide' ELSE 'Europe' END || ')' END AS prevalence FROM part""")
def _(t):
    return X.prevalences(X.parsed(read(t, DISORDER), "value", X.PREVALENCE))


SUMMARY = """SELECT '<gene-summary><gene-symbol>G' || CAST(p_partkey AS STRING) || '</gene-symbol><name>' || p_name || '</name><ghr-page>https://x.org/' || CAST(p_partkey AS STRING) || '</ghr-page><db-key-list><db-key><db>' || CASE WHEN p_partkey % 2 = 0 THEN 'NCBI Gene' ELSE 'OMIM' END || '</db><key>' || CAST(p_size AS STRING) || '</key></db-key></db-key-list>' ||
  '<text-list><text><text-role>' || CASE WHEN p_partkey % 4 = 0 THEN 'location' ELSE 'function' END || '</text-role><html>' || CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_type || '  <b>more</b>' ELSE '<p>' || p_type || '</p><ul><li>  of   size <i>' || CAST(p_size AS STRING) || '</i></li></ul>' END || '</html></text></text-list></gene-summary>' AS value FROM part"""


@query("gene_summaries_xml", """SELECT 'G' || p_partkey AS gene, p_name AS name, 'https://x.org/' || p_partkey AS url, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_type || ' more' ELSE p_type || chr(10) || 'of size ' || p_size END AS function, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS ncbi_id FROM part""")
def _(t):
    return X.gene_texts(X.parsed(read(t, SUMMARY), "value", X.GENE_SUMMARY)).select("gene", "name", "url", "function", "ncbi_id")
