"""Queries over annotations and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..operators import knowledge as K
from ..operators import variants as V
from .registry import query
from .variants import STORE

SIG = """CASE WHEN significance IS NULL THEN 'other' WHEN lower(significance) LIKE 'conflicting%' THEN 'conflicting' WHEN lower(significance) LIKE 'pathogenic%' THEN 'pathogenic' WHEN lower(significance) LIKE 'likely\\_pathogenic%' ESCAPE '\\' THEN 'likely_pathogenic'
 WHEN lower(significance) LIKE 'uncertain%' THEN 'uncertain' WHEN lower(significance) LIKE 'benign%' THEN 'benign' WHEN lower(significance) = 'drug_response' THEN 'drug_response' WHEN lower(significance) = 'risk_factor' THEN 'risk_factor' WHEN lower(significance) = 'association' THEN 'association' ELSE 'other' END"""
KNOWN = f"k AS (SELECT chrom_order, pos, ref, alt, variation_id, significance, conflicts, stars, af_1kg, {SIG} AS cls, CASE WHEN popmax_raw >= 0 THEN popmax_raw END AS popmax, flag_raw = '1' AS flagged FROM fx_known)"
AF = "greatest(CASE WHEN flagged THEN NULL ELSE popmax END, af_1kg)"
LEVEL = f"""CASE WHEN cls IN ('pathogenic', 'likely_pathogenic') THEN CASE WHEN {AF} >= 0.05 THEN 0 WHEN {AF} >= 0.01 THEN greatest(CASE WHEN stars >= 3 THEN 2 WHEN stars = 2 THEN 1 ELSE 0 END - 1, 0) ELSE CASE WHEN stars >= 3 THEN 2 WHEN stars = 2 THEN 1 ELSE 0 END END
 WHEN cls = 'conflicting' THEN 0 WHEN cls = 'drug_response' THEN CASE WHEN stars >= 2 THEN 1 ELSE 0 END ELSE CASE WHEN stars >= 3 THEN 2 WHEN stars = 2 THEN 1 ELSE 0 END END"""
RANK = """list_max(list_transform(string_split(csq, '&'), lambda x: CASE WHEN x IN ('frameshift', 'stop_gained', 'splice_acceptor', 'splice_donor') THEN 9 WHEN x IN ('start_lost', 'stop_lost') THEN 8 WHEN x IN ('missense', 'inframe_deletion', 'inframe_insertion', 'inframe_altering') THEN 6
 WHEN x = 'splice_region' THEN 4 WHEN x IN ('synonymous', 'stop_retained', 'start_retained', 'coding_sequence', 'feature_elongation') THEN 3 WHEN x IN ('5_prime_utr', '3_prime_utr') THEN 2 WHEN x IN ('non_coding', 'intron') THEN 1 ELSE 0 END))"""
PICK = f"""sc AS (SELECT *, {RANK} AS r FROM fx_csq), sd AS (SELECT *, {{'s': CASE WHEN mane = 'MANE Select' THEN 2000 ELSE 0 END + r * 10, 't': -tx_no}} AS o FROM sc),
 pk AS (SELECT chrom_order, pos, ref, alt, arg_max(csq, o) AS consequence, arg_max(gene, o) AS gene, arg_max(aa_change, o) AS aa_change, arg_max(mane, o) AS basis, arg_max(r, o) AS r, list_sort(list(DISTINCT gene)) AS genes FROM sd GROUP BY 1, 2, 3, 4)"""
IMPACT = "CASE WHEN r >= 8 THEN 'HIGH' WHEN r >= 6 THEN 'MODERATE' WHEN r >= 3 THEN 'LOW' ELSE 'MODIFIER' END"
ANN = f"""{STORE}, {KNOWN}, {PICK}, nm AS (SELECT chrom_order, pos, min(rsid) AS rsid, min(genotype) AS provider_genotype FROM fx_provider GROUP BY 1, 2),
 ann AS (SELECT s.*, coalesce(pk.consequence, 'intergenic') AS consequence, pk.gene, pk.aa_change, coalesce({IMPACT.replace('r >=', 'pk.r >=')}, 'MODIFIER') AS impact, k.significance, k.conflicts, k.stars, k.af_1kg, coalesce(k.cls, 'other') AS cls, k.popmax, k.flagged, nm.rsid, nm.provider_genotype
 FROM store s LEFT JOIN pk USING (chrom_order, pos, ref, alt) LEFT JOIN k USING (chrom_order, pos, ref, alt) LEFT JOIN nm USING (chrom_order, pos) WHERE s.zygosity IN ('het', 'hom', 'hemi'))"""
CALLS = """CASE WHEN filter IS NOT NULL AND filter NOT IN ('PASS', '.') THEN 1 WHEN provider = 'disagree' THEN 1 ELSE CASE WHEN (zygosity = 'het' AND NOT vaf BETWEEN 0.2 AND 0.8) OR (zygosity = 'hom' AND vaf < 0.8)
 THEN greatest(CASE WHEN gq >= 30 AND dp >= 15 THEN 3 WHEN gq >= 20 AND dp >= 10 THEN 2 ELSE 1 END - 1, 1) ELSE CASE WHEN gq >= 30 AND dp >= 15 THEN 3 WHEN gq >= 20 AND dp >= 10 THEN 2 ELSE 1 END END END"""
GRADED = f"""{ANN}, gp AS (SELECT *, CASE WHEN provider_genotype IS NULL THEN NULL WHEN zygosity = 'het' AND provider_genotype IN (ref || alt, alt || ref) THEN 'agree' WHEN zygosity <> 'het' AND provider_genotype = alt || alt THEN 'agree' ELSE 'disagree' END AS provider FROM ann),
 gl AS (SELECT *, {LEVEL} AS evidence, {CALLS} AS call, coalesce(stars, 0) < 3 AND coalesce({AF} >= 0.05, false) AS common FROM gp),
 cl AS (SELECT 'v-' || chrom_order || '-' || pos || '-' || ref || '-' || alt AS claim_id, CASE WHEN cls = 'drug_response' THEN 'medicines' WHEN cls IN ('risk_factor', 'protective', 'association') THEN 'traits' WHEN common THEN 'common' WHEN cls IN ('pathogenic', 'likely_pathogenic') AND zygosity = 'het' THEN 'carrier' ELSE 'health' END AS section,
 cls, gene, zygosity, ['Limited', 'Moderate', 'Strong'][evidence + 1] AS evidence_level, ['Not callable', 'Low', 'Medium', 'High'][call + 1] AS call_confidence, ['Not callable', 'Limited', 'Moderate', 'Strong'][least(evidence + 1, call) + 1] AS overall,
 list_filter(['stars_' || coalesce(stars, 0), CASE WHEN cls = 'drug_response' AND stars >= 3 THEN 'drug_response_capped' END, CASE WHEN cls = 'conflicting' THEN 'labs_disagree' END, CASE WHEN cls IN ('pathogenic', 'likely_pathogenic') AND {AF} >= 0.05 THEN 'ba1_common' END,
  CASE WHEN cls IN ('pathogenic', 'likely_pathogenic') AND {AF} >= 0.01 AND {AF} < 0.05 THEN 'bs1_common' END, CASE WHEN cls IN ('pathogenic', 'likely_pathogenic') AND coalesce(flagged, false) THEN 'frequency_flagged' END], lambda x: x IS NOT NULL) AS reasons
 FROM gl WHERE cls IN ('pathogenic', 'likely_pathogenic', 'drug_response', 'risk_factor', 'protective', 'association') OR (cls = 'conflicting' AND conflicts ILIKE '%pathogenic%'))"""


def _annotated(t):
    t = t.written("fx_variants", V.store)  # four tables are made of it
    return K.annotate(t.fx_variants, t.fx_csq, t.fx_known, t.fx_provider)


def _assertions(t):
    return K.assertions(_annotated(t))


@query("significance_class", f"WITH {KNOWN} SELECT chrom_order, pos, ref, alt, variation_id, cls, popmax, flagged FROM k")
def _(t):
    return K.known(t.fx_known).select("chrom_order", "pos", "ref", "alt", "variation_id", "cls", "popmax", "flagged")


@query("frequency_rules", f"""WITH {KNOWN} SELECT chrom_order, pos, ref, alt, {AF} AS highest, CASE WHEN {AF} IS NOT NULL THEN {AF} < 0.001 ELSE NOT coalesce(flagged, false) END AS rare, coalesce(stars, 0) < 3 AND coalesce({AF} >= 0.05, false) AS common,
 CASE WHEN coalesce(flagged, false) THEN 'flagged' WHEN greatest(popmax, af_1kg) IS NULL THEN 'not_seen' WHEN greatest(popmax, af_1kg) >= 0.01 THEN 'common' ELSE 'rare' END AS population, coalesce(coalesce(af_1kg, CASE WHEN NOT coalesce(flagged, false) THEN popmax END) >= 0.5, false) AS alt_major FROM k""")
def _(t):
    from ..functions.alleles import alt_is_major

    k, c = K.known(t.fx_known), F.col
    return k.select(*K.ALLELE, E.highest_af(c("popmax"), c("af_1kg"), c("flagged")).alias("highest"), E.is_rare(c("popmax"), c("af_1kg"), c("flagged")).alias("rare"), E.too_common(c("popmax"), c("af_1kg"), c("flagged"), c("stars")).alias("common"), E.population_class(c("popmax"), c("af_1kg"), c("flagged")).alias("population"), alt_is_major(c("af_1kg"), c("popmax"), c("flagged")).alias("alt_major"))


@query("clinvar_evidence", f"WITH {KNOWN} SELECT chrom_order, pos, ref, alt, cls, stars, {LEVEL} AS evidence FROM k")
def _(t):
    c = F.col
    return K.known(t.fx_known).select(*K.ALLELE, "cls", "stars", E.clinvar_level(c("stars"), c("cls"), c("popmax"), c("af_1kg"), c("flagged"), F.lit(None).cast("string")).alias("evidence"))


@query("consequence_rank", f"WITH s AS (SELECT *, {RANK} AS r FROM fx_csq) SELECT chrom_order, pos, ref, alt, tx_no, r, {IMPACT} AS impact FROM s")
def _(t):
    s = t.fx_csq.withColumn("r", E.consequence_rank(F.col("csq")))
    return s.select(*K.ALLELE, "tx_no", "r", E.impact(F.col("r")).alias("impact"))


@query("pick_consequence", f"WITH {PICK} SELECT chrom_order, pos, ref, alt, consequence, gene, aa_change, basis, {IMPACT} AS impact, genes FROM pk")
def _(t):
    return K.pick_consequence(t.fx_csq)


@query("annotate", f"WITH {ANN} SELECT chrom_order, pos, ref, alt, zygosity, consequence, impact, gene, aa_change, significance, stars, cls, popmax, flagged, af_1kg, rsid, provider_genotype FROM ann")
def _(t):
    return _annotated(t).select("chrom_order", "pos", "ref", "alt", "zygosity", "consequence", "impact", "gene", "aa_change", "significance", "stars", "cls", "popmax", "flagged", "af_1kg", "rsid", "provider_genotype")


@query("annotation_summary", f"WITH {ANN} SELECT impact, cls, count(*) AS n, count(rsid) AS named, count(af_1kg) AS in_1kg FROM ann GROUP BY 1, 2")
def _(t):
    return _annotated(t).groupBy("impact", "cls").agg(F.count("*").alias("n"), F.count("rsid").alias("named"), F.count("af_1kg").alias("in_1kg"))


@query("claims_overview", f"WITH {GRADED} SELECT section, overall, count(*) AS n FROM cl GROUP BY 1, 2")
def _(t):
    return _assertions(t).groupBy("section", "overall").agg(F.count("*").alias("n"))


@query("compound_findings", f"""WITH {GRADED}, ca AS (SELECT gene, count(*) AS n, bool_or(cls IN ('pathogenic', 'likely_pathogenic')) AS severe FROM cl WHERE section = 'carrier' AND gene IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
 SELECT claim_id, CASE WHEN section = 'carrier' AND coalesce(severe, false) THEN 'health' ELSE section END AS section, CASE WHEN section = 'carrier' AND coalesce(severe, false) THEN 'compound' WHEN section = 'carrier' AND n IS NOT NULL THEN 'note' END AS compound FROM cl LEFT JOIN ca USING (gene)""")
def _(t):
    return K.compound(_assertions(t))


@query("rare_gene_variants", f"""WITH {ANN} SELECT chrom_order, pos, ref, alt, gene, impact FROM ann WHERE filter = 'PASS' AND gq >= 20 AND impact IN ('HIGH', 'MODERATE') AND gene IS NOT NULL AND CASE WHEN {AF} IS NOT NULL THEN {AF} < 0.001 ELSE NOT coalesce(flagged, false) END""")
def _(t):
    a = _annotated(t).filter("filter = 'PASS' AND gq >= 20 AND gene IS NOT NULL AND impact IN ('HIGH', 'MODERATE')")
    return a.filter(E.is_rare(F.col("popmax"), F.col("af_1kg"), F.col("flagged"))).select("chrom_order", "pos", "ref", "alt", "gene", "impact")


@query("gene_attribute_join", """SELECT g.symbol, count(*) AS alleles, count(*) FILTER (g.biotype = 'protein_coding') AS coding, max(c.pos) AS last_pos FROM fx_csq c JOIN fx_genes g ON c.gene = g.symbol GROUP BY 1""")
def _(t):
    counts = t.fx_csq.groupBy("gene").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    j = t.fx_genes.join(counts, t.fx_genes["symbol"] == counts["gene"])
    return j.groupBy("symbol").agg(F.sum("n").alias("alleles"), F.coalesce(F.sum(F.when(F.col("biotype") == "protein_coding", F.col("n"))), F.lit(0)).alias("coding"), F.max("last").alias("last_pos"))


@query("allele_counts", """SELECT chrom_order, pos, ref, alt, zyg_copies AS copies, count(*) AS people FROM (SELECT *, CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 WHEN '0/0' THEN 0 END AS zyg_copies FROM fx_variants) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    copies = F.when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2).when(F.col("gt") == "0/0", 0)
    return t.fx_variants.groupBy("chrom_order", "pos", "ref", "alt", copies.alias("copies")).agg(F.count("*").alias("people"))


ATTRIBUTES = "SELECT gene, max(loeuf) AS loeuf, max(validity) AS validity, bool_or(listed) AS listed FROM (SELECT 'G' || CAST(case_id % 500 AS STRING) AS gene, loeuf, classification AS validity, yes_3 AS listed FROM fx_cases) x GROUP BY gene"


@query("gene_attributes", f"WITH {PICK}, a AS ({ATTRIBUTES}), l AS (SELECT DISTINCT symbol FROM fx_genes WHERE biotype = 'protein_coding') SELECT chrom_order, pos, ref, alt, pk.gene, loeuf, validity, coalesce(listed, false) AS listed, l.symbol IS NOT NULL AS coding FROM pk LEFT JOIN a ON a.gene = pk.gene LEFT JOIN l ON l.symbol = pk.gene")
def _(t):
    from .matching import read

    coding = t.fx_genes.filter("biotype = 'protein_coding'").select(F.col("symbol").alias("gene"), F.lit(True).alias("coding")).distinct()
    return K.with_gene_attributes(K.pick_consequence(t.fx_csq).select(*K.ALLELE, "gene"), read(t, ATTRIBUTES), coding)
