"""Queries of findings graded in full, over annotated alleles and what is known of their genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading as G
from .knowledge import AF, ANN, CALLS, LEVEL, _annotated
from .matching import read
from .registry import query

c = F.col
#: What is known of each gene, made of parts' keys.
GENES = """SELECT 'G' || CAST(g AS STRING) AS gene, CASE g % 9 WHEN 0 THEN 'Definitive' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Limited' WHEN 4 THEN 'Disputed' WHEN 5 THEN 'Refuted' WHEN 6 THEN 'Animal Model Only' END AS validity,
  CASE g % 7 WHEN 0 THEN 'AR' WHEN 1 THEN 'AD' WHEN 2 THEN 'AD,AR' WHEN 3 THEN 'XLR' WHEN 4 THEN 'MF' WHEN 5 THEN 'AR,DG' END AS mode_text, CASE g % 5 WHEN 0 THEN 'All P and LP' WHEN 1 THEN 'Biallelic P and LP' WHEN 2 THEN 'Truncating variants only' END AS rule, g % 4 > 0 AS disease_gene
 FROM (SELECT DISTINCT p_partkey % 500 AS g FROM part WHERE p_partkey % 500 < 460) x"""


def _inputs(t):
    a = _annotated(t)
    pos = c("pos").cast("bigint")  # products of positions go beyond 32 bits
    a = a.withColumns({
        "am": F.when(pos % 6 != 0, (pos * 37 % 100).cast("double") / 100), "revel": F.when(pos % 4 != 0, (pos * 53 % 1000).cast("double") / 1000), "loeuf": F.when(pos % 5 != 0, (pos % 17).cast("double") / 10),
        "low_penetrance": pos % 13 == 0, "blood_group": pos % 29 == 0,
    })
    genes = read(t, GENES).withColumn("modes", F.coalesce(F.split("mode_text", ","), F.array().cast("array<string>")))
    return a, genes


LOF = "(consequence LIKE '%stop_gained%' OR consequence LIKE '%frameshift%' OR consequence LIKE '%splice_acceptor%' OR consequence LIKE '%splice_donor%' OR consequence LIKE '%start_lost%')"
RARE = f"(CASE WHEN {AF} IS NOT NULL THEN {AF} < 0.001 ELSE NOT coalesce(flagged, false) END)"
FULL = f"""{ANN}, ge AS (SELECT *, CASE WHEN mode_text IS NULL THEN [] ELSE string_split(mode_text, ',') END AS modes FROM ({GENES})),
 an AS (SELECT ann.*, CASE WHEN pos % 6 <> 0 THEN (pos * 37 % 100)::DOUBLE / 100 END AS am, CASE WHEN pos % 4 <> 0 THEN (pos * 53 % 1000)::DOUBLE / 1000 END AS revel, CASE WHEN pos % 5 <> 0 THEN (pos % 17)::DOUBLE / 10 END AS loeuf, pos % 13 = 0 AS low, pos % 29 = 0 AS blood, ge.validity, coalesce(ge.modes, []) AS modes, ge.rule, coalesce(ge.disease_gene, false) AS disease_gene FROM ann LEFT JOIN ge USING (gene)),
 as_ AS (SELECT *, CASE WHEN cls IN ('pathogenic', 'likely_pathogenic') THEN CASE WHEN validity IN ('Disputed', 'Refuted') THEN 0 WHEN validity = 'Limited' THEN greatest({LEVEL} - 1, 0) ELSE {LEVEL} END ELSE {LEVEL} END AS evidence,
  ['stars_' || coalesce(stars, 0), CASE WHEN cls = 'drug_response' AND stars >= 3 THEN 'drug_response_capped' END, CASE WHEN cls = 'conflicting' THEN 'labs_disagree' END, CASE WHEN path AND {AF} >= 0.05 THEN 'ba1_common' WHEN path AND {AF} >= 0.01 THEN 'bs1_common' END, CASE WHEN path AND coalesce(flagged, false) THEN 'frequency_flagged' END,
   CASE WHEN path AND NOT coalesce(flagged, false) AND coalesce({AF} < 0.01, true) THEN CASE WHEN popmax IS NOT NULL THEN 'rare' WHEN af_1kg IS NULL THEN 'not_seen' END END, CASE WHEN path THEN CASE WHEN validity IN ('Disputed', 'Refuted') THEN 'gene_disputed' WHEN validity = 'Limited' THEN 'gene_limited' WHEN validity IN ('Definitive', 'Strong', 'Moderate') THEN 'gene_supported' END END, CASE WHEN path AND low THEN 'low_penetrance' END] AS why
  FROM (SELECT *, cls IN ('pathogenic', 'likely_pathogenic') AS path FROM an) WHERE cls IN ('pathogenic', 'likely_pathogenic', 'drug_response', 'risk_factor', 'protective', 'association') OR (cls = 'conflicting' AND conflicts ILIKE '%pathogenic%')),
 pr AS (SELECT *, CASE WHEN {LOF} THEN CASE WHEN loeuf < 0.6 THEN 'breaks_constrained_gene' WHEN list_contains(modes, 'AR') THEN 'breaks_recessive_gene' END WHEN consequence LIKE '%missense%' THEN CASE WHEN revel >= 0.932 THEN 'revel_strong' WHEN revel >= 0.644 AND am > 0.564 THEN CASE WHEN revel >= 0.773 THEN 'revel_moderate_and_am' ELSE 'revel_supporting_and_am' END WHEN revel IS NULL AND am >= 0.9 THEN 'am_strong' END END AS mark
  FROM an WHERE disease_gene AND filter = 'PASS' AND cls NOT IN ('pathogenic', 'likely_pathogenic', 'drug_response', 'risk_factor', 'protective', 'association', 'conflicting', 'benign', 'likely_benign') AND {RARE}),
 al AS (SELECT * EXCLUDE (path, why), why FROM as_ UNION ALL BY NAME SELECT * EXCLUDE (mark) REPLACE ('predicted' AS cls), 0 AS evidence, [mark, CASE WHEN {AF} IS NULL THEN 'not_seen' ELSE 'rare' END, CASE WHEN coalesce(flagged, false) THEN 'frequency_flagged' END, CASE WHEN significance IS NOT NULL THEN 'labs_unsettled' ELSE 'prediction_only' END] AS why FROM pr WHERE mark IS NOT NULL),
 pv AS (SELECT *, CASE WHEN provider_genotype IS NULL THEN NULL WHEN zygosity = 'het' AND provider_genotype IN (ref || alt, alt || ref) THEN 'agree' WHEN zygosity <> 'het' AND provider_genotype = alt || alt THEN 'agree' ELSE 'disagree' END AS provider, list_filter(modes, lambda m: m NOT IN ('DG', 'MF', 'SP')) AS core, cls IN ('pathogenic', 'likely_pathogenic', 'conflicting', 'predicted') AS sick FROM al),
 rl AS (SELECT *, {CALLS} AS call, CASE WHEN sick AND coalesce(stars, 0) < 3 AND coalesce({AF} >= 0.05, false) THEN 'common' WHEN len(core) = 0 THEN 'unknown' WHEN zygosity = 'hom' AND list_has_any(core, ['AR', 'XL', 'XLR', 'XLD']) THEN 'affected' WHEN zygosity = 'hemi' AND chrom = 'X' AND list_has_any(core, ['XL', 'XLR', 'XLD']) THEN 'affected'
  WHEN zygosity = 'het' AND len(list_filter(core, lambda m: m <> 'AR')) = 0 THEN 'carrier' WHEN zygosity = 'het' AND chrom = 'X' AND len(list_filter(core, lambda m: m NOT IN ('XL', 'XLR'))) = 0 THEN 'carrier' WHEN list_has_any(core, ['AD', 'SD', 'XLD']) THEN 'possible' ELSE 'unknown' END AS meaning FROM pv),
 ro AS (SELECT *, CASE WHEN cls = 'drug_response' THEN 'pgx/drug_response' WHEN cls = 'association' OR blood THEN 'traits/association' WHEN sick AND meaning = 'carrier' THEN 'carrier/carrier' WHEN cls IN ('risk_factor', 'protective') OR low THEN 'health/risk' WHEN cls = 'conflicting' OR meaning = 'common' THEN 'health/uncertain' WHEN cls = 'predicted' THEN 'health/predicted' ELSE 'health/monogenic' END AS spot FROM rl),
 fu AS (SELECT 'v-' || chrom_order || '-' || pos || '-' || ref || '-' || alt AS claim_id, gene, cls, zygosity, consequence, rule, split_part(spot, '/', 1) AS section, split_part(spot, '/', 2) AS grp, CASE WHEN sick AND NOT blood THEN meaning END AS role, ['Limited', 'Moderate', 'Strong'][evidence + 1] AS evidence_level, ['Not callable', 'Low', 'Medium', 'High'][call + 1] AS call_level,
  ['Not callable', 'Limited', 'Moderate', 'Strong'][least(evidence + 1, call) + 1] AS overall, list_filter(why, lambda x: x IS NOT NULL) AS evidence_reasons, CASE WHEN filter IS NOT NULL AND filter NOT IN ('PASS', '.') THEN ['not_passed'] ELSE list_filter([CASE WHEN gq >= 30 AND dp >= 15 THEN 'strong_reads' WHEN gq >= 20 AND dp >= 10 THEN 'moderate_reads' ELSE 'thin_reads' END,
   CASE WHEN (zygosity = 'het' AND NOT vaf BETWEEN 0.2 AND 0.8) OR (zygosity = 'hom' AND vaf < 0.8) THEN 'unbalanced_reads' END, CASE provider WHEN 'agree' THEN 'provider_agrees' WHEN 'disagree' THEN 'provider_disagrees' END], lambda x: x IS NOT NULL) END AS call_reasons,
  coalesce(cls IN ('pathogenic', 'likely_pathogenic') AND CASE rule WHEN 'All P and LP' THEN true WHEN 'Biallelic P and LP' THEN zygosity = 'hom' WHEN 'Truncating variants only' THEN {LOF} END, false) AS reportable FROM ro)"""


#: Alleles outside of consequences take the gene of their record; a provider's letters are compared with those of single-letter alleles.
OWN = "(SELECT ann.* REPLACE (coalesce(ann.gene, f.gene) AS gene, CASE WHEN length(ann.ref) = 1 AND length(ann.alt) = 1 AND regexp_full_match(provider_genotype, '[ACGT]{2}') THEN provider_genotype END AS provider_genotype) FROM ann LEFT JOIN fx_known f USING (chrom_order, pos, ref, alt)) ann"


@query("claims_from_annotations", f"WITH {FULL.replace('FROM ann LEFT JOIN ge', f'FROM {OWN} LEFT JOIN ge')} SELECT claim_id, section, cls, gene, zygosity, evidence_level, call_level AS call_confidence, overall, evidence_reasons AS reasons FROM fu")
def _(t):
    return G.claims(*_inputs(t))


@query("full_findings", f"WITH {FULL} SELECT claim_id, gene, cls, section, grp, role, evidence_level, call_level, overall, evidence_reasons, call_reasons, reportable FROM fu")
def _(t):
    return G.findings(*_inputs(t)).select("claim_id", "gene", "cls", "section", "grp", "role", "evidence_level", "call_level", "overall", "evidence_reasons", "call_reasons", "reportable")


@query("full_compounds", f"""WITH {FULL}, kc AS (SELECT gene, count(*) AS n, bool_or(cls IN ('pathogenic', 'likely_pathogenic')) AS severe FROM fu WHERE section = 'carrier' AND gene IS NOT NULL GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT fu.*, section = 'carrier' AND n IS NOT NULL AND coalesce(severe, false) AS moved, section = 'carrier' AND n IS NOT NULL AS here FROM fu LEFT JOIN kc USING (gene))
 SELECT claim_id, CASE WHEN moved THEN 'health' ELSE section END AS section, CASE WHEN moved THEN 'compound' ELSE grp END AS grp, CASE WHEN moved THEN 'possible' ELSE role END AS role, CASE WHEN moved THEN 'compound' WHEN here THEN 'note' END AS compound,
  CASE WHEN moved THEN coalesce(cls IN ('pathogenic', 'likely_pathogenic') AND CASE rule WHEN 'All P and LP' THEN true WHEN 'Biallelic P and LP' THEN true WHEN 'Truncating variants only' THEN {LOF} END, false) ELSE reportable END AS reportable FROM j""")
def _(t):
    return G.compounds(G.findings(*_inputs(t))).select("claim_id", "section", "grp", "role", "compound", "reportable")


CALLED = "SELECT 'f' || CAST(o_orderkey AS STRING) AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2000 END AS site_key, CASE WHEN o_orderkey % 3 = 0 THEN 'pgx' ELSE 'health' END AS section, CASE WHEN o_orderkey % 6 = 0 THEN 'pgx_gene' WHEN o_orderkey % 9 = 0 THEN 'pgx_drug' ELSE 'other' END AS grp, 'G' || CAST(o_orderkey % 11 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ', G' || CAST(o_orderkey % 13 AS STRING) ELSE '' END AS gene, CAST(o_orderkey % 3 AS INT) AS evidence, CAST(o_custkey % 4 AS INT) AS call FROM orders"
SEEN = "SELECT p_partkey AS site_key, CASE p_partkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'weak' WHEN 2 THEN 'unclear' WHEN 3 THEN 'disagrees' WHEN 4 THEN 'not_checkable' ELSE 'not_called' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 'look_alike' WHEN p_partkey % 11 = 0 THEN 'one_strand' END AS flag, CASE WHEN p_partkey % 2 = 0 THEN 'other letters' END AS note, CASE WHEN p_partkey % 5 = 0 THEN 'segdup' END AS hard FROM part"
OF_GENES = "SELECT DISTINCT 'G' || CAST(p_partkey % 12 AS STRING) AS gene, CASE p_partkey % 12 % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'weak' WHEN 2 THEN 'unclear' ELSE 'disagrees' END AS status FROM part"


@query("calls_after_recount", f"""WITH f AS ({CALLED}), s AS ({SEEN}), g AS ({OF_GENES}), e AS (SELECT claim_id, trim(unnest(string_split(gene, ','))) AS one FROM f WHERE section = 'pgx' AND grp IN ('pgx_gene', 'pgx_drug') AND site_key IS NULL), w AS (SELECT claim_id, min(list_position(['disagrees', 'unclear', 'weak', 'confirmed'], g.status)) AS k FROM e JOIN g ON g.gene = e.one GROUP BY 1),
 j AS (SELECT f.*, coalesce(s.status, ['disagrees', 'unclear', 'weak', 'confirmed'][w.k]) AS status, s.flag, s.note, s.hard FROM f LEFT JOIN s USING (site_key) LEFT JOIN w USING (claim_id)), a AS (SELECT *, CASE WHEN status IS NULL OR call = 0 THEN call WHEN status = 'disagrees' THEN least(call, 1) WHEN status IN ('weak', 'unclear') OR flag IS NOT NULL THEN least(call, 2) ELSE call END AS after FROM j)
 SELECT claim_id, status, ['Not callable', 'Low', 'Medium', 'High'][after + 1] AS call_level, ['Not callable', 'Limited', 'Moderate', 'Strong'][least(evidence + 1, after) + 1] AS overall, list_filter(['reads', CASE WHEN status IN ('disagrees', 'unclear', 'weak', 'confirmed') THEN 'recount_' || status WHEN status = 'not_checkable' AND note IS NOT NULL THEN 'recount_not_possible' END, flag, CASE WHEN hard IS NOT NULL THEN 'difficult_region' END], lambda x: x IS NOT NULL) AS call_reasons FROM a""")
def _(t):
    sites = read(t, SEEN).withColumns({"flags": F.array_compact(F.array("flag")), "difficult": F.array_compact(F.array("hard"))})
    return G.after_recount(read(t, CALLED).withColumn("call_reasons", F.array(F.lit("reads"))), sites, read(t, OF_GENES))
