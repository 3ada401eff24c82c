"""Self-checks of a release: rules over its tables, which here are projections of the given ones."""

from __future__ import annotations

from ..operators import checks as C
from ..operators.checks import Group, Orphan, Pair, Row, all_of, any_of, but_not, either_alone, lacks, one_of, outside
from .matching import read
from .registry import query

#: The release's tables, as SQL that both engines read.
TABLES = {
    "findings": "SELECT case_id, 'f' || CAST(case_id AS STRING) AS claim_id, CASE WHEN case_id % 50 = 0 THEN NULL ELSE CASE WHEN case_id % 70 = 0 THEN 'https://x.org/' ELSE 'https://x.org/a/' || CAST(case_id AS STRING) END END AS source_url, CASE classification WHEN 'Strong' THEN 'Strong' WHEN 'Moderate ' THEN 'Moderate' ELSE 'Limited' END AS evidence_level, CASE WHEN case_id % 60 = 7 THEN NULL ELSE 'High' END AS call_level, CASE case_id % 6 WHEN 0 THEN 'pathogenic' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'predicted' ELSE 'drug_response' END AS category, CASE case_id % 4 WHEN 0 THEN 'carrier' WHEN 1 THEN 'affected' ELSE 'common' END AS role, af, popmax, flagged, copies AS stars, zyg, change, 'a finding about ' || csq AS statement, yes_5 AS sensitive, status AS recount_status, CASE level WHEN 0 THEN 'Not callable' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS call_after, CASE WHEN case_id % 9 = 0 THEN 2 ELSE 1 END AS rated_genes, CASE WHEN case_id % 8 = 0 THEN NULL WHEN case_id % 8 = 1 THEN 'MT' ELSE '1' END AS chrom, CASE WHEN case_id % 23 = 0 THEN NULL ELSE status END AS recounted FROM fx_cases",
    "brain": "SELECT case_id, 'f' || CAST(case_id AS STRING) AS claim_id, CASE WHEN case_id % 7 = 0 THEN 'hom' ELSE zyg END AS zyg, af, flagged, CASE WHEN case_id % 31 = 0 THEN '' ELSE 'list' END AS sources FROM fx_cases WHERE case_id % 3 = 0",
    "traits": "SELECT 'rs' || CAST(case_id AS STRING) AS rsid, '15' AS chrom, CAST(case_id * 10 + CASE WHEN case_id = 7 THEN 1 ELSE 0 END AS INT) AS pos, CASE WHEN case_id % 40 = 0 THEN NULL ELSE 'GCST' END AS study, CASE classification WHEN 'Strong' THEN 'Strong' ELSE 'Limited' END AS evidence_level, CASE WHEN case_id % 45 = 0 THEN NULL ELSE 'High' END AS call_confidence, yes_2 AS direction_known FROM fx_cases",
    "drugs": "SELECT 'd' || CAST(case_id % 60 AS STRING) AS drug, source, yes_2 AS matched, recommendation, CASE WHEN case_id % 11 = 0 THEN 'odd' WHEN case_id % 3 = 0 THEN 'change' WHEN case_id % 3 = 1 THEN 'note' ELSE 'none' END AS tier, yes_3 AS dosing, yes_5 AS alternative, classification FROM fx_cases",
    "medicine_genes": "SELECT 'G' || CAST(case_id AS STRING) AS gene, CASE WHEN case_id % 17 = 0 THEN NULL ELSE 'High' END AS call_level, CASE WHEN case_id % 4 = 0 THEN NULL ELSE 'about' END AS described, status, level FROM fx_cases WHERE case_id % 2 = 1",
    "scores": "SELECT * FROM fx_scores",
    "trait_heads": "SELECT trait_group AS trait_id, median(p) AS percentile, count(*) AS n_studies FROM (SELECT trait_group, coalesce(pgp_id, pgs_id) AS study, median(percentile) AS p FROM fx_scores WHERE passed AND percentile IS NOT NULL AND z IS NOT NULL GROUP BY trait_group, coalesce(pgp_id, pgs_id)) s GROUP BY trait_group",
    "shares": "SELECT case_id, gc AS share, ratio_all / 4 AS noise_floor, gc > ratio_all / 4 OR case_id % 37 = 0 AS detected, CASE WHEN yes_2 THEN 'Limited' ELSE 'Moderate' END AS evidence_level FROM fx_cases WHERE gc IS NOT NULL",
    "haplogroups": "SELECT CAST(case_id AS STRING) AS line, CASE WHEN case_id % 29 = 0 THEN NULL ELSE 'tool' END AS tool, gc AS quality, CASE WHEN case_id % 43 = 0 THEN 'M1,nan' ELSE 'M1,M2' END AS mutations FROM fx_cases",
    "special_genes": "SELECT 'G' || CAST(case_id AS STRING) AS gene, CASE WHEN observed IS NULL THEN 'not_determined' ELSE 'typical' END AS status, CASE WHEN observed IS NULL OR case_id % 47 = 0 THEN 'Not callable' ELSE 'High' END AS call_level, CASE WHEN case_id % 53 = 0 THEN NULL ELSE 'tool' END AS tool, CASE WHEN case_id % 59 = 0 THEN '' ELSE 'list' END AS sources FROM fx_cases",
    "repeats": "SELECT 'f' || CAST(case_id + 1000 * (case_id % 2) AS STRING) AS locus_id, CASE WHEN count_1 = 0 THEN 'not_readable' WHEN count_1 >= 36 THEN 'disease_range' ELSE 'typical' END AS status, CASE WHEN count_1 = 0 AND yes_5 THEN 'Not callable' ELSE 'High' END AS call_level, CASE WHEN case_id % 39 = 0 THEN '' ELSE 'a' END AS alleles FROM fx_cases",
    "immune": "SELECT CAST(case_id AS STRING) AS association_id, CASE WHEN case_id % 33 = 0 THEN 'none' ELSE 'https://pubmed.ncbi.nlm.nih.gov/12345/' END AS quote_url FROM fx_cases",
    "blood": "SELECT CAST(case_id AS STRING) AS system, CASE WHEN case_id % 21 = 0 THEN NULL ELSE 'A' END AS result, CASE WHEN case_id % 42 = 0 THEN 'Not callable' ELSE 'High' END AS call_level FROM fx_cases",
    "copies": "SELECT 'f' || CAST(case_id + 500 * (case_id % 2) AS STRING) AS event_id, CASE WHEN exons > 4 THEN 'possible_exon_deletion' ELSE 'common' END AS status, yes_2 AS breakpoint, yes_3 AS depth_support FROM fx_cases",
    "recounts": "SELECT site_id, CASE WHEN site_id % 10 = 0 THEN 'disagrees' ELSE 'confirmed' END AS status, expected, label, kind, reason, truth FROM fx_sites",
    "highlights": "SELECT 'f' || CAST(case_id + 150 * (case_id % 2) AS STRING) AS ref_key, CASE classification WHEN 'Strong' THEN 'Strong' ELSE 'Limited' END AS evidence_level, 'h' || CAST(case_id % 190 AS STRING) AS highlight_id, csq AS because FROM fx_cases",
    "trait_studies": "SELECT trait_group AS trait_id, count(*) AS n FROM (SELECT DISTINCT trait_group, coalesce(pgp_id, pgs_id) AS study FROM fx_scores WHERE passed AND percentile IS NOT NULL AND z IS NOT NULL) s GROUP BY trait_group",
    "numbers": "SELECT 'PGS' || CAST(case_id AS STRING) AS pgs_id, CASE WHEN case_id % 3 = 0 THEN 'not_established' ELSE 'ok' END AS status, CASE WHEN case_id % 41 = 0 THEN NULL ELSE 'https://x.org/1' END AS baseline_url, CASE WHEN case_id % 43 = 0 THEN NULL ELSE 'https://x.org/2' END AS effect_url, CASE WHEN case_id % 5 = 0 THEN 'cohort' ELSE 'lifetime_risk' END AS baseline_kind, quote, gc AS you, CASE WHEN case_id % 4 = 0 THEN 'Not callable' ELSE 'Medium' END AS call_confidence, CASE WHEN case_id % 13 = 0 THEN NULL ELSE ratio / 2 END AS match_rate, CASE WHEN case_id % 71 = 0 THEN 'Strong' ELSE 'Moderate' END AS evidence_level FROM fx_cases",
    "risk_heads": "SELECT trait_group AS trait_id, CASE WHEN count(*) % 7 = 0 THEN 'PGS0' ELSE max(pgs_id) END AS risk_pgs_id FROM fx_scores WHERE passed AND percentile IS NOT NULL AND z IS NOT NULL GROUP BY trait_group",
    "risk_scores": "SELECT trait_group AS trait_id, max(pgs_id) AS pgs_id FROM fx_scores WHERE passed AND percentile IS NOT NULL AND z IS NOT NULL GROUP BY trait_group",
    "genotype_qc": "SELECT CASE WHEN case_id % 2 = 0 THEN 'snp' ELSE 'indel' END AS kind, CAST(case_id % 6 + 1 AS INT) AS band, CAST(case_id % 300 AS INT) AS sites, ratio_all * 2 AS hom_ref_pct FROM fx_cases",
    "populations": "SELECT CAST(case_id % 8 AS STRING) AS superpop, 'p' || CAST(case_id AS STRING) AS code, CAST(case_id % 3 AS INT) AS neighbours, CASE WHEN case_id % 6 = 0 THEN 'q' || CAST(case_id AS STRING) END AS twin, case_id % 4 > 0 AS twin_confused FROM fx_cases",
    "second_caller": "SELECT CAST(case_id AS STRING) AS place, CASE WHEN case_id % 51 = 0 THEN NULL ELSE 'flagged' END AS verdict, CASE WHEN case_id % 37 = 0 THEN NULL ELSE status END AS recount FROM fx_cases WHERE case_id % 2 = 0",
}
#: The largest frequency that a grade may rest on; a flagged one does not count.
_AF = "greatest(CASE WHEN flagged = 'true' THEN NULL ELSE popmax END, af)"
_COMMON = f"{_AF} >= 0.05"
_GUIDELINE, _POSSIBLE = one_of("source", "CPIC", "DPWG"), one_of("status", "possible_exon_deletion", "possible_exon_duplication")
_LIMITED, _UNCALLED = "evidence_level = 'Limited'", "call_level = 'Not callable'"
#: A known place of a known variant, which a wrong build would put elsewhere.
LANDMARK = ("rs7", "15", 70)
#: Whether a link names a record: two parts of a path one after the other, or a query with a value.
_RECORD = "(source_url LIKE '%://%/_%/_%' OR source_url LIKE '%?%=%')"
_SHARE = "avg(CASE WHEN status = 'confirmed' THEN 1.0 ELSE 0.0 END)"
_COUNT = "sum(CASE WHEN label = '{}' THEN 1 ELSE 0 END)"
RULES: dict[str, C.Rule] = {
    "claims.sourced": Row("findings", "claim_id", lacks("source_url", "evidence_level", "call_level")),
    "claims.exact_record": Row("findings", "claim_id", f"NOT coalesce({_RECORD}, FALSE)"),
    "claims.drug_response_not_sensitive": Row("findings", "claim_id", all_of("sensitive", "category = 'drug_response'")),
    "claims.common_is_limited": Row("findings", "claim_id", but_not(all_of(_COMMON, one_of("category", "pathogenic", "conflicting", "predicted")), _LIMITED)),
    "claims.ba1_role": Row("findings", "claim_id", all_of(_COMMON, "coalesce(stars, 0) < 3", one_of("role", "carrier", "affected", "possible"))),
    "claims.flag_not_graded": Row("findings", "claim_id", all_of("role = 'common'", "flagged = 'true'", "coalesce(af, 0) < 0.05")),
    "claims.flag_read": Row("findings", "claim_id", all_of("flagged = 'none'", "popmax IS NOT NULL")),
    "claims.no_rarer_allele_text": Row("findings", "claim_id", "lower(statement) LIKE '%rarer allele%'"),
    "claims.protein_names": Row("findings", "claim_id", any_of("change NOT LIKE 'p.%'", "length(change) > 40")),
    "claims.penetrance_single_gene": Row("findings", "claim_id", "rated_genes <> 1"),
    "claims.brain_agree": Pair("brain", "claim_id", "findings", "claim_id", "a.zyg <> b.zyg"),
    "brain.sourced": Row("brain", "claim_id", "coalesce(sources, '') = ''"),
    "brain.flag_not_rare": Row("brain", "claim_id", all_of("af IS NULL", "flagged = 'true'")),
    "traits.sourced": Row("traits", "rsid", lacks("study")),
    "traits.graded": Row("traits", "rsid", lacks("evidence_level", "call_confidence")),
    "traits.direction_unknown_limited": Row("traits", "rsid", but_not("NOT direction_known", _LIMITED)),
    "traits.lift_sane": Group("traits", f"'{LANDMARK[0]}'", f"count(*) = 0 OR sum(CASE WHEN chrom = '{LANDMARK[1]}' AND pos = {LANDMARK[2]} THEN 0 ELSE 1 END) > 0", f"rsid = '{LANDMARK[0]}'"),
    "pgx.matched_has_text": Row("drugs", "drug || ' ' || source", all_of("matched", _GUIDELINE, "coalesce(trim(recommendation), '') = ''")),
    "pgx.tier_valid": Row("drugs", "drug || ' ' || source", any_of("NOT " + one_of("tier", "change", "note", "standard", "none"), all_of("matched", "tier = 'none'"), but_not("NOT matched", one_of("tier", "note", "none")))),
    "pgx.tier_from_flags": Row("drugs", "drug || ' ' || source", but_not(all_of("matched", _GUIDELINE, either_alone("tier = 'change'", "dosing OR alternative")), "tier = 'standard' AND lower(classification) = 'no recommendation'")),
    "pgx.notes_are_guidance": Row("drugs", "drug || ' ' || source", but_not(all_of("tier = 'note'", "NOT matched"), _GUIDELINE)),
    "pgx.gene_described": Row("medicine_genes", "gene", lacks("described")),
    "pgx.gene_called_has_level": Row("medicine_genes", "gene", lacks("call_level")),
    "recount.medicine_genes": Row("medicine_genes", "gene", all_of("level > 1", "status = 'disagrees'")),
    "pgs.percentile_range": Row("scores", "pgs_id", outside("percentile", 0, 100)),
    "pgs.featured_scored": Row("scores", "pgs_id", all_of("featured", lacks("percentile"))),
    "pgs.sourced": Row("scores", "pgs_id", all_of("passed", lacks("pgp_id"))),
    "pgs.score_spread": Group("scores", "'spread'", "count(*) >= 20 AND (abs(avg(z)) > 0.5 OR stddev_samp(z) < 0.6 OR stddev_samp(z) > 1.5)", "z IS NOT NULL"),
    "pgs.trait_headline": Pair("trait_heads", "trait_id", "trait_studies", "trait_id", "a.n_studies <> b.n"),
    "pgs.trait_risk_named": Pair("risk_heads", "trait_id", "risk_scores", "trait_id", "a.risk_pgs_id <> b.pgs_id"),
    "pgs.abs_risk_sourced": Row("numbers", "pgs_id", all_of("status = 'ok'", any_of(lacks("baseline_url", "effect_url"), all_of("baseline_kind <> 'cohort'", lacks("quote")), outside("you", 0, 1)))),
    "pgs.match_rate": Row("numbers", "pgs_id", all_of("call_confidence <> 'Not callable'", any_of(lacks("match_rate"), "match_rate < 0.75"))),
    "pgs.never_strong": Row("numbers", "pgs_id", "evidence_level = 'Strong'"),
    "pgs.genotype_calibration": Row("genotype_qc", "kind || ' ' || CAST(sites AS STRING)", all_of("band = 6", "sites >= 100", "hom_ref_pct > 2")),
    "ancestry.shares_valid": Group("shares", "'sum'", "abs(sum(share) - 1) > 1e-6 OR min(share) < 0 OR max(share) > 1"),
    "ancestry.noise_labelled": Row("shares", "case_id", any_of(all_of("share > noise_floor", "NOT detected"), all_of("share <= noise_floor", any_of("detected", "evidence_level <> 'Limited'")))),
    "ancestry.neighbours_counted": Group("populations", "superpop", "sum(neighbours) <> 10", by="superpop"),
    "ancestry.panels_comparable": Row("populations", "code", all_of("twin IS NOT NULL", "NOT twin_confused")),
    "haplogroups.sourced": Row("haplogroups", "line", any_of(lacks("tool", "quality"), outside("quality", 0, 1))),
    "haplogroups.no_placeholders": Row("haplogroups", "line", "',' || lower(mutations) || ',' LIKE '%,nan,%'"),
    "special.genes_sourced": Row("special_genes", "gene", any_of(lacks("tool", "sources", "call_level"), "sources = ''")),
    "special.undetermined_not_reassuring": Row("special_genes", "gene", either_alone("status = 'not_determined'", _UNCALLED)),
    "repeats.unreadable_not_typical": Row("repeats", "locus_id", any_of(either_alone("status = 'not_readable'", _UNCALLED), all_of("alleles = ''", "status = 'typical'"))),
    "repeats.out_of_range_is_a_claim": Orphan("repeats", "locus_id", "findings", "claim_id", one_of("status", "intermediate", "disease_range")),
    "hla.quoted": Row("immune", "association_id", "quote_url NOT LIKE '%pubmed.ncbi.nlm.nih.gov/%'"),
    "blood_group.read": Row("blood", "system", either_alone("result IS NULL", _UNCALLED)),
    "cnv.two_signals": Row("copies", "event_id", but_not(_POSSIBLE, "breakpoint AND depth_support")),
    "cnv.findings_are_claims": Orphan("copies", "event_id", "findings", "claim_id", "status LIKE 'possible_%'"),
    "recount.covered": Row("findings", "claim_id", all_of("chrom <> 'MT'", lacks("recounted"))),
    "recount.lowers_call": Row("findings", "claim_id", any_of(all_of("call_after = 'High'", one_of("recount_status", "weak", "unclear")), but_not("recount_status = 'disagrees'", one_of("call_after", "Low", "Not callable")))),
    "recount.mostly_agrees": Group("recounts", "'share'", f"count(*) >= 50 AND {_SHARE} < 0.95", "expected IS NOT NULL"),
    "benchmark.recount_accuracy": Group("recounts", "'accuracy'", f"{_SHARE} < 0.98", all_of("reason IS NULL", "expected = truth")),
    "benchmark.second_caller": Group("recounts", "'precision'", f"{_COUNT.format('tp')} + {_COUNT.format('fp')} > 100 AND {_COUNT.format('fp')} > 0.01 * ({_COUNT.format('tp')} + {_COUNT.format('fp')})", all_of("kind = 'snv'", "reason IS NULL")),
    "secondcall.recounted": Row("second_caller", "place", lacks("verdict", "recount")),
    "highlights.match_source": Pair("highlights", "ref_key", "findings", "claim_id", "a.evidence_level <> b.evidence_level"),
    "highlights.have_a_source": Orphan("highlights", "ref_key", "findings", "claim_id"),
    "highlights.unique": Group("highlights", "highlight_id", "count(*) > 1", by="highlight_id"),
    "highlights.complete": Row("highlights", "ref_key", lacks("because")),
}


def _told(rule: C.Rule) -> str:
    """What breaks a rule, as plain SQL."""
    of = lambda t: f"({TABLES[t]})"
    if isinstance(rule, Row):
        return f"SELECT CAST({rule.key} AS VARCHAR) AS key FROM {of(rule.table)} WHERE {rule.broken}"
    if isinstance(rule, Orphan):
        return f"SELECT CAST(x.{rule.key} AS VARCHAR) AS key FROM {of(rule.table)} x WHERE ({rule.where}) AND NOT EXISTS (SELECT 1 FROM {of(rule.other)} y WHERE y.{rule.other_key} = x.{rule.key})"
    if isinstance(rule, Pair):
        return f"SELECT CAST(a.{rule.key} AS VARCHAR) AS key FROM {of(rule.table)} a, {of(rule.other)} b WHERE a.{rule.key} = b.{rule.other_key} AND ({rule.broken})"
    return f"SELECT CAST({rule.key} AS VARCHAR) AS key FROM {of(rule.table)} WHERE {rule.where}" + (f" GROUP BY {rule.by}" if rule.by else "") + f" HAVING {rule.broken}"


def _sql() -> str:
    parts = []
    for name, rule in RULES.items():
        if all(n in TABLES for n in rule.needs):
            parts.append(f"SELECT '{name}' AS rule, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS violations, coalesce(list_sort(list(key))[1:10], []) AS examples FROM ({_told(rule)})")
        else:
            parts.append(f"SELECT '{name}', 'skipped', 0, []::VARCHAR[]")
    return " UNION ALL ".join(parts)


@query("self_checks", _sql())
def _(t):
    return C.run(t.spark, {name: read(t, sql) for name, sql in TABLES.items()}, RULES)
