"""Queries over the column rules: cases that meet every branch, and rules over the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import evidence as E
from ..functions.alleles import genotype_share
from ..functions.protein import THREE, protein_name
from .registry import query

c = F.col
_FLAG = "CASE flagged WHEN 'true' THEN true WHEN 'false' THEN false END"


def _flag():
    return F.when(c("flagged") == "true", True).when(c("flagged") == "false", False)


def _aa(x):
    codes = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in THREE.items()) + "}"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda q: coalesce({codes}[q], q)), '')"


@query("protein_names", f"""WITH f AS (SELECT *, regexp_extract(aa_change, '^([0-9]+)', 1)::INT AS p, regexp_extract(split_part(aa_change, '>', 1), '([A-Z*]+)$', 1) AS r, regexp_extract(split_part(aa_change, '>', 2), '([A-Z*]+)$', 1) AS a FROM fx_csq WHERE aa_change IS NOT NULL),
 k AS (SELECT *, list_max([i FOR i IN range(0, least(length(r), length(a)) + 1) IF left(r, i) = left(a, i)]) AS k FROM f), t AS (SELECT *, r[k + 1:] AS rr, a[k + 1:] AS aa, p + k AS q FROM k)
 SELECT chrom_order, pos, ref, alt, tx_no, CASE WHEN a = '' OR a = r THEN 'p.' || {_aa('r[1]')} || p || '=' WHEN csq LIKE '%frameshift%' THEN 'p.' || {_aa("CASE WHEN rr = '' THEN '*' ELSE rr[1] END")} || q || CASE WHEN aa[1] = '*' THEN 'Ter' ELSE CASE WHEN aa = '' THEN '' ELSE {_aa('aa[1]')} END || 'fs' || CASE WHEN position('*' IN aa) > 0 THEN 'Ter' || position('*' IN aa) ELSE 'Ter?' END END
  WHEN length(r) = 1 AND length(a) = 1 THEN CASE WHEN p = 1 AND r = 'M' THEN 'p.Met1?' WHEN r = '*' THEN 'p.Ter' || p || {_aa('a')} || 'ext*?' ELSE 'p.' || {_aa('r')} || p || {_aa('a')} END
  WHEN rr = '' THEN 'p.' || {_aa('r[-1]')} || (q - 1) || 'delins' || {_aa("(r[-1] || aa)")} WHEN aa = '*' THEN 'p.' || {_aa('rr[1]')} || q || 'Ter'
  ELSE 'p.' || {_aa('rr[1]')} || q || CASE WHEN length(rr) > 1 THEN '_' || {_aa('rr[-1]')} || (q + length(rr) - 1) ELSE '' END || CASE WHEN aa = '' THEN 'del' ELSE 'delins' || {_aa('aa')} END END AS protein FROM t
 UNION ALL SELECT chrom_order, pos, ref, alt, tx_no, NULL FROM fx_csq WHERE aa_change IS NULL""")
def _(t):
    return t.fx_csq.select("chrom_order", "pos", "ref", "alt", "tx_no", protein_name(c("aa_change"), c("csq")).alias("protein"))


@query("inheritance_rules", """WITH m AS (SELECT case_id, lower(trim(mode_text)) AS t, lower(coalesce(conditions, '')) AS n FROM fx_cases) SELECT case_id,
 CASE WHEN t LIKE '%semi-dominant%' THEN 'SD' WHEN t LIKE '%autosomal dominant%' THEN 'AD' WHEN t LIKE '%autosomal recessive%' OR t = 'ar' THEN 'AR' WHEN t LIKE '%x-linked recessive%' THEN 'XLR' WHEN t LIKE '%x-linked dominant%' THEN 'XLD' WHEN t LIKE '%x-linked%' THEN 'XL' WHEN t LIKE '%y-linked%' THEN 'YL' WHEN t LIKE '%mitochondrial%' THEN 'MT' WHEN t LIKE '%multifactorial%' THEN 'MF' WHEN t LIKE '%digenic%' THEN 'DG' WHEN t LIKE '%sporadic%' THEN 'SP' END AS code,
 CASE WHEN n LIKE '%autosomal dominant%' THEN ['AD'] WHEN n LIKE '%autosomal recessive%' THEN ['AR'] WHEN n LIKE '%x-linked recessive%' THEN ['XLR'] WHEN n LIKE '%x-linked%' THEN ['XL'] ELSE [] END AS cues FROM m""")
def _(t):
    return t.fx_cases.select("case_id", C.inheritance_code(c("mode_text")).alias("code"), C.inheritance_cues(c("conditions")).alias("cues"))


@query("role_of_findings", """WITH m AS (SELECT case_id, zyg, CASE WHEN mode_text ILIKE '%dominant%' AND mode_text NOT ILIKE 'x-%' THEN 'AD' WHEN mode_text ILIKE '%recessive%' AND mode_text NOT ILIKE 'x-%' OR mode_text = 'AR' THEN 'AR' WHEN mode_text ILIKE 'x-%dominant%' THEN 'XLD' WHEN mode_text ILIKE 'x-linked%' THEN 'XL' END AS mode FROM fx_cases)
 SELECT case_id, CASE WHEN mode IS NULL THEN 'unknown' WHEN zyg = 'hom' AND (mode IN ('AR', 'XL', 'XLD') OR (mode = 'AD' AND case_id % 2 = 0)) THEN 'affected' WHEN zyg = 'het' AND mode = 'AR' THEN 'carrier' WHEN mode IN ('AD', 'XLD') THEN 'possible' WHEN zyg = 'het' AND mode = 'XL' AND case_id % 3 = 0 THEN 'carrier' ELSE 'unknown' END AS role FROM m""")
def _(t):
    code = C.inheritance_code(c("mode_text"))
    plain = F.when(code == "SD", "AD").otherwise(code)
    modes = F.array_compact(F.array(F.when(plain.isin("AD", "AR", "XL", "XLR", "XLD", "DG", "MF", "SP"), plain), F.when((plain == "AD") & c("yes_2"), "AR"), F.lit("MF")))
    return t.fx_cases.select("case_id", E.role(modes, c("zyg"), F.when(c("case_id") % 3 == 0, "X").otherwise("1")).alias("role"))


@query("penetrance_bands", """SELECT case_id, CASE pen_code WHEN '3A' THEN 40 WHEN '2 B' THEN 5 WHEN ' 2D' THEN 5 WHEN '1N' THEN 1 WHEN '0' THEN 0 END AS low, CASE pen_code WHEN '3A' THEN 100 WHEN '2 B' THEN 39 WHEN ' 2D' THEN 39 WHEN '1N' THEN 4 WHEN '0' THEN 1 END AS high,
 CASE pen_code WHEN '3A' THEN 'substantial evidence' WHEN '2 B' THEN 'moderate evidence' WHEN ' 2D' THEN 'poor evidence' WHEN '1N' THEN 'evidence assessed as not applicable' WHEN '0' THEN 'evidence level not stated' END AS evidence FROM fx_cases""")
def _(t):
    p = C.penetrance(c("pen_code"))
    return t.fx_cases.select("case_id", p["low"].alias("low"), p["high"].alias("high"), p["evidence"].alias("evidence"))


_BREAKS = "coalesce(csq IN ('stop_gained&splice_region', 'frameshift', 'start_lost'), false)"
_RARE = f"CASE WHEN greatest(CASE WHEN {_FLAG} THEN NULL ELSE popmax END, af) IS NULL THEN NOT coalesce({_FLAG}, false) ELSE greatest(CASE WHEN {_FLAG} THEN NULL ELSE popmax END, af) < 0.001 END"


@query("reporting_rules", f"""SELECT case_id, CASE case_id % 5 WHEN 0 THEN true WHEN 1 THEN zyg = 'hom' AND coalesce(change = '282C>282Y', false) WHEN 2 THEN copies = 2 OR yes_5 WHEN 3 THEN {_BREAKS} ELSE false END AS reportable,
 CASE WHEN {_RARE} AND (({_BREAKS} AND (coalesce(loeuf < 0.6, false) OR yes_2)) OR (csq LIKE 'missense%' AND (coalesce(revel, 0) >= 0.932 OR (coalesce(revel, 0) >= 0.644 AND coalesce(am, 0) > 0.564) OR (revel IS NULL AND coalesce(am, 0) >= 0.9)))) THEN 'Limited' END AS predicted FROM fx_cases""")
def _(t):
    report = C.reportable(c("rule"), c("copies"), c("zyg"), c("csq"), c("change"), c("yes_5"))
    return t.fx_cases.select("case_id", report.alias("reportable"), C.predicted(c("csq"), c("am"), c("revel"), c("loeuf"), c("popmax"), c("af"), c("yes_2"), _flag()).alias("predicted"))


@query("association_rules", """WITH e AS (SELECT *, CASE WHEN size IS NULL THEN NULL WHEN case_id % 4 IN (0, 1) THEN 'beta' ELSE 'or' END AS k FROM fx_cases) SELECT case_id, k AS effect_kind, CASE WHEN k = 'beta' THEN CASE case_id % 4 WHEN 0 THEN 1 ELSE -1 END WHEN k = 'or' THEN sign(size - 1)::INT END AS direction,
 CASE WHEN NOT yes_2 OR size < 1.5 THEN 'Limited' WHEN copies + exons >= 3 THEN 'Strong' WHEN copies + exons = 2 THEN 'Moderate' ELSE 'Limited' END AS evidence, CASE copies WHEN 2 THEN af * af ELSE 2 * af * (1 - af) END AS share, 1 - (1 - af) * (1 - af) AS carriers,
 CASE WHEN af IS NULL THEN 'not seen in the reference panel' WHEN af >= 0.5 THEN 'the majority version' WHEN af >= 0.05 THEN 'common' WHEN af >= 0.01 THEN 'uncommon' WHEN af >= 0.001 THEN 'rare' ELSE 'very rare' END AS rarity,
 CASE WHEN size / 3 >= 0.9 THEN 'High' WHEN size / 3 >= 0.75 THEN 'Medium' ELSE 'Not callable' END AS match_call FROM e""")
def _(t):
    e = C.association_effect(c("size"), c("note"))
    level = E.gwas_level(c("copies") + c("exons"), c("size") * 7.3 / 1.5, c("yes_2"))
    return t.fx_cases.select(
        "case_id", e["kind"].alias("effect_kind"), e["direction"].alias("direction"), E.word(F.coalesce(level, F.lit(0)), E.EVIDENCE).alias("evidence"), genotype_share(c("af"), c("copies")).alias("share"),
        (1 - (1 - c("af")) * (1 - c("af"))).alias("carriers"), C.rarity(c("af")).alias("rarity"), E.word(E.match_call(c("size") / 3), E.CALL).alias("match_call"),
    )


@query("condition_texts", """SELECT case_id, CASE case_id % 5 WHEN 0 THEN 'Pathogenic 2, Benign 4' WHEN 1 THEN 'Likely pathogenic 1' WHEN 2 THEN 'odd text' ELSE 'details not given' END AS conflicts,
 CASE case_id % 8 WHEN 0 THEN 'Autosomal dominant deafness 1' WHEN 1 THEN 'X-linked recessive ichthyosis' WHEN 2 THEN 'Alpha thing; beta thing' WHEN 3 THEN 'X-linked disorder' WHEN 7 THEN 'Autosomal recessive kidneys; Diabetes' ELSE 'an unspecified condition' END AS conditions FROM fx_cases""")
def _(t):
    return t.fx_cases.select("case_id", C.conflict_counts(c("conflicts")).alias("conflicts"), C.condition_text(c("conditions")).alias("conditions"))


@query("medicine_rules", """SELECT case_id, CASE WHEN coalesce(recommendation, '') = '' OR lower(classification) = 'no recommendation' THEN 'standard' WHEN yes_2 OR yes_3 THEN 'change' WHEN yes_5 THEN 'note' ELSE 'standard' END AS tier,
 CASE case_id % 12 WHEN 0 THEN 'poor' WHEN 1 THEN 'ultrarapid' WHEN 2 THEN 'rapid' WHEN 3 THEN 'normal' WHEN 4 THEN 'risk' WHEN 5 THEN 'risk' WHEN 6 THEN 'negative' WHEN 7 THEN 'deficien' WHEN 8 THEN 'no_result' WHEN 9 THEN 'no_result' WHEN 10 THEN 'other' ELSE 'intermediate' END AS phenotype_class,
 CASE source WHEN 'CPIC' THEN CASE WHEN trim(classification) IN ('Strong', 'Moderate') THEN trim(classification) ELSE 'Limited' END WHEN 'FDA table' THEN 'Limited' ELSE 'Moderate' END AS evidence,
 CASE WHEN total = missing THEN 'Not callable' WHEN 5 * missing > total OR yes_5 THEN 'Low' WHEN missing > 0 OR yes_3 THEN 'Medium' ELSE 'High' END AS call_level FROM fx_cases""")
def _(t):
    return t.fx_cases.select(
        "case_id", C.guideline_tier(c("recommendation"), c("classification"), c("yes_2"), c("yes_3"), c("yes_5")).alias("tier"), C.phenotype_class(c("phenotype")).alias("phenotype_class"),
        C.guideline_evidence(c("source"), c("classification")).alias("evidence"), C.diplotype_level(c("total"), c("missing"), c("yes_5"), c("yes_3")).alias("call_level"),
    )


@query("second_caller_verdict", """SELECT case_id, CASE WHEN count_1 >= 8 AND coalesce(z, 0) >= 2 AND observed >= 1 THEN CASE WHEN yes_3 THEN 'reads_flagged' ELSE 'reads_support' END WHEN count_1 >= 8 AND coalesce(z, 0) >= 2 AND observed = 0 THEN 'reads_disagree' ELSE 'unclear' END AS verdict,
 CASE WHEN level = 0 THEN 0 WHEN status = 'disagrees' THEN 1 WHEN status IN ('weak', 'unclear') OR yes_3 OR yes_5 THEN least(level, 2) ELSE level END AS call_after_recount FROM fx_cases""")
def _(t):
    return t.fx_cases.select("case_id", C.second_call(c("count_1"), c("z"), c("observed"), c("yes_3")).alias("verdict"), C.recount_cap(c("level"), c("status"), c("yes_3"), c("yes_5")).alias("call_after_recount"))


@query("blood_group_rules", """SELECT case_id, CASE WHEN non_o IS NULL OR b_copies IS NULL OR b_copies > non_o THEN NULL WHEN non_o = 0 THEN 'O' WHEN b_copies = 0 THEN 'A' WHEN b_copies = non_o THEN 'B' ELSE 'AB' END AS abo, CASE WHEN ratio < 0.15 THEN 0 WHEN ratio >= 0.3 AND ratio <= 0.7 THEN 1 WHEN ratio > 0.8 THEN 2 END AS rhd,
 CASE genotype WHEN 'DI' THEN 1 WHEN 'II' THEN CASE ref WHEN '-' THEN 2 ELSE 0 END WHEN 'AG' THEN CASE alt WHEN 'G' THEN 1 END WHEN 'GG' THEN CASE alt WHEN 'G' THEN 2 END END AS marker_copies FROM fx_cases""")
def _(t):
    return t.fx_cases.select("case_id", C.blood_group(c("non_o"), c("b_copies")).alias("abo"), C.rh_copies(c("ratio")).alias("rhd"), C.provider_copies(c("genotype"), c("ref"), c("alt")).alias("marker_copies"))


@query("repeat_rules", """WITH v AS (SELECT *, [CASE WHEN pure = 0 THEN count_1 ELSE least(pure, coalesce(benign_max, pure)) + count_1 - ref_count END, CASE WHEN pure = 0 THEN count_2 ELSE least(pure, coalesce(benign_max, pure)) + count_2 - ref_count END] AS al, CASE WHEN pure = 0 THEN upper_1 ELSE least(pure, coalesce(benign_max, pure)) + upper_1 - ref_count END AS up,
  pure > 0 AND abs(count_1 - ref_count) <= 1 AND abs(count_2 - ref_count) <= 1 AS alike FROM fx_cases), s AS (SELECT *, CASE WHEN NOT alike AND list_max(al) >= pathogenic_min THEN 'disease_range' WHEN NOT alike AND list_max(al) >= intermediate_min THEN 'intermediate' ELSE 'typical' END AS st FROM v)
 SELECT case_id, greatest(regexp_extract(upper(seq), '^((CAG)*)', 1).length() // 3, regexp_extract(upper(seq), '^(CAG)*T((CAG)*)', 2).length() // 3) AS run,
 CASE WHEN pathogenic_min IS NULL OR pathogenic_min <= benign_max THEN 'no_thresholds' ELSE st END AS status, CASE WHEN pathogenic_min IS NULL OR pathogenic_min <= benign_max THEN 'Low' WHEN st <> 'typical' THEN 'Medium' WHEN up >= pathogenic_min THEN 'Low' WHEN up >= intermediate_min THEN 'Medium' ELSE 'High' END AS call, coalesce(age >= 18, false) AS adult FROM s""")
def _(t):
    s = C.repeat_status(F.array("count_1", "count_2"), F.array("upper_1"), c("ref_count"), c("pure"), c("benign_max"), c("intermediate_min"), c("pathogenic_min"))
    rows = t.fx_cases.withColumn("s", s)
    return rows.select("case_id", C.longest_run(c("seq"), "CAG").alias("run"), c("s.status").alias("status"), c("s.call").alias("call"), C.adult_onset(c("age"), F.lit(None).cast("int")).alias("adult"))


@query("copy_number_rules", """SELECT case_id, CASE WHEN gc IS NOT NULL AND (gc < 0.25 OR gc > 0.75) THEN NULL WHEN ratio < 0.65 AND ratio_all < 0.65 AND coalesce(z, -3) <= -3 THEN 'DEL' WHEN ratio > 1.4 AND ratio_all > 1.4 AND coalesce(z, 3) >= 3 THEN 'DUP' END AS depth_kind,
 CASE WHEN greatest(coalesce(popmax, 0), coalesce(af, 0)) >= 0.01 THEN ['common', 'Limited', CASE WHEN yes_2 AND yes_3 THEN 'High' ELSE 'Medium' END] WHEN exons = 0 THEN ['no_exon', 'Limited', CASE WHEN yes_2 AND yes_3 THEN 'Medium' ELSE 'Low' END] WHEN yes_2 AND yes_3 THEN CASE kind WHEN 'DEL' THEN ['possible_exon_deletion', 'Moderate', 'Medium'] ELSE ['possible_exon_duplication', 'Limited', 'Medium'] END
  WHEN exons >= 5 THEN ['long_depth_signal', 'Limited', 'Low'] ELSE ['unconfirmed_signal', 'Limited', 'Low'] END AS told FROM fx_cases""")
def _(t):
    k = t.fx_cases.withColumn("k", C.copy_number_class(c("kind"), c("yes_2"), c("yes_3"), c("exons"), c("af"), c("popmax")))
    return k.select("case_id", C.depth_kind(c("gc"), c("ratio"), c("ratio_all"), c("z")).alias("depth_kind"), F.array("k.status", "k.evidence", "k.call").alias("told"))


@query("quoted_estimates", """SELECT case_id, CASE case_id % 6 WHEN 0 THEN 0.63 WHEN 1 THEN 1.5 WHEN 2 THEN 0.7 WHEN 5 THEN 12 END::DOUBLE AS value, CASE case_id % 6 WHEN 0 THEN 0.62 WHEN 2 THEN 0.6 END::DOUBLE AS low, CASE case_id % 6 WHEN 0 THEN 0.64 WHEN 2 THEN 0.8 END::DOUBLE AS high, case_id % 6 IN (0, 1, 3) AS stated FROM fx_cases""")
def _(t):
    e = C.estimate(c("estimate"))
    return t.fx_cases.select("case_id", e["value"].alias("value"), e["low"].alias("low"), e["high"].alias("high"), C.risk_stated(F.lit(0.125), c("quote")).alias("stated"))


@query("score_gates", """WITH x AS (SELECT case_id, ['age, sex, PCs', '10 PCs; array', 'PC(1-10), genotyping batch', NULL, 'BMI'][case_id % 5 + 1] AS cov, ['Incident coeliac disease', 'Type 2 diabetes', 'Any stroke', '', NULL][case_id % 5 + 1] AS ev FROM fx_cases)
 SELECT case_id, case_id % 5 IN (1, 2, 3) AS technical, case_id % 5 IN (0, 2) AND (case_id % 5 = 0 OR case_id % 2 = 0) AS same FROM x""")
def _(t):
    k = c("case_id") % 5
    cov = F.when(k == 0, "age, sex, PCs").when(k == 1, "10 PCs; array").when(k == 2, "PC(1-10), genotyping batch").when(k == 4, "BMI")
    ev = F.when(k == 0, "Incident coeliac disease").when(k == 1, "Type 2 diabetes").when(k == 2, "Any stroke").when(k == 3, "")
    traits = F.array(F.lit("Celiac disease"), F.lit("diabetes mellitus type 1"), F.when(c("case_id") % 2 == 0, "ischaemic stroke"), F.lit(None).cast("string"))
    return t.fx_cases.select("case_id", C.technical_only(cov).alias("technical"), C.same_outcome(ev, traits).alias("same"))


@query("lost_copy_status", "SELECT case_id, CASE observed WHEN 0 THEN 'affected' WHEN 1 THEN 'carrier' WHEN 2 THEN CASE WHEN yes_3 THEN 'possible_silent_carrier' ELSE 'typical' END ELSE 'not_determined' END AS status FROM fx_cases")
def _(t):
    return t.fx_cases.select("case_id", C.survival_gene_status(c("observed"), c("yes_3")).alias("status"))


_CLS = ["drug_response", "association", "protective", "conflicting", "likely_pathogenic"]


@query("finding_statements", "SELECT case_id, 'You carry ' || CASE copies WHEN 2 THEN 'two copies' ELSE 'one copy' END || ' of a variant in ' || CASE WHEN yes_3 THEN 'no known gene' ELSE 'G' || case_id END || [' that changes how a medicine works', ' that is linked to a trait', ' that is linked to protection', ' about which labs disagree', ' listed as likely pathogenic'][case_id % 5 + 1] || CASE WHEN yes_2 THEN '; on its own it is not expected to cause disease' ELSE '' END || '.' AS statement FROM fx_cases")
def _(t):
    cls = F.get(F.array(*[F.lit(x) for x in _CLS]), (c("case_id") % 5).cast("int"))
    gene = F.when(~c("yes_3"), F.concat(F.lit("G"), c("case_id").cast("string")))
    return t.fx_cases.select("case_id", C.statement(cls, gene, c("copies"), F.when(c("yes_2"), "carrier")).alias("statement"))


@query("record_links", r"""SELECT page_id, coalesce(regexp_matches(url, '://[^/]+/[^?#]*[^/?#]/[^/?#]+|[?][^#]*=|pubmed[.]ncbi[.]nlm[.]nih[.]gov/[0-9]+'), false) AS exact FROM pages""")
def _(t):
    from ..functions.text import exact_record

    return t.pages.select("page_id", exact_record(c("url")).alias("exact"))


@query("local_paths", r"""SELECT case_id, 'read ' || CASE WHEN yes_2 THEN 'x.bam' ELSE 'a.txt' END || ' and b/c' AS told FROM fx_cases""")
def _(t):
    from ..functions.text import strip_local_path

    path = F.when(c("yes_2"), "read /home/kim/data_1/x.bam and b/c").otherwise("read /tmp/a.txt and b/c")
    return t.fx_cases.select("case_id", strip_local_path(path).alias("told"))
