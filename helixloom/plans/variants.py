"""Queries over the variant store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles as A
from ..operators import variants as V
from .registry import query

ZYG = """CASE WHEN gt IN ('./.', '.|.', '.') THEN 'nocall' WHEN gt IN ('0/0', '0|0', '0') THEN 'ref' WHEN gt IN ('1/1', '1|1') THEN 'hom' WHEN gt = '1' THEN 'hemi' ELSE 'het' END"""
VT = """CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) = length(alt) THEN 'MNV' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'DEL' END"""
STORE = f"store AS (SELECT *, {VT} AS vtype, {ZYG} AS zygosity, ad_alt::DOUBLE / dp AS vaf FROM fx_variants)"
CALLED = "filter = 'PASS' AND zygosity IN ('het', 'hom', 'hemi')"
PAR = "(pos BETWEEN 60001 AND 2699520 OR pos BETWEEN 154931044 AND 155260560)"
#: Expected ranges of a whole genome's metrics, for those that the variant store gives.
RANGES = {"snv_count": (3.3e6, 4.6e6), "indel_count": (5.5e5, 1.2e6), "titv": (1.95, 2.15), "het_hom": (1.2, 2.2), "vaf_median": (0.45, 0.55)}


@query("variant_store", f"WITH {STORE} SELECT chrom, chrom_order, pos, ref, alt, filter, gt, gq, dp, vtype, zygosity, vaf FROM store")
def _(t):
    return V.store(t.fx_variants).select("chrom", "chrom_order", "pos", "ref", "alt", "filter", "gt", "gq", "dp", "vtype", "zygosity", "vaf")


# One row for each called allele and thing that it counts for, then counts by thing; quantiles by rank over sorted values.
QC = f"""WITH {STORE}, c AS (SELECT *, chrom_order < 22 AS autosome, chrom = 'X' AND NOT {PAR} AS on_x FROM store WHERE {CALLED}),
 things AS (SELECT lower(vtype) AS thing FROM c UNION ALL SELECT 'snv_' || zygosity FROM c WHERE vtype = 'SNV' UNION ALL SELECT 'ts' FROM c WHERE vtype = 'SNV' AND abs(position(ref IN 'AGCT') - position(alt IN 'AGCT')) = 1 AND position(ref IN 'AGCT') + position(alt IN 'AGCT') IN (3, 7)
  UNION ALL SELECT CASE WHEN zygosity = 'het' THEN 'x_het' ELSE 'x_hom' END FROM c WHERE vtype = 'SNV' AND on_x UNION ALL SELECT 'y_snv' FROM c WHERE vtype = 'SNV' AND chrom = 'Y'),
 n AS (SELECT thing, count(*) AS n FROM things GROUP BY 1), v AS (SELECT coalesce((SELECT n FROM n WHERE thing = x), 0) AS n, x FROM (SELECT unnest(['snv', 'ins', 'del', 'mnv', 'snv_het', 'snv_hom', 'ts', 'x_het', 'x_hom', 'y_snv']) AS x)),
 m AS (FROM (PIVOT v ON x IN ('snv', 'ins', 'del', 'mnv', 'snv_het', 'snv_hom', 'ts', 'x_het', 'x_hom', 'y_snv') USING max(n)), (SELECT quantile_cont(vaf, [0.5, 0.25, 0.75]) AS f FROM c WHERE vtype = 'SNV' AND zygosity = 'het' AND autosome), (SELECT quantile_cont(dp, 0.5) AS d, quantile_cont(gq, 0.5) AS g FROM c)),
 q AS (SELECT snv, ins, del, mnv, snv_het, snv_hom, ts, f[1] AS vaf_median, f[2] AS vaf_q1, f[3] AS vaf_q3, d AS dp_median, g AS gq_median, x_het, x_hom, y_snv, snv AS snv_count, ins + del AS indel_count, ts / greatest(snv - ts, 1) AS titv, snv_het / greatest(snv_hom, 1) AS het_hom, x_het / nullif(x_het + x_hom, 0) AS x_het_share FROM m)"""


@query("variant_qc", f"{QC} SELECT * FROM q")
def _(t):
    return V.qc(V.store(t.fx_variants))


@query("qc_assess", f"{QC}, u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, {k}::DOUBLE AS value, {a}::DOUBLE AS low, {b}::DOUBLE AS high FROM q" for k, (a, b) in RANGES.items()) + ") SELECT *, CASE WHEN value BETWEEN low AND high THEN 'pass' ELSE 'warn' END AS status FROM u WHERE value IS NOT NULL")
def _(t):
    return V.assess(V.qc(V.store(t.fx_variants)), RANGES)


@query("infer_sex", f"{QC} SELECT CASE WHEN x_het_share < 0.1 THEN 'XY' WHEN x_het_share >= 0.1 THEN 'XX' END AS sex, x_het_share, y_snv FROM q")
def _(t):
    return V.infer_sex(V.qc(V.store(t.fx_variants)))


@query("per_chrom", f"WITH {STORE} SELECT chrom, chrom_order, count(*) FILTER (vtype='SNV') snv, count(*) FILTER (vtype IN ('INS','DEL')) indel, count(*) FILTER (zygosity='het') het, count(*) FILTER (zygosity IN ('hom','hemi')) hom FROM store WHERE {CALLED} GROUP BY ALL")
def _(t):
    return V.per_chrom(V.store(t.fx_variants))


@query("qc_histograms", f"""WITH {STORE}, p AS (SELECT * FROM store WHERE filter = 'PASS')
SELECT 'het_vaf' AS metric, floor(vaf*50)::BIGINT::VARCHAR AS bin, count(*) AS n FROM p WHERE vtype='SNV' AND zygosity='het' AND chrom NOT IN ('X','Y','MT') GROUP BY 2
UNION ALL SELECT 'depth', least(dp,100)::VARCHAR, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'gq', gq::VARCHAR, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'indel_length', greatest(least(length(alt)-length(ref),20),-20)::VARCHAR, count(*) FROM p WHERE vtype IN ('INS','DEL') AND zygosity <> 'ref' GROUP BY 2
UNION ALL SELECT 'substitution', ref||'>'||alt, count(*) FROM p WHERE vtype='SNV' AND zygosity <> 'ref' GROUP BY 2""")
def _(t):
    return V.histograms(V.store(t.fx_variants))


POSITIONS = """pv AS (SELECT chrom_order, pos, arg_min(rsid, {'a': file_rank, 'b': rsid, 'c': genotype}) AS rsid, arg_min(genotype, {'a': file_rank, 'b': rsid, 'c': genotype}) AS genotype,
 bool_or(file_rank = 0) AS in_panel, count(DISTINCT genotype) > 1 AS conflicting FROM fx_provider GROUP BY 1, 2)"""


@query("provider_positions", f"WITH {POSITIONS} SELECT * FROM pv")
def _(t):
    return V.provider_positions(t.fx_provider)


@query("concordance", f"""WITH {STORE}, {POSITIONS}, o AS (SELECT chrom_order, pos, count(*) AS alleles, max(CASE zygosity WHEN 'het' THEN ref||alt WHEN 'hom' THEN alt||alt WHEN 'ref' THEN ref||ref END) AS expected,
 bool_or(zygosity = 'nocall') AS nocall, max(zygosity) AS zyg FROM store WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY 1, 2),
 j AS (SELECT pv.in_panel, CASE WHEN alleles IS NULL THEN 'unverifiable' WHEN nocall THEN 'nocall' WHEN alleles > 1 THEN 'unverifiable'
 WHEN genotype = expected OR reverse(genotype) = expected THEN CASE WHEN zyg = 'ref' THEN 'concordant_reference' ELSE 'concordant_variant' END ELSE 'discordant' END AS status
 FROM pv LEFT JOIN o USING (chrom_order, pos)) SELECT in_panel, status, count(*) AS n FROM j GROUP BY 1, 2""")
def _(t):
    return V.concordance(V.store(t.fx_variants), t.fx_provider)


@query("rsid_join", f"""WITH g AS (SELECT chrom_order, pos, min(rsid) FILTER (rsid LIKE 'rs%') AS rsid, min(genotype) FILTER (rsid LIKE 'rs%') AS genotype FROM fx_provider GROUP BY 1, 2)
SELECT v.chrom_order, v.pos, v.ref, v.alt, g.rsid, g.genotype FROM fx_variants v LEFT JOIN g USING (chrom_order, pos)""")
def _(t):
    g = t.fx_provider.filter(F.col("rsid").startswith("rs")).groupBy("chrom_order", "pos").agg(F.min("rsid").alias("rsid"), F.min("genotype").alias("genotype"))
    return t.fx_variants.join(g, ["chrom_order", "pos"], "left").select("chrom_order", "pos", "ref", "alt", "rsid", "genotype")


@query("trim_alleles", """SELECT chrom_order, pos, ref, alt, CASE WHEN length(ref) > length(alt) AND ref[1] = alt[1] THEN pos + 1 WHEN length(alt) > length(ref) AND ref[1] = alt[1] THEN pos + 1 ELSE pos END AS t_pos,
 CASE WHEN length(ref) <> length(alt) THEN ref[2:] ELSE ref END AS t_ref, CASE WHEN length(ref) <> length(alt) THEN alt[2:] ELSE alt END AS t_alt FROM fx_variants WHERE NOT (length(ref) = 3 AND ref[3] = alt[1])
 UNION ALL SELECT chrom_order, pos, ref, alt, pos, ref[1:2], '' FROM fx_variants WHERE length(ref) = 3 AND ref[3] = alt[1] AND false
 UNION ALL SELECT chrom_order, pos, ref, alt, pos + 1, ref[2:], '' FROM fx_variants WHERE length(ref) = 3 AND ref[3] = alt[1]""")
def _(t):
    x = A.trim_alleles(F.col("pos"), F.col("ref"), F.col("alt"))
    rows = t.fx_variants.select("chrom_order", "pos", "ref", "alt", F.inline(F.array(x)).alias("t_pos", "t_ref", "t_alt"))
    return rows


@query("allele_classes", f"""SELECT chrom_order, pos, ref, alt, CASE WHEN length(ref) <> length(alt) THEN 'indel' WHEN length(ref) = 1 THEN 'snv' ELSE 'mnv' END AS kind,
 CASE WHEN chrom = 'Y' THEN 1 WHEN chrom = 'X' THEN CASE WHEN {PAR} THEN 2 ELSE 1 END ELSE 2 END AS ploidy_xy, translate(ref, 'ACGT', 'TGCA') AS ref_rev FROM fx_variants""")
def _(t):
    return t.fx_variants.select("chrom_order", "pos", "ref", "alt", A.variant_kind(F.col("ref"), F.col("alt")).alias("kind"), A.ploidy(F.col("chrom"), F.col("pos"), F.lit("XY")).alias("ploidy_xy"), A.complement(F.col("ref")).alias("ref_rev"))


@query("effect_copies", """SELECT p.chrom_order, p.pos, v.ref, v.alt, p.genotype, p.file_rank, CASE WHEN genotype[1] IN (alt, ref) AND genotype[2] IN (alt, ref) THEN (genotype[1] = alt)::INT + (genotype[2] = alt)::INT
 WHEN translate(genotype, 'ACGT', 'TGCA')[1] IN (alt, ref) AND translate(genotype, 'ACGT', 'TGCA')[2] IN (alt, ref) THEN (translate(genotype, 'ACGT', 'TGCA')[1] = alt)::INT + (translate(genotype, 'ACGT', 'TGCA')[2] = alt)::INT END AS copies
 FROM fx_provider p JOIN fx_variants v USING (chrom_order, pos) WHERE length(v.ref) = 1 AND length(v.alt) = 1""")
def _(t):
    v = t.fx_variants.filter("length(ref) = 1 AND length(alt) = 1").select("chrom_order", "pos", "ref", "alt")
    j = t.fx_provider.join(v, ["chrom_order", "pos"])
    return j.select("chrom_order", "pos", "ref", "alt", "genotype", "file_rank", A.effect_copies(F.col("genotype"), F.col("alt"), F.col("ref")).alias("copies"))


@query("genome_stats", f"WITH {STORE} SELECT count(DISTINCT (chrom_order, pos)) AS sites, count(*) FILTER (vtype = 'SNV' AND chrom_order < 22) AS autosomal_snv, count(*) FILTER (length(ref) <> length(alt) AND (length(ref) - length(alt)) % 3 <> 0) AS frame_changing FROM store WHERE {CALLED}")
def _(t):
    v = V.store(t.fx_variants).filter((F.col("filter") == "PASS") & F.col("zygosity").isin(*V.CALLED))
    shift = F.length("ref") - F.length("alt")
    return v.agg(F.count_distinct("chrom_order", "pos").alias("sites"), F.count(F.when((F.col("vtype") == "SNV") & (F.col("chrom_order") < 22), 1)).alias("autosomal_snv"), F.count(F.when((shift != 0) & (shift % 3 != 0), 1)).alias("frame_changing"))


@query("hash_sample", """SELECT chrom_order, pos, ref, alt FROM (SELECT *, row_number() OVER (PARTITION BY chrom_order ORDER BY md5(chrom_order || ':' || pos || ':' || ref || ':' || alt)) AS k FROM fx_variants) WHERE k <= 20""")
def _(t):
    from ..operators.windows import hash_sample

    return hash_sample(t.fx_variants, ["chrom_order"], ["chrom_order", "pos", "ref", "alt"], 20).select("chrom_order", "pos", "ref", "alt")


@query("variant_page", "SELECT chrom_order, pos, ref, alt, gt, gq FROM fx_variants WHERE filter = 'PASS' AND gq >= 20 AND chrom_order = 0 ORDER BY pos, ref, alt LIMIT 50 OFFSET 100")
def _(t):
    from ..operators.windows import page
    from ..operators.search import variant_search

    return page(variant_search(t.fx_variants, chrom="1", filter="PASS", min_gq=20), ["pos", "ref", "alt"], 50, 100).select("chrom_order", "pos", "ref", "alt", "gt", "gq")


@query("chromosome_parts", """WITH RECURSIVE c AS (SELECT chrom_order, count(*) AS n, row_number() OVER (ORDER BY chrom_order) AS k FROM fx_variants GROUP BY 1),
 w(k, chrom_order, n, part, used) AS (SELECT k, chrom_order, n, 0, n FROM c WHERE k = 1 UNION ALL
 SELECT c.k, c.chrom_order, c.n, CASE WHEN w.used + c.n > 10000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + c.n > 10000 THEN c.n ELSE w.used + c.n END FROM w JOIN c ON c.k = w.k + 1)
 SELECT chrom_order, n, part FROM w""")
def _(t):
    from ..operators.windows import parts_by_size

    return parts_by_size(t.fx_variants.groupBy("chrom_order").agg(F.count("*").alias("n")), "chrom_order", "n", 10_000)
