"""Queries over genotypes at given sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.genotype import genotype_sites
from ..operators.storage import stored
from .registry import query

GT = """s AS (SELECT DISTINCT chrom_order, pos, other_allele AS ref, effect_allele AS alt FROM fx_weights UNION SELECT chrom_order, pos, ref, alt FROM fx_variants WHERE length(ref) <> length(alt) AND pos % 2 = 0
  UNION SELECT chrom_order, pos + 1, 'C', 'T' FROM fx_variants WHERE length(ref) > length(alt) UNION SELECT chrom_order, pos + 9, 'AG', 'A' FROM fx_variants WHERE pos % 5 = 0),
 v AS (SELECT chrom_order, pos, ref, alt, filter, gt, gq, gt NOT IN ('0/0', './.') AND filter <> 'RefCall' AS shown FROM fx_variants WHERE chrom_order < 22),
 a AS (SELECT chrom_order, pos, count(*) FILTER (shown) AS n, bool_or(gt = './.' OR filter = 'NoCall') AS nocall, bool_or(filter = 'RefCall' AND gq >= 20) AS refcall FROM v GROUP BY 1, 2),
 e AS (SELECT chrom_order, pos, ref, alt, max(filter) AS filter, max(gq) AS gq, max(gt) AS gt FROM v WHERE filter <> 'RefCall' GROUP BY 1, 2, 3, 4),
 g AS (SELECT s.*, a.n, a.nocall, a.refcall, e.filter, e.gq, e.gt AS call,
  EXISTS (SELECT 1 FROM v WHERE v.chrom_order = s.chrom_order AND v.shown AND length(v.ref) > length(v.alt) AND s.pos BETWEEN v.pos + 1 AND v.pos + length(v.ref) - 1) AS inside,
  EXISTS (SELECT 1 FROM v WHERE v.chrom_order = s.chrom_order AND v.shown AND length(v.ref) <> length(v.alt) AND length(s.ref) <> length(s.alt) AND NOT (v.pos = s.pos AND v.ref = s.ref AND v.alt = s.alt) AND v.pos <= s.pos + length(s.ref) - 1 + 25 AND v.pos + length(v.ref) - 1 >= s.pos - 25) AS near,
  EXISTS (SELECT 1 FROM fx_intervals i WHERE i.state = 'CALLABLE' AND i.chrom_order = s.chrom_order AND s.pos > i.start_pos AND s.pos <= i.end_pos) AS open FROM s LEFT JOIN a ON a.chrom_order = s.chrom_order AND a.pos = s.pos LEFT JOIN e ON e.chrom_order = s.chrom_order AND e.pos = s.pos AND e.ref = s.ref AND e.alt = s.alt),
 r AS (SELECT chrom_order, pos, ref, alt, CASE WHEN call IS NOT NULL THEN CASE WHEN n > 1 OR filter <> 'PASS' OR gq < 20 THEN './.' ELSE call END WHEN coalesce(n, 0) > 0 OR coalesce(nocall, false) OR inside OR near THEN './.' WHEN coalesce(refcall, false) OR open THEN '0/0' ELSE './.' END AS gt FROM g)"""


def _sites(t):
    """Places of a score, places of indels, places inside deletions, and other indels close by."""
    v = t.fx_variants
    score = t.fx_weights.select("chrom_order", "pos", F.col("other_allele").alias("ref"), F.col("effect_allele").alias("alt"))
    indels = v.filter("length(ref) <> length(alt) AND pos % 2 = 0").select("chrom_order", "pos", "ref", "alt")
    inside = v.filter("length(ref) > length(alt)").select("chrom_order", F.col("pos") + 1, F.lit("C"), F.lit("T"))
    beside = v.filter("pos % 5 = 0").select("chrom_order", F.col("pos") + 9, F.lit("AG"), F.lit("A"))
    return score.union(indels).union(inside).union(beside).distinct()


def _genotypes(t):
    t.fx_variants = stored(t.fx_variants.select("chrom_order", "pos", "ref", "alt", "filter", "gt", "gq"), "variants")  # read seven times
    return genotype_sites(stored(_sites(t), "sites"), t.fx_variants, t.fx_intervals)


@query("genotype_sites", f"WITH {GT} SELECT * FROM r")
def _(t):
    return _genotypes(t)


@query("genotype_site_counts", f"WITH {GT} SELECT gt, count(*) AS n FROM r GROUP BY 1")
def _(t):
    return _genotypes(t).groupBy("gt").agg(F.count("*").alias("n"))
