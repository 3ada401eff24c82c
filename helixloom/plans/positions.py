"""Queries of genotypes at positions and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions as P
from .knowledge import ANN, _annotated
from .matching import read
from .registry import query

c = F.col
POS = "SELECT chrom_order * CAST(1000000000 AS BIGINT) + pos AS position_id, chrom_order, CAST(pos + CASE WHEN pos % 11 = 0 THEN 3 ELSE 0 END AS INT) AS pos, min(ref) AS ref, min(alt) || CASE WHEN pos % 3 = 0 THEN ',TTT' ELSE '' END AS alts, CASE WHEN pos % 13 = 0 THEN min(alt) WHEN pos % 17 = 0 THEN 'N' WHEN pos % 19 = 0 THEN NULL ELSE min(ref) END AS here, pos % 10 = 0 AS haploid FROM fx_variants GROUP BY chrom_order, pos"
_TRIM = "CASE WHEN length({r}) <> length({a}) AND left({r}, 1) = left({a}, 1) AND (length({r}) = 1 OR length({a}) = 1) THEN ({p} + 1) || ':' || {r}[2:] || ':' || {a}[2:] ELSE {p} || ':' || {r} || ':' || {a} END"


def _trim(p, r, a):
    return _TRIM.format(p=p, r=r, a=a)


@query("genotype_positions", f"""WITH p AS ({POS}), q AS (SELECT *, string_split(alts, ',') AS al, CASE WHEN length(ref) = 1 AND here <> ref THEN coalesce(list_position(string_split(alts, ','), here), 0) ELSE 0 END AS home FROM p),
 w AS (SELECT position_id, unnest(al) AS a, unnest(range(1, len(al) + 1)) AS n, pos, ref FROM q), wk AS (SELECT position_id, {_trim('pos', 'ref', 'a')} AS k, n FROM w UNION ALL SELECT position_id, {_trim('pos', 'here', 'ref')}, 0 FROM q WHERE home > 0),
 v AS (SELECT q.position_id, v.pos AS vpos, v.ref AS vref, v.alt AS valt, v.filter, v.gt, v.gq, v.filter = 'RefCall' OR v.gt = '0/0' AS same, (SELECT min(n) FROM wk WHERE wk.position_id = q.position_id AND wk.k = {_trim('v.pos', 'v.ref', 'v.alt')}) AS n FROM q JOIN fx_variants v ON v.chrom_order = q.chrom_order AND v.pos <= q.pos + length(q.ref) - 1 AND v.pos + length(v.ref) - 1 >= q.pos),
 f AS (SELECT *, CASE WHEN same THEN NULL WHEN gt LIKE '%.%' OR filter = 'NoCall' THEN 'no_call' WHEN n IS NULL THEN 'other_variant' WHEN filter NOT IN ('PASS', '.') THEN 'filtered' WHEN gq < 20 THEN 'low_quality' END AS fault FROM v),
 g AS (SELECT position_id, min({{'a': vpos, 'b': vref, 'c': valt, 'd': fault}}) FILTER (fault IS NOT NULL).d AS fault, bool_or(same AND gq >= 20) AS refcall, count(*) FILTER (NOT same) AS m, list({{'n': n, 'gt': gt}} ORDER BY vpos, vref, valt) FILTER (NOT same) AS own FROM f GROUP BY 1),
 h AS (SELECT q.*, g.fault, coalesce(g.m, 0) AS m, g.own, coalesce(g.refcall, false) OR EXISTS (SELECT 1 FROM fx_intervals i WHERE i.state = 'CALLABLE' AND i.chrom_order = q.chrom_order AND q.pos > i.start_pos AND q.pos <= i.end_pos) AS sure FROM q LEFT JOIN g USING (position_id)),
 x AS (SELECT *, CASE WHEN m = 0 THEN [home, home] WHEN m = 1 THEN CASE WHEN own[1].gt = '1/1' THEN [own[1].n, own[1].n] ELSE list_sort([home, own[1].n]) END ELSE list_sort([own[1].n, own[2].n]) END AS pair FROM h),
 y AS (SELECT *, CASE WHEN here IS NULL THEN 'no_reference' WHEN here <> ref AND home = 0 THEN 'ref_mismatch' WHEN fault IS NOT NULL THEN fault WHEN m = 0 AND NOT sure THEN 'not_callable' WHEN m > 2 THEN 'complex' WHEN haploid AND pair[1] <> pair[2] THEN 'het_haploid' WHEN m = 0 THEN 'reference' ELSE 'variant' END AS status FROM x)
 SELECT position_id, CASE WHEN status NOT IN ('reference', 'variant') THEN './.' WHEN haploid THEN pair[1]::VARCHAR ELSE pair[1] || '/' || pair[2] END AS gt, status FROM y""")
def _(t):
    t = t.written("fx_variants", lambda v: v.select("chrom_order", "pos", "ref", "alt", "filter", "gt", "gq"))  # positions are made of it, too
    longest = t.fx_variants.agg(F.max(F.length("ref"))).first()[0]  # of positions, too
    p = read(t, POS).withColumn("alts", F.split("alts", ","))
    return P.genotype_positions(p, t.fx_variants, t.fx_intervals.filter("state = 'CALLABLE'"), longest or 0)


MARKERS = "SELECT DISTINCT chrom_order * CAST(1000000000 AS BIGINT) + pos AS marker_id, chrom_order, pos, CASE WHEN pos % 4 = 0 THEN 'A' ELSE 'G' END AS alt FROM fx_variants WHERE pos % 2 = 0"


@query("marker_copies", f"""WITH m AS ({MARKERS}), v AS (SELECT chrom_order, pos, alt, max(CASE gt WHEN '1/1' THEN 2 WHEN '0/1' THEN 1 ELSE 0 END) AS n FROM fx_variants WHERE filter = 'PASS' GROUP BY 1, 2, 3)
 SELECT marker_id, coalesce(v.n, CASE WHEN EXISTS (SELECT 1 FROM fx_intervals i WHERE i.state IN ('CALLABLE', 'HIGH') AND i.chrom_order = m.chrom_order AND m.pos > i.start_pos AND m.pos <= i.end_pos) THEN 0 END)::INT AS copies FROM m LEFT JOIN v USING (chrom_order, pos, alt)""")
def _(t):
    return P.marker_copies(read(t, MARKERS), t.fx_variants, t.fx_intervals)


FOUND = "SELECT c_custkey % 100 AS sample, 'm.' || CAST(c_custkey % 7 AS STRING) AS name, CAST(c_custkey % 3 AS INT) AS priority, CAST(c_custkey % 10 AS DOUBLE) / 10 AS vaf FROM customer WHERE c_custkey % 100 < 60"
COVERED = "SELECT c_custkey % 100 AS sample, max(c_custkey % 1000 + 500) AS bases FROM customer WHERE c_custkey % 100 >= 20 GROUP BY c_custkey % 100"


@query("mitochondrial_gene_call", f"""WITH f AS ({FOUND}), k AS (SELECT DISTINCT sample, name, vaf, row_number() OVER (PARTITION BY sample ORDER BY priority, name, vaf) AS k FROM f), b AS (SELECT sample, name, (SELECT min(vaf) FROM f WHERE f.sample = k.sample AND f.name = k.name AND f.priority = (SELECT min(priority) FROM f g WHERE g.sample = k.sample)) AS vaf FROM k WHERE k = 1), o AS ({COVERED})
 SELECT coalesce(b.sample, o.sample) AS sample, coalesce(b.name, CASE WHEN o.bases >= 0.95 * 954 THEN 'Reference' END) AS call, coalesce(b.vaf < 0.9, false) AS mixed FROM b FULL JOIN o ON b.sample = o.sample""")
def _(t):
    one = read(t, FOUND).groupBy("sample", "name", "priority").agg(F.min("vaf").alias("vaf"))
    return P.gene_call(one, read(t, COVERED), 954)


SNPS = "SELECT rsid, effect, other, af FROM (SELECT 'rs' || CAST(pos AS STRING) AS rsid, min(alt) AS effect, min(ref) AS other, CAST(pos % 101 AS DOUBLE) / 100 AS af FROM fx_variants WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY pos) x"
CALLED = "SELECT rsid, min(genotype) AS genotype FROM fx_provider GROUP BY rsid"


@query("trait_genotypes", f"""WITH s AS ({SNPS}), g AS ({CALLED}), j AS (SELECT s.*, genotype, translate(genotype, 'ACGT', 'TGCA') AS back FROM s LEFT JOIN g USING (rsid)), n AS (SELECT *, CASE WHEN genotype[1] IN (effect, other) AND genotype[2] IN (effect, other) THEN (genotype[1] = effect)::INT + (genotype[2] = effect)::INT WHEN back[1] IN (effect, other) AND back[2] IN (effect, other) THEN (back[1] = effect)::INT + (back[2] = effect)::INT END AS copies FROM j)
 SELECT rsid, genotype, copies, af, CASE copies WHEN 0 THEN (1 - af) * (1 - af) WHEN 1 THEN 2 * af * (1 - af) WHEN 2 THEN af * af END AS share FROM n""")
def _(t):
    return P.trait_genotypes(read(t, SNPS), read(t, CALLED))


LIST = "SELECT 'G' || CAST(p_partkey % 400 AS STRING) AS gene, 'list' || CAST(p_partkey % 400 % 3 AS STRING) AS list FROM part WHERE p_partkey % 2 = 0"


@query("rare_listed_genes", f"WITH {ANN}, li AS (SELECT DISTINCT * FROM ({LIST})) SELECT ann.gene, chrom_order, pos, ref, alt, impact, list FROM ann JOIN li USING (gene) WHERE filter = 'PASS' AND gq >= 20 AND impact IN ('HIGH', 'MODERATE') AND coalesce(greatest(CASE WHEN flagged THEN NULL ELSE popmax END, af_1kg) < 0.001, NOT coalesce(flagged, false))")
def _(t):
    return P.rare_gene_variants(_annotated(t), read(t, LIST)).select("gene", "chrom_order", "pos", "ref", "alt", "impact", "list")
