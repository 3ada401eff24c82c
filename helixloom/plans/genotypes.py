"""Queries over a cohort's genotypes as a matrix: products of people, components, projections, and thinned sites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import pruning as L
from .registry import query

PANEL = """st AS (SELECT site_id, avg(dosage) AS mu FROM fx_cohort GROUP BY 1 HAVING count(*) FILTER (dosage IS NULL) < 0.05 * count(*) AND least(avg(dosage) / 2, 1 - avg(dosage) / 2) > 0.01),
 z AS (SELECT site_id, sample, coalesce((dosage - mu) / sqrt(mu * (1 - mu / 2)), 0) AS z FROM fx_cohort JOIN st USING (site_id))"""


@query("panel_products", f"WITH {PANEL} SELECT a.sample::BIGINT AS a, b.sample::BIGINT AS b, sum(a.z * b.z) AS product FROM z a JOIN z b USING (site_id) GROUP BY 1, 2")
def _(t):
    cohort = t.fx_cohort.select("site_id", "sample", "dosage")
    people = C.numbered(cohort)
    n = people.count()
    z = C.standardised(cohort, C.site_statistics(cohort), people, n)
    g = C.gram(z, 4, n)
    table = pd.DataFrame({"at": np.arange(n), "g": [r.tolist() for r in g]})  # people x people, C.MOST_GRAM at most
    rows = t.spark.createDataFrame(table, "at int, g array<double>").join(people, "at")
    other = people.select(F.col("at").alias("i"), F.col("sample").cast("bigint").alias("b"))
    return rows.select(F.col("sample").cast("bigint").alias("a"), F.posexplode("g").alias("i", "product")).join(other, "i").select("a", "b", "product")


@query("panel_sites", f"WITH {PANEL} SELECT site_id, mu AS mean FROM st")
def _(t):
    return C.site_statistics(t.fx_cohort).select("site_id", "mean")


@query("panel_components")
def _(t):
    return C.principal_components(t.fx_cohort, 10).people


@query("people_projected")
def _(t):
    old = t.fx_cohort.filter("sample < 14")
    return C.project(t.fx_cohort.filter("sample >= 14"), C.principal_components(old, 4).loadings)


@query("region_components")
def _(t):
    person = t.fx_cohort.filter("sample = 19").select("site_id", "dosage")
    return C.region_components(t.fx_cohort.filter("sample % 3 = 0"), person, 10).people


@query("thinned_sites", """WITH RECURSIVE o AS (SELECT site_id, chrom_order, pos, sample, dosage FROM fx_cohort c WHERE NOT EXISTS (SELECT 1 FROM fx_intervals v WHERE v.state = 'NO_COVERAGE' AND v.chrom_order = c.chrom_order AND c.pos > v.start_pos AND c.pos <= v.end_pos)),
 s AS (SELECT site_id, chrom_order, pos, row_number() OVER (PARTITION BY chrom_order ORDER BY pos, site_id) - 1 AS i FROM (SELECT DISTINCT site_id, chrom_order, pos FROM o)), d AS (SELECT s.*, sample, dosage FROM o JOIN s USING (site_id) WHERE dosage IS NOT NULL),
 e AS (SELECT x.chrom_order, x.i, y.i AS j FROM d x JOIN d y ON x.chrom_order = y.chrom_order AND x.sample = y.sample AND y.i < x.i AND y.i > x.i - 50 GROUP BY 1, 2, 3
  HAVING 4 * power(count(*) * sum(x.dosage * y.dosage) - sum(x.dosage) * sum(y.dosage), 2) > (count(*) * sum(x.dosage * x.dosage) - power(sum(x.dosage), 2)) * (count(*) * sum(y.dosage * y.dosage) - power(sum(y.dosage), 2))),
 l AS (SELECT s.chrom_order, s.i, list(e.j) FILTER (e.j IS NOT NULL) AS js FROM s LEFT JOIN e USING (chrom_order, i) GROUP BY 1, 2),
 g(chrom_order, i, kept) AS (SELECT DISTINCT chrom_order, -1::BIGINT, []::BIGINT[] FROM s UNION ALL SELECT g.chrom_order, l.i, CASE WHEN list_has_any(coalesce(l.js, []), g.kept) THEN g.kept ELSE list_append(g.kept, l.i) END FROM g JOIN l ON l.chrom_order = g.chrom_order AND l.i = g.i + 1),
 f AS (SELECT chrom_order, arg_max(kept, i) AS kept FROM g GROUP BY 1) SELECT s.site_id, s.chrom_order, s.pos, list_contains(f.kept, s.i) AS kept FROM s JOIN f USING (chrom_order)""")
def _(t):
    return L.ld_prune(t.fx_cohort, 50, 1, 4, t.fx_intervals.filter("state = 'NO_COVERAGE'"))
