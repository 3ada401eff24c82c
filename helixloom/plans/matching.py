"""Queries of joins to what is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from .registry import query

c = F.col
#: The projections of these queries, as SQL that both engines read.
CASES = "SELECT case_id AS finding, conditions AS names, CASE WHEN case_id % 3 = 0 THEN NULL WHEN conditions LIKE '%|%|%' THEN 'D1|D2|D3' WHEN conditions LIKE '%|%' THEN 'D' || CAST(case_id % 5 AS STRING) || '|D' || CAST(case_id % 7 AS STRING) ELSE 'D' || CAST(case_id % 9 AS STRING) END AS ids FROM fx_cases WHERE conditions IS NOT NULL"
DISEASES = "SELECT 'G' || CAST(p_partkey % 40 AS STRING) AS gene, 'D' || CAST(p_partkey % 9 AS STRING) AS disease_id, CASE p_partkey % 3 WHEN 0 THEN 'MENDELIAN' WHEN 1 THEN 'Disease-causing germline mutation' ELSE 'POLYGENIC' END AS association FROM part"
VALIDITY = "SELECT 'G' || CAST(case_id % 45 AS STRING) AS gene, CASE case_id % 7 WHEN 0 THEN 'Definitive' WHEN 1 THEN 'Limited' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Strong' WHEN 4 THEN 'Disputed' ELSE 'Unheard of' END AS classification, mode_text FROM fx_cases"
RATINGS = "SELECT case_id AS rating_id, CASE case_id % 2 WHEN 0 THEN 'Adult' ELSE 'Pediatric' END AS context, 'G' || CAST(case_id % 30 AS STRING) || CASE WHEN case_id % 4 = 0 THEN ', G' || CAST((case_id + 7) % 30 AS STRING) ELSE '' END AS genes, CASE WHEN case_id % 11 = 0 THEN 'none' ELSE CAST(case_id % 13 AS STRING) || 'CB' END AS overall, pen_code AS likelihood FROM fx_cases"
BLOCKS = "SELECT CAST(p_partkey % 5 AS INT) AS chrom, CAST(p_partkey * 50 AS INT) AS t_start, CAST(p_partkey * 50 + 20 + p_size * 4 AS INT) AS t_end, CAST(p_partkey % 3 AS INT) AS q_chrom, CAST(p_partkey * 70 AS INT) AS q_start, 50000000 AS q_size, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_partkey % 10 AS INT) AS rank FROM part"
POINTS = "SELECT event_id AS point_id, CAST(event_id % 5 AS INT) AS chrom, CAST(1 + (event_id * 13) % 12000 AS INT) AS pos, CAST(1 + event_id % 30 AS INT) AS length FROM events"
PANEL = "SELECT c.chrom_order, c.pos, substr('ACGT', CAST(1 + c.site_id % 4 AS INT), 1) AS a1, substr('ACGT', CAST(1 + (c.site_id + 1 + c.site_id % 3) % 4 AS INT), 1) AS a2, c.sample, c.dosage FROM fx_cohort c"
PANEL_SITES = "SELECT CAST(p_partkey % 25 AS INT) AS chrom_order, CAST(p_partkey * 100 AS INT) AS pos, substr('ACGT', CAST(1 + (p_partkey + p_size % 2 * (1 + p_partkey % 3)) % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (p_partkey + (1 - p_size % 2) * (1 + p_partkey % 3)) % 4 AS INT), 1) AS alt, CASE WHEN p_size % 7 = 0 THEN '-' ELSE '+' END AS strand FROM part"
STORED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS value FROM orders"
LIVE = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 100 AS DOUBLE) * 1.005 WHEN 1 THEN CAST(o_orderkey % 100 AS DOUBLE) + 5 WHEN 2 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST('2026-01-01' AS DATE) END AS evaluated FROM orders WHERE o_orderkey % 5 <> 0"
TYPED = "SELECT c_custkey AS sample, g.gene, CASE WHEN (c_custkey + g.k) % 3 = 0 THEN '02:01:01' WHEN (c_custkey + g.k) % 3 = 1 THEN '020:01' ELSE '27:05' END AS allele, CAST((c_custkey * 7 + g.k) % 60 AS INT) AS quality FROM customer CROSS JOIN (VALUES ('A', 0), ('A', 1), ('B', 2), ('B', 4), ('DQB1', 5), ('DQB1', 7)) AS g(gene, k) WHERE NOT (c_custkey % 10 = 0 AND g.gene = 'DQB1')"
RULES = "SELECT * FROM (VALUES ('any_b27', 'risk', 'B*27'), ('not_dq2', 'rule_out', 'DQB1*02,DQB1*27:05'), ('pair', 'haplotype', 'A*02:01,B*27:05')) AS r(rule_id, kind, joined)"
SUBS = "SELECT case_id % 40 AS variation_id, CASE case_id % 3 WHEN 0 THEN 'pathogenic' WHEN 1 THEN 'likely_pathogenic' ELSE 'benign' END AS cls, 'Cond' || CAST(case_id % 7 AS STRING) || CASE WHEN case_id % 4 = 0 THEN ';cond' || CAST(case_id % 5 AS STRING) WHEN case_id % 9 = 0 THEN ';a;b;c' WHEN case_id % 5 = 0 THEN ';not provided' ELSE '' END AS named FROM fx_cases"
_XREF = "SELECT DISTINCT disease_id AS id, 'S' || disease_id AS synonym FROM d WHERE disease_id < 'D5'"
_MODES = "SELECT DISTINCT CASE WHEN disease_id < 'D3' THEN 'S' || disease_id ELSE disease_id END AS id, 1 AS source_rank, CASE WHEN disease_id IN ('D0', 'D4', 'D6') THEN ['AR'] ELSE ['AD'] END AS modes FROM d"


def read(t, sql, **more):
    import re

    from ..fixtures import BASE
    from ..fixtures import SQL as FX

    used = [n for n in (*BASE, *FX) if re.search(rf"\b{n}\b", sql)]
    plain = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself
    text = re.sub(r"\b(" + "|".join(used) + r")\b", lambda m: "{" + m[1] + "}", plain) if used else sql
    return t.spark.sql(text, **{n: getattr(t, n) for n in used}, **more)


def _modes(t):
    d = read(t, DISEASES).select("disease_id").distinct()
    return d.select(F.when(c("disease_id") < "D3", F.concat(F.lit("S"), "disease_id")).otherwise(c("disease_id")).alias("id"), F.lit(1).alias("source_rank"), F.array(F.when(c("disease_id").isin("D0", "D4", "D6"), "AR").otherwise("AD")).alias("modes"))


@query("resolve_conditions", f"""WITH n AS ({CASES}), d AS ({DISEASES}), x AS ({_XREF}), m AS ({_MODES}), e AS (SELECT finding, string_split(names, '|') AS ns, string_split(coalesce(ids, ''), '|') AS xs FROM n),
 r AS (SELECT finding, unnest(range(1, len(ns) + 1)) AS k, ns, xs FROM e), o AS (SELECT finding, k, trim(ns[k]) AS name, CASE WHEN len(ns) = len(xs) THEN trim(xs[k]) ELSE '' END AS id FROM r),
 f AS (SELECT *, row_number() OVER (PARTITION BY finding, lower(name) ORDER BY k) AS q FROM o WHERE name <> '' AND lower(name) NOT IN ('not provided', 'not specified', 'see cases', 'other', 'none provided')),
 g AS (SELECT finding, name, list_sort(list_distinct(list_filter([f.id, x.synonym], lambda y: y IS NOT NULL AND y <> ''))) AS ids FROM f LEFT JOIN x ON f.id = x.id WHERE q = 1),
 h AS (SELECT g.*, (SELECT arg_min(m.modes, m.id) FROM m WHERE list_contains(g.ids, m.id)) AS known FROM g)
 SELECT finding, name, ids, coalesce(known, CASE WHEN lower(name) LIKE '%autosomal dominant%' THEN ['AD'] WHEN lower(name) LIKE '%autosomal recessive%' THEN ['AR'] WHEN lower(name) LIKE '%x-linked recessive%' THEN ['XLR'] WHEN lower(name) LIKE '%x-linked%' THEN ['XL'] ELSE [] END) AS modes FROM h""")
def _(t):
    d = read(t, DISEASES).select("disease_id").distinct().filter("disease_id < 'D5'")
    return M.resolve_conditions(read(t, CASES), d.select(c("disease_id").alias("id"), F.concat(F.lit("S"), "disease_id").alias("synonym")), _modes(t)).select("finding", "name", "ids", "modes")


@query("gene_inheritance", f"""WITH d AS ({DISEASES}), v AS ({VALIDITY}), m AS ({_MODES}), k AS (SELECT *, CASE classification WHEN 'Definitive' THEN 5 WHEN 'Strong' THEN 4 WHEN 'Moderate' THEN 3 WHEN 'Limited' THEN 2 WHEN 'Disputed' THEN 1 END AS r FROM v),
 a AS (SELECT gene, m.modes[1] AS mode FROM d JOIN m ON d.disease_id = m.id WHERE association <> 'POLYGENIC' UNION SELECT gene, CASE WHEN mode_text ILIKE 'semi%' THEN 'SD' WHEN mode_text ILIKE 'autosomal dominant%' THEN 'AD' WHEN mode_text ILIKE 'autosomal recessive' OR mode_text = 'AR' THEN 'AR' WHEN mode_text = 'X-linked recessive' THEN 'XLR' WHEN mode_text = 'x-linked dominant form' THEN 'XLD' WHEN mode_text = 'X-linked' THEN 'XL' WHEN mode_text ILIKE 'y-%' THEN 'YL' WHEN mode_text = 'Mitochondrial' THEN 'MT' WHEN mode_text = 'Multifactorial' THEN 'MF' WHEN mode_text = 'Digenic' THEN 'DG' WHEN mode_text = 'Sporadic' THEN 'SP' END FROM k WHERE r >= 3),
 x AS (SELECT gene, list_sort(list(DISTINCT mode)) AS modes FROM a WHERE mode IS NOT NULL GROUP BY 1), y AS (SELECT gene, arg_max(classification, r) AS validity FROM k WHERE r IS NOT NULL GROUP BY 1) SELECT coalesce(x.gene, y.gene) AS gene, modes, validity FROM x FULL JOIN y ON x.gene = y.gene""")
def _(t):
    return M.gene_inheritance(read(t, DISEASES), _modes(t), read(t, VALIDITY))


@query("best_actionability", f"""WITH r AS ({RATINGS}), e AS (SELECT *, list_filter([trim(x) FOR x IN string_split(genes, ',')], lambda x: x <> '') AS gs, try_cast(regexp_extract(overall, '^([0-9]+)', 1) AS INT) AS score FROM r), u AS (SELECT *, len(gs) AS n, unnest(gs) AS gene, CASE trim(likelihood) WHEN '3A' THEN 40 WHEN '2 B' THEN 5 WHEN '2D' THEN 5 WHEN '1N' THEN 1 WHEN '0' THEN 0 END AS low FROM e WHERE score IS NOT NULL),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY context, score DESC, rating_id DESC) AS k FROM u) WHERE k = 1), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY context, score DESC, rating_id DESC) AS k FROM u WHERE n = 1 AND low IS NOT NULL) WHERE k = 1)
 SELECT b.gene, b.context, b.score, s.low AS penetrance_low, CASE WHEN s.low IS NULL THEN b.n - 1 ELSE 0 END::INT AS others FROM b LEFT JOIN s USING (gene)""")
def _(t):
    return M.best_actionability(read(t, RATINGS))


@query("supported_conditions", f"""WITH s AS ({SUBS}), e AS (SELECT variation_id, list_distinct(list_filter([lower(trim(x)) FOR x IN string_split(named, ';')], lambda x: x <> 'not provided')) AS ns FROM s WHERE cls <> 'benign'), u AS (SELECT variation_id, unnest(ns) AS condition FROM e WHERE len(ns) BETWEEN 1 AND 2),
 n AS (SELECT variation_id, condition, count(*) AS labs FROM u GROUP BY 1, 2) SELECT *, labs >= 0.2 * max(labs) OVER (PARTITION BY variation_id) AS kept FROM n""")
def _(t):
    return M.supported_conditions(read(t, SUBS).withColumn("conditions", F.split("named", ";")))


@query("lift_positions", f"""WITH p AS ({POINTS}), b AS ({BLOCKS}), j AS (SELECT p.*, b.*, row_number() OVER (PARTITION BY point_id ORDER BY rank, t_start) AS k FROM p JOIN b ON p.chrom = b.chrom AND t_start <= pos - 1 AND t_end >= pos - 1 + length)
 SELECT p.point_id, j.q_chrom, CASE j.strand WHEN '+' THEN j.q_start + p.pos - j.t_start ELSE j.q_size - (j.q_start + p.pos - 1 - j.t_start) - p.length + 1 END AS q_pos, j.strand FROM p LEFT JOIN j ON j.point_id = p.point_id AND j.k = 1""")
def _(t):
    return M.lift_positions(read(t, POINTS), read(t, BLOCKS))


@query("align_panel", f"""WITH p AS ({PANEL}), s AS ({PANEL_SITES}), q AS (SELECT chrom_order, pos FROM (SELECT DISTINCT chrom_order, pos, a1, a2 FROM p) GROUP BY 1, 2 HAVING count(*) = 1), j AS (SELECT p.*, s.ref, s.alt, CASE s.strand WHEN '-' THEN translate(a1, 'ACGT', 'TGCA') ELSE a1 END AS x, CASE s.strand WHEN '-' THEN translate(a2, 'ACGT', 'TGCA') ELSE a2 END AS y FROM p JOIN q USING (chrom_order, pos) JOIN s USING (chrom_order, pos))
 SELECT chrom_order, pos, sample, CASE WHEN x = alt THEN dosage ELSE 2 - dosage END AS copies FROM j WHERE (ref || alt) NOT IN ('AT', 'TA', 'CG', 'GC') AND ((x = alt AND y = ref) OR (x = ref AND y = alt))""")
def _(t):
    return M.align_panel(read(t, PANEL_SITES), read(t, PANEL))


@query("audit_compare", f"""WITH s AS ({STORED}), l AS ({LIVE}) SELECT s.id, CASE WHEN l.id IS NULL THEN 'missing' WHEN s.value IS NOT DISTINCT FROM l.value OR abs(s.value - l.value) <= 0.01 * greatest(abs(s.value), abs(l.value)) THEN 'ok' WHEN evaluated > DATE '2025-06-30' THEN 'changed_upstream' ELSE 'mismatch' END AS status FROM s LEFT JOIN l USING (id)""")
def _(t):
    return M.audit_compare(read(t, STORED), read(t, LIVE), "2025-06-30")


@query("immune_type_rules", f"""WITH y AS ({TYPED}), r AS ({RULES}), n AS (SELECT rule_id, kind, unnest(string_split(joined, ',')) AS prefix, len(string_split(joined, ',')) AS need FROM r),
 h AS (SELECT s.sample, n.*, split_part(prefix, '*', 1) AS gene, (SELECT list(split_part(prefix, '*', 1) || '*' || y.allele) FROM y WHERE y.sample = s.sample AND y.gene = split_part(prefix, '*', 1) AND (y.allele || ':') LIKE split_part(prefix, '*', 2) || ':%') AS hit,
  (SELECT min(quality) FROM y WHERE y.sample = s.sample AND y.gene = split_part(prefix, '*', 1) AND (y.allele || ':') LIKE split_part(prefix, '*', 2) || ':%') AS lh, (SELECT min(quality) FROM y WHERE y.sample = s.sample AND y.gene = split_part(prefix, '*', 1)) AS la FROM (SELECT DISTINCT sample FROM y) s, n),
 g AS (SELECT sample, rule_id, kind, need, count(la) AS typed, count(hit) AS met, list_sort(list_distinct(coalesce(flatten(list(hit) FILTER (hit IS NOT NULL)), []))) AS carried, min(lh) AS lh, min(la) AS la FROM h GROUP BY ALL)
 SELECT sample, rule_id, CASE kind WHEN 'haplotype' THEN met = need WHEN 'rule_out' THEN met = 0 ELSE met > 0 END AS notable, carried, CASE WHEN coalesce(lh, la) < 20 THEN 'Medium' ELSE 'High' END AS call FROM g WHERE typed > 0 AND (kind = 'risk' OR typed = need)""")
def _(t):
    return M.type_match(read(t, TYPED), read(t, RULES).withColumn("alleles", F.split("joined", ",")))
