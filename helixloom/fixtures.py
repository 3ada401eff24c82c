"""Projections of the driver's star-schema tables into the shapes that the operators take.

The tables hold no genetics; each projection maps keys and quantities to alleles, intervals, reads, genes, scores and
claims by integer arithmetic, so that both engines get the same values. Names in braces are tables or projections.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.storage import stored

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str] = {
    "fx_variants": """
SELECT chrom_order,
  CASE chrom_order WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST(chrom_order + 1 AS STRING) END AS chrom,
  pos, ref, alt, filter, gt, gq, dp, ad_alt
FROM (
  SELECT CAST(l_suppkey % 25 AS INT) AS chrom_order,
    CAST(l_partkey * 100 + l_linenumber * 7 AS INT) AS pos,
    CASE WHEN l_linenumber = 7 THEN substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) || 'CA'
         ELSE substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) END AS ref,
    CASE WHEN l_linenumber = 7 THEN substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1)
         WHEN l_linenumber = 6 THEN substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) || 'TG'
         ELSE substr('ACGT', CAST(1 + (l_orderkey + 1 + l_linenumber % 3) % 4 AS INT), 1) END AS alt,
    CASE WHEN l_discount > 0.095 THEN 'NoCall'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'RefCall' ELSE 'PASS' END AS filter,
    CASE WHEN l_discount > 0.095 THEN './.'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '0/0'
         WHEN l_orderkey % 10 < 6 THEN '0/1' ELSE '1/1' END AS gt,
    CAST(l_quantity AS INT) AS gq,
    CAST(5 + l_orderkey % 40 AS INT) AS dp,
    CAST(2 + l_orderkey % 20 AS INT) AS ad_alt,
    row_number() OVER (PARTITION BY l_suppkey % 25, l_partkey * 100 + l_linenumber * 7, l_linenumber, l_orderkey % 4
      ORDER BY l_orderkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k
  FROM {lineitem}) x
WHERE k = 1""",
    "fx_intervals": """
SELECT CAST(user_id % 25 AS INT) AS chrom_order,
  CAST((event_id * 37) % 200000 AS INT) AS start_pos,
  CAST((event_id * 37) % 200000 + 50 + floor(value) AS INT) AS end_pos,
  CASE event_type WHEN 'click' THEN 'CALLABLE' WHEN 'view' THEN 'CALLABLE' WHEN 'purchase' THEN 'LOW_5_9'
    WHEN 'signup' THEN 'LOW_1_4' ELSE 'NO_COVERAGE' END AS state
FROM {events}""",
    "fx_reads": """
SELECT event_id AS read_id, CAST(user_id % 25 AS INT) AS chrom_order,
  CAST((event_id * 37) % 200000 AS INT) AS start_pos,
  CAST((event_id % 2) * 16 + CASE WHEN event_id % 17 = 0 THEN 1024 WHEN event_id % 19 = 0 THEN 4 WHEN event_id % 23 = 0 THEN 256 WHEN event_id % 29 = 0 THEN 512 WHEN event_id % 31 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
  CAST(event_id % 61 AS INT) AS mapq, CASE event_id % 5 WHEN 0 THEN '50M4D46M4S' WHEN 1 THEN '48M2I2D50M' ELSE '100M' END AS cigar,
  substr(repeat('ACGT', 30), CAST(1 + event_id % 4 AS INT), 100) AS seq,
  repeat(substr('!5?I', CAST(1 + event_id % 4 AS INT), 1), 100) AS qual
FROM {events}""",
    "fx_genes": """
SELECT 'G' || CAST(p_partkey % 500 AS STRING) AS symbol, p_partkey AS gene_id,
  CAST(p_partkey % 25 AS INT) AS chrom_order, CAST(p_partkey * 100 AS INT) AS start_pos,
  CAST(p_partkey * 100 + p_size * 40 AS INT) AS end_pos,
  CASE WHEN p_size % 3 = 0 THEN 'lincRNA' ELSE 'protein_coding' END AS biotype
FROM {part}""",
    "fx_known": """
SELECT chrom_order, pos, ref, alt, CAST(pos AS BIGINT) AS variation_id,
  CASE pos % 9 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Uncertain_significance'
    WHEN 3 THEN 'Benign' WHEN 4 THEN 'Conflicting_classifications_of_pathogenicity' WHEN 5 THEN 'drug_response'
    WHEN 6 THEN 'risk_factor' WHEN 7 THEN 'association' ELSE NULL END AS significance,
  CAST(pos % 5 AS INT) AS stars,
  CASE WHEN gq % 3 = 0 THEN NULL ELSE CAST(pos % 1000 AS DOUBLE) / 1000 END AS af_1kg,
  CASE WHEN gq % 4 = 0 THEN -1.0E0 ELSE CAST(pos % 997 AS DOUBLE) / 9970 END AS popmax_raw,
  CASE WHEN dp % 11 = 0 THEN '1' ELSE '.' END AS flag_raw,
  CASE WHEN pos % 9 <> 4 THEN NULL WHEN pos % 2 = 0 THEN 'Likely_pathogenic(2)|Benign(' || CAST(1 + pos % 5 AS STRING) || ')' ELSE 'Uncertain_significance(3)|Likely_benign (1)' END AS conflicts,
  'G' || CAST(pos % 500 AS STRING) AS gene
FROM {fx_variants} WHERE (pos + chrom_order) % 3 = 0""",
    "fx_provider": """
SELECT 'rs' || CAST(pos AS STRING) AS rsid, chrom_order, pos,
  CASE WHEN dp = 7 THEN alt || alt WHEN gt = '0/1' THEN ref || alt WHEN gt = '1/1' THEN alt || alt ELSE ref || ref END AS genotype,
  CAST(gq % 2 AS INT) AS file_rank
FROM {fx_variants} WHERE length(ref) = 1 AND length(alt) = 1 AND chrom_order % 2 = 0""",
    "fx_csq": """
SELECT v.chrom_order, v.pos, v.ref, v.alt, t.t AS tx_no,
  CASE (v.pos + t.t) % 23 WHEN 0 THEN 'missense' WHEN 1 THEN 'synonymous' WHEN 2 THEN 'stop_gained&splice_region' WHEN 3 THEN 'intron'
    WHEN 4 THEN 'frameshift' WHEN 5 THEN 'non_coding' WHEN 6 THEN 'splice_acceptor' WHEN 7 THEN 'splice_donor'
    WHEN 8 THEN 'start_lost' WHEN 9 THEN 'stop_lost' WHEN 10 THEN 'inframe_deletion' WHEN 11 THEN
    'inframe_insertion' WHEN 12 THEN 'inframe_altering' WHEN 13 THEN 'splice_region' WHEN 14 THEN 'stop_retained'
    WHEN 15 THEN 'start_retained' WHEN 16 THEN 'coding_sequence' WHEN 17 THEN 'feature_elongation' WHEN 18 THEN
    '5_prime_utr' WHEN 19 THEN '3_prime_utr' WHEN 20 THEN 'intron&non_coding' WHEN 21 THEN 'missense&start_lost' ELSE 'unheard_of' END AS csq,
  'G' || CAST((v.pos + t.t) % 500 AS STRING) AS gene,
  CASE WHEN t.t = 1 AND v.dp % 2 = 0 THEN 'MANE Select' ELSE NULL END AS mane,
  CASE WHEN (v.pos + t.t) % 4 = 0 THEN NULL ELSE CASE v.pos % 9 WHEN 0 THEN '1M>1V'
    WHEN 1 THEN CAST(2 + v.pos % 900 AS STRING) || 'A' ELSE CAST(2 + v.pos % 900 AS STRING) || CASE v.pos % 9 WHEN 2 THEN 'R' WHEN 3 THEN 'R' WHEN 4 THEN '*' WHEN 5 THEN 'RKL' WHEN 6 THEN 'RK' WHEN 7 THEN 'RKLT' ELSE 'RK' END
    || '>' || CAST(2 + v.pos % 900 AS STRING) || CASE v.pos % 9 WHEN 2 THEN 'Q' WHEN 3 THEN '*' WHEN 4 THEN 'W' WHEN 5 THEN 'RL' WHEN 6 THEN 'RQW' WHEN 7 THEN 'RQS*' ELSE 'RKGH' END END END AS aa_change
FROM {fx_variants} v CROSS JOIN (VALUES (1), (2), (3)) AS t(t)
WHERE v.gt IN ('0/1', '1/1') AND v.chrom_order < 10""",
    "fx_weights": """
SELECT 'S' || CAST(p_partkey % 8 AS STRING) AS score_id, CAST(s.s AS INT) AS chrom_order,
  CAST(p_partkey * 100 + (1 + p_partkey % 5) * 7 AS INT) AS pos,
  substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS effect_allele,
  substr('ACGT', CAST(1 + (p_partkey + 1) % 4 AS INT), 1) AS other_allele,
  CAST(p_size - 25 AS INT) AS weight, CAST(p_partkey % 100 AS INT) AS af_pct
FROM {part} CROSS JOIN (VALUES (0), (5), (10), (15), (20)) AS s(s)""",
    "fx_scores": """
SELECT 'PGS' || CAST(o_orderkey AS STRING) AS pgs_id, 'T' || CAST(o_custkey % 200 AS STRING) AS trait_group,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey % 7 AS STRING) END AS pgp_id,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 10 END AS percentile,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST((o_orderkey * 37) % 1001 - 500 AS DOUBLE) / 250 END AS z,
  o_orderstatus <> 'P' AS passed, CAST(o_orderkey % 5 AS INT) AS independent_pubs,
  CAST((o_orderkey * 13) % 50000 AS INT) AS independent_n, o_orderkey % 11 = 0 AS featured
FROM {orders}""",
    "fx_sites": """
SELECT o_orderkey AS site_id, CAST(o_custkey % 25 AS INT) AS chrom_order, CAST(o_orderkey * 11 AS INT) AS pos,
  CASE WHEN o_orderkey % 4 = 0 THEN 'indel' ELSE 'snv' END AS kind,
  CAST(o_orderkey % 31 AS INT) AS ref_reads, CAST((o_orderkey * 7) % 29 AS INT) AS alt_reads,
  CAST(o_orderkey % 16 AS INT) AS ref_fwd_cap, CAST((o_orderkey * 7) % 15 AS INT) AS alt_fwd_cap,
  CAST(o_orderkey % 13 AS INT) AS low_mapq, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS expected, CAST((o_orderkey * 5) % 3 AS INT) AS truth,
  CASE o_orderstatus WHEN 'F' THEN 'tp' WHEN 'O' THEN 'tp_base' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'fp' ELSE 'fn' END END AS label,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'repeat' WHEN '2-HIGH' THEN 'segdup' ELSE NULL END AS reason
FROM {orders}""",
    "fx_claims_old": """
SELECT 'c' || CAST(c_custkey AS STRING) AS claim_id, c_mktsegment AS section, 'G' || CAST(c_custkey % 60 AS STRING) AS gene,
  CASE WHEN c_acctbal < 2000 THEN 'Limited' WHEN c_acctbal < 6000 THEN 'Moderate' ELSE 'Strong' END AS overall,
  CAST(c_custkey % 5 AS INT) AS stars, 'About ' || c_name AS statement
FROM {customer} WHERE c_custkey % 10 <> 0""",
    "fx_claims_new": """
SELECT 'c' || CAST(c_custkey AS STRING) AS claim_id, c_mktsegment AS section, 'G' || CAST(c_custkey % 60 AS STRING) AS gene,
  CASE WHEN c_custkey % 13 = 0 THEN 'Limited' WHEN c_acctbal < 2000 THEN 'Limited' WHEN c_acctbal < 6000 THEN 'Moderate' ELSE 'Strong' END AS overall,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INT) END AS stars,
  CASE WHEN c_custkey % 19 = 0 THEN 'Reworded ' || c_name ELSE 'About ' || c_name END AS statement
FROM {customer} WHERE c_custkey % 10 <> 1""",
    "fx_cohort": """
SELECT p.p_partkey AS site_id, CAST(p.p_partkey % 25 AS INT) AS chrom_order, CAST(p.p_partkey * 100 AS INT) AS pos, CAST(s.s AS INT) AS sample,
  CASE WHEN (p.p_partkey * 31 + s.s * 17) % (10 + p.p_partkey % 40) = 0 THEN NULL
    ELSE CAST(CASE WHEN (p.p_partkey * 7 + s.s * 13 + s.s * s.s) % 10 < p.p_partkey % 7 THEN 1 ELSE 0 END
      + CASE WHEN (p.p_partkey * 11 + s.s * 5 + s.s * s.s * 3) % 10 < p.p_partkey % 7 THEN 1 ELSE 0 END AS INT) END AS dosage
FROM {part} p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19)) AS s(s)""",
    "fx_exons": """
SELECT 'G' || CAST(p_partkey % 60 AS STRING) AS gene, CAST(p_partkey AS INT) AS exon, CAST(p_partkey * 100 AS INT) AS start_pos,
  CAST(p_partkey * 100 + 80 AS INT) AS end_pos, CAST(20 + p_size AS INT) AS gc_pct,
  CAST(CASE WHEN p_partkey % 600 < 180 AND p_partkey % 3 = 0 THEN 50 ELSE 85 + p_size % 30 END AS INT) AS ratio_pct
FROM {part}""",
}


def _pick(by: str, values: list) -> str:
    """CASE over `by` modulo the number of values; None is null."""
    told = ["NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE ({by}) % {len(told)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(told)) + " END"


#: Cases for the column rules: texts and numbers picked by the part's key, so that every branch is met.
CASES = {
    "mode_text": _pick("p_partkey", ["Autosomal dominant inheritance", "autosomal recessive", "AR", "X-linked recessive", "x-linked dominant form", "X-linked", "Y-linked inheritance", "Mitochondrial", "Multifactorial", "Digenic", "Semi-dominant", "Sporadic", "Unknown", None]),
    "conditions": _pick("p_partkey", ["Autosomal dominant deafness 1|not provided", "SEE CASES|X-linked recessive ichthyosis", "beta thing|Alpha thing|beta thing", "X-linked disorder", "Not Specified", "", None, "DIABETES|Autosomal recessive kidneys"]),
    "pen_code": _pick("p_partkey", ["3A", "2 B", "1N", "0", "4A", "", None, " 2D"]),
    "rule": _pick("p_partkey", ["All P and LP", "Only C282Y homozygous", "Biallelic P and LP", "Truncating variants only", None]),
    "copies": "CAST(1 + p_size % 2 AS INT)",
    "zyg": _pick("p_size", ["het", "hom"]),
    "csq": _pick("p_partkey", ["missense", "stop_gained&splice_region", "intron", "frameshift", "missense&splice_region", "start_lost", "synonymous", None]),
    "change": _pick("p_partkey", ["282C>282Y", "7A>7V", None]),
    "am": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 100 AS DOUBLE) / 100 END",
    "revel": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey * 53 % 1000 AS DOUBLE) / 1000 END",
    "loeuf": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 17 AS DOUBLE) / 10 END",
    "popmax": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 20 AS DOUBLE) / 10000 END",
    "af": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 11 AS DOUBLE) / 10 * CAST(p_partkey % 13 AS DOUBLE) / 13 * CAST(p_partkey % 3 AS DOUBLE) / 2 END",
    "flagged": _pick("p_partkey", ["true", "false", "none"]),
    "size": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 30 AS DOUBLE) / 10 END",
    "note": _pick("p_partkey", ["[0.1-0.2] unit increase", "[NR] cm Decrease", "[1.1-1.3]", None]),
    "conflicts": _pick("p_partkey", ["Pathogenic(2)|Benign_(4)", "likely_pathogenic (1)", "odd_text", "", None]),
    "recommendation": _pick("p_partkey", ["Use less", "", None, "Use another"]),
    "classification": _pick("p_partkey", ["Strong", "No Recommendation", "Moderate ", None, "Optional"]),
    "phenotype": _pick("p_partkey", ["Poor Metabolizer", "Ultrarapid Metabolizer", "Rapid Metabolizer", "Normal Function", "Increased risk of something", "HLA positive", "negative", "Deficient", "", None, "Strange", "possible intermediate"]),
    "source": _pick("p_partkey", ["CPIC", "DPWG", "FDA label", "FDA table"]),
    "total": "CAST(p_partkey % 6 AS INT)",
    "missing": "CAST(least(p_partkey % 6, p_partkey % 4) AS INT)",
    "observed": "CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(p_partkey % 3 AS INT) END",
    "non_o": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS INT) END",
    "b_copies": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 3 AS INT) END",
    "ratio": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 200 AS DOUBLE) / 100 END",
    "ratio_all": "CAST((p_partkey + p_size) % 200 AS DOUBLE) / 100",
    "z": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 11 - 5 AS DOUBLE) END",
    "gc": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END",
    "genotype": _pick("p_partkey", ["AG", "DI", "II", "--", "A", "GG", None]),
    "ref": _pick("p_partkey", ["A", "-", "C"]),
    "alt": _pick("p_size", ["G", "-", "AT"]),
    "seq": "repeat('CAG', CAST(p_size % 7 AS INT)) || 'T' || repeat('cag', CAST(p_partkey % 5 AS INT)) || 'A'",
    "count_1": "CAST(p_partkey % 60 AS INT)",
    "count_2": "CAST(p_size AS INT)",
    "upper_1": "CAST(p_partkey % 60 + p_partkey % 9 AS INT)",
    "ref_count": "CAST(15 + p_partkey % 5 AS INT)",
    "pure": "CAST(p_partkey % 20 AS INT)",
    "benign_max": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 26 END",
    "intermediate_min": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 30 END",
    "pathogenic_min": "CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 20 ELSE 36 END",
    "age": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) END",
    "kind": _pick("p_size", ["DEL", "DUP"]),
    "exons": "CAST(p_partkey % 8 AS INT)",
    "level": "CAST(p_partkey % 4 AS INT)",
    "status": _pick("p_partkey", ["confirmed", "weak", "unclear", "disagrees", "not_checkable"]),
    "estimate": _pick("p_partkey", ["0.63 [0.62,0.64]", "1.5", ".7 (0.6-0.8)", "", None, "n = 12, 3"]),
    "quote": _pick("p_partkey", ["a risk of 12.5%", "1 in 8 people", "1,250 per 10,000", "125 in 1,000", "none said", None]),
}
SQL["fx_cases"] = "SELECT p_partkey AS case_id, p_size % 3 = 0 AS yes_3, p_partkey % 2 = 0 AS yes_2, p_partkey % 5 = 0 AS yes_5, " + ", ".join(f"{x} AS {c}" for c, x in CASES.items()) + " FROM {part}"


class Tables:
    """The tables of one folder and the projections over them, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in SQL:
            used = {t: getattr(self, t) for t in (*BASE, *SQL) if "{" + t + "}" in SQL[name]}
            made = self.spark.sql(SQL[name], **used)
        else:
            raise AttributeError(name)
        setattr(self, name, made)
        return made

    def written(self, name: str, more: Callable[[DataFrame], DataFrame] = lambda df: df) -> Tables:
        """These tables with a projection, not used before, worked out once, with more columns, and read from files by all that is made
        of it."""
        setattr(self, name, stored(more(getattr(self, name)), name, last=True))
        return self


def columns_of(name: str) -> list[str]:
    """Column names of a projection, from the last names in its outer list."""
    depth, part, parts = 0, "", []
    head = SQL[name].strip()[len("SELECT") :]
    for c in re.split(r"([(),]|\bFROM\b)", head):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c in (",", "FROM"):
            parts.append(part)
            part = ""
            if c == "FROM":
                break
        else:
            part += c
    return [p.split()[-1].split(".")[-1] for p in parts]


def with_projections(query: str) -> str:
    """DuckDB text of a query over projections: those it names are put before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(SQL[name])
                if name not in order:
                    order.append(name)

    need(query)
    plain = {t: t for t in (*BASE, *SQL)}
    ctes = [f"{n} AS ({SQL[n].format(**plain)})" for n in order]
    if not ctes:
        return query
    head = query.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + head[len("WITH RECURSIVE") :]
    if head.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + head[4:]
    return "WITH " + ",\n".join(ctes) + "\n" + query
