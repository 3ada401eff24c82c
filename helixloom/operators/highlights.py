"""What stands out among a person's results: eleven rules over whichever result tables there are.

A rule is a filter and a projection onto one set of columns; a table that is missing contributes nothing. Tables have a
person each row belongs to, results are ranked within the person: best grade, then the order of kinds, then the title.

Defined results: no table at all gives no rows; a missing column of a table counts as null; null flags count as false; a null percentile,
share or status is not notable; repeated rows are listed as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .findings import highlights

#: Percentiles from either end, the share of people below which a genotype is uncommon, phenotypes that are not the
#: usual one, statuses of genes and repeats that say nothing is wrong, or nothing at all.
EXTREME, UNCOMMON = 5, 0.25
NOT_NORMAL = ("poor", "intermediate", "decreased", "increased", "rapid", "ultrarapid", "positive")
QUIET_GENES, LOUD_REPEATS = ("typical", "not_determined"), ("intermediate", "disease_range")
GOOD = ("Strong", "Moderate")
SOURCES = "array<struct<source:string,record:string,url:string>>"
COLUMNS = {"person": "long", "kind": "string", "kind_label": "string", "section": "string", "title": "string", "statement": "string", "notable_because": "string", "overall": "string", "evidence_level": "string",
           "call_level": "string", "ref_table": "string", "ref_key": "string", "sensitive": "boolean", "extra": "string", "sources": SOURCES}
#: What the rules read of each table, and of what type a column is that a table lacks.
INPUTS = {
    "claims": "person long, claim_id string, section string, grp string, gene string, subject string, statement string, evidence_reasons array<string>, category_label string, overall string, evidence_level string, call_level string, sensitive boolean, sources " + SOURCES,
    "pgx_genes": "person long, gene string, phenotype string, phenotype_class string, overall string, evidence_level string, call_level string",
    "pgx_drugs": "person long, drug string, source string, tier string, matched boolean, genes array<string>",
    "hla_associations": "person long, association_id string, condition string, statement string, kind string, markers string, direction string, notable boolean, overall string, evidence_level string, call_level string, quotes " + SOURCES,
    "pgs_traits": "person long, trait_id string, section string, label string, agreement string, agreement_text string, percentile double, overall string, evidence_level string, call_confidence string, abs_risk string, risk_pgs_id string, best_pgs_id string",
    "trait_snps": "person long, rsid string, label string, effect_text string, genotype_share double, pmid string, overall string, evidence_level string, call_confidence string",
    "special_genes": "person long, gene string, statement string, tool string, status string, overall string, evidence_level string, call_level string, sources " + SOURCES,
    "repeats": "person long, locus_id string, gene string, disease string, status string, overall string, evidence_level string, call_level string, sensitive boolean, url string",
    "cnv_events": "person long, event_id string, genes array<string>, status string, overall string, evidence_level string, call_level string",
}


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns that the rules read; what it lacks is null."""
    parts = [x.strip().split(" ", 1) for x in _fields(INPUTS[name])]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in parts])


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _row(df: DataFrame, kind: str, label: str, table: str, key: str, **told: Column) -> DataFrame:
    """Rows of the common columns; what is not told is null, grades are taken over as they are."""
    fixed = {"kind": F.lit(kind), "kind_label": F.lit(label), "ref_table": F.lit(table), "ref_key": F.col(key), "sensitive": F.lit(False), "overall": F.col("overall"), "evidence_level": F.col("evidence_level"), "person": F.col("person")}
    values = fixed | told
    return df.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _source(name: str, record: Column, url: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("source"), record.alias("record"), url.alias("url")))


def percentile_place(p: Column) -> Column:
    """In words: the 3rd percentile, below the 1st, above the 99th."""
    n = F.round(p).cast("int")
    ending = F.when((n % 100).between(11, 13), "th").otherwise(F.coalesce(F.try_element_at(F.array(F.lit("st"), F.lit("nd"), F.lit("rd")), F.nullif(n % 10, F.lit(0))), F.lit("th")))
    place = F.when(p < 0.5, "below the 1st").when(p > 99.5, "above the 99th").otherwise(F.concat(F.lit("the "), n.cast("string"), ending))
    return F.concat(place, F.lit(" percentile"))


def _of_claims(c: DataFrame) -> list[DataFrame]:
    first = F.coalesce(F.get("evidence_reasons", F.lit(0)), "category_label")
    health, grp = F.col("section") == "health", F.col("grp")
    rules = [
        ("monogenic", "One gene", "health", health & (grp == "monogenic")),
        ("carrier", "Carrier", "carrier", F.col("section") == "carrier"),
        ("risk", "Raised risk", "health", health & (grp == "risk") & F.col("overall").isin(*GOOD)),
        ("predicted", "Predicted only", "health", health & (grp == "predicted")),
    ]
    return [_row(c.filter(where), kind, label, "claims", "claim_id", section=F.lit(section), title=F.coalesce("gene", "subject"), statement=F.col("statement"), notable_because=first, call_level=F.col("call_level"), sensitive=F.coalesce("sensitive", F.lit(False)), sources=F.col("sources")) for kind, label, section, where in rules]


def _of_medicine_genes(g: DataFrame, drugs: DataFrame, claims: DataFrame) -> DataFrame:
    """A gene with an unusual phenotype, the number of medicines whose matching guideline asks for a change, and its finding's words."""
    asked = drugs.filter((F.col("tier") == "change") & F.col("matched") & F.col("source").isin("CPIC", "DPWG")).select("person", "drug", F.explode("genes").alias("gene"))
    changed = asked.groupBy("person", "gene").agg(F.count_distinct("drug").alias("changed"))
    own = claims.filter("grp = 'pgx_gene'").groupBy("person", "gene").agg(F.min(F.struct("statement", "sources")).alias("own"))
    j = g.filter(F.col("phenotype_class").isin(*NOT_NORMAL)).join(changed, ["person", "gene"], "left").join(own, ["person", "gene"], "left")
    n = F.coalesce("changed", F.lit(0))
    advice = F.when(n > 0, F.concat(F.lit(", medicines to change: "), n.cast("string"))).otherwise("")
    return _row(j, "pgx", "Gene of medicines", "pgx_genes", "gene", section=F.lit("pgx"), title=F.col("gene"), statement=F.coalesce("own.statement", "phenotype"), notable_because=F.concat("phenotype", advice), call_level=F.col("call_level"), sources=F.col("own.sources"))


def branches(spark: SparkSession, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """One table for each rule whose input is there."""
    c, lit = F.col, F.lit
    t = {name: conformed(df, name) for name, df in tables.items() if name in INPUTS}
    empty = lambda name: spark.createDataFrame([], INPUTS[name])
    out = _of_claims(t["claims"]) if "claims" in t else []
    if "pgx_genes" in t:
        out.append(_of_medicine_genes(t["pgx_genes"], t.get("pgx_drugs", empty("pgx_drugs")), t.get("claims", empty("claims"))))
    if "hla_associations" in t:
        why = F.when(c("kind") == "rule_out", F.concat(lit("Does not carry "), "markers")).otherwise(F.concat(lit("Carries the type of a "), "direction", lit(" association")))
        out.append(_row(t["hla_associations"].filter("notable"), "hla", "Immune type", "hla_associations", "association_id", section=lit("health"), title=c("condition"), statement=c("statement"), notable_because=why, call_level=c("call_level"), sources=c("quotes")))
    if "pgs_traits" in t:
        p = c("percentile")
        extreme = (F.coalesce("section", lit("")) != "") & ((p <= EXTREME) | (p >= 100 - EXTREME)) & (F.coalesce("agreement", lit("")) != "disagree")
        why = F.concat(F.when(p >= 50, "Highest").otherwise("Lowest"), lit(f" {EXTREME} of 100, median of studies: "), percentile_place(p))
        score = F.coalesce("risk_pgs_id", "best_pgs_id")
        out.append(_row(t["pgs_traits"].filter(extreme), "pgs", "Score of many variants", "pgs_traits", "trait_id", section=c("section"), title=c("label"), statement=c("agreement_text"), notable_because=why, call_level=c("call_confidence"), extra=c("abs_risk"), sources=_source("pgs_catalog", score, F.concat(lit("https://www.pgscatalog.org/score/"), score, lit("/")))))
    if "trait_snps" in t:
        why = F.concat(lit("Genotype of "), F.round(c("genotype_share") * 100).cast("int").cast("string"), lit(" people in 100"))
        shared = (c("genotype_share") < UNCOMMON) & c("overall").isin(*GOOD)
        out.append(_row(t["trait_snps"].filter(shared), "trait", "Trait of one variant", "trait_snps", "rsid", section=lit("traits"), title=c("label"), statement=c("effect_text"), notable_because=why, call_level=c("call_confidence"), sources=_source("gwas_catalog", F.concat(lit("PMID "), "pmid"), F.concat(lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", lit("/")))))
    if "special_genes" in t:
        why = F.concat(lit("Read again by "), F.coalesce("tool", lit("a caller of its own")))
        out.append(_row(t["special_genes"].filter(~c("status").isin(*QUIET_GENES)), "special", "Gene read apart", "special_genes", "gene", section=lit("carrier"), title=c("gene"), statement=c("statement"), notable_because=why, call_level=c("call_level"), sources=c("sources")))
    if "repeats" in t:
        why = F.concat(lit("Length class: "), F.replace("status", lit("_"), lit(" ")))
        out.append(_row(t["repeats"].filter(c("status").isin(*LOUD_REPEATS)), "repeat", "Repeat", "repeats", "locus_id", section=lit("health"), title=F.coalesce("gene", "locus_id"), statement=c("disease"), notable_because=why, call_level=c("call_level"), sensitive=F.coalesce("sensitive", lit(False)), sources=_source("strchive", c("locus_id"), F.coalesce("url", lit("")))))
    if "cnv_events" in t:
        why = lit("Breakpoints and depth agree, seldom seen in others")
        out.append(_row(t["cnv_events"].filter(c("status").startswith("possible_")), "cnv", "Copies of exons", "cnv_events", "event_id", section=lit("health"), title=F.array_join("genes", ", "), statement=F.replace("status", lit("_"), lit(" ")), notable_because=why, call_level=c("call_level"), sensitive=lit(True)))
    return out


def highlighted(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """All highlights with their id and rank; no rows where there is no table."""
    found = branches(spark, tables)
    return highlights(*found) if found else spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", highlight_id string, rank int")
