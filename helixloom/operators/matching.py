"""Joins of findings to what is known: conditions, genes, lifted positions, panels, live records and immune types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import complement
from ..functions.clinical import FILLER, inheritance_code, inheritance_cues, penetrance
from ..functions.evidence import VALIDITY_RANK
from .intervals import overlaps

#: Share of the best support that a condition needs, conditions a submission may name to count.
SUPPORT_SHARE, MOST_NAMED = 0.2, 2
MIN_TYPE_QUALITY = 20


def resolve_conditions(named: DataFrame, xrefs: DataFrame, modes: DataFrame) -> DataFrame:
    """(finding, name, ids, modes): conditions of findings (finding, names, ids), both texts parted by bars and matched by place
    if there are as many of each. xrefs (id, synonym) adds an id's synonyms; modes (id, source_rank, modes) gives inheritance,
    the lowest rank first, else the name's own cue. Fillers and repeats of a name go."""
    names, ids = F.split("names", r"\|"), F.split(F.coalesce("ids", F.lit("")), r"\|")
    matched = F.when(F.size(names) == F.size(ids), ids).otherwise(F.array_repeat(F.lit(""), F.size(names)))
    rows = named.select("finding", F.posexplode(F.arrays_zip(names.alias("name"), matched.alias("id"))).alias("k", "c"))
    rows = rows.select("finding", "k", F.trim("c.name").alias("name"), F.trim("c.id").alias("id")).filter((F.col("name") != "") & ~F.lower("name").isin(*FILLER))
    one = rows.groupBy("finding", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "id"), "k").alias("c")).select("finding", "c.name", "c.id")
    known = one.join(xrefs.select("id", "synonym"), "id", "left")
    every = known.groupBy("finding", "name").agg(F.array_sort(F.array_distinct(F.filter(F.array_compact(F.concat(F.collect_set("id"), F.collect_set("synonym"))), lambda x: x != ""))).alias("ids"))
    found = every.select("finding", "name", F.explode("ids").alias("id")).join(modes, "id").groupBy("finding", "name").agg(F.min_by("modes", F.struct("source_rank", "id")).alias("modes"))
    return every.join(found, ["finding", "name"], "left").withColumn("modes", F.coalesce("modes", inheritance_cues(F.col("name"))))


def gene_inheritance(diseases: DataFrame, modes: DataFrame, validity: DataFrame) -> DataFrame:
    """(gene, modes, validity): modes of a gene's diseases (gene, disease_id, association), where the association is causal, and
    of its ratings (gene, classification, mode_text) from Moderate up; the best rating."""
    causal = diseases.filter((F.col("association") == "MENDELIAN") | F.col("association").startswith("Disease-causing"))
    of_disease = causal.join(modes, F.col("disease_id") == F.col("id")).select("gene", F.explode("modes").alias("mode"))
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in VALIDITY_RANK.items() for x in kv]), F.col("classification"))
    rated = validity.withColumn("rank", rank)
    of_rating = rated.filter("rank >= 3").select("gene", inheritance_code(F.col("mode_text")).alias("mode")).filter("mode IS NOT NULL")
    best = rated.filter("rank IS NOT NULL").groupBy("gene").agg(F.max_by("classification", F.struct("rank", "classification")).alias("validity"))
    every = of_disease.unionByName(of_rating).groupBy("gene").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    return every.join(best, "gene", "full_outer")


def best_actionability(ratings: DataFrame) -> DataFrame:
    """(gene, context, score, penetrance_low, others): the rating that counts for a gene, adults before children, then the
    higher score; a band of penetrance only from ratings of that gene alone, else how many others were rated with it."""
    genes = F.filter(F.transform(F.split("genes", ","), lambda g: F.trim(g)), lambda g: g != "")
    r = ratings.withColumns({"list": genes, "score": F.regexp_extract("overall", "^([0-9]+)", 1).try_cast("int")}).filter("score IS NOT NULL")
    rows = r.select("context", "score", "rating_id", F.size("list").alias("n"), penetrance(F.col("likelihood"))["low"].alias("low"), F.explode("list").alias("gene"))
    order = F.struct((F.col("context") == "Adult").alias("adult"), "score", "rating_id")
    own = (F.col("n") == 1) & F.col("low").isNotNull()
    best = rows.groupBy("gene").agg(F.max_by(F.struct("context", "score", "n"), order).alias("b"), F.max_by("low", F.when(own, order)).alias("penetrance_low"))
    return best.select("gene", "b.context", "b.score", "penetrance_low", F.when(F.col("penetrance_low").isNull(), F.col("b.n") - 1).otherwise(0).alias("others"))


def supported_conditions(submissions: DataFrame) -> DataFrame:
    """(variation_id, condition, labs, kept): votes of submissions (variation_id, cls, conditions array) that call a variant
    pathogenic and name at most MOST_NAMED conditions; kept are those with SUPPORT_SHARE of the best one's votes."""
    names = F.array_distinct(F.filter(F.transform("conditions", lambda c: F.lower(F.trim(c))), lambda c: ~c.isin(*FILLER) & (c != "")))
    votes = submissions.filter(F.col("cls").isin("pathogenic", "likely_pathogenic")).withColumn("names", names).filter(F.size("names").between(1, MOST_NAMED))
    n = votes.select("variation_id", F.explode("names").alias("condition")).groupBy("variation_id", "condition").agg(F.count("*").alias("labs"))
    top = n.groupBy("variation_id").agg(F.max("labs").alias("top"))
    return n.join(top, "variation_id").select("variation_id", "condition", "labs", (F.col("labs") >= SUPPORT_SHARE * F.col("top")).alias("kept"))


def lift_positions(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (point_id, chrom, pos, length; 1-based) on another build, by aligned blocks (chrom, t_start, t_end, q_chrom, q_start,
    q_size, strand, rank; 0-based): the block of the best rank that holds the whole span; null where none does."""
    spans = points.select("point_id", "chrom", (F.col("pos") - 1).alias("s"), (F.col("pos") - 1 + F.col("length")).alias("e"), "length")
    hit = overlaps(spans, blocks, ["chrom"], ("s", "e"), ("t_start", "t_end")).filter("t_start <= s AND t_end >= e")
    best = hit.groupBy("point_id", "s", "length").agg(F.min_by(F.struct("q_chrom", "q_start", "q_size", "strand", "t_start"), F.struct("rank", "t_start")).alias("b"))
    q = F.col("b.q_start") + F.col("s") - F.col("b.t_start")
    at = F.when(F.col("b.strand") == "-", F.col("b.q_size") - q - F.col("length") + 1).otherwise(q + 1)
    told = best.select("point_id", F.col("b.q_chrom").alias("q_chrom"), at.cast("int").alias("q_pos"), F.col("b.strand").alias("strand"))
    return points.select("point_id").join(told, "point_id", "left")


def alignment_sign(ref: Column, alt: Column, strand: Column, a1: Column, a2: Column) -> Column:
    """1 if a panel's first letter is the site's alternative, -1 if it is the reference, 0 if neither fits or the letters are
    the same on both strands."""
    x, y = F.when(strand == "-", complement(a1)).otherwise(a1), F.when(strand == "-", complement(a2)).otherwise(a2)
    return F.when(alt == complement(ref), 0).when((x == alt) & (y == ref), 1).when((x == ref) & (y == alt), -1).otherwise(0)


def align_panel(sites: DataFrame, panel: DataFrame) -> DataFrame:
    """(chrom_order, pos, sample, copies) of the sites' alternative letter, from panel rows (chrom_order, pos, a1, a2, sample, dosage
    of a1): positions that the panel lists more than once, and letters that do not fit, are left out; missing stays missing."""
    once = panel.select("chrom_order", "pos", "a1", "a2").distinct().groupBy("chrom_order", "pos").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    j = panel.join(once, ["chrom_order", "pos"], "left_semi").join(sites, ["chrom_order", "pos"])
    j = j.withColumn("sign", alignment_sign(F.col("ref"), F.col("alt"), F.col("strand"), F.col("a1"), F.col("a2"))).filter("sign <> 0")
    return j.select("chrom_order", "pos", "sample", F.when(F.col("sign") == 1, F.col("dosage")).otherwise(2 - F.col("dosage")).alias("copies"))


def audit_compare(stored: DataFrame, live: DataFrame, snapshot: str, tolerance: float = 0.01) -> DataFrame:
    """(id, status): stored values against live ones (id, value, evaluated): ok within a relative tolerance, changed upstream if the
    live record was evaluated after the snapshot, else mismatch; missing if there is no live record."""
    j = stored.select("id", F.col("value").alias("a")).join(live.select("id", F.col("value").alias("b"), "evaluated", F.lit(True).alias("there")), "id", "left")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.abs("a"), F.abs("b")), F.lit(False))
    later = F.coalesce(F.col("evaluated") > F.lit(snapshot).cast("date"), F.lit(False))
    return j.select("id", F.when(F.col("there").isNull(), "missing").when(same, "ok").when(later, "changed_upstream").otherwise("mismatch").alias("status"))


def type_match(typed: DataFrame, rules: DataFrame) -> DataFrame:
    """(sample, rule_id, notable, carried, call): immune types (sample, gene, allele, quality) against rules (rule_id, kind, alleles).
    An allele fits a rule's prefix at a field's end. haplotype: all must be carried; rule_out: none; else any. Rules of the
    first two kinds say nothing where a gene that they need was not typed."""
    need = rules.select("rule_id", "kind", F.size("alleles").alias("n_alleles"), F.explode("alleles").alias("prefix"))
    need = need.select("rule_id", "kind", "n_alleles", "prefix", F.split_part("prefix", F.lit("*"), F.lit(1)).alias("gene"), F.split(F.split_part("prefix", F.lit("*"), F.lit(2)), ":").alias("want"))
    samples = typed.select("sample").distinct()
    own = typed.groupBy("sample", "gene").agg(F.collect_list(F.struct("allele", "quality")).alias("have"))  # two alleles of a gene
    j = samples.join(need.join(own, "gene", "left").select("rule_id", "kind", "n_alleles", "prefix", "gene", "want", F.col("sample").alias("s"), "have"), F.col("s") == F.col("sample"))
    fits = F.filter("have", lambda h: F.slice(F.split(h["allele"], ":"), 1, F.size("want")) == F.col("want"))
    j = j.withColumn("hit", fits)
    g = j.groupBy("sample", "rule_id", "kind", "n_alleles").agg(
        F.count("*").alias("typed"),
        F.count(F.when(F.size("hit") > 0, 1)).alias("met"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("hit", lambda h: F.concat(F.col("gene"), F.lit("*"), h["allele"])))))).alias("carried"),
        F.min(F.array_min(F.transform(F.when(F.size("hit") > 0, F.col("hit")), lambda h: h["quality"]))).alias("low_hit"),
        F.min(F.array_min(F.transform("have", lambda h: h["quality"]))).alias("low_any"),
    )
    g = g.filter(~F.col("kind").isin("haplotype", "rule_out") | (F.col("typed") == F.col("n_alleles")))
    notable = F.when(F.col("kind") == "haplotype", F.col("met") == F.col("n_alleles")).when(F.col("kind") == "rule_out", F.col("met") == 0).otherwise(F.col("met") > 0)
    return g.select("sample", "rule_id", notable.alias("notable"), "carried", F.when(F.coalesce("low_hit", "low_any") < MIN_TYPE_QUALITY, "Medium").otherwise("High").alias("call"))
