"""Findings after they are graded: re-counts, sources, highlights, medicines, evaluations, and diffs of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions.clinical import recount_cap

#: Kinds of highlights in the order in which they are shown; grades from the best down.
KIND_ORDER = ("monogenic", "special", "cnv", "repeat", "carrier", "pgx", "hla", "risk", "pgs", "trait", "predicted")
GRADES = ("Strong", "Moderate", "Limited")
TIERS = ("none", "standard", "note", "change")


def apply_recount(claims: DataFrame, sites: DataFrame) -> DataFrame:
    """claims (claim_id, key, evidence, call) with call and overall after the re-count of their site (key, status, look_alike,
    one_strand): it lowers, never raises; findings without a site stay."""
    j = claims.join(sites.select("key", "status", "look_alike", "one_strand"), "key", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    call = F.when(F.col("status").isNull(), F.col("call")).otherwise(recount_cap(F.col("call"), F.col("status"), no("look_alike"), no("one_strand")))
    j = j.withColumn("after", call)
    return j.select("claim_id", "status", E.word(F.col("after"), E.CALL).alias("call_level"), E.word(E.overall(F.col("evidence"), F.col("after")), E.OVERALL).alias("overall"))


def sources_of(parts: dict[str, tuple[Column, Column]], versions: dict[str, str]) -> Column:
    """array(struct(source, version, record, url)) of the sources that apply, in the given order: name -> (record, url); a null
    record leaves its source out."""
    rows = [F.when(record.isNotNull(), F.struct(F.lit(name).alias("source"), F.lit(versions.get(name)).alias("version"), record.cast("string").alias("record"), url.alias("url"))) for name, (record, url) in parts.items()]
    return F.array_compact(F.array(*rows))


def union_claims(*claims: DataFrame) -> DataFrame:
    """Findings of several kinds in one table: columns that a kind lacks are null."""
    out = claims[0]
    for c in claims[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def highlights(*branches: DataFrame) -> DataFrame:
    """Branches (kind, title, overall, ref_table, ref_key) in one table with an id and a rank: best grade first, then the order of
    the kinds, then the title. The rank counts over all rows; there are a few for each person."""
    h = union_claims(*branches)
    grade = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("overall")), F.lit(0)), F.lit(4))
    kind = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    h = h.withColumn("highlight_id", F.md5(F.concat_ws(":", "ref_table", "ref_key")))
    rank = F.row_number().over(Window.partitionBy("person").orderBy(grade, kind, "title", "highlight_id"))
    return h.withColumn("rank", rank)


def drug_bucket(rows: DataFrame) -> DataFrame:
    """(drug, bucket, differ): the strongest tier of the matching guidelines of CPIC and DPWG (others never set it), and whether
    those two disagree."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    told = rows.filter(F.col("source").isin("CPIC", "DPWG") & F.col("matched"))
    by = told.groupBy("drug", "source").agg(F.max(rank).alias("r")).groupBy("drug").agg(F.max("r").alias("r"), (F.count_distinct("r") > 1).alias("differ"))
    every = rows.select("drug").distinct().join(by, "drug", "left")
    return every.select("drug", F.coalesce(F.get(F.array(*[F.lit(t) for t in TIERS]), (F.col("r") - 1).cast("int")), F.lit("none")).alias("bucket"), F.coalesce("differ", F.lit(False)).alias("differ"))


def best_evaluation(evals: DataFrame) -> DataFrame:
    """One evaluation for each score: by others before the developers' own, then one with an effect size, then the largest."""
    some = F.greatest(*[F.when(F.coalesce(F.col(k), F.lit(0.0)) != 0, 1).otherwise(0) for k in ("odds_ratio", "hazard_ratio", "auroc")])
    order = F.struct(F.coalesce("independent", F.lit(False)), some, F.coalesce("n", F.lit(0)), F.col("eval_id"))
    return evals.groupBy("pgs_id").agg(F.max_by("eval_id", order).alias("eval_id"))


#: Words of an evaluation's notes that tell what a ratio compares: people a standard deviation apart, or groups of people.
GROUPED = ("decile", "quintile", "quartile", "tertile", "percentile")


def effect_text(evals: DataFrame) -> DataFrame:
    """(eval_id, text): the sizes of an effect, ratios with what they compare, as far as the notes tell."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    words = F.split(notes, "[^a-z0-9%]+")
    spread = F.array_contains(words, "per") & (F.array_contains(words, "sd") | F.array_contains(words, "1sd") | F.contains(notes, F.lit("standard deviation")))
    groups = F.exists(words, lambda w: F.rtrim(w, F.lit("s")).isin(*GROUPED)) | F.exists(F.split(notes, "top "), lambda x: x.rlike("^[0-9]+ ?%"))
    compares = F.when(spread, "for one standard deviation").when(groups, "between groups of people").otherwise("of what is not told")

    def size(column: str, name: str, of: Column | None = None) -> Column:
        text = F.concat(F.lit(name + " "), F.col(column).cast("string"), *([F.lit(" "), of] if of is not None else []))
        return F.when(F.coalesce(F.col(column), F.lit(0.0)) != 0, text)

    parts = F.array_compact(F.array(size("odds_ratio", "odds ratio", compares), size("hazard_ratio", "hazard ratio", compares), size("auroc", "area under the curve")))
    return evals.select("eval_id", F.nullif(F.array_join(parts, ", "), F.lit("")).alias("text"))


def version_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, was, now, kind): sources (source, version) that were changed, added or removed."""
    j = old.select("source", F.col("version").alias("was")).join(new.select("source", F.col("version").alias("now")), "source", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return j.withColumn("kind", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))


def why(findings: DataFrame, delta: DataFrame, model_changed: bool) -> DataFrame:
    """(claim_id, why): the sources of a finding that moved, and the grading rules if they did; empty if the analysis itself
    changed. One row for each finding and source is joined, so the list of sources may be any size."""
    cited = findings.select("claim_id", F.explode_outer("sources").alias("source"))
    moved = cited.join(delta.select("source", F.lit(True).alias("moved")), "source", "left")
    told = moved.groupBy("claim_id").agg(F.array_sort(F.collect_set(F.when(F.col("moved"), F.col("source")))).alias("w"))
    return told.select("claim_id", (F.concat("w", F.array(F.lit("evidence_model"))) if model_changed else F.col("w")).alias("why"))


def reclassified(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, old_class, new_class): alleles whose class, or else review, or else wording differs between two versions
    (key, cls, stars, significance)."""
    side = lambda df, p: df.select(*key, F.struct("cls", "stars", "significance").alias(p))
    j = side(old, "o").join(side(new, "n"), key, "full_outer")
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = F.col("o.cls") == F.col("n.cls")
    kind = F.when(~same("cls"), "class").when(both & ~same("stars"), "review").when(both & ~same("significance"), "detail")
    return j.select(*key, kind.alias("kind"), F.coalesce("o.cls", F.lit("not listed")).alias("old_class"), F.coalesce("n.cls", F.lit("not listed")).alias("new_class")).filter("kind IS NOT NULL")


def change_summary(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """(summary): one sentence from counts (what, n) of findings and the sources that moved (a few dozen)."""
    n = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0))
    c = counts.agg(n("added").alias("a"), n("removed").alias("r"), n("regraded").alias("g"), n("reworded").alias("w"))
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) and len(x) != 1 else F.col(x).cast("string") for x in xs])
    more = (F.col("r") > 0) | (F.col("g") > 0) | (F.col("w") > 0)
    told = F.when(more, text("findings +", "a", " / -", "r", "; ", "g", " regraded, ", "w", " reworded")).when(F.col("a") > 0, text("findings +", "a"))
    moved = F.when(F.col("kind") == "added", F.concat("source", F.lit(" added ("), "now", F.lit(")"))).when(F.col("kind") == "removed", F.concat("source", F.lit(" removed"))).otherwise(F.concat("source", F.lit(" "), "was", F.lit(" to "), "now"))
    d = delta.agg(F.array_join(F.array_sort(F.collect_list(moved)), ", ").alias("d"))
    parts = F.filter(F.array(F.col("d"), told), lambda x: x.isNotNull() & (x != ""))
    return c.join(d).select(F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("No changes in findings.").alias("summary"))
