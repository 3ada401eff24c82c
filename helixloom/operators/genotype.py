"""Genotypes at given sites, from calls and a map of callable intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge, overlaps, points_in

#: Least quality of a genotype, distance within which another indel makes a site unreadable, the only state that counts
#: as callable, autosomes, genotypes that show no variant.
MIN_GQ, INDEL_REACH, CALLABLE, AUTOSOMES = 20, 25, "CALLABLE", 22
NO_VARIANT = ("0/0", "./.")


def genotype_sites(sites: DataFrame, variants: DataFrame, intervals: DataFrame) -> DataFrame:
    """sites (chrom_order, pos, ref, alt, distinct) with gt. variants are one person's (chrom_order, pos, ref, alt, filter, gt, gq), intervals
    (chrom_order, start_pos, end_pos, state).

    A call of the very alleles decides where there is one: its genotype if it passed, is sure and stands alone, else ./. . Without
    one, ./. where another variant or a no-call stands at the position, where the site lies inside one of the person's own
    deletions, where another indel is near an indel site, or where a change of several letters covers the site; then 0/0 where the
    caller saw the reference for sure or the place is callable (no other state counts); else ./. . Calls on other
    chromosomes than the autosomes do not count. Every flag is one row for each site before the last join, so no site is multiplied.
    """
    key, allele = ["chrom_order", "pos"], ["chrom_order", "pos", "ref", "alt"]
    v = variants.filter((F.col("chrom_order") >= 0) & (F.col("chrom_order") < AUTOSOMES)).withColumn("gt", F.replace("gt", F.lit("|"), F.lit("/")))
    shown = ~F.col("gt").isin(*NO_VARIANT) & (F.col("filter") != "RefCall")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    here = v.groupBy(*key).agg(F.count(F.when(shown, 1)).alias("shown"), any_((F.col("gt") == "./.") | (F.col("filter") == "NoCall")).alias("nocall"), any_((F.col("filter") == "RefCall") & (F.col("gq") >= MIN_GQ)).alias("refcall"))
    exact = v.filter("filter <> 'RefCall'").groupBy(*allele).agg(F.min(F.struct("filter", "gq", "gt")).alias("call"))
    own = v.filter(shown)
    longer = F.length("ref") != F.length("alt")
    deletions = own.filter(F.length("ref") > F.length("alt")).select("chrom_order", F.col("pos").alias("d_start"), (F.col("pos") + F.length("ref") - 1).alias("d_end"))
    inside = points_in(sites.select(*key).distinct(), deletions, ["chrom_order"], "pos", "d_start", "d_end", "left_semi").withColumn("inside", F.lit(True))
    # Places are 0-based half-open here; an indel reaches INDEL_REACH to either side.
    reach = F.when(longer, INDEL_REACH).otherwise(0)
    spans = own.filter(longer | (F.length("ref") > 1)).select("chrom_order", F.col("pos").alias("v_pos"), F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt"), longer.alias("v_indel"), (F.col("pos") - 1 - reach).alias("v_start"), (F.col("pos") - 1 + F.length("ref") + reach).alias("v_end"))
    spots = sites.select(*allele, (F.col("pos") - 1).alias("s_start"), (F.col("pos") - 1 + F.length("ref")).alias("s_end"))
    met = overlaps(spots, spans, ["chrom_order"], ("s_start", "s_end"), ("v_start", "v_end"))
    other = ~((F.col("v_pos") == F.col("pos")) & (F.col("v_ref") == F.col("ref")) & (F.col("v_alt") == F.col("alt")))
    near = met.filter(other & (~F.col("v_indel") | longer)).select(*allele).distinct().withColumn("near", F.lit(True))
    callable_ = merge(intervals.filter((F.col("state") == CALLABLE) & (F.col("start_pos") < F.col("end_pos"))), ["chrom_order"], "start_pos", "end_pos")
    open_ = points_in(sites.select(*key).distinct(), callable_, ["chrom_order"], "pos", "start_pos", "end_pos", "left_semi").withColumn("open", F.lit(True))
    j = sites.join(here, key, "left").join(exact, allele, "left").join(inside, key, "left").join(near, allele, "left").join(open_, key, "left")
    called = F.col("call.gt")
    unsure = (F.col("shown") > 1) | ~F.col("call.filter").isin("PASS", ".") | (F.coalesce("call.gq", F.lit(0)) < MIN_GQ)
    told = F.when(unsure, "./.").when(called == "1/1", "1/1").when(called.isin("0/1", "1/0"), "0/1").otherwise("./.")
    hidden = (F.coalesce("shown", F.lit(0)) > 0) | F.coalesce("nocall", F.lit(False)) | F.coalesce("inside", F.lit(False)) | F.coalesce("near", F.lit(False))
    gt = F.when(F.col("call").isNotNull(), told).when(hidden, "./.").when(F.coalesce("refcall", F.lit(False)) | F.coalesce("open", F.lit(False)), "0/0").otherwise("./.")
    return j.select(*allele, gt.alias("gt"))
