"""Copy numbers from exon depths, genotypes of mitochondrial genes, reference checks and facts about genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bin of GC share in hundredths, exons that a pooled bin needs, scale of a median deviation.
GC_BIN, POOL, MAD_SCALE = 5, 30, 1.4826


def gc_corrected(exons: DataFrame) -> DataFrame:
    """exons (gene, exon, gc_pct, ratio) with gc_ratio and gc_z: the ratio over the median of exons of like GC share, and its
    distance in robust deviations. Bins are pooled with their neighbours, further out step by step, until they hold POOL exons;
    bins are a hundred at most, so the table of pools is small."""
    bins = exons.withColumn("bin", F.floor(F.col("gc_pct") / GC_BIN).cast("int"))
    counts = bins.groupBy("bin").agg(F.count("*").alias("n"))
    pair = counts.select("bin").join(counts.select(F.col("bin").alias("other"), "n"))  # bins x bins
    reach = pair.withColumn("r", F.abs(F.col("bin") - F.col("other")))
    sums = reach.groupBy("bin", "r").agg(F.sum("n").alias("n"))
    upto = sums.join(sums.select("bin", F.col("r").alias("r2"), F.col("n").alias("n2")), "bin").filter("r2 <= r").groupBy("bin", "r").agg(F.sum("n2").alias("held"))
    radius = upto.groupBy("bin").agg(F.coalesce(F.min(F.when(F.col("held") >= POOL, F.col("r"))), F.max("r")).alias("radius"))
    pools = reach.join(radius, "bin").filter("r <= radius").select(F.col("bin").alias("pool"), F.col("other").alias("bin"))
    in_pool = bins.select("bin", "ratio").join(F.broadcast(pools), "bin")
    median = in_pool.groupBy("pool").agg(F.median("ratio").alias("mid"))
    spread = in_pool.join(F.broadcast(median), "pool").groupBy("pool").agg((F.median(F.abs(F.col("ratio") / F.col("mid") - 1)) * MAD_SCALE).alias("mad"))
    told = median.join(spread, "pool").withColumnRenamed("pool", "bin")
    out = bins.join(F.broadcast(told), "bin").withColumn("gc_ratio", F.col("ratio") / F.col("mid"))
    return out.withColumn("gc_z", F.try_divide(F.col("gc_ratio") - 1, F.col("mad"))).drop("bin", "mid", "mad")


def exon_ratios(exons: DataFrame, male: bool) -> DataFrame:
    """exons (gene, exon, chrom_order, depth) with their depth over the median of autosomal exons; X and Y of a male count twice."""
    mid = exons.filter("chrom_order < 22").agg(F.median("depth").alias("mid"))
    twice = F.when(F.col("chrom_order").isin(22, 23) & F.lit(male), 2).otherwise(1)
    return exons.join(F.broadcast(mid)).select("gene", "exon", (F.col("depth") * twice / F.col("mid")).alias("ratio"))


def copy_events(breaks: DataFrame, runs: DataFrame, exons: DataFrame) -> DataFrame:
    """(gene, start_pos, end_pos, kind, breakpoint, depth_support, exons): breakpoint calls (gene, start_pos, end_pos, kind) with the
    share of their exons whose depth agrees, and runs of depth that overlap no call of their kind. Both meet by bins of a gene, so
    genes may have any number of exons."""
    from .intervals import overlaps

    e = exons.select("gene", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.col("kind").alias("depth"))
    key = ["gene", "start_pos", "end_pos", "kind"]
    held = overlaps(breaks.select(*key), e, ["gene"], ("start_pos", "end_pos"), ("s", "e")).groupBy(*key).agg(F.count("*").alias("exons"), F.count(F.when(F.col("depth") == F.col("kind"), 1)).alias("agree"))
    called = breaks.join(held, key, "left").select(*key, F.lit(True).alias("breakpoint"), F.coalesce(2 * F.col("agree") >= F.col("exons"), F.lit(False)).alias("depth_support"), F.coalesce("exons", F.lit(0)).alias("exons"))
    b = breaks.select("gene", "kind", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    met = overlaps(runs.select(*key), b, ["gene", "kind"], ("start_pos", "end_pos"), ("s", "e")).select(*key).distinct()
    alone = runs.join(met, key, "left_anti")
    return called.unionByName(alone.select(*key, F.lit(False).alias("breakpoint"), F.lit(True).alias("depth_support"), "exons"))


def reference_mismatches(variants: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Variants whose reference letters are not those of the sequence, given in chunks (chrom_order, chunk, seq) of `width` letters
    that overlap the next by enough for any reference allele."""
    v = variants.withColumn("chunk", F.floor((F.col("pos") - 1) / width))
    j = v.join(chunks, ["chrom_order", "chunk"])
    there = F.substring("seq", ((F.col("pos") - 1) % width + 1).cast("int"), F.length("ref"))
    return j.filter(there != F.col("ref")).drop("chunk", "seq")


def gene_about(wanted: DataFrame, plain: DataFrame, curated: DataFrame) -> DataFrame:
    """(gene, text, source): plain-language text first, else the curated summary; genes without either keep their row."""
    one = curated.groupBy("gene").agg(F.min("summary").alias("summary"))
    p = plain.groupBy("gene").agg(F.min("text").alias("text"))
    j = wanted.select("gene").distinct().join(p, "gene", "left").join(one, "gene", "left")
    return j.select("gene", F.coalesce("text", "summary").alias("text"), F.when(F.col("text").isNotNull(), "plain").when(F.col("summary").isNotNull(), "curated").alias("source"))


def insertion_counts(reads: DataFrame, points: DataFrame) -> DataFrame:
    """(chrom_order, pos, insertions, others): reads with an insertion right after a point, by their CIGAR, and other reads over it."""
    from ..functions.reads import SKIP_FLAGS
    from .intervals import MIN_MAPQ, points_in

    r = reads.filter((F.col("flag").bitwiseAND(SKIP_FLAGS) == 0) & (F.col("mapq") >= MIN_MAPQ)).select("chrom_order", "start_pos", "end_pos", "cigar")
    j = points_in(points, r, ["chrom_order"], "pos", "start_pos", "end_pos")
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    start = F.struct(F.lit(0).alias("ref"), F.array().cast("array<int>").alias("ins"))

    def step(acc, op):
        n, kind = F.regexp_extract(op, "^([0-9]+)", 1).cast("int"), F.right(op, F.lit(1))
        return F.struct((acc["ref"] + F.when(kind.isin("M", "=", "X", "D", "N"), n).otherwise(0)).alias("ref"), F.when(kind == "I", F.concat(acc["ins"], F.array(acc["ref"]))).otherwise(acc["ins"]).alias("ins"))

    after = F.aggregate(ops, start, step, lambda acc: acc["ins"])
    hit = F.array_contains(after, (F.col("pos") - F.col("start_pos")).cast("int"))
    return j.groupBy("chrom_order", "pos").agg(F.count(F.when(hit, 1)).alias("insertions"), F.count(F.when(~hit, 1)).alias("others"))
