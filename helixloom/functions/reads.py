"""Column rules for read counts: genotype likelihoods, strand test and the verdict on a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error rate of a read, thresholds of the verdict.
ERROR = 0.02
MIN_LOD, MIN_READS = 2.0, 8
LOOK_ALIKE_READS, LOOK_ALIKE_SHARE = 3, 0.3
STRAND_READS, STRAND_P = 6, 0.001


def likelihoods(alt: Column, n: Column, ploidy: Column) -> Column:
    """array(struct(ll, copies)), best first; fewer copies first among equals."""
    ll = lambda p: alt * F.log10(F.lit(p)) + (n - alt) * F.log10(F.lit(1 - p))
    row = lambda p, k: F.struct((-ll(p)).alias("worse"), F.lit(k).alias("copies"))
    two = F.array(row(ERROR, 0), row(0.5, 1), row(1 - ERROR, 2))
    one = F.array(row(ERROR, 0), row(1 - ERROR, 1))
    return F.sort_array(F.when(ploidy == 1, one).otherwise(two))


def best_copies(alt: Column, n: Column, ploidy: Column) -> Column:
    return F.get(likelihoods(alt, n, ploidy), F.lit(0))["copies"]


def lod(alt: Column, n: Column, ploidy: Column) -> Column:
    """How much likelier, in powers of ten, the best number of copies is than the runner-up."""
    ls = likelihoods(alt, n, ploidy)
    return F.get(ls, F.lit(1))["worse"] - F.get(ls, F.lit(0))["worse"]


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p-value of the table [[a, b], [c, d]]: the share of tables that are no likelier than this one. From table to table the
    likelihood changes by a ratio of two products, so a walk to either side takes one step for each table."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))

    def walk(gain: tuple[Column, Column], loss: tuple[Column, Column], base: float) -> Column:
        (p, q), (u, v) = gain, loss
        steps = F.sequence(F.lit(0), F.greatest(F.least(p, q), F.lit(0.0)).cast("int"))
        start = F.struct(F.lit(0.0).alias("l"), F.lit(base).alias("all"), F.lit(base).alias("part"))

        def step(acc: Column, k: Column) -> Column:
            l = acc["l"] + F.ln((p - k + 1) / (u + k) * ((q - k + 1) / (v + k)))  # noqa: E741
            return F.when(k > 0, let(l, lambda m: F.struct(m.alias("l"), (acc["all"] + F.exp(m)).alias("all"), (acc["part"] + F.when(m <= 1e-9, F.exp(m)).otherwise(0.0)).alias("part")))).otherwise(acc)

        return F.aggregate(steps, start, step)

    up, down = walk((b, c), (a, d), 1.0), walk((a, d), (b, c), 0.0)
    return let(F.struct(up.alias("up"), down.alias("down")), lambda s: F.least(F.lit(1.0), (s["up"]["part"] + s["down"]["part"]) / (s["up"]["all"] + s["down"]["all"])))


#: Flag bits of reads that are left out (unmapped, secondary, failed, duplicate, supplementary).
SKIP_FLAGS = 0x4 | 0x100 | 0x200 | 0x400 | 0x800


def query_offset(cigar: Column, offset: Column) -> Column:
    """Where in the read the base stands that is aligned `offset` bases after the read's start on the reference (both from 0);
    null if the alignment has a gap there."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    zero = F.lit(0)
    start = F.struct(zero.alias("ref"), zero.alias("query"), F.lit(None).cast("int").alias("hit"))

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, "^([0-9]+)", 1).cast("int"), F.right(op, F.lit(1))
        both, here = kind.isin("M", "=", "X"), (offset >= acc["ref"]) & (offset < acc["ref"] + n)
        return F.struct(
            (acc["ref"] + F.when(both | kind.isin("D", "N"), n).otherwise(0)).alias("ref"),
            (acc["query"] + F.when(both | kind.isin("I", "S"), n).otherwise(0)).alias("query"),
            F.when(both & here, acc["query"] + offset.cast("int") - acc["ref"]).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["hit"])


#: Statuses that judge a gene, worst first.
JUDGED = ("disagrees", "unclear", "weak", "confirmed")


def gene_verdicts(sites: DataFrame) -> DataFrame:
    """(gene, status, positions, problems, uncalled): the worst status of a gene's judged positions, those that are not
    confirmed, and those without a call. A gene has a bounded number of positions."""
    order = F.array_position(F.array(*[F.lit(x) for x in JUDGED]), F.col("status"))
    judged = F.col("status").isin(*JUDGED)
    named = F.concat(F.col("site_id").cast("string"), F.lit(" ("), "status", F.lit(")"))
    by = sites.groupBy("gene").agg(
        F.min_by("status", F.when(judged, order)).alias("status"),
        F.count(F.when(judged, 1)).alias("positions"),
        F.array_sort(F.collect_list(F.when(judged & (F.col("status") != "confirmed"), named))).alias("problems"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "not_called", F.col("site_id")))).alias("uncalled"),
    )
    return by.filter("positions > 0")


def verdict(ref: Column, alt: Column, expected: Column, ploidy: Column) -> Column:
    n = ref + alt
    clear = (lod(alt, n, ploidy) >= MIN_LOD) & (n >= MIN_READS)
    same = best_copies(alt, n, ploidy) == expected
    return (
        F.when(n == 0, "not_checkable")
        .when(expected.isNull(), "not_called")
        .when(same, F.when(clear, "confirmed").otherwise("weak"))
        .otherwise(F.when(clear, "disagrees").otherwise("unclear"))
    )


def look_alike(ref: Column, alt: Column, low_mapq: Column) -> Column:
    return (low_mapq >= LOOK_ALIKE_READS) & (low_mapq >= LOOK_ALIKE_SHARE * (ref + alt + low_mapq))
