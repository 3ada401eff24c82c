"""Re-counting the reads behind calls: sequence around each target, windows, whole-read fits, counts and verdicts.

Targets (chrom_order, pos, ref, alt) get the letters FLANK to either side from a sequence kept in chunks: a join of a few
chunks for each target. An insertion or deletion is given the stretch over which it can be written, and every read that
reaches within SPREAD of that stretch is laid, whole and without gaps, on both versions of the letters around it, soft clips
included. Reads meet targets in a range join by bins, so deep places spread over tasks; pairs are judged in Arrow batches
right where they were joined, and only counts are shuffled. The kernel takes all reads of one length at once: for each place
along the sequence it compares the whole batch in one step.

Defined results: targets without sequence, with other letters than the sequence's, too long or in too wide a repeat have a
note and no counts; a read without letters or qualities, or whose letters and qualities differ in number, does not span;
targets without reads have zeros; repeated targets are one; null positions take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from .fitting import MARGIN, MIN_Q, MOST_APART, MOST_WIDE, SPREAD, letters, mismatches, windows
from .intervals import MIN_MAPQ, overlaps, snv_counts
from .storage import stored

#: Letters of the sequence to either side of a target.
FLANK = 300
KEY = ["chrom_order", "pos", "ref", "alt"]
COUNTS = ["low_mapq", "low_baseq", "ref_reads", "alt_reads", "other", "not_spanning", "ref_fwd", "alt_fwd"]
NOT_SPANNING, REF, ALT, OTHER = range(4)


def flanks(targets: DataFrame, chunks: DataFrame, width: int, flank: int = FLANK) -> DataFrame:
    """targets with `first` (where the letters begin, from 0) and `seq` (null where the sequence has a hole); chunks are
    (chrom_order, chunk, seq), each of the `width` letters from chunk * width on, the last of a chromosome perhaps shorter."""
    spot = targets.withColumns({"first": F.greatest(F.lit(0), F.col("pos") - 1 - flank), "until": F.col("pos") - 1 + F.length("ref") + flank})
    spot = spot.withColumns({"c0": F.floor(F.col("first") / width), "c1": F.floor((F.col("until") - 1) / width)})
    parts = spot.withColumn("chunk", F.explode(F.sequence("c0", "c1"))).join(chunks.select("chrom_order", "chunk", F.col("seq").alias("letters")), ["chrom_order", "chunk"])
    held = parts.groupBy(*KEY, "first", "until", "c0").agg(F.array_sort(F.collect_list(F.struct("chunk", "letters"))).alias("p"))
    whole = (F.col("p")[0]["chunk"] == F.col("c0")) & (F.element_at("p", -1)["chunk"] - F.col("c0") + 1 == F.size("p"))
    text = F.array_join(F.transform("p", lambda x: x["letters"]), "")
    seq = F.upper(F.substring(text, (F.col("first") - F.col("c0") * width + 1).cast("int"), (F.col("until") - F.col("first")).cast("int")))
    return targets.join(held.select(*KEY, "first", F.when(whole, seq).alias("seq")), KEY, "left")


def windowed(targets: DataFrame) -> DataFrame:
    """targets (with first, seq) with the window (start, end) in which reads must reach, or a note why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pos, ref, alt, first, seq in zip(b["pos"], b["ref"], b["alt"], b["first"], b["seq"]):
                found = windows(seq, int(first), pos, ref, alt) if seq is not None else None
                if found is not None:
                    note = None
                elif seq is None:
                    note = "no sequence"
                elif seq[pos - 1 - int(first) :][: len(ref)] != ref:
                    note = "other letters"
                else:
                    note = "too long" if abs(len(ref) - len(alt)) + 1 > MOST_WIDE else "wide repeat"
                out.append((found[0] if found else None, found[1] if found else None, note))
            b[["w_start", "w_end", "note"]] = pd.DataFrame(out, columns=["w_start", "w_end", "note"], index=b.index)
            yield b.astype({"w_start": "Int64", "w_end": "Int64", "first": "Int64"})

    t = targets.select(F.col("chrom_order").cast("int"), F.col("pos").cast("int"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col("first").cast("long").alias("first"), "seq")
    return t.mapInPandas(run, "chrom_order int, pos int, ref string, alt string, first long, seq string, w_start long, w_end long, note string")


def fewest_mismatches(seqs: list[bytes], quals: list[bytes], versions: list[bytes], at: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Fewest mismatches of each read laid whole on its version of the sequence, its first letter within `spread` of `at`; letters
    of poor quality do not count; -1 where the read does not fit in. Reads of one length and spread are taken at once."""
    best = np.full(len(seqs), -1, dtype=np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(seqs):
        kinds.setdefault((len(s), int(spread[k])), []).append(k)
    for (n, reach), rows in kinds.items():
        q, good = letters(seqs, rows), letters(quals, rows) >= 33 + MIN_Q
        low = at[rows] - reach
        last = np.array([len(versions[k]) - n for k in rows])
        width = n + 2 * reach
        # What lies before a version's beginning or after its end is filled up, and never chosen.
        near = letters([(b"\0" * min(max(-a, 0), width) + versions[k][max(0, a) : max(0, a + width)]).ljust(width, b"\0") for k, a in zip(rows, low)], range(len(rows)))
        found = np.full(len(rows), n + 1)
        for s in range(2 * reach + 1):
            there = (low + s >= 0) & (low + s <= last)
            apart = mismatches(q, good, near[s : s + n])
            found = np.where(there & (apart < found), apart, found)
        best[rows] = np.where(found > n, -1, found)
    return best


def _fits(b: pd.DataFrame) -> np.ndarray:
    """Which version each read of a batch of pairs shows."""
    out = np.full(len(b), NOT_SPANNING)
    ok = np.flatnonzero([s is not None and q is not None and len(s) == len(q) and len(s) > 0 for s, q in zip(b["r_seq"], b["qual"])])
    if not len(ok):
        return out
    b = b.iloc[ok]
    seqs, quals = [s.upper().encode() for s in b["r_seq"]], [q.encode() for q in b["qual"]]
    ref = [s.encode() for s in b["seq"]]
    off = (b["pos"] - 1 - b["first"]).to_numpy()
    alt = [s[:o] + a.encode() + s[o + len(r) :] for s, o, r, a in zip(ref, off, b["ref"], b["alt"])]
    at = (b["start_pos"] - b["lead"] - b["first"]).to_numpy()
    spread = np.array([abs(len(a) - len(r)) + SPREAD for r, a in zip(b["ref"], b["alt"])])
    x, y = fewest_mismatches(seqs, quals, ref, at, spread), fewest_mismatches(seqs, quals, alt, at, spread)
    fit = np.where(np.minimum(x, y) > MOST_APART, OTHER, np.where(y <= x - MARGIN, ALT, np.where(x <= y - MARGIN, REF, NOT_SPANNING)))
    out[ok] = np.where((x < 0) | (y < 0), NOT_SPANNING, fit)
    return out


def indel_counts(targets: DataFrame, reads: DataFrame, longest: int | None = None) -> DataFrame:
    """Counts by target of windowed targets; reads are (chrom_order, start_pos, end_pos, flag, mapq, cigar, seq, qual), `longest` bounds their
    lengths. Reads of low mapping quality go along without letters, so that the join is worked out once."""
    t = targets.filter("w_start IS NOT NULL").select(*KEY, "first", "seq", (F.col("w_start") - SPREAD).alias("lo"), (F.col("w_end") + SPREAD).alias("hi"))
    lead = F.coalesce(F.expr("try_cast(regexp_extract(cigar, '^([0-9]+)S', 1) AS INT)"), F.lit(0))
    sure = F.coalesce(F.col("mapq") >= MIN_MAPQ, F.lit(False))
    r = reads.filter((F.col("flag").bitwiseAND(R.SKIP_FLAGS) == 0) & F.col("mapq").isNotNull())
    r = r.select("chrom_order", "start_pos", "end_pos", "flag", sure.alias("sure"), F.when(sure, F.col("seq")).alias("r_seq"), F.when(sure, F.col("qual")).alias("qual"), lead.alias("lead"))
    widest = MOST_WIDE + 2 * SPREAD  # of a target's window
    pairs = overlaps(r, t, ["chrom_order"], ("start_pos", "end_pos"), ("lo", "hi"), longest=None if longest is None else max(longest, widest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[*KEY, "flag", "sure"]].assign(fit=_fits(b))

    kinds = dict(t.dtypes)
    judged = pairs.select(*KEY, "flag", "sure", "first", F.when(F.col("sure"), F.col("seq")).alias("seq"), "r_seq", "qual", "start_pos", "lead")
    judged = judged.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", flag int, sure boolean, fit int")
    n = lambda c: F.count(F.when(F.col("sure") & c, 1))
    fit, forward = F.col("fit"), F.col("flag").bitwiseAND(16) == 0
    counted = judged.groupBy(*KEY).agg(F.count(F.when(~F.col("sure"), 1)).alias("low_mapq"), n(fit == REF).alias("ref_reads"), n(fit == ALT).alias("alt_reads"), n(fit == OTHER).alias("other"), n(fit == NOT_SPANNING).alias("not_spanning"), n((fit == REF) & forward).alias("ref_fwd"), n((fit == ALT) & forward).alias("alt_fwd"))
    return counted.withColumn("low_baseq", F.lit(0).cast("bigint"))


def recount(targets: DataFrame, reads: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """(chrom_order, pos, ref, alt, counts, note) for distinct targets: single letters by the letter at the site, other changes by
    whole-read fits. Targets with their letters are written once, the longest read is looked up once for both."""
    one = targets.select(*KEY).filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY)).distinct()
    letter = (F.length("ref") == 1) & (F.length("alt") == 1)
    at = F.substring("seq", (F.col("pos") - F.col("first")).cast("int"), F.lit(1))
    by_letter = F.when(F.col("seq").isNull(), "no sequence").when(at != F.col("ref"), "other letters")
    placed = windowed(flanks(one, chunks, width)).select(*KEY, "first", F.when(F.col("w_start").isNotNull() & ~letter, F.col("seq")).alias("seq"), "w_start", "w_end", F.when(letter, by_letter).otherwise(F.col("note")).alias("note"))
    placed = stored(placed, "placed")
    longest = reads.filter(F.col("flag").bitwiseAND(R.SKIP_FLAGS) == 0).agg(F.max(F.col("end_pos") - F.col("start_pos"))).first()[0] or 0
    found = indel_counts(placed.filter(~letter), reads, longest).select(*KEY, *COUNTS)
    single = placed.filter(letter)
    if single.limit(1).count():
        counted = snv_counts(single.filter("note IS NULL").select(*KEY), reads, longest).withColumn("not_spanning", F.lit(0).cast("bigint"))
        found = found.unionByName(counted.select(*KEY, *COUNTS))
    return placed.select(*KEY, "note").join(found, KEY, "left").select(*KEY, *[F.when(F.col("note").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS], "note")


def judged(counts: DataFrame) -> DataFrame:
    """Counts (with expected, ploidy, others: copies of the site's other alleles) with reads, observed, lod, status and flags; reads that show
    something else count where other alleles are expected. A flag warns of reads that belong elsewhere, or on one strand."""
    c = F.col
    n = c("ref_reads") + c("alt_reads") + F.when(c("others") > 0, c("other")).otherwise(0)
    seen = c("ref_reads") + c("alt_reads") + c("other") + c("low_mapq")
    look = (c("low_mapq") >= R.LOOK_ALIKE_READS) & (c("low_mapq") >= R.LOOK_ALIKE_SHARE * seen)
    enough = (c("alt_reads") >= R.STRAND_READS) & (c("ref_reads") >= R.STRAND_READS)
    p = R.fisher_exact(c("ref_fwd"), c("ref_reads") - c("ref_fwd"), c("alt_fwd"), c("alt_reads") - c("alt_fwd"))
    one_strand = F.when(enough, p < R.STRAND_P).otherwise(False)
    none = c("note").isNotNull() | (c("reads") == 0)
    best, lod = R.best_copies(c("alt_reads"), c("reads"), c("ploidy")), R.lod(c("alt_reads"), c("reads"), c("ploidy"))
    clear = (c("lod") >= R.MIN_LOD) & (c("reads") >= R.MIN_READS)
    status = (
        F.when(none, "not_checkable")
        .when(c("expected").isNull(), "not_called")
        .when(c("observed") == c("expected"), F.when(clear, "confirmed").otherwise("weak"))
        .otherwise(F.when(clear, "disagrees").otherwise("unclear"))
    )
    told = counts.withColumns({"reads": F.when(c("note").isNull(), n), "flags": F.array_compact(F.array(F.when(look, "look_alike"), F.when(one_strand, "one_strand")))})
    told = told.withColumns({"observed": F.when(~none, best), "lod": F.when(~none, lod)})
    return told.withColumn("status", status)
