"""Whole-read re-counts against a read-by-read version, windows across chunks, and verdicts with their flags."""

import random

import numpy as np
import pytest

from helixloom.operators import recount as P
from helixloom.operators.fitting import MIN_Q, SPREAD, windows

SCHEMA = "chrom_order int, start_pos int, end_pos int, flag int, mapq int, cigar string, seq string, qual string"


def fewest(seq, qual, version, at, spread):
    """One read, one place after the other."""
    best = None
    for s in range(max(0, at - spread), min(len(version) - len(seq), at + spread) + 1):
        apart = sum(a != b and ord(q) - 33 >= MIN_Q for a, b, q in zip(seq, version[s:], qual))
        best = apart if best is None else min(best, apart)
    return best


def fit(read, first, ref_version, alt_version, shift):
    seq, qual, start, cigar = read
    if seq is None or qual is None or len(seq) != len(qual):
        return None
    lead = int(cigar.split("S")[0]) if cigar and cigar.split("S")[0].isdigit() else 0
    at, spread = start - lead - first, abs(shift) + SPREAD
    x, y = (fewest(seq, qual, v, at, spread) for v in (ref_version, alt_version))
    if x is None or y is None:
        return None
    return "other" if min(x, y) > 8 else "alt" if y <= x - 2 else "ref" if x <= y - 2 else None


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(7)
    return "".join(rng.choice("ACGT") for _ in range(700)) + "CAG" * 12 + "".join(rng.choice("ACGT") for _ in range(700)) + "A" * 130 + "".join(rng.choice("ACGT") for _ in range(500))


def test_kernel_is_the_read_by_read_one():
    rng = random.Random(3)
    seqs, quals, versions, at, spread = [], [], [], [], []
    for _ in range(400):
        v = "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 120)))
        n = rng.choice([10, 15, 40])
        k = rng.randrange(0, max(1, len(v) - n))
        s = "".join(c if rng.random() < 0.9 else "N" for c in v[k : k + n].ljust(n, "G"))
        seqs.append(s), quals.append("".join(rng.choice("!I") for _ in s)), versions.append(v), at.append(k + rng.randrange(-30, 31)), spread.append(rng.choice([0, 5, 14]))
    got = P.fewest_mismatches([s.encode() for s in seqs], [q.encode() for q in quals], [v.encode() for v in versions], np.array(at), np.array(spread))
    want = [fewest(*x) for x in zip(seqs, quals, versions, at, spread)]
    assert got.tolist() == [-1 if w is None else w for w in want] and len(set(want)) > 5


def test_recount_end_to_end(spark, genome):
    rng = random.Random(11)
    width = 64
    chunks = [(1, k, genome[width * k : width * (k + 1)].lower()) for k in range(-(-len(genome) // width))] + [(2, k, "ACGT" * 16) for k in (0, 1, 3)]
    p0 = 700  # the repeat begins here
    targets = [(1, p0, genome[p0 - 1] + "CAG", genome[p0 - 1]), (1, p0, genome[p0 - 1], genome[p0 - 1] + "CAG"), (1, 350, genome[349:352], genome[349]), (1, 500, genome[499:501], "TT" if genome[499:501] != "TT" else "GG"),
               (1, 900, genome[899], "C" if genome[899] != "C" else "G"), (1, 910, "AC" if genome[909:911] != "AC" else "GG", "A"), (1, 1437, "A", "AA"), (1, 300, genome[299:420], genome[299]), (2, 100, "T", "TA"), (3, 5, "A", "AT"), (1, 1, genome[0:2], genome[0])]
    made = []
    for _, pos, ref, alt in targets[:4]:
        for _ in range(60):
            version = genome[: pos - 1] + alt + genome[pos - 1 + len(ref) :] if rng.random() < 0.5 else genome
            start = pos - 1 - rng.randrange(-5, 95)
            lead = rng.choice([0, 0, 8])
            seq = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in version[max(0, start) : start + 100])
            if rng.random() < 0.1:
                seq = "".join(rng.choice("ACGT") for _ in seq)
            qual = "".join(rng.choice("5?I!") for _ in seq)
            made.append((1, start + lead, start + 100, rng.choice([0, 16, 16, 1024, 4]), rng.choice([60, 60, 60, 3]), f"{lead}S{100 - lead}M" if lead else "100M", seq, qual))
    made += [(1, 690, 790, 0, 60, "100M", None, None), (1, 690, 790, 0, 60, "100M", "ACGT", "II")]
    reads = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = {tuple(r[c] for c in P.KEY): r for r in P.recount(spark.createDataFrame([*targets, targets[0], (1, None, "A", "T")], "chrom_order int, pos int, ref string, alt string"), reads, spark.createDataFrame(chunks, "chrom_order int, chunk long, seq string"), width).collect()}
    assert set(got) == set(targets)
    seen = set()
    for t in targets[:4]:
        _, pos, ref, alt = t
        first = max(0, pos - 1 - P.FLANK)
        flank = genome[first : pos - 1 + len(ref) + P.FLANK]
        lo, hi, _, _ = windows(flank, first, pos, ref, alt)
        off = pos - 1 - first
        other = flank[:off] + alt + flank[off + len(ref) :]
        want = dict.fromkeys(P.COUNTS, 0)
        for _, start, end, flag, mapq, cigar, seq, qual in made:
            if flag & 0xF04 or not (start < hi + SPREAD and end > lo - SPREAD):
                continue
            if mapq < 20:
                want["low_mapq"] += 1
                continue
            f = fit((seq, qual, start, cigar), first, flank, other, len(alt) - len(ref))
            want[{"ref": "ref_reads", "alt": "alt_reads", "other": "other", None: "not_spanning"}[f]] += 1
            if f in ("ref", "alt") and not flag & 16:
                want[f + "_fwd"] += 1
            seen.add(f)
        assert {c: got[t][c] for c in P.COUNTS} == want
    assert seen == {"ref", "alt", "other", None}
    assert got[targets[4]]["note"] is None and got[targets[4]]["low_mapq"] is not None
    assert [got[t]["note"] for t in targets[5:]] == ["other letters", "wide repeat", "too long", "no sequence", "no sequence", "wide repeat"]


CASES = [  # ref, alt, ref_fwd, alt_fwd, other, low, expected, ploidy, others -> status, observed, flags
    (12, 11, 6, 5, 0, 0, 1, 2, 0, "confirmed", 1, []),
    (3, 2, 1, 1, 0, 0, 1, 2, 0, "weak", 1, []),
    (25, 0, 12, 0, 0, 0, 1, 2, 0, "disagrees", 0, []),
    (19, 3, 9, 1, 0, 0, 1, 2, 0, "unclear", None, []),
    (10, 10, 5, 5, 0, 12, 1, 2, 0, "confirmed", 1, ["look_alike"]),
    (20, 20, 20, 0, 0, 0, 1, 2, 0, "confirmed", 1, ["one_strand"]),
    (0, 20, 0, 10, 0, 0, 1, 1, 0, "confirmed", 1, []),
    (0, 0, 0, 0, 5, 0, 1, 2, 0, "not_checkable", None, []),
    (0, 10, 0, 5, 10, 0, 1, 2, 1, "confirmed", 1, []),
    (0, 10, 0, 5, 10, 0, 2, 2, 0, "confirmed", 2, []),
    (10, 10, 5, 5, 0, 0, None, 2, 0, "not_called", 1, []),
]


@pytest.mark.parametrize("case", CASES)
def test_verdicts(spark, case):
    rr, aa, rf, af, other, low, expected, ploidy, others, status, observed, flags = case
    df = spark.createDataFrame([(rr, aa, rf, af, other, low, expected, ploidy, others, None)], "ref_reads long, alt_reads long, ref_fwd long, alt_fwd long, other long, low_mapq long, expected int, ploidy int, others int, note string")
    r = P.judged(df).first()
    assert (r["status"], r["flags"]) == (status, flags)
    assert observed is None or r["observed"] == observed
    noted = P.judged(df.drop("note").selectExpr("*", "'other letters' AS note")).first()
    assert noted["status"] == "not_checkable" and noted["observed"] is None


def test_targets_and_pairs_are_worked_out_once(spark):
    from helixloom.plans import QUERIES

    df = QUERIES["indel_recounts"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Window" not in plan  # windows of targets and variants are read from files
