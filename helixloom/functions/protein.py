"""Protein changes in the notation of papers (p.Arg3Gln), from amino-acid fields like 3R>3Q."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alleles import _let

#: Three-letter codes of amino acids.
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter", "X": "Xaa", "U": "Sec"}
FIELD = r"^([0-9]+)([A-Z*]+)(?:>([0-9]+)([A-Z*]+))?$"


def three(letters: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    each = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: F.coalesce(F.try_element_at(codes, c), c)), "")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cut(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substring(s, start, F.length(s) if n is None else n)


def protein_name(field: Column, consequence: Column) -> Column:
    """Synonymous (=), substitution, stop, lost start (p.Met1?), lost stop (ext), frameshift with the first changed residue and the
    distance to the new stop, deletion and deletion-insertion; null where the field does not name a change."""
    pos = F.regexp_extract(field, FIELD, 1).try_cast("int")
    ref, alt = F.regexp_extract(field, FIELD, 2), F.regexp_extract(field, FIELD, 4)
    first = F.substring(ref, 1, 1)

    def frameshift(k: Column) -> Column:
        old = F.when(k < F.length(ref), _cut(ref, k + 1, F.lit(1))).otherwise("*")
        new = _cut(alt, k + 1, F.lit(1))
        stop = F.instr(_cut(alt, k + 1), "*")
        end = F.when(stop > 0, _text("Ter", stop)).otherwise("Ter?")
        return F.when(new == "*", _text("p.", three(old), pos + k, "Ter")).otherwise(_text("p.", three(old), pos + k, three(new), "fs", end))

    def inframe(k: Column) -> Column:
        r, a, at = _cut(ref, k + 1), _cut(alt, k + 1), pos + k
        last = lambda s: F.right(s, F.lit(1))
        span = F.concat(three(F.substring(r, 1, 1)), at.cast("string"), F.when(F.length(r) > 1, _text("_", three(last(r)), at + F.length(r) - 1)).otherwise(""))
        return (
            F.when(F.length(r) == 0, _text("p.", three(last(ref)), at - 1, "delins", three(F.concat(last(ref), a))))
            .when(F.length(a) == 0, _text("p.", span, "del"))
            .when(a == "*", _text("p.", three(F.substring(r, 1, 1)), at, "Ter"))
            .otherwise(_text("p.", span, "delins", three(a)))
        )

    single = (
        F.when((pos == 1) & (ref == "M"), "p.Met1?")
        .when(ref == "*", _text("p.Ter", pos, three(alt), "ext*?"))
        .otherwise(_text("p.", three(ref), pos, three(alt)))
    )
    shared = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(ref), F.length(alt))), lambda k: F.substring(ref, F.lit(1), k) == F.substring(alt, F.lit(1), k)))
    shift = F.coalesce(F.contains(consequence, F.lit("frameshift")), F.lit(False))
    return (
        F.when(field.isNull() | pos.isNull(), F.lit(None).cast("string"))
        .when((alt == "") | (ref == alt), _text("p.", three(first), pos, "="))
        .when(shift, _let(shared, frameshift))
        .when((F.length(ref) == 1) & (F.length(alt) == 1), single)
        .otherwise(_let(shared, inframe))
    )
