"""Predicates of the variant explorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A


def variant_search(v: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, vtype: str | None = None, zygosity: str | None = None, filter: str | None = None, min_gq: int | None = None, gene: str | None = None) -> DataFrame:
    """Rows that meet all the conditions given; conditions on stored columns reach the scan."""
    if chrom is not None:
        v = v.filter(F.col("chrom_order") == (A.CHROMS.index(chrom) if chrom in A.CHROMS else 99))
    if start is not None:
        v = v.filter(F.col("pos") >= start)
    if end is not None:
        v = v.filter(F.col("pos") <= end)
    if filter is not None:
        v = v.filter(F.col("filter") == filter)
    if min_gq is not None:
        v = v.filter(F.col("gq") >= min_gq)
    if gene is not None:
        v = v.filter(F.col("gene") == gene)
    if vtype is not None:
        v = v.filter(A.vtype(F.col("ref"), F.col("alt")) == vtype)
    if zygosity is not None:
        v = v.filter(A.zygosity(F.col("gt")) == zygosity)
    return v
