"""Registered queries over the given tables; importing the modules fills the registry."""

from . import changes, checks, copies, findings, fitting, genotype, genotypes, grading, highlights, ingest, ingest_more, intervals, knowledge, lineage, matching, panel, positions, recount, rules, scores, variants  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
