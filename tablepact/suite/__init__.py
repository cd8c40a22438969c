"""Queries over the test tables, one or more per operator, with equivalent SQL."""

from tablepact.suite import casts, checks, csvs, fingerprints, reads, refusals, runs, tables
from tablepact.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "casts", "checks", "csvs", "fingerprints", "reads", "refusals", "runs", "tables"]
