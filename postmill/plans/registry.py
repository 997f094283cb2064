"""Registered queries of the reference operators, by name."""

from postmill.plans import base, classify, coverage, declared, ecosystem, people, positions, publish, scalars, streams, tables  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
