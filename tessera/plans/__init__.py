"""All registered queries."""

from tessera.plans import documents, evaluation, inference, pii, postings, relational, retrieval, scalar, scans, sqlsurface, streaming  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
