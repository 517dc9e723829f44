"""All registered queries: importing the modules fills the registry."""

from cohortflow.plans import queries_longitudinal, queries_models, queries_tables  # noqa: F401
from cohortflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
