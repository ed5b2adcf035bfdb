"""The registered queries and their SQL."""

from . import benchmarks, curated, evaluation, labelling, ordered, quotas, relational, search
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "benchmarks", "curated", "evaluation", "labelling", "ordered", "quotas", "relational", "search"]
