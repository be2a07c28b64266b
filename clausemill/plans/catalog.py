"""All queries over the reference tables."""

from . import evaluation_queries, finance_queries, invariant_queries, provenance_queries, recompute_queries, retrieval_queries, review_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
