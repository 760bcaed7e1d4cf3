"""Every registered query."""

from cohortlake.plans import (  # noqa: F401 - imported for registration
    cohort_queries,
    curated_queries,
    evaluation_queries,
    model_queries,
    privacy_queries,
    projection_queries,
    quality_queries,
    source_queries,
)
from cohortlake.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
