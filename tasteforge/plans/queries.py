"""All registered queries."""

from tasteforge.plans import queries_eda, queries_models, queries_prep, queries_sampling, queries_xlog  # noqa: F401
from tasteforge.plans.registry import ORACLES, QUERIES  # noqa: F401
