"""All registered queries."""

from reachworks.plans import (  # noqa: F401
    queries_frames, queries_joins, queries_models, queries_space, queries_survey)
from reachworks.plans.registry import ORACLE, QUERIES  # noqa: F401
