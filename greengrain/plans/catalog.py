"""All registered queries."""

from greengrain.plans import (assortment_plan, auditing, category_plan, fitting, profiling,  # noqa: F401
                               relation_levels, relationships, tables_and_checks)
from greengrain.plans.registry import QUERIES  # noqa: F401
