"""Model-name routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.fixed_values import MODEL_ROUTE_OTHER, MODEL_ROUTES


def model_route(x) -> Column:
    """``claude*`` / ``ollama:*`` / ``gpt-*`` / otherwise unsupported, first match wins."""
    c = F.col(x) if isinstance(x, str) else x
    expr = None
    for prefix, route in MODEL_ROUTES:
        cond = F.startswith(c, F.lit(prefix))
        expr = F.when(cond, F.lit(route)) if expr is None else expr.when(cond, F.lit(route))
    return expr.otherwise(F.lit(MODEL_ROUTE_OTHER))
