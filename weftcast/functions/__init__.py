"""Column-level (scalar) functions: all built-in expressions, no Python UDFs."""

from .scalar import (  # noqa: F401
    expm1_clip,
    finite_or_null,
    harmonic,
    log1p_target,
    r6,
    rint_long,
    seasonality_columns,
)
