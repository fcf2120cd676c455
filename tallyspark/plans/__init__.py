"""Driver-table bindings and the registry of named queries."""

from .registry import REGISTRY, Query, present  # noqa: F401


def load_all() -> dict:
    """Import every query module so the registry is complete."""
    from . import checks, folders, large, scalars, shares, statistics  # noqa: F401
    return REGISTRY
