"""Registered queries: domain views over the given tables, operators on them, and the SQL each must equal."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module so that its queries are registered."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
