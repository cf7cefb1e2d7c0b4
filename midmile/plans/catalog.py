"""All registered queries: importing the modules fills the registry."""

from midmile.plans import evidence, feeds, figures, routes, stores, tables_and_columns  # noqa: F401
from midmile.plans.registry import ORACLES, QUERIES
from midmile.plans.views import Views

__all__ = ["ORACLES", "QUERIES", "Views"]
