"""Named queries over the driver's tables, each with the SQL it is checked against where SQL can say it."""

from tallyfield.registry.core import ORACLES, QUERIES
from tallyfield.registry import aggregates, cleaning, composites, joins, strings, windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
