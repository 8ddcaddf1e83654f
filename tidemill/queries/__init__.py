"""The library's own operators as queries over the driver's tables."""

from __future__ import annotations

from tidemill.queries import arrays, details, kernels, lifecycle, relational, text
from tidemill.queries._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "arrays", "details", "kernels", "lifecycle", "relational", "text"]
