"""Every query of the library over the given tables, with the SQL that defines it."""

from __future__ import annotations

from partita.plans import assembly, audit, dataset, details, detection, harmony, inputs  # noqa: F401
from partita.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
