"""The registered queries: each runs an operator over the given tables.

Where a second engine can say the same thing in SQL, the SQL stands beside the query.
"""

from __future__ import annotations

from lamplight.workload.register import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
