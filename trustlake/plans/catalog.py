"""Every registered query and its SQL, by name."""

from __future__ import annotations

from trustlake.plans import q_access, q_contracts, q_ingest, q_lineage, q_metadata, q_observe, q_quality, q_search, q_streaming  # noqa: F401
from trustlake.plans.registry import ORACLES, QUERIES  # noqa: F401
