"""The corpus pipeline as the driver calls it: ``STAGES``, ``ORACLE_SQL`` and ``run``; the stages lie in the corpus subpackage."""

from __future__ import annotations

from cadenza.llm.common import stored, table
from cadenza.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run", "stored", "table"]
