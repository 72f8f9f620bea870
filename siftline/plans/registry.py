"""Every query of the core, and the SQL that must give the same rows."""

from __future__ import annotations

from siftline.plans import core, instants, records

QUERIES = {**core.QUERIES, **records.QUERIES, **instants.QUERIES}
SQL: dict[str, str] = {**core.SQL, **records.SQL, **instants.SQL}
FLAGSHIP = core.cfp_pipeline
