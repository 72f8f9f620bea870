"""Every query of the llm operators.  SQL tells p2_found, and of the others exact parts and what must hold of the whole; brute force tells the rest in tests."""

from __future__ import annotations

from siftline.llm import checks, copies, history, matching, mixing, packing, places, privacy, survivors

QUERIES = {**matching.QUERIES, **survivors.QUERIES, **copies.QUERIES, **places.QUERIES, **history.QUERIES, **packing.QUERIES, **mixing.QUERIES, **privacy.QUERIES, **checks.QUERIES}
SQL: dict[str, str] = {**checks.SQL}
