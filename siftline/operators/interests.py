"""Records against a list of interests: keywords in their text, hints in their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import haystack, keyword_hit

#: An interest list is a config table; a longer one is refused, not cut.
MAX_INTERESTS = 1_000


def matched(records: DataFrame, row_id: str, name: str, notes: str, source: str, interests: list[dict]) -> DataFrame:
    """(row_id, interests): ids of the interests each record meets, in config order, each once; an empty list for none.

    An interest has `id`, `keywords` and `sources`.  Keywords are looked for in
    name and notes, source hints in the stated source only.  The list becomes
    one expression per interest, so there is no join at all.
    """
    if len(interests) > MAX_INTERESTS:
        raise ValueError("more interests than a config table may hold")
    text = haystack(F.col(name), F.col(notes))
    rows = records.select(F.col(row_id), text.alias("__t"), F.lower(F.coalesce(F.col(source), F.lit(""))).alias("__s"))
    hits = []
    for i in interests:
        hit = F.lit(False)
        for k in i.get("keywords") or []:
            hit |= F.coalesce(keyword_hit(F.lit(k), F.col("__t")), F.lit(False))
        for s in i.get("sources") or []:
            hit |= F.contains("__s", F.lit(s.lower())) if s else F.lit(False)
        hits.append((i["id"], hit))
    ids = list(dict.fromkeys(i for i, _ in hits))
    parts = []
    for one in ids:
        any_hit = F.lit(False)
        for i, h in hits:
            if i == one:
                any_hit |= h
        parts.append(F.when(any_hit, F.lit(one)))
    made = F.array_compact(F.array(*parts)) if parts else F.expr("cast(array() as array<string>)")
    return rows.select(row_id, made.alias("interests"))
