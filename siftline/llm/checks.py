"""Queries over the llm operators whose rows SQL can tell too: exact parts of their results, and what must hold of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import copies, history, mixing, packing, places, privacy
from siftline.operators.skew import salted_join
from siftline.plans.core import s_host, s_identity, s_usable
from siftline.sources.tables import read

_HEAD = f"""WITH h AS (SELECT *, {s_host("cfp_url")} AS host, {s_identity("cfp_url")} AS norm FROM cfp_state), p AS (SELECT source, CAST(row_number() OVER (ORDER BY prio) AS INT) AS r FROM feed_sources),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY coalesce(user_actioned, false) DESC, coalesce(shown_in_brief, false) DESC, m DESC, r, slug) AS rn, count(*) OVER (PARTITION BY norm) AS n, count(*) FILTER (coalesce(user_actioned, false)) OVER (PARTITION BY norm) AS np
  FROM (SELECT h.*, EXISTS (SELECT 1 FROM feed_sources f WHERE f.source = h.source AND (h.host = f.host_suffix OR ends_with(h.host, '.' || f.host_suffix))) AS m, coalesce((SELECT min(p.r) FROM p WHERE p.source = h.source), 1000000) AS r FROM h WHERE norm IS NOT NULL)),
g AS (SELECT * FROM ranked WHERE n > 1 AND np <= 1)"""
_FIELD = " UNION ALL ".join(
    f"SELECT max(ord) FILTER (rn = 1) AS survivor_ord, '{f}' AS field_name, CASE WHEN bool_or({s_usable(f)}) FILTER (rn = 1) THEN max(ord) FILTER (rn = 1) WHEN NOT bool_or(coalesce(user_actioned, false)) FILTER (rn = 1) THEN min_by(ord, slug) FILTER ({s_usable(f)}) END AS donor_ord FROM g GROUP BY norm"
    for f in ("name", "city", "conf_date")
)
P2_FOUND = f"{_HEAD} SELECT * FROM ({_FIELD}) WHERE donor_ord IS NOT NULL"


def p4_equal(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose bytes an earlier line has: each is a copy of the same first line as that one."""
    w = read(spark, d, "state_export").select("line_id", F.struct("slug", "cfp_url", "record").alias("x"))
    firsts = w.groupBy("x").agg(F.min("line_id").alias("same_as"), F.count("*").alias("n")).where("n > 1")
    later = salted_join(w, firsts, ["x"], "n").where(F.col("line_id") != F.col("same_as")).select("line_id", "same_as")
    found = copies.p4_found(spark, d)
    got = later.join(found.select(F.col("copy_id").alias("line_id"), F.col("first_id").alias("f")), "line_id", "left").join(found.select(F.col("copy_id").alias("same_as"), F.col("first_id").alias("g")), "same_as", "left")
    return got.where(F.col("f") == F.coalesce("g", "same_as")).select("line_id", "same_as")


P4_EQUAL = "SELECT line_id, same_as FROM (SELECT line_id, min(line_id) OVER (PARTITION BY slug, cfp_url, record) AS same_as FROM state_export) WHERE line_id <> same_as"


def p5_exact(spark: SparkSession, d: str) -> DataFrame:
    """State rows whose city is, but for case, the one name of one entry."""
    cities = read(spark, d, "canonical_cities")
    one = cities.groupBy(F.lower("city").alias("k")).agg(F.count("*").alias("n")).where("n = 1")
    rows = read(spark, d, "cfp_state").select("ord", F.lower("city").alias("k"))
    return places.p5_found(spark, d).join(rows, "ord").join(F.broadcast(one), "k").select("ord", "city_id")  # a reference list, see places.MAX_ENTRIES


P5_EXACT = "SELECT s.ord, c.city_id FROM cfp_state s JOIN (SELECT lower(city) AS k, min(city_id) AS city_id FROM canonical_cities GROUP BY 1 HAVING count(*) = 1) c ON lower(s.city) = c.k"


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Every row is matched or reported, and none is both."""
    told = places.p5_unmatched(spark, d).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_twice"))
    found = places.p5_found(spark, d).agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("ord")).alias("n_twice"))
    return told.unionByName(found).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_twice").alias("n_twice"))


P5_REPORT = "SELECT count(*) AS n_rows, 0 AS n_twice FROM cfp_state"


def p6_order(spark: SparkSession, d: str) -> DataFrame:
    """Per batch that is not the first: arrivals, and finds that are no arrival of an earlier batch or are found twice."""
    rows = read(spark, d, "cfp_intake").select("arrival_id", "batch_no")
    found = history.p6_found(spark, d).join(rows, "arrival_id").join(rows.select(F.col("arrival_id").alias("earlier_id"), F.col("batch_no").alias("earlier")), "earlier_id", "left")
    wrong = found.groupBy("batch_no").agg((F.count_if(~F.coalesce((F.col("earlier") < F.col("batch_no")) & (F.col("earlier_id") < F.col("arrival_id")), F.lit(False))) + F.count("*") - F.count_distinct("arrival_id")).alias("n_wrong"))
    return rows.groupBy("batch_no").agg(F.count("*").alias("n_arrivals")).join(wrong, "batch_no", "left").select("batch_no", "n_arrivals", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))


P6_ORDER = "SELECT batch_no, count(*) AS n_arrivals, 0 AS n_wrong FROM cfp_intake GROUP BY batch_no"


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: texts packed, and packs too full, texts split that would fit, places taken twice and texts with a gap."""
    packs = packing.p7_packs(spark, d).join(F.broadcast(read(spark, d, "pack_sizes")), "pack_id")  # a fixed, tiny table
    full = packs.groupBy("pack_id", "pack_no", "capacity_tokens").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("position").alias("places"))
    full = full.groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"), F.sum(F.col("n") - F.col("places")).alias("n_shared_places"))
    texts = packs.groupBy("pack_id", "doc_id", "capacity_tokens").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("t"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"))
    texts = texts.groupBy("pack_id").agg(F.count("*").alias("n_texts"), F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_split_needlessly"), F.count_if(F.col("t") != F.col("end")).alias("n_gaps"))
    return texts.join(full, "pack_id")


P7_WHOLE = "SELECT pack_id, (SELECT count(*) FROM documents) AS n_texts, 0 AS n_split_needlessly, 0 AS n_gaps, 0 AS n_overfull, 0 AS n_shared_places FROM pack_sizes"


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per source: whether its tokens stay within the target and its texts within the repeats allowed, no text of it twice."""
    chosen, report = mixing.mixed(mixing._rows(spark, d), read(spark, d, "mix_targets"))
    texts = chosen.groupBy("source").agg((F.count("*") - F.count_distinct("row_id")).alias("n_twice"))
    return report.join(texts, "source", "left").select("source", (F.col("reached_tokens") <= F.col("target_tokens") + 1).alias("within_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"))


P8_LIMITS = "SELECT source, true AS within_target, true AS within_repeats, 0 AS n_twice FROM mix_targets"


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Texts, and spans that leave their text, are empty, or meet another one of it."""
    docs = read(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    spans = privacy.p9_found(spark, d)
    each = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("s"))  # the spans of one text
    meets = F.exists(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: F.coalesce(F.get("s", i)["span_start"] < F.get("s", i - 1)["span_end"], F.lit(False)))
    wrong = F.coalesce(meets | F.exists("s", lambda x: (x["span_start"] < 0) | (x["span_end"] > F.col("n")) | (x["span_start"] >= x["span_end"])), F.lit(False))
    return docs.join(each, "doc_id", "left").agg(F.count("*").alias("n_texts"), F.count_if(wrong).alias("n_wrong"))


P9_SPANS = "SELECT count(*) AS n_texts, 0 AS n_wrong FROM documents"

QUERIES = {"p4_equal": p4_equal, "p5_exact": p5_exact, "p5_report": p5_report, "p6_order": p6_order, "p7_whole": p7_whole, "p8_limits": p8_limits, "p9_spans": p9_spans}
SQL = {"p2_found": P2_FOUND, "p4_equal": P4_EQUAL, "p5_exact": P5_EXACT, "p5_report": P5_REPORT, "p6_order": P6_ORDER, "p7_whole": P7_WHOLE, "p8_limits": P8_LIMITS, "p9_spans": P9_SPANS}
